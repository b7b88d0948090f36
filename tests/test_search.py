"""The composed search, blocks of vectors, running totals and segments, against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import chunkers as C
from fathomline.functions import code as K
from fathomline.operators import analytics as A
from fathomline.operators import clusters, ordered, payload, vector_index
from fathomline.operators import ranking as M
from fathomline.operators import retrieval as R
from fathomline.operators.components import connected_components
from fathomline.plans import search
from fathomline.streaming import ingest as I

NOW = dt.datetime(2026, 7, 10, 12)

TEXTS = {
    "people/ann": ("Ann Lee", "Ann works at Acme and writes about compilers."),
    "people/bob": ("Bob Ray", "Bob works at Acme. He plays chess."),
    "people/cas": ("Cas Orr", "Cas sails and cooks."),
    "companies/acme": ("Acme", "Acme builds engines for boats and compilers for all."),
    "companies/zeta": ("Zeta", "Zeta builds nothing."),
    "test/hidden": ("Acme test", "Acme Acme Acme."),
    "notes/a": ("Compilers", "A note on compilers that Ann wrote, on engines and boats."),
}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "main", slug, title, text, "person" if slug.startswith("people") else "other", None, dt.datetime(2026, 7, 1), None, None) for i, (slug, (title, text)) in enumerate(TEXTS.items())]
    pages = spark.createDataFrame(rows, "page_id long, source_id string, slug string, title string, compiled_truth string, type string, effective_date timestamp, updated_at timestamp, created_at timestamp, deleted_at timestamp").cache()
    links = spark.createDataFrame([("people/ann", "companies/acme", "works_at", "markdown"), ("people/bob", "companies/acme", "works_at", "markdown"), ("people/cas", "companies/zeta", "works_at", "markdown")], "src string, dst string, link_type string, link_source string")
    aliases = spark.createDataFrame([("the boat people", "main", "companies/acme")], "alias_norm string, source_id string, slug string")
    return search.Corpus(pages, links=links, aliases=aliases)


def slugs(df):
    return [r["slug"] for r in df.collect()]


def test_relation_question_finds_what_words_do_not(corpus):
    asked = search.run_search(search.compile_search("Who works at Acme?", NOW), corpus)
    assert set(slugs(asked)) == {"people/ann", "people/bob"}
    assert slugs(search.run_search(search.compile_search("Who works at Zeta?", NOW), corpus)) == ["people/cas"]
    without = search.Corpus(corpus.pages)
    assert slugs(search.run_search(search.compile_search("Who works at Zeta?", NOW), without)) == []


def test_questions_about_two_seeds(corpus, spark):
    for question in ("What connects Acme and Zeta?", "how are Acme and the Zeta connected?", "what is the link between acme and zeta"):
        assert search.compile_search(question, NOW).connection is not None
    more = corpus.links.unionByName(spark.createDataFrame([("people/bob", "companies/zeta", "advises", "markdown")], corpus.links.schema))
    linked = search.Corpus(corpus.pages, links=more, aliases=corpus.aliases)
    assert slugs(search.run_search(search.compile_search("what connects the boat people and zeta", NOW), linked)) == ["people/bob"]
    assert slugs(search.run_search(search.compile_search("what connects the boat people and zeta", NOW), corpus)) == []


def test_outgoing_and_other_relation_questions(corpus):
    ask = lambda q: set(slugs(search.run_search(search.compile_search(q, NOW), corpus)))
    assert ask("Where does Ann Lee work?") == {"companies/acme", "people/bob"} or ask("Where does Ann Lee work?") == {"companies/acme"}
    assert ask("who at Acme works on engines") >= {"people/ann", "people/bob"}
    assert search.relation_of("who introduced me to Bob Ray") == ("Bob Ray", None, "both")
    assert search.relation_of("what did Cas Orr invest in") == ("Cas Orr", "invested_in", "out")
    assert search.relation_of("who advises Zeta") == ("Zeta", "advises", "in")


def test_alias_brings_its_page_to_the_top(corpus):
    got = search.run_search(search.compile_search("the boat people", NOW), corpus).collect()
    assert [(r["slug"], r["evidence"], r["safety"]) for r in got] == [("companies/acme", "alias_hit", "exists")]


def test_excluded_pages_stay_out_and_exact_titles_gain(corpus):
    got = slugs(search.run_search(search.compile_search("acme", NOW), corpus))
    assert got[0] == "companies/acme" and "test/hidden" not in got


def test_postings_and_scan_agree(corpus):
    postings = R.inverted_index(corpus.pages, ["page_id"], {"A": F.col("title"), "B": F.col("compiled_truth")})
    indexed = search.Corpus(corpus.pages, links=corpus.links, aliases=corpus.aliases, postings=postings)
    for question in ("compilers", 'engines "for boats" or "and boats"', "acme -engines", "ann compilers"):
        plan = search.compile_search(question, NOW)
        scan, index = ([(r["slug"], round(r["score"], 9)) for r in search.run_search(plan, c).collect()] for c in (corpus, indexed))
        assert scan == index and scan


def test_failing_reranker_leaves_the_ranking(corpus):
    plan = search.compile_search("compilers", NOW)
    assert slugs(search.run_search(plan, corpus, rerank=lambda t: 1 / 0)) == slugs(search.run_search(plan, corpus))
    first = slugs(search.run_search(plan, corpus, rerank=lambda t: 1.0 if "note" in t else 0.99))
    assert first[0] == "notes/a"


def test_verbs_of_unknown_types_are_an_error():
    assert search.relation_of("Who trades with the 'Acme'?", search.verb_relations({"trades with": ("trades", "both")}, {"trades"})) == ("Acme", "trades", "both")
    with pytest.raises(ValueError):
        search.verb_relations({"trades with": ("trades", "both")}, {"works_at"})


@pytest.mark.parametrize("block", [3, 1024])
@pytest.mark.parametrize("earlier", [False, True])
def test_block_matches(spark, block, earlier):
    rng = np.random.default_rng(4)
    rows = [(int(i % 2 if i > 20 else 0), i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(40)]
    rows[5] = (0, 5, [0.0] * 4)
    rows.append((1, 99, None))
    df = spark.createDataFrame(rows, "bucket int, id long, vector array<double>")
    got = sorted((r["bucket"], r["id"], r["other"], round(r["sim"], 9)) for r in R.block_matches(df, df, 2, earlier, block).collect())
    want = []
    usable = [(b, i, np.array(v)) for b, i, v in rows if v and any(v)]
    for b, i, v in usable:
        near = [(-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for c, j, w in usable if c == b and j != i and (j < i or not earlier)]
        want += [(b, i, j, -s) for s, j in sorted(near)[:2]]
    assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in sorted(want)] or got == sorted(want)
    assert len(got) == len(want)


@pytest.mark.parametrize("clustered", [True, False])
def test_index_reaches_its_recall(spark, tmp_path, clustered):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(24, 18))
    made = [(i, (clustered * 3 * centres[i % 24] + rng.normal(size=18)).tolist()) for i in range(2000)]
    rows = spark.createDataFrame([*made, (5000, None), (5001, []), (5002, [0.0] * 18)], "id long, vector array<double>")
    queries = rows.filter("id % 100 = 0")
    index = vector_index.build(rows, str(tmp_path / "index"))
    again = vector_index.read(spark, index.path)
    assert (again.probed, again.short, again.rows) == (index.probed, index.short, 2000)
    exact = {(r["id"], r["other"]): r["sim"] for r in R.block_matches(queries.withColumn("bucket", F.lit(0)), rows.withColumn("bucket", F.lit(0)), 10).collect()}
    found = {(r["id"], r["other"]): r["sim"] for r in vector_index.search(queries, again, 10).collect()}
    assert len(exact) == 200 and len(exact.keys() & found.keys()) >= 180
    assert all(abs(found[x] - exact[x]) < 1e-9 for x in exact.keys() & found.keys())
    assert index.short <= 400 and len(index.lists) >= 30
    if clustered:  # a search looks into few lists, and few folders are read for it
        assert index.probed <= len(index.lists) // 4
        one = vector_index.rows_of(spark, index, index.looked_into(vector_index.unit(np.array([made[0][1]])))[0])
        assert one.count() < 700 and "PartitionFilters: [folder" in one._jdf.queryExecution().toString().replace("isnotnull(folder), ", "")
    one = [(r["id"], round(r["score"], 6)) for r in vector_index.nearest(spark, again, made[100][1], 5).collect()]
    assert one[0] == (100, 1.0) and len({i for i, _ in one[1:]} & {o for q, o in exact if q == 100}) >= 3


def test_empty_index(spark, tmp_path):
    rows = spark.createDataFrame([(1, None)], "id long, vector array<double>")
    index = vector_index.build(rows, str(tmp_path / "none"))
    assert vector_index.search(rows, index, 3).count() == 0 and vector_index.nearest(spark, index, [1.0, 0.0], 3).count() == 0


def greedy(rows, least):
    """Leader clusters, one row after another, newest first."""
    heads, out = {}, {}
    for b, i, v in sorted(rows, key=lambda r: -r[1]):
        v = np.array(v or [0.0] * 3)
        near = [h for h, w in heads.get(b, []) if np.linalg.norm(v) and np.linalg.norm(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= least]
        out[b, i] = near[0] if near else i
        if not near:
            heads.setdefault(b, []).append((i, v))
    return out


def test_leader_clusters_are_the_sequential_ones(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(0 if i % 3 else i % 7, i, rng.integers(-4, 5, 3).astype(float).tolist()) for i in range(300)] + [(0, 900, None), (0, 901, [0.0] * 3), (9, 1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "bucket int, id long, vector array<double>").repartition(4)
    monkeypatch.setattr(R.block_first, "__defaults__", (32,))  # a bucket is dealt over many tasks
    for least in (0.5, 0.9):
        got = {(r["bucket"], r["id"]): r["head"] for r in clusters.leader_clusters(df, least).collect()}
        assert got == greedy(rows, least)
        assert len(set(got.values())) > 10
    assert clusters.leader_clusters(df.limit(0), 0.5).count() == 0


@pytest.mark.parametrize("span", [16, 4096])
def test_boundaries_are_those_of_the_whole_sequence(spark, span):
    rng = np.random.default_rng(3)
    rows = [(g, int(i), (rng.normal(size=4) + [3 * (i // 9 % 2), 0, 0, 0]).tolist()) for g, n in (("a", 500), ("b", 120), ("c", 2), ("d", 3), ("e", 1)) for i in rng.permutation(n)]
    df = spark.createDataFrame(rows, "g string, at long, v array<double>").repartition(3)
    got, parts = {}, {}
    for r in clusters.semantic_boundaries(df, ["g"], "at", "v", span=span).collect():
        got.setdefault(r["g"], set()).add(r["boundary"])
    for r in clusters.semantic_parts(df, ["g"], "at", "v", span=span).collect():
        parts[r["g"], r["at"]] = r["part"]
    for g in "abcde":
        own = sorted((i, v) for h, i, v in rows if h == g)
        cuts = C.semantic_boundaries(np.array([v for _, v in own]))
        assert got.get(g, set()) == set(cuts)
        assert [parts[g, i] for i, _ in own] == np.searchsorted(cuts, np.arange(len(own)), side="right").tolist()
    assert len(got["a"]) > 15


def test_search_by_the_kept_index_is_the_exact_one(spark, corpus, tmp_path):
    rng = np.random.default_rng(2)
    chunks = spark.createDataFrame([(i // 3, i, rng.normal(size=8).tolist()) for i in range(3 * len(TEXTS))], "page_id long, chunk_id long, embedding array<double>").cache()
    index = vector_index.build(chunks.select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector")), str(tmp_path / "v"))
    plan = search.compile_search("compilers", NOW, embed=lambda q: rng.normal(size=8).tolist())
    exact, kept = ([(r["slug"], round(r["score"], 9)) for r in search.run_search(plan, c).collect()] for c in (search.Corpus(corpus.pages, chunks=chunks), search.Corpus(corpus.pages, chunks=chunks, vectors=index)))
    assert exact == kept and len(exact) > 3


def test_running_totals(spark):
    random.seed(3)
    rows = [(random.choice("ab"), random.randrange(50), i, random.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, at long, id long, v long")
    got = {r["id"]: r["total"] for r in ordered.running_total(df, F.col("v"), "at", ["id"], ["g"]).collect()}
    for g, at, i, _ in rows:
        assert got[i] == sum(v for h, t, j, v in rows if h == g and (t, j) <= (at, i))
    numbers = sorted(r["n"] for r in ordered.row_number(df, "at", ["id"]).collect())
    assert numbers == list(range(1, 401))
    assert ordered.row_number(df.limit(0), "at").count() == 0


def test_score_distribution_is_nearest_rank(spark):
    values = [random.Random(5).randrange(40) / 7 for _ in range(233)]
    got = M.score_distribution(spark.createDataFrame([(v,) for v in values], "score double")).first()
    x = sorted(values)
    assert got["n"] == 233 and [got[f"p{q}"] for q in (25, 50, 75, 90, 95)] == [x[int((len(x) - 1) * q / 100 + 0.5)] for q in (25, 50, 75, 90, 95)]


@pytest.mark.parametrize("kind,options", [("dedup", {"ttl": 500.0}), ("rate", {"limit": 2, "seconds": 700.0}), ("throttle", {"seconds": 900.0})])
def test_segments_change_nothing(spark, kind, options):
    random.seed(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, random.choice(["a", "b", None]), start + dt.timedelta(seconds=random.randrange(0, 40_000, 50))) for i in range(500)] + [(900, "a", None)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp")
    got = sorted(r["event_id"] for r in I.stateful_batch(df, ["key"], kind, **options).collect())
    step, pack = I.STEPS[kind]
    want = []
    for k in ("a", "b", None):
        state = []
        for i, _, t in sorted((x for x in rows if x[1] == k and x[2]), key=lambda x: (x[2], x[0])):
            new, ok = step(state, (t - start).total_seconds(), **options)
            state = pack(new)
            want += [i] * ok
    assert got == sorted(want) and 0 < len(want) < 500


def test_components_of_a_hub_and_of_binary_nodes(spark):
    edges = [(b"\x05", bytes([i])) for i in range(6, 200)] + [(b"\x01", b"\x05"), (b"\xf0", b"\xf1")]
    got = {bytes(r["node"]): bytes(r["component"]) for r in connected_components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert got == {bytes([i]): b"\x01" for i in [1, 5, *range(6, 200)]} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


def test_chunks_of_chinese_text_are_counted_in_characters():
    text = "这是一个没有空格的句子，它有一些字。" * 60
    found = C.chunk_text(text, 100, 0)
    assert len(found) > 8 and all(len(x) <= 160 for x in found)
    assert "".join("".join(found).split()) == text
    assert len(C.chunk_text("a few plain words. " * 100 + "句子", 300, 0)) == 1  # 401 words, within one and a half times the target


def test_code_in_strings_and_comments_is_no_code():
    source = "/* class No { */\nconst s = `function no() { ${f(1)} }`;\nfunction yes(a) {\n  return '}' + g(a); // h(a)\n}\nconst arrow = async (x) => { await yes(x); };\n"
    assert [(x["symbol"], x["start_line"], x["end_line"]) for x in K.code_chunks(source, "javascript")] == [("yes", 3, 5), ("arrow", 6, 6)]
    assert K.code_edges(source, "javascript") == [("yes", "g", "calls"), ("arrow", "yes", "calls")]
    for language in [*K.LANGUAGES, "python", "text"]:
        for odd in ("", "{", "}}}", "class", "func (", "'", "`", "/*", "impl X {", "x = y("):
            assert K.code_chunks(odd, language) and isinstance(K.code_edges(odd, language), list)
    assert K.language_of("a/b.TSX") == "typescript" and K.language_of("README") is None


def test_resample_weights_are_poisson():
    w = A.resample_weights(np.arange(2000), 50, 3)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.04 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.08
    assert abs(np.corrcoef(w[:-1, 0], w[1:, 0])[0, 1]) < 0.08 and (w == A.resample_weights(np.arange(2000), 50, 3)).all()


def test_payload_clusters_fit(spark):
    rng = np.random.default_rng(5)
    centres = 4 * rng.normal(size=(6, 8))
    rows = [("a" if i % 4 else "b", i, int(rng.integers(1, 60)), (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(600)]
    rows += [("a", 900, 500, centres[0].tolist()), ("a", 901, 80, None), ("b", 902, 0, [0.0] * 8)]
    df = spark.createDataFrame(rows, "bucket string, id long, tokens long, vector array<double>").repartition(4)
    members = payload.clusters(df, 100).cache()
    got = members.collect()
    assert sorted(r["id"] for r in got) == sorted(r[1] for r in rows)
    totals, kinds = {}, {}
    for r in got:
        key = r["bucket"], r["cluster"]
        totals[key] = totals.get(key, 0) + r["tokens"]
        kinds.setdefault(key, []).append(r["id"] % 6)
    assert {k: v for k, v in totals.items() if v > 100} == {("a", "x900"): 500}
    assert sum(totals.values()) / len(totals) > 40
    pure = [max(np.bincount(k)) / len(k) for k in kinds.values() if len(k) > 1]
    assert np.mean(pure) > 0.85  # like vectors are together
    texts = df.selectExpr("id", "CASE WHEN id = 900 THEN null ELSE concat('text ', id) END AS text")
    whole = payload.summed_up(members, texts, lambda t: str(len(t)), 100).collect()
    assert sum(int(r["summary"]) for r in whole) == len(rows) and [r["cluster"] for r in whole if r["over"]] == ["x900"]

    def fussy(t):
        return 1 / 0 if "text 7" in t else "fine"

    run = payload.outcome(payload.summed_up(members, texts, fussy, 100)).first()
    assert run["dropped"] == 1 and not run["degraded"] and run["clusters"] == len(totals)
    assert payload.outcome(payload.summed_up(members.limit(0), texts, fussy, 100)).first()["success_ratio"] == 1.0
    assert payload.clusters(df.limit(0), 100).count() == 0
