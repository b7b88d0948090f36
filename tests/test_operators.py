"""Hand-checked cases of the engine's operators."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.functions import chunkers as C
from fathomline.functions import text as T
from fathomline.functions import vector as V
from fathomline.operators import analytics as A
from fathomline.operators import graph as G
from fathomline.operators import ontology
from fathomline.operators import ranking as M
from fathomline.operators import retrieval as R
from fathomline.operators import scope, writes
from fathomline.operators.components import connected_components
from fathomline.plans import search
from fathomline.sources import documents as D

NOW = dt.datetime(2026, 7, 10, 12)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


# --- scope -----------------------------------------------------------------------------------------------------------


def test_longest_prefix_wins(spark):
    df = spark.createDataFrame([("media/x/1",), ("media/y",), ("originals/a",), ("zzz",)], "slug string")
    got = dict(rows(df.select("slug", scope.prefix_case(F.col("slug"), {"media/": 2.0, "media/x/": 0.7, "originals/": 1.5}).alias("f"))))
    assert got == {"media/x/1": 0.7, "media/y": 2.0, "originals/a": 1.5, "zzz": 1.0}


@pytest.mark.parametrize("n,want", [(None, 20), (0, 20), (-3, 20), (0.5, 20), (7.9, 7), (1000, 100), (float("nan"), 20)])
def test_limit_is_clamped(n, want):
    assert scope.clamp_limit(n) == want


def test_date_bounds():
    assert scope.parse_bound("7d", NOW) == NOW - dt.timedelta(days=7)
    assert scope.parse_bound("1y", NOW) == NOW - dt.timedelta(days=365)
    assert scope.parse_bound("2026-07-09", NOW, upper=True) == dt.datetime(2026, 7, 9, 23, 59, 59, 999999)
    assert scope.parse_bound("2026-07-09T01:00:00.000001Z", NOW) == dt.datetime(2026, 7, 9, 1, 0, 0, 1)
    with pytest.raises(ValueError):
        scope.date_window("2026-07-09", "2026-07-01", NOW)


def test_window_keeps_microseconds(spark):
    at = [dt.datetime(2026, 7, 8, 23, 59, 59, 999999), dt.datetime(2026, 7, 9), dt.datetime(2026, 7, 9, 12), dt.datetime(2026, 7, 9, 23, 59, 59, 999999), dt.datetime(2026, 7, 10)]
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(at)], "i int, effective_date timestamp, updated_at timestamp, created_at timestamp")
    a, b = scope.date_window("2026-07-09", "2026-07-09", NOW)
    assert rows(scope.in_window(df, a, b), "i") == [(1,), (2,), (3,)]
    assert rows(scope.in_window(df, after=at[1], before=at[3]), "i") == [(2,)]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20))
def test_escaped_like_means_the_text(text):
    import re

    pattern = scope.like_escaped(text)
    assert re.sub(r"\\([\\%_])", r"\1", pattern) == text


# --- writes ----------------------------------------------------------------------------------------------------------


def test_upsert_keeps_first_writes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, v string, via string")
    new = spark.createDataFrame([(2, "c", "y"), (1, None, "z"), (3, "d", "w")], "id int, v string, via string")
    assert sorted(writes.upsert(old, new, ["id"], ["via"]).collect()) == [(1, None, "x"), (2, "c", "y"), (3, "d", "w")]


def test_insert_ignore_takes_null_as_equal(spark):
    old = spark.createDataFrame([("a", None)], "k string, s string")
    new = spark.createDataFrame([("a", None), ("a", "m"), ("a", "m")], "k string, s string")
    assert rows(writes.insert_ignore(old, new, ["k", "s"])) == [("a", "m")]


def test_manifest_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("e", "3"), ("f", "7")], "path string, hash string")
    got = {(r["change"], r["path"], r["old_path"]) for r in writes.manifest_diff(old, new).collect()}
    assert got == {("modified", "b", None), ("renamed", "e", "c"), ("added", "f", None), ("deleted", "d", None)}


# --- retrieval -------------------------------------------------------------------------------------------------------


def test_query_syntax():
    q = R.parse_query('alpha "two words" -gone beta or gamma')
    assert q.groups == [["alpha"], ["two words"], ["beta", "gamma"]] and q.excluded == ["gone"]


def test_keyword_search(spark):
    df = spark.createDataFrame([(1, "red fox", "a quick red fox"), (2, "", "red then fox"), (3, "", "red fox gone"), (4, "", "fox")], "id int, title string, body string")
    got = {r["id"]: r["score"] for r in R.keyword_scores(df, '"red fox" -gone', ["id"], {"A": F.col("title"), "B": F.col("body")}).collect()}
    assert got == {1: pytest.approx(2 * 0.5 + 2 * 0.4 * 0.5)}


def test_max_pool_before_the_limit(spark):
    unit = lambda c: [c, math.sqrt(1 - c * c)]
    chunks = [(1, 1, unit(0.99)), (2, 1, unit(0.98)), (3, 1, unit(0.97)), (4, 2, unit(0.95)), (5, 3, unit(0.90)), (6, 4, unit(0.90))]
    df = spark.createDataFrame(chunks, "chunk_id int, page_id int, embedding array<double>")
    assert [r["page_id"] for r in R.vector_search(df, [1.0, 0.0], 3).collect()] == [1, 2, 3]


def test_cosine_of_odd_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, pytest.approx(1.0)]


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([("x", 9.0), ("y", 5.0)], "k string, score double")
    b = spark.createDataFrame([("y", 2.0), ("z", 1.0)], "k string, score double")
    got = {r["k"]: r["score"] for r in R.rrf([(a, 1.0), (b, 2.0)], ["k"], boosted=F.col("k") == "z").collect()}
    y = 1 / 61 + 1 / 30
    assert got == {"x": pytest.approx(1 / 60 / y), "y": pytest.approx(1.0), "z": pytest.approx(2 * (1 / 31) / y)}
    assert R.effective_k(60, 0) == 60 and R.effective_k(60, 2) == 30


def test_rerank_fails_open(spark):
    df = spark.createDataFrame([(i, f"t{i}", 10.0 - i) for i in range(6)], "id int, text string, score double")
    order = [F.desc("score")]
    assert [r["id"] for r in R.rerank(df, lambda t: float(t[1:]), 3, 5, order).collect()] == [2, 1, 0, 3, 4]
    assert [r["id"] for r in R.rerank(df, lambda t: 1 / 0, 3, 4, order).collect()] == [0, 1, 2, 3]


# --- ranking ---------------------------------------------------------------------------------------------------------


def test_floor_gates_boosts(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 0.5), ("c", 0.2)], "slug string, score double")
    got = dict(rows(M.boost(M.floor_threshold(df, 0.5), F.lit(2.0)), "slug", "score"))
    assert got == {"a": 2.0, "b": 1.0, "c": 0.2}
    assert M.floor_threshold(df, 1.5).filter("floor is not null").count() == 0


def test_autocut_keeps_ties_and_aliases(spark):
    data = [("a", 0.9, False), ("b", 0.9, False), ("c", 0.3, False), ("d", None, True), ("e", None, False)]
    df = spark.createDataFrame(data, "slug string, rerank_score double, alias_hit boolean")
    assert rows(M.autocut(df), "slug") == [("a",), ("b",), ("d",)]
    flat = spark.createDataFrame([("a", 0.9, False), ("b", 0.8, False)], df.schema)
    assert M.autocut(flat).count() == 2


def test_text_dedup_is_greedy_in_rank_order(spark):
    a = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([("s", 1, a), ("s", 2, a + " x"), ("s", 3, "other words"), ("s", 4, a)], "source string, rank int, text string")
    assert rows(M.text_dedup(df, "source"), "rank") == [(1,), (3,)]


def test_token_budget_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([(1, "", "x" * 40), (2, "", "x" * 400), (3, "", "x" * 4)], "id int, title string, text string")
    assert rows(M.token_budget(df, 50, [F.asc("id")]), "id") == [(1,)]


def test_truth_guarantee_swaps_the_lowest(spark):
    pool = [(1, 1, 0.9, "timeline"), (1, 2, 0.8, "timeline"), (1, 3, 0.1, "compiled_truth"), (2, 4, 0.5, "timeline")]
    df = spark.createDataFrame(pool, "page_id int, chunk_id int, score double, chunk_source string")
    assert rows(M.truth_guarantee(df.filter("chunk_id in (1, 2, 4)"), df), "chunk_id") == [(1,), (3,), (4,)]


# --- graph -----------------------------------------------------------------------------------------------------------

EDGES = [("alice", "acme", "works_at", None), ("bob", "acme", "works_at", "mentions"), ("widget", "acme", "made_by", "markdown"), ("alice", "bob", "knows", "markdown")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, link_type string, link_source string")


def test_adjacency_counts(spark, edges):
    nodes = spark.createDataFrame([("alice", "a"), ("bob", "a"), ("acme", "a"), ("widget", "b")], "node string, source_id string")
    got = {r["node"]: (r["hits"], r["cross_hits"]) for r in G.adjacency(nodes, edges).collect()}
    assert got == {"acme": (3, 1), "bob": (1, 0)}


def test_backlinks_skip_mentions_but_not_nulls(spark, edges):
    nodes = spark.createDataFrame([("acme",), ("alice",)], "node string")
    assert rows(G.backlink_counts(nodes, edges)) == [("acme", 2), ("alice", 0)]


def test_paths_filter_types_and_direction(spark):
    e = spark.createDataFrame([("standup", p, "attended", "m") for p in ("a", "b", "c")] + [(p, "acme", "works_at", "m") for p in ("a", "b", "c")] + [("acme", "standup", "hosts", "m")], "src string, dst string, link_type string, link_source string")
    assert G.paths(e, "standup", 5).count() == 6
    assert rows(G.paths(e, "standup", 5, "attended"), "dst") == [("a",), ("b",), ("c",)]
    assert {r["dst"] for r in G.paths(e, "acme", 2, direction="in").collect()} == {"a", "b", "c", "standup"}


def test_fanout_paths(spark):
    kind = "src string, dst string, link_type string, link_source string"
    e = spark.createDataFrame([("i2", "co", "invested_in", "m"), ("i1", "co", "invested_in", "m"), ("gone", "co", "invested_in", "m"), ("w", "co", "works_at", "m"), ("x", "co", "mentions", "mentions"), ("i2", "far", "knows", "m"), ("w", "far", "knows", "m"), ("far", "end", "knows", "m")], kind)
    seed = spark.createDataFrame([("co",)], "node string")
    live = spark.createDataFrame([(n,) for n in ("co", "i1", "i2", "w", "x", "far", "end")], "node string")
    chunks = spark.createDataFrame([("i1", 2, 8), ("i1", 1, 9), ("far", 1, 4)], "node string, ordinal int, chunk_id long")
    got = {r["node"]: (r["hop"], r["edge_count"], r["types"], r["path"], r["chunk_id"]) for r in G.fanout_paths(e, seed, 3, live=live, chunks=chunks).collect()}
    assert got == {
        "i1": (1, 1, "invested_in", ["co", "i1"], 9), "i2": (1, 2, "invested_in,knows", ["co", "i2"], None), "w": (1, 2, "knows,works_at", ["co", "w"], None),
        "far": (2, 2, "knows", ["co", "i2", "far"], 4), "end": (3, 1, "knows", ["co", "i2", "far", "end"], None),
    }
    assert [r["node"] for r in G.fanout_paths(e, seed, 1, ["invested_in"], "in", most=2).orderBy("node").collect()] == ["gone", "i1"]
    assert "x" in [r["node"] for r in G.fanout_paths(e, seed, 1, mentions=True).collect()]
    assert G.fanout_paths(e, seed.limit(0)).count() == 0


def test_meeting_in_the_middle(spark):
    e = spark.createDataFrame([("a", "m1", "t", "m"), ("b", "m1", "t", "m"), ("a", "p", "t", "m"), ("p", "q", "t", "m"), ("q", "b", "t", "m"), ("a", "n", "t", "mentions"), ("n", "b", "t", "mentions")], "src string, dst string, link_type string, link_source string")
    seed = lambda s: spark.createDataFrame([(s,)], "node string")
    got = {r["node"]: (r["hop_a"], r["hop_b"], r["hops"]) for r in G.meeting(e, seed("a"), seed("b")).collect()}
    assert got == {"m1": (1, 1, 2), "p": (1, 2, 3), "q": (2, 1, 3)}
    assert {r["node"] for r in G.meeting(e, seed("a"), seed("b"), cap=1).collect()} == {"m1"}


def observed(spark, rows):
    kind = "id long, source_id string, entity string, dimension string, value string, source string, valid_from timestamp, arrived timestamp"
    at = lambda d: None if d is None else dt.datetime.fromisoformat(d)
    return spark.createDataFrame([(i, r[6] if len(r) > 6 else "default", *r[:4], at(r[4]), at(r[5])) for i, r in enumerate(rows)], kind).repartition(3)


def test_ontology_merge(spark):
    rows = [
        ("sarah", "job role", "founder", "m/a", "2024-01-01", "2026-06-01"),
        ("sarah", "role", "Founder ", "m/a", None, "2026-06-02"),
        ("sarah", "Job-Title", "founder", "m/b", None, "2026-06-03"),
        ("sarah", "role", "advisor", "m/b", "2026-05-01", "2026-06-04"),
        ("sarah", "vibe", "chaotic", "m/a", None, "2026-06-05"),
        ("bob", "role", "advisor", "m/a", "2026-05-01", "2026-06-01"),
        ("bob", "role", "founder", "m/b", "2026-01-01", "2026-06-02"),
        ("bob", "role", None, "m/c", "2026-05-15", "2026-06-03"),
        ("sarah", "role", "founder", "m/a", None, "2026-06-01", "other"),
    ]
    out = ontology.merged(observed(spark, rows))
    got = {r["id"]: (r["dimension"], r["action"], r["closed"], r["status"]) for r in out.collect()}
    assert [got[i] for i in range(9)] == [
        ("role", "inserted", [], "active"), ("role", "noop", [], "active"), ("role", "corroborated", [], "active"), ("role", "superseded_prior", [0], "active"),
        ("vibe", "inserted", [], "quarantined"), ("role", "inserted", [], "active"), ("role", "inserted", [], "active"), ("role", "superseded_prior", [5, 6], "active"), ("role", "inserted", [], "active"),
    ]
    past = ontology.history(out)
    held = lambda *a, **k: sorted((r["source_id"], r["entity"], r["value"]) for r in ontology.values_at(past, *a, **k).collect())
    assert held() == [("default", "bob", None), ("default", "sarah", "advisor"), ("other", "sarah", "founder")] or held() == sorted([("default", "bob", None), ("default", "sarah", "advisor"), ("other", "sarah", "founder")], key=str)
    assert ("default", "sarah", "founder") in held("2025-01-01 00:00:00")
    assert ("default", "sarah", "chaotic") in held(quarantined=True)
    assert ontology.conflicts(past).count() == 0
    two = ontology.conflicts(ontology.history(ontology.merged(observed(spark, rows[5:7])))).collect()
    assert [(r["entity"], r["dimension"], r["values"]) for r in two] == [("bob", "role", ["advisor", "founder"])]
    assert ontology.merged(observed(spark, rows).limit(0)).count() == 0


def test_fanout(spark):
    e = spark.createDataFrame([("i1", "co", "invested_in", "m"), ("i2", "co", "invested_in", "m"), ("w", "co", "works_at", "m"), ("x", "co", "mentions", "mentions")], "src string, dst string, link_type string, link_source string")
    seed = spark.createDataFrame([("co",)], "node string")
    assert rows(G.fanout(e, seed, 1, ["invested_in"]), "node") == [("i1",), ("i2",)]
    assert rows(G.fanout(e, seed, 1), "node") == [("i1",), ("i2",), ("w",)]
    assert G.fanout(e, seed, 1, mentions=True).count() == 4


def test_bfs_caps_each_hop(spark, edges):
    root = spark.createDataFrame([("acme",)], "node string")
    assert rows(G.bfs(edges, root, 1, "in", frontier_cap=2)) == [("acme", 0), ("alice", 1), ("bob", 1)]


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(i, 1) for i in range(2, 40)] + [(500, 500), (601, 600), (601, 600)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in range(1, 40)} == {1} and got[500] == 500 and got[601] == 600
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- analytics -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def takes(spark):
    data = [(0.9, "correct"), (0.6, "correct"), (0.7, "incorrect"), (0.4, "incorrect"), (0.5, "partial"), (0.3, None)]
    return spark.createDataFrame([("h", w, q) for w, q in data], "holder string, weight double, quality string")


def test_scorecard_by_hand(takes):
    r = A.scorecard(takes).first()
    assert (r["resolved"], r["correct"], r["incorrect"], r["partial"]) == (5, 2, 2, 1)
    assert r["brier"] == pytest.approx(0.205) and r["partial_rate"] == pytest.approx(0.2) and r["accuracy"] == 0.5
    none = A.scorecard(takes, holders=["other"]).first()
    assert none["total"] == 0 and none["accuracy"] is None and none["brier"] is None


def test_calibration_leaves_partial_out(takes):
    assert sum(r["n"] for r in A.calibration_curve(takes).collect()) == 4


def test_anomalies(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    flat = [("flat", d) for d in days for _ in range(2)] + [("flat", days[-1])] * 4
    noisy = [("noisy", d) for i, d in enumerate(days) for _ in range(1 + i % 3)]
    df = spark.createDataFrame(flat + noisy + [("new", days[-1])] * 3, "c string, day date")
    got = A.anomalies(A.daily_cohorts(df, "c", "day"), F.lit(days[-1]), 3.0).collect()
    assert [(r["cohort"], r["today"], r["sigma"]) for r in got] == [("flat", 6, 4.0), ("new", 3, 3.0)]


def test_retrieval_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", d, i + 1) for i, d in enumerate("abcde")], "query string, doc string, rank int")
    qrels = spark.createDataFrame([("q", "b", 2.0), ("q", "e", 1.0), ("q", "z", 3.0), ("r", "a", 1.0)], "query string, doc string, grade double")
    got = {r["query"]: r for r in A.retrieval_metrics(ranked, qrels, 3).collect()}
    dcg, ideal = 2 / math.log2(3), 3 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    assert got["q"]["p_at_k"] == pytest.approx(1 / 3) and got["q"]["r_at_k"] == pytest.approx(1 / 3) and got["q"]["mrr"] == 0.5 and got["q"]["ndcg"] == pytest.approx(dcg / ideal)
    assert got["r"]["mrr"] == 0.0 and got["r"]["ndcg"] == 0.0


def test_wilson_and_empty_lists(spark):
    lo, hi = spark.range(1).select(*A.wilson(F.lit(8), F.lit(10))).first()
    assert lo == pytest.approx(0.4901, abs=1e-3) and hi == pytest.approx(0.9433, abs=1e-3)
    assert spark.range(1).select(A.wilson(F.lit(0), F.lit(0))[0]).first()[0] is None
    empty = F.array().cast("array<string>")
    assert tuple(spark.range(1).select(*A.replay_stability(empty, empty)).first()) == (1.0, True)


def test_bootstrap_tells_a_clear_difference(spark):
    df = spark.createDataFrame([(i, 1.0 + i % 3, 0.5) for i in range(200)], "key long, a double, b double")
    r = A.paired_bootstrap(df, 300).first()
    assert r["difference"] == pytest.approx(1.495) and r["p_value"] == 0.0 and r["resamples"] == 300
    assert A.bonferroni(0.02, 10) == pytest.approx(0.2)


def test_decay_is_e_folding(spark):
    assert spark.range(1).select(F.exp(F.lit(-90) / 90)).first()[0] == pytest.approx(0.3679, abs=1e-3)


# --- text, chunkers, sources -----------------------------------------------------------------------------------------


def test_scrub(spark):
    text = "mail a.b@c.org or +1 (415) 555-0100, ssn 123-45-6789, Bearer abc.def, card 4111 1111 1111 1111 not 4111 1111 1111 1112"
    got = spark.createDataFrame([(text,)], "t string").select(T.scrub(F.col("t"))).first()[0]
    assert "[EMAIL]" in got and "[PHONE]" in got and "[SSN]" in got and "Bearer [TOKEN]" in got
    assert "4111 1111 1111 1111" not in got and "4111 1111 1111 1112" in got


def test_aliases_and_slugs(spark):
    df = spark.createDataFrame([(' "Ａcme  Corp" ', "Crème Brûlée & Co."), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(T.normalize_alias("a"), T.slugify("b")).collect()] == [("acme corp", "creme-brulee-co"), (None, None)]


def test_html_text(spark):
    html = "<style>p{}</style><p>One &amp; two</p><script>var x='</p>'</script><p>three<br>four</p>"
    assert spark.createDataFrame([(html,)], "h string").select(T.html_text(F.col("h"))).first()[0] == "One & two\nthree\nfour"


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab. \n,", max_size=400), st.integers(2, 20))
def test_chunks_hold_every_word(text, target):
    chunks = C.chunk_text(text, target, 0)
    assert " ".join(chunks).split() == text.split()
    assert all(len(c.split()) <= math.ceil(1.5 * target) for c in chunks)
    assert all(len(c) <= 6000 for c in C.chunk_text(text, target, 5))


def test_semantic_boundary_lies_between_topics():
    a, b = np.tile([1.0, 0.0], (6, 1)), np.tile([0.0, 1.0], (6, 1))
    assert C.semantic_boundaries(np.concatenate([a, b])) == [6]
    assert C.semantic_boundaries(a[:2]) == []


def test_code_chunks_and_edges():
    code = "import os\nclass A:\n    def m(self):\n        return f(1)\ndef f(x):\n    'doc'\n    return os.path.join(x)\n"
    assert [(c["symbol"], c["kind"]) for c in C.code_chunks(code)] == [("A", "class"), ("A.m", "method"), ("f", "function")]
    assert set(C.code_edges(code)) == {("", "os", "imports"), ("A.m", "f", "calls"), ("f", "join", "calls")}
    assert C.code_edges("def (") == [] and C.code_chunks("def (")[0]["kind"] == "text"


def test_timeline_lines():
    text = "- 2024-01-02: met\n    with notes\n    and more\nplain\n- 2024-02-30: no such day\n2024-03-04 | call"
    assert C.timeline_lines(text) == [("2024-01-02", "met", "with notes\nand more"), ("2024-03-04", "call", "")]


@pytest.mark.parametrize("text,name,n", [("[1:02] Ann: hi\nmore\n[1:03] Bob: yo", "bracket", 2), ("12:01 <ann> hi\n12:02 <bob> yo", "irc", 2), ("**Ann**: hi\n\n**Bob**: yo", "bold", 2), ("user: hi\nassistant: yo", "plain", 2), ("nothing here", None, 0)])
def test_chat_formats(text, name, n):
    got = D.parse_chat(text)
    assert got[0] == name and len(got[1]) == n


def test_markdown_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("people/ann", "person", "Ann", "# Ann\nWorks at acme.")], "slug string, type string, title string, compiled_truth string")
    D.export_markdown(pages, str(tmp_path / "out"))
    files = D.read_files(spark, str(tmp_path / "out/*/*.txt"))
    m = D.split_markdown(F.col("text"))
    r = files.select(m["frontmatter"]["title"].alias("t"), m["compiled_truth"].alias("b")).first()
    assert (r["t"], r["b"]) == ("Ann", "# Ann\nWorks at acme.")


def test_qrels_reader(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"query": "a", "relevant": ["x", "y"]}\n{"query": "b", "grades": {"z": 3}}\n')
    assert rows(D.read_qrels(spark, str(tmp_path / "q.jsonl"))) == [("a", "x", 1.0), ("a", "y", 1.0), ("b", "z", 3.0)]


# --- the query compiler ----------------------------------------------------------------------------------------------


def test_plan_is_settled_on_the_driver():
    p = search.compile_search("Who invested in Acme?", NOW, limit=500, since="7d", expand=lambda q: 1 / 0)
    assert p.relation == ("Acme", "invested_in", "in") and p.limit == 100 and p.variants == ("Who invested in Acme?",)
    assert search.compile_search("latest call", NOW).intent == "temporal"
    assert search.compile_search("x", NOW, expand=lambda q: ["x", "y;", "z", "w"]).variants == ("x", "y", "z")


def test_bound_calls(spark):
    from fathomline.operators import code_graph

    defs = [("a/x.py", "C"), ("a/x.py", "C.m"), ("a/x.py", "C.go"), ("a/x.py", "m"), ("b/x.py", "m"), ("b/y.js", "m"), ("b/y.js", "far"), ("c/z.py", "C"), ("c/z.py", "C.m"), ("c/z.py", "")]
    edges = [
        ("a/x.py", "C.go", "m", "calls"), ("a/x.py", "top", "m", "calls"), ("d/q.js", "f", "m", "calls"), ("d/q.js", "", "../b/y.js", "imports"), ("e/r.py", "g", "m", "calls"), ("e/r.py", "", "a.x.m", "imports"),
        ("h/s.py", "g", "m", "calls"), ("h/s.py", "g", "far", "calls"), ("h/s.py", "g", "none", "calls"), ("i/t.py", "g", "m", "calls"), ("i/t.py", "", "x", "imports"), ("h/s.py", "g", "far", "calls"),
    ]
    got = {(r["file"], r["from_symbol"], r["name"]): (r["to_file"], r["to_symbol"], r["way"]) for r in code_graph.bound_calls(spark.createDataFrame(defs, "file string, symbol string"), spark.createDataFrame(edges, "file string, from_symbol string, to_symbol string, kind string")).collect()}
    assert got == {
        ("a/x.py", "C.go", "m"): ("a/x.py", "C.m", "class"), ("a/x.py", "top", "m"): ("a/x.py", "m", "file"), ("d/q.js", "f", "m"): ("b/y.js", "m", "import"), ("e/r.py", "g", "m"): ("a/x.py", "m", "import"),
        ("h/s.py", "g", "m"): (None, None, None), ("h/s.py", "g", "far"): ("b/y.js", "far", "unique"), ("h/s.py", "g", "none"): (None, None, None), ("i/t.py", "g", "m"): ("a/x.py", "m", "import"),
    }
