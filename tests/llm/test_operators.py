"""Each operator against brute force, a round trip or held-out accuracy, and on odd input."""

import collections
import hashlib
import pathlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import crf_quality, line_dedup, mixing, multiset_hash, packing, quality_rules, resharding, simhash, substring_dedup, suffix_array, toxicity_chain
from fathomline.llm.textbatch import Texts, chunks, span_hash, words

LONG = "A long line of words, with an end. " * 6000


def odd_rows():
    texts = [None, "", " \n\t\n", "one", "two words", LONG, LONG, "x" * 60, "x" * 60, "x" * 49, "é|é\x0b\x0c x.\r\n", "The same line.\nThe same line.\n", "a b c d e f g " * 30, "idiot. You are a stupid moron, a loser.\n" * 3, None]
    return [(i // 2 if i < 8 else i, t, None if i % 5 == 0 else "en", ["s1", "s2", None][i % 3], None, "c", 1, 2.0, "z") for i, t in enumerate(texts)] + [(None, "no id here, at all.", "en", "s1", 3, "c", 1, 2.0, "z")]


ODD = "doc_id long, text string, lang string, source string, n_chars long, copy string, part int, score double, fp string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def texts_of(df):
    return [r["text"] for r in df.select("text").collect()]


# --- words and hashes ------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té|", max_size=30), min_size=1, max_size=6))
def test_words_and_spans(texts):
    for at, t in chunks(pa.array(texts, pa.string())):
        a, b, d = words(t)
        got = [(int(x), t.buf[i:j].tobytes().decode()) for i, j, x in zip(a, b, d, strict=True)]
        assert got == [(i, w) for i, x in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", x)]
        h = dict(zip([w for _, w in got], span_hash(t.prefix_hash(), a, b).tolist(), strict=True))
        assert len(set(h.values())) == len(h)


# --- 1 quality classifier, 5 toxicity --------------------------------------------------------------------------------


def test_crf_gradient_is_that_of_the_likelihood():
    score = np.array([0.3, -1.2, 2.0, 0.1, 0.7])
    doc = np.array([0, 0, 0, 1, 1])
    steps = np.array([[0.5, -0.2], [0.1, 0.9]])

    def brute():
        marginal = np.zeros(5)
        for d in (0, 1):
            at = np.flatnonzero(doc == d)
            total = 0.0
            for bits in range(2 ** len(at)):
                y = [bits >> i & 1 for i in range(len(at))]
                w = np.exp(sum(score[i] * v for i, v in zip(at, y, strict=True)) + 0.4 * y[0] + sum(steps[a, b] for a, b in zip(y, y[1:], strict=False)))
                total += w
                for i, v in zip(at, y, strict=True):
                    marginal[i] += w * v
            marginal[at] /= total
        return marginal

    p, pairs = crf_quality.forward_backward(score, doc, 0.4, steps)
    assert np.allclose(p, brute())
    assert np.isclose(pairs.sum(), 3)


def test_crf_held_out_accuracy(docs, labels):
    got = crf_quality.classify(docs, crf_quality.train(docs, labels)).join(labels, "doc_id").toPandas()
    unseen = got[got.held_out]
    assert (unseen.predicted == unseen.quality).mean() > 0.9
    assert got.score.between(0, 1).all()


def test_crf_odd_rows(odd, labels):
    m = crf_quality.train(odd.limit(0), labels)
    rows = crf_quality.classify(odd, m).collect()
    assert len(rows) == odd.count() and all(abs(r["score"] - 0.5) < 1e-9 for r in rows)
    assert crf_quality.classify(odd.limit(0), m).count() == 0
    assert crf_quality.accepted(odd, m).columns == odd.columns


def test_latent_labels_keep_the_majority():
    p = np.array([0.9, 0.05, 0.95, 0.1, 0.02, 0.99, 0.9])
    good = np.array([1, 1, 1, 0, 0, 1, 1], bool)
    doc = np.array([0, 0, 0, 1, 1, 2, 2])
    chars = np.array([30, 20, 30, 50, 10, 5, 5])
    assert crf_quality.latent(p, good, doc, chars).tolist() == [True, False, True, False, False, True, True]
    assert crf_quality.latent(1 - p, good, doc, chars).tolist() == [True, True, False, False, True, True, True]


def test_mixed_documents_have_mixed_lines(spark, sf):
    """Four held-out good lines with a held-out bad one among them."""
    big = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    m = crf_quality.train(docs, labels)
    rows = docs.join(labels, "doc_id").filter(crf_quality.held_out()).select("text", "quality").collect()
    line = lambda r: max((r["text"] or "").split("\n"), key=len)[:400]
    good, bad = ([line(r) for r in rows if r["quality"] == q and len(line(r)) > 80] for q in (1, 0))
    texts = ["\n".join([g, good[i - 1], b, good[i - 2], good[i - 3]]) for i, (g, b) in enumerate(zip(good, bad, strict=False))]
    made = [crf_quality.scores(m, t) for _, t in chunks(pa.array(texts, pa.string()))]
    n_bad, score = (np.concatenate([x[k] for x in made]) for k in ("n_bad_lines", "score"))
    assert len(texts) > 3 and (n_bad == 1).mean() > 0.8 and (score > 0.5).mean() > 0.8


def test_toxicity_held_out_accuracy(spark, sf):
    big = sf.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = toxicity_chain.score(docs, toxicity_chain.train(docs, labels)).join(labels.withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    unseen = got[got.held_out]
    assert (unseen.toxic == unseen.y).mean() > 0.95
    assert unseen.toxic[unseen.y == 1].mean() > 0.85 and unseen.toxic[unseen.y == 0].mean() < 0.02


def test_toxicity_odd_rows(odd, labels):
    c = toxicity_chain.train(odd.limit(0), labels)
    rows = toxicity_chain.score(odd, c).collect()
    assert len(rows) == odd.count() and not any(r["toxic"] for r in rows)
    assert toxicity_chain.score(odd.limit(0), c).count() == 0


def test_later_models_use_earlier_probabilities():
    texts = ["you idiot", "stupid thing", "fine day", "good word"] * 30
    c = toxicity_chain.fit(list(range(120)), texts, np.array([1, 1, 0, 0] * 30))
    assert [len(m) for m in c.models] == [1 + k + len(c.vocabulary) for k in range(3)]
    p = toxicity_chain.predict(c, Texts.of(["an idiot", "a good day"]))
    assert p[0, -1] > 0.5 > p[1, -1]


# --- 2 fingerprints --------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab c", min_size=1, max_size=20), min_size=1, max_size=8), st.randoms())
def test_fingerprint_is_homomorphic(paragraphs, random):
    of = lambda p: multiset_hash.of_texts(["\n".join(p)])
    mixed = paragraphs[:]
    random.shuffle(mixed)
    whole = multiset_hash.to_hex(of(paragraphs))
    assert multiset_hash.to_hex(of(mixed)) == whole
    parts = multiset_hash.combine(of(paragraphs[:3]), of(paragraphs[3:]))
    assert multiset_hash.to_hex(parts) == whole
    assert multiset_hash.to_hex(multiset_hash.remove(parts, of(paragraphs[3:]))) == multiset_hash.to_hex(of(paragraphs[:3]))
    assert multiset_hash.to_hex(multiset_hash.from_hex(whole)) == whole
    assert multiset_hash.to_hex(of([*paragraphs, paragraphs[0]])) != whole


@pytest.mark.parametrize("which", ["docs", "odd", "hot", "one", "none"])
def test_edited_texts(which, docs, odd, spark):
    hot = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text {i % 90} of a table with two frequent ids") for i in range(600)]
    df = {"docs": docs, "odd": odd, "hot": spark.createDataFrame(hot, "doc_id long, text string").repartition(5), "one": docs.limit(1), "none": docs.limit(0)}[which].select("doc_id", "text")
    hashed = df.selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()
    rows = [(r["doc_id"], r["text"]) for r in sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["h"], r["text"]))]
    want = collections.Counter((a[0], len(a[1]), hashlib.sha256(multiset_hash.edited_text(a[1], rows[(i + 1) % len(rows)][1]).encode()).hexdigest()) for i, a in enumerate(rows))
    laid = multiset_hash.with_next(df)
    got = multiset_hash.compared(laid).collect()
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    if which == "docs":
        assert np.mean([r.near_edited for r in got]) > 0.6 > 0.2 > np.mean([r.near_next for r in got])
    if which == "hot":  # a third of the rows have one id; no bucket holds more than a few dozen
        assert max(n for n in collections.Counter(r.bucket for r in laid.collect()).values()) < 90


def test_likeness_of_heavy_repetition():
    line = "one line of words that comes again and again"
    a, b = (multiset_hash.of_texts(["\n".join([line] * n)]) for n in (40_000, 30_000))
    assert multiset_hash.likeness(a, b)[0] > 0.999


def test_fingerprint_against_brute_force(docs):
    """The exact lanes are the sums of the paragraphs' BLAKE2b words; the likeness is near the cosine of shingle counts."""

    def brute(text):
        lanes, counts = [0] * 4, collections.Counter()
        for p in filter(None, text.split("\n")):
            d = hashlib.blake2b(p.encode(), digest_size=32).digest()
            lanes = [(x + int.from_bytes(d[8 * i : 8 * i + 8], "little")) % (1 << 64) for i, x in enumerate(lanes)]
            w = re.findall(r"[^\x20\x09-\x0D]+", p)
            counts.update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w)
        return lanes, counts

    texts = [x or "" for x in texts_of(docs)]
    got = multiset_hash.of_texts(texts)
    want = [brute(x) for x in texts]
    assert got[0].tolist() == [lanes for lanes, _ in want]
    edited = [multiset_hash.edited_text(a, b) for a, b in zip(texts, texts[1:] + texts[:1], strict=True)]
    near = multiset_hash.likeness(got, multiset_hash.of_texts(edited))
    for (_, a), x, n in zip(want, edited, near, strict=True):
        b = brute(x)[1]
        if a and b:
            true = sum(v * b[k] for k, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
            assert abs(n - true) < 0.3


# --- 3 packing -------------------------------------------------------------------------------------------------------


def test_ids_are_those_of_the_tokenizer(docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    for x in texts_of(docs) + texts_of(odd):
        assert packing.token_ids(x, packing.default_tokenizer()).tolist() == [*t.encode(x or "", add_special_tokens=False).ids, packing.END_ID]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "a", " b", "  ", "\n", "é", "<"]), max_size=8).map("".join))
def test_added_tokens_are_those_of_the_tokenizer(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    for x in (text, f"a {text}<|endoftext|> b"):
        assert packing.token_ids(x, packing.default_tokenizer()).tolist() == [*t.encode(x, add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize(
    "text",
    [" " * 1_000_000, "\n" * 1_000_000, " \n\t" * 200_000, "a word" + " " * 700_000 + "next. " + "\n" * 500_000 + "<|endoftext|>end" + " " * 20_000, "\xa0" * 20_000 + "x", "a\x1c" + " " * 9999 + "\x1d" + "\t" * 30_000 + "<|endoftext|>"],
)
def test_long_runs_of_blanks(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert packing.token_ids(text, packing.default_tokenizer()).tolist() == [*t.encode(text, add_special_tokens=False).ids, packing.END_ID]


@pytest.mark.parametrize("which,part_rows,slack", [("docs", 20_000, 1.02), ("docs", 40, 1.1), ("odd", 4, 1.5), ("none", 40, 1)])
def test_packing(which, part_rows, slack, docs, odd):
    df = {"docs": docs, "odd": odd, "none": docs.limit(0)}[which]
    want = collections.Counter()
    for r in df.select("doc_id", "text").collect():
        ids = packing.token_ids(r["text"], packing.default_tokenizer())
        for k, (a, n) in enumerate(packing.cut(len(ids))):
            want[r["doc_id"], k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    got = packing.pack(packing.pieces(df).cache(), part_rows=part_rows).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    if got:
        lengths = np.array([r.length for r in got])
        assert packing.lower_bound(lengths) <= len(by) <= slack * packing.lower_bound(lengths) + 1
        assert {r.bound_all for r in got} == {packing.lower_bound(lengths)}
        for part in {r.partition for r in got}:
            own = [r for r in got if r.partition == part]
            assert {r.bins for r in own} == {len({r.sequence_id for r in own})}
            assert {r.bound for r in own} == {packing.lower_bound(np.array([r.length for r in own]))}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 24), min_size=1, max_size=9))
def test_lower_bound_never_exceeds_the_optimum(lengths):
    def fits(n):
        rooms = [24] * n

        def place(i):
            if i == len(lengths):
                return True
            for room in set(rooms):
                if room >= lengths[i]:
                    k = rooms.index(room)
                    rooms[k] -= lengths[i]
                    if place(i + 1):
                        return True
                    rooms[k] += lengths[i]
            return False

        return place(0)

    best = next(n for n in range(1, len(lengths) + 1) if fits(n))
    x = np.array(lengths)
    assert packing.lower_bound(x, 24) <= best <= packing.best_fit(x, 24)[2]


# --- 4 resharding ----------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=2, max_size=3), st.lists(st.integers(1, 9), min_size=9, max_size=9))
def test_flow_is_cheapest(sizes, cost):
    n = len(sizes)
    total = sum(sizes)
    need = [total // n + (i < total % n) for i in range(n)]
    arcs = [("s", ("a", i), sizes[i], 0.0) for i in range(n)] + [(("b", j), "t", need[j], 0.0) for j in range(n)]
    arcs += [(("a", i), ("b", j), total, float(cost[3 * i + j])) for i in range(n) for j in range(n)]
    flow, price = resharding.minimum_cost_flow(arcs, "s", "t")

    def brute(i, left):
        if i == n:
            return 0 if not any(left) else float("inf")
        best = float("inf")

        def deal(j, rest, spent, now):
            nonlocal best
            if j == n - 1:
                if rest <= now[j]:
                    best = min(best, spent + rest * cost[3 * i + j] + brute(i + 1, [*now[:j], now[j] - rest]))
                return
            for k in range(min(rest, now[j]) + 1):
                deal(j + 1, rest - k, spent + k * cost[3 * i + j], [*now[:j], now[j] - k, *now[j + 1 :]])

        deal(0, sizes[i], 0, left)
        return best

    assert price == pytest.approx(brute(0, need)) and sum(flow[:n]) == total


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_resharding(which, docs, odd):
    df = {"docs": docs, "odd": odd, "none": docs.limit(0)}[which]
    got = resharding.reshard(df).collect()
    want = collections.Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in df.select("doc_id", "text").collect())
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(resharding.SHARDS)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("slices", [1024, 4])
@pytest.mark.parametrize("which", ["docs", "odd"])
def test_fewest_bytes_move(which, slices, docs, odd, monkeypatch):
    """Each shard with too many rows must lose that many: the fewest bytes are those of its smallest rows."""
    monkeypatch.setattr(resharding, "SLICES", slices)
    rows = resharding.described({"docs": docs, "odd": odd}[which]).cache()
    got = resharding.assigned(rows, resharding.plan(rows)).collect()
    sizes = collections.defaultdict(list)
    for r in rows.collect():
        sizes[r.old_shard].append(r["size"])
    room = resharding.even(len(got), resharding.SHARDS)
    least = sum(sum(sorted(x)[: max(0, len(x) - room[s])]) for s, x in sizes.items())
    assert sum(r["size"] for r in got if r.shard != r.old_shard) == least > 0


@pytest.mark.parametrize("which", ["docs", "odd", "twice"])
def test_rewrite(which, docs, odd, tmp_path):
    odd = odd.selectExpr("*", "7 as shard", "'x' as slot")
    df = {"docs": docs, "odd": odd, "twice": odd.union(odd).union(odd)}[which]
    rows = resharding.described(df).cache()
    plan = resharding.plan(rows)
    placed = resharding.assigned(rows, plan).cache()
    changed = resharding.rewrite(df, placed, plan, str(tmp_path / "out"))
    assert changed
    written = df.sparkSession.read.parquet(str(tmp_path / "out")).collect()
    want = collections.Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in resharding.with_slots(placed, placed, plan).collect() if r.shard in changed)
    assert collections.Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r.shard, r.slot) for r in written) == want
    if which != "docs":
        assert all((r.shard_, r.slot_) == (7, "x") for r in written)
    rows = collections.Counter((r.doc_id, r.text, r.source, r.lang) for r in df.collect())
    assert not collections.Counter((r.doc_id, r.text, r.source, r.lang) for r in written) - rows


def test_op4_reads_what_it_wrote(spark, sf, docs):
    got = resharding.op4(spark, sf).collect()
    plan = resharding.reshard(docs).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, plan))


# --- 6 line dedup, 7 mixing ------------------------------------------------------------------------------------------


def brute_lines(rows, share, least):
    bare = lambda x: x.strip(" ")
    total, pages = collections.Counter(), collections.Counter()
    for site, text in rows:
        total[site] += 1
        for x in {bare(x) for x in (text or "").split("\n")} - {""}:
            pages[site, x] += 1
    drop = {k for k, n in pages.items() if n >= least and n > share * total[k[0]]}
    return collections.Counter((site, None if text is None else "\n".join(x for x in text.split("\n") if (site, bare(x)) not in drop)) for site, text in rows)


@pytest.mark.parametrize("which,options", [("docs", {}), ("odd", {}), ("none", {}), ("docs", {"broadcast_rows": 0, "hot_sites": 10}), ("odd", {"broadcast_rows": 0, "hot_sites": 4})])
def test_line_dedup(which, options, docs, odd):
    df = {"docs": docs, "odd": odd.selectExpr("*", "'x' as site", "1 as __drop", "2 as drop", "3 as met", "4 as row", "5 as salt"), "none": docs.limit(0)}[which]
    out = line_dedup.drop_boilerplate(df, least_pages=2, **options)
    assert out.columns == df.columns
    rows = [(r["source"], r["text"]) for r in df.collect()]
    assert collections.Counter((r["source"], r["text"]) for r in out.collect()) == brute_lines(rows, line_dedup.MAX_SHARE, 2)


def test_host_of(spark):
    rows = spark.createDataFrame([("http://A.example.com/x",), ("https://u:p@b.org:80?q",), ("nothing",)], "url string")
    assert [r[0] for r in rows.select(line_dedup.host_of(rows["url"])).collect()] == ["a.example.com", "b.org", ""]


def test_poisson_counts_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    rows = spark.range(40000).select(F.col("id").cast("string").alias("k"))
    for rate in (0.3, 2.5, 30.0):
        n = rows.select(mixing.poisson(F.lit(rate), F.col("k")).alias("n")).agg(F.avg("n"), F.var_samp("n"), F.min("n")).first()
        assert abs(n[0] - rate) < 5 * (rate / 40000) ** 0.5 and abs(n[1] / rate - 1) < 0.05 and n[2] >= 0


def test_mixing_reaches_its_weights(docs):
    got = collections.Counter(r["source"] for r in mixing.mixed(docs, {"src0": 4.0}, size=8000).select("source").collect())
    rest = [n for s, n in got.items() if s != "src0"]
    assert abs(sum(got.values()) / 8000 - 1) < 0.06 and abs(got["src0"] / np.mean(rest) / 4 - 1) < 0.2


def test_mixing_odd_rows(odd):
    out = mixing.mixed(odd, {"s1": 3.0})
    assert out.columns == odd.columns and {r["copy"] for r in out.select("copy").collect()} <= {"c"}
    assert out.collect() == mixing.mixed(odd, {"s1": 3.0}).collect()
    assert mixing.mixed(odd.limit(0)).count() == 0
    clash = odd.selectExpr("*", "'x' as site", "'y' as count", "1 as rate", "2 as row", "3 as shuffle_key", "4 as __rate", "5 as __drop")
    for r in mixing.mixed(clash, {"s1": 3.0}).collect():
        assert (r.site, r["count"], r.rate, r.row, r.shuffle_key, r["__rate"], r["__drop"]) == ("x", "y", 1, 2, 3, 4, 5)
    assert mixing.mixed(odd, default_weight=0.0).count() == 0
    nameless = odd.sparkSession.range(600).selectExpr("CAST(null AS long) AS doc_id", "concat('text ', id) AS text", "'s1' AS source")
    drawn = collections.Counter(r.text for r in mixing.mixed(nameless, size=1200, detail=True).collect())
    assert len(set(drawn.values())) > 3 and 1000 < sum(drawn.values()) < 1400
    assert set(mixing.mixed(odd, detail=True).columns) == {*odd.columns, "rate", "shuffle_key"}
    with pytest.raises(ValueError):
        mixing.mixed(odd, {"s1": -1.0})


# --- 8 quality rules -------------------------------------------------------------------------------------------------


def brute_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    often = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {i + k for i in range(len(w) - 4) if often[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_quality_rules(which, docs, odd):
    df = {"docs": docs, "odd": odd, "none": docs.limit(0)}[which]
    want = collections.Counter((r["doc_id"], *brute_base(r["text"])) for r in df.select("doc_id", "text").collect())
    got = quality_rules.quality_rules(df).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules.cleaned(df).count() == sum(r.kept for r in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.|é", max_size=60), min_size=1, max_size=5))
def test_base_columns_on_any_text(texts):
    got = []
    for _, t in chunks(pa.array(texts, pa.string())):
        x = quality_rules.judge(t)
        got += list(zip(*[x[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], strict=True))
    assert got == [brute_base(x) for x in texts]


def test_cleaned_text_loses_its_failed_lines(spark):
    text = "A good line with several words in it.\nHome | About | Contact | Help\nAll rights reserved.\nAnother good line, also with some words."
    row = quality_rules.cleaned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["text"] == "A good line with several words in it.\nAnother good line, also with some words."


def brute_kept(text):
    """The verdict, line by line on characters."""
    if brute_base(text)[-1]:
        return False
    total = lost = 0
    for line in text.split("\n"):
        w = re.findall(r"[^\x20\x09-\x0D]+", line)
        n = sum(map(len, w))
        total += n
        free = sum(0x0E00 <= ord(c) < 0x10A0 or 0x1700 <= ord(c) < 0x1D00 or 0xA800 <= ord(c) < 0xAC00 for c in line)
        bad = (2 * free <= n and not any(c in quality_rules.SENTENCE_MARKS for c in line)) or 2 * sum(x.endswith("!") for x in w) > len(w)
        bad |= 10 * sum(line.count(c) for c in "#*$%&|<>") > n or 2 * sum(a == b for a, b in zip(w, w[1:], strict=False)) > len(w)
        bad |= sum(line.count(c) for c in quality_rules.ENTRY_MARKS) > 2
        low = "".join(c.lower() if c.isascii() else c for c in line).encode()
        if w and (bad or any(p in low for p in quality_rules.BOILERPLATE)):
            lost += n
    return total > 0 and lost <= quality_rules.MAX_LOSS * total


SCRIPTS = (
    "Мы шли домой по длинной улице и долго говорили о школе и делах.",
    "Le château du bâtiment âgé plaît à l'âme grâce au théâtre du pâturage.",
    "这 是 一 行 没有 问题 的 文字 ， 我们 说 了 很 多 话 。",
    "هذا سطر عادي من نص واضح، وفيه كلمات كثيرة لا بأس بها ؟",
    "यह एक साधारण पंक्ति है जिसमें बहुत से शब्द हैं और अंत में विराम है।",
    "วันนี้ อากาศ ดี มาก เรา ไป เดิน เล่น ที่ สวน สาธารณะ กัน",
    "ມື້ນີ້ ອາກາດ ດີ ຫຼາຍ ພວກ ເຮົາ ໄປ ຍ່າງ ຫຼິ້ນ ຢູ່ ສວນ",
    "དེ་རིང་ གནམ་གཤིས་ ཡག་པོ་ འདུག ང་ཚོ་ གླིང་ཀར་ འགྲོ་གི་ཡིན།",
    "ថ្ងៃនេះ អាកាសធាតុ ល្អ ណាស់ យើង ទៅ ដើរ លេង នៅ សួន",
    "ဒီနေ့ ရာသီဥတု ကောင်း တယ် ငါတို့ ပန်းခြံ ကို သွား မယ်",
    "วันนี้ ดี but this line is mostly in plain words without any mark",
    "Home | About | Contact | Help",
    "All rights reserved, as ever, by the people who wrote this page.",
    "no mark at the end of this line of words",
    "BUY! NOW! CHEAP! words",
    "a â • û • л • Т.",
)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(SCRIPTS), min_size=1, max_size=8, unique=True))
def test_verdict_by_characters_in_all_scripts(lines):
    text = "\n".join(lines)
    _, t = next(iter(chunks(pa.array([text], pa.string()))))
    assert bool(quality_rules.judge(t)["kept"][0]) == brute_kept(text)


def test_clean_text_without_marks_is_kept():
    for line in SCRIPTS[5:10]:
        text = "\n".join(f"{line} {k}" for k in "กขคง")
        _, t = next(iter(chunks(pa.array([text], pa.string()))))
        assert quality_rules.judge(t)["loss"][0] == 0 and not quality_rules.judge(t)["n_lines_removed"][0]


def test_verdict_on_the_table(docs):
    want = {r["doc_id"]: brute_kept(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()} == want


def test_boilerplate_counts_in_the_loss(spark):
    text = "\n".join(["A good line with several words in it."] + [f"Use is licensed under the terms of number {i}." for i in range(20)])
    row = quality_rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.loss > 0.9 and not row.kept


CLEAN = (
    "Мы шли домой по длинной улице и долго говорили о школе и делах.\nНаш большой дом стоял около поля, а вокруг было светло и тепло.",
    "Le château du bâtiment âgé plaît à l'âme grâce au théâtre du pâturage.\nIl est sûr que la bûche et la flûte brûlent, dit-on, près du mûr.",
    "这 是 一 行 没有 问题 的 文字 ， 我们 说 了 很 多 话 。\n第二 行 的 意思 也 很 清楚 ， 一共 有 两 句 ！",
)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_lines_in_other_scripts_stay(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = quality_rules.quality_rules(docs).first()
    assert row.kept and row.n_lines == 2 and row.n_lines_removed == 0
    assert quality_rules.cleaned(docs).first()["text"] == text


def test_entry_marks_are_whole_characters():
    lines = ["a • b • c • d.", "a » b » c » d.", "a • b • c.", "ллл âââ ûûû 。", "no mark"]
    _, t = next(iter(chunks(pa.array(["\n".join(lines)], pa.string()))))
    assert quality_rules.Lines(t).failures()[0].tolist() == [True, True, False, False, True]


# --- 9 SimHash -------------------------------------------------------------------------------------------------------


def brute_simhash(text, k=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_simhash_components(which, docs, odd):
    df = {"docs": docs, "odd": odd.filter("doc_id is not null"), "none": docs.limit(0)}[which].select("doc_id", "text")
    rows = df.collect()
    prints = [brute_simhash(r["text"]) for r in rows]
    up = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(rows[i]["doc_id"]), find(rows[j]["doc_id"])
                up[max(x, y)] = min(x, y)
    got = simhash.components(df, tile=16).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == collections.Counter((r["doc_id"], format(p, "016x"), find(r["doc_id"])) for r, p in zip(rows, prints, strict=True))


def test_components_of_rows_without_an_id(spark):
    text = "a text of some words that is there three times"
    rows = [(None, text), (4, text), (7, text), (None, "another text that nobody else has in this table")]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("7", "4"), ("None", "4"), ("None", "None")]


def test_links_through_rows_without_an_id(spark):
    """A third of the rows have no id, and a third one id; every row links, whatever its id."""
    rng = np.random.default_rng(8)
    base = [[f"w{x}" for x in rng.integers(0, 50, 80)] for _ in range(12)]
    rows = []
    for k in range(240):
        w = list(base[k % 12])
        for i in rng.integers(0, 80, rng.integers(0, 3)):
            w[i] = f"w{rng.integers(0, 50)}"
        rows.append((None if k % 3 == 0 else 500 if k % 3 == 1 else k, " ".join(w)))
    prints = [brute_simhash(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(zip(prints, rows, strict=True)):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 or (x[0] is not None and x[0] == rows[j][0]):
                up[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    want = collections.Counter((doc, format(prints[i], "016x"), least.get(find(i))) for i, (doc, _) in enumerate(rows))
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=16).collect()
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert len(least) > 1


def test_row_without_id_in_the_middle(spark, monkeypatch):
    """Two documents two bits apart from a row without an id, on either side of it, are one component."""
    monkeypatch.setattr(simhash, "fingerprint_table", lambda docs, *_: docs)
    fp = [0xFF00, 0xFF03, 0xFF0F]
    rows = [(d, bytearray(x.to_bytes(8, "big")), int(simhash.block_key(np.array([[x]], np.uint64), np.ones(1))[0])) for d, x in zip((1, None, 2), fp, strict=True)]
    got = simhash.components(spark.createDataFrame(rows, "doc_id long, fp binary, tile_key long")).collect()
    assert [r.component_id for r in got] == [1, 1, 1]


def test_tiles_lose_no_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 30).astype(np.uint64)
    fp = np.unique(np.concatenate([base] + [base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 62, 6)]))
    keys = simhash.block_key(fp[:, None], np.ones(len(fp)))
    for i in range(len(fp)):
        for j in range(len(fp)):
            if int(fp[i] ^ fp[j]).bit_count() <= 2:
                assert int(keys[j]) - int(keys[i]) in simhash.block_steps(2)
    u, v = simhash.tile_links(fp[:, None], fp[:, None], True, 1)
    assert len(u) == len(fp) - len(base) and (v < u).all()


def test_stage_keeps_one_of_each(spark, odd):
    a = " ".join(f"word{i}" for i in range(200))
    b = a.replace("word50 ", "other ").replace("word150 ", "else ")
    c = " ".join(f"term{i}" for i in range(200))
    rows = spark.createDataFrame([(5, a, "s"), (3, b, "s"), (9, a, "t"), (7, c, "t"), (8, None, "t"), (2, "", "t")], "doc_id long, text string, source string")
    out = simhash.one_of_each(rows)
    assert out.columns == rows.columns and sorted(r["doc_id"] for r in out.collect()) == [2, 3, 7]
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id is null").count() == 1
    assert sorted(map(str, kept.collect())) == sorted(map(str, simhash.one_of_each(odd.repartition(7)).collect()))
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_stage_keeps_other_texts_of_one_id(spark):
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in ("a", "b", "c")]
    rows = [(1, texts[0], "p"), (1, texts[1], "q"), (2, texts[1], "r"), (None, texts[2], "s"), (3, texts[2], "t"), (1, texts[0], "o"), (None, texts[0], "u")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, texts[0]), (1, texts[1]), (3, texts[2])]


def brute_sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows, least=0.8):
    """The smallest id of each component of the pairs whose sets of shingles are similar, over all pairs."""
    up = {i: i for i, _ in rows}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, brute_sets(t)) for i, t in rows]
    for n, (i, x) in enumerate(sets):
        for j, y in sets[:n]:
            if x == y or len(x & y) >= least * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted(i for i in up if find(i) == i)


def test_stage_on_the_table(docs):
    """Every pair of the table's texts is compared; copies and near copies are found without a miss."""
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_groups(rows)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == want and len(want) < len(rows)


def test_stage_links_repeated_passages(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 200)) for _ in range(6)]
    again = [f"{t}\n{t}" for t in texts] + [f"{t}\n{t}\n{t}" for t in texts] + [t + (" " + " ".join(t.split()[:20])) * 20 for t in texts]
    rows = list(enumerate(texts + again))
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == brute_groups(rows) == list(range(6))


def test_stage_links_what_is_similar(spark):
    rng = np.random.default_rng(6)
    rows = []
    for n in [8, 9, 20, 60, 200, 600] * 4:
        text = [f"w{x}" for x in rng.integers(0, 100_000, n)]
        rows.append(" ".join(text))
        for changes in (1, 2, 3, 4, 5, 6, 8, 12):  # similarities on both sides of 0.8
            other = list(text)
            for at in rng.integers(0, n, changes):
                other[at] = f"w{rng.integers(0, 100_000)}"
            rows.append(" ".join(other))
    rows = list(enumerate(rows))
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), tile=32)
    assert sorted(r["doc_id"] for r in got.collect()) == brute_groups(rows)


# --- 10 suffix arrays ------------------------------------------------------------------------------------------------


@settings(max_examples=250, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=50), st.integers(1, 5), st.sampled_from([0, 512]))
def test_suffix_array_by_induced_sorting(body, times, few):
    before, suffix_array.FEW = suffix_array.FEW, few  # 0: every level sweeps runs of buckets
    try:
        s = np.array([*body * times, 0], np.uint16)
        sa = suffix_array.suffix_array(s, 5)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert sa.tolist() == want
        shared = suffix_array.permuted_prefixes(s, sa)
        for k in range(1, len(s)):
            a, b = s[want[k - 1] :].tolist(), s[want[k] :].tolist()
            assert shared[want[k]] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    finally:
        suffix_array.FEW = before


def test_suffix_array_of_a_long_text(docs):
    data = "\n".join(x for x in texts_of(docs) if x).encode()[:400_000]
    s = np.append(np.frombuffer(data + data[:50_000], np.uint8).astype(np.uint16) + 1, np.uint16(0))
    sa = suffix_array.suffix_array(s, 258)
    shared = suffix_array.permuted_prefixes(s, sa)[sa]
    assert np.array_equal(np.sort(sa), np.arange(len(s)))
    raw = data + data[:50_000]
    for i in np.random.default_rng(2).integers(1, len(s), 3000):
        a, b, n = int(sa[i - 1]), int(sa[i]), int(shared[i])
        assert raw[a : a + n] == raw[b : b + n] and raw[a + n : a + n + 1] < raw[b + n : b + n + 1]


def brute_removed(rows, length=50):
    first = {}
    data = [(-1 if d is None else d, d, (t or "").encode()) for d, t in rows]
    for k, _, b in data:
        for w in {b[i : i + length] for i in range(len(b) - length + 1)}:
            first[w] = min(first.get(w, k), k)
    out = collections.Counter()
    for k, d, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < k:
                gone[i : i + length] = True
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out[d, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which,options", [("docs", {}), ("docs", {"most_contexts": 1}), ("odd", {}), ("none", {})])
def test_remove_repeats(which, options, docs, odd, spark):
    more = [(900, "ab" * 100), (901, "x" + "ab" * 60), (902, "y" * 120), (903, "y" * 50), (904, "y" * 51), (900, "zz" * 40)]
    df = {"docs": docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")), "odd": odd, "none": docs.limit(0)}[which]
    if options:
        h = np.unique(np.concatenate([substring_dedup.anchors(t)[1] for _, t in chunks(pa.array(texts_of(df), pa.string()))]))
        options = options | {"hot": h[::2]}
    got = substring_dedup.remove_repeats(df, **options).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_removed([(r["doc_id"], r["text"]) for r in df.collect()])
    kept = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not list(pathlib.Path(kept).glob("table-*"))


def test_removed_text_is_what_the_digest_says(docs):
    for r in substring_dedup.remove_repeats(docs.limit(50), with_text=True).collect():
        assert hashlib.sha256(r.kept_text).hexdigest() == r.kept_sha256 and len(r.kept_text) == r.n_bytes - r.n_removed
