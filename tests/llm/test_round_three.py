"""Fill-in-middle and token counts against plain computations and the tokenizers library."""

import hashlib
import random
import re
import unicodedata

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from fathomline.llm import fill_middle, multiset_hash, simhash, token_counts, toxicity_chain
from fathomline.llm.textbatch import CHUNK_BYTES, Texts, byte_class, one_text, stretches
from tests.llm.test_operators import ODD, odd_rows, texts_of


@pytest.fixture(scope="module")
def odd(spark):
    more = [(100 + i, x, "en", "s", None, "c", 1, 2.0, "z") for i, x in enumerate(["a <P> b\nc\n", "<S>", "<M", "<P\n>x\n", "\n" * 70, "é\nß\n中文\n😀", "a\nb\n<|endoftext|>c"])]
    return spark.createDataFrame(odd_rows() + more, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


# --- 11 fill-in-middle -----------------------------------------------------------------------------------------------


def brute_fim(doc, text, unit=r"[^\n]*\n|[^\n]+", rate=100):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return doc, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("which,window", [("docs", 1 << 20), ("docs", 100), ("odd", 1 << 20), ("odd", 5), ("none", 5)])
def test_fill_in_middle(which, window, docs, odd):
    df = {"docs": docs, "odd": odd, "none": docs.limit(0)}[which]
    rows = df.select("doc_id", "text").collect()
    made = fill_middle.fill_in_middle(df, window=window)
    got = made.withColumn("text", fill_middle.restored(made.output, made.form)).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(str(brute_fim(*r)) for r in rows)
    assert sorted((r.doc_id or -1, r.text) for r in got) == sorted((r.doc_id or -1, r.text or "") for r in rows)
    assert {r.form for r in got} == {"odd": {"plain", "psm", "spm"}, "docs": {"psm", "spm"}, "none": set()}[which]


def test_fill_in_middle_by_words_and_rate(docs):
    got = fill_middle.fill_in_middle(docs, unit="words", rate=50, window=64).collect()
    want = [brute_fim(r.doc_id, r.text, r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+$", 50) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert 0.3 < np.mean([r.form == "plain" for r in got]) < 0.7


def test_fill_in_middle_query(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    found = duck.execute(fill_middle.OP11_SQL)
    names = [x[0] for x in found.description]
    got = fill_middle.op11(spark, sf)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(found.fetchall(), key=str)
    assert all(r.restored_sha256 == r.sha for r in got.join(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "sha2(coalesce(text, ''), 256) AS sha"), "doc_id").collect())


# --- 12 token counts -------------------------------------------------------------------------------------------------


PIECES = ["'", "s", "t", "re", "ve", "m", "ll", "d", "r", "l", "S", "É", "é", "Σ", "İ", "ς", " ", "\n", "\t", "\xa0", "1", "٣", "!", "!!", "<|endoftext|>", "<|endo", "|>", "中", "字", "ก", "ี", "😀", "́", "\x1c", "Ᲊ", "a", "ing", "the", "-", "_", "...", "llll", "x" * 30]


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.vocabulary(token_counts.default_tokenizer())


def made_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_are_those_of_the_tokenizer(vocabulary, docs, odd):
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    texts = texts_of(docs) + texts_of(odd) + made_texts(6000) + [t.decode() for t in vocabulary.final if t.isascii()][::7]
    want = [len(x.ids) for x in library.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    for chunk in (1 << 19, 6):
        assert token_counts.batch_totals(vocabulary, iter(texts), chunk).tolist() == want


def test_long_runs(vocabulary):
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    for x in ("a" * 100_000, " " * 1_000_000, "\n" * 300_000 + "end", "!" * 50_000, "中文" * 20_000, "12" * 50_000, "ab, " * 200_000):
        assert token_counts.batch_totals(vocabulary, iter([x]))[0] == len(library.encode(x, add_special_tokens=False).ids)


def test_every_prefix(vocabulary, docs):
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    texts = [x for x in made_texts(1500) if not set(x) & {"́", "Ᲊ"}] + [x[:120] for x in texts_of(docs)[:40]]
    for x in texts:
        x = unicodedata.normalize("NFC", x)
        want = [len(library.encode(x[:i], add_special_tokens=False).ids) for i in range(len(x) + 1)]
        for chunk in (1 << 19, 6):
            assert np.concatenate(list(token_counts.prefix_counts(vocabulary, x, chunk))).tolist() == want


def test_budget_and_truncation(spark, docs, vocabulary):
    library = Tokenizer.from_file(token_counts.default_tokenizer())
    few = docs.filter("doc_id < 12").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in few.collect()}
    table = token_counts.prefix_table(few, part=64).cache()
    assert max(len(r.counts) for r in table.collect()) <= 64
    asked = spark.createDataFrame([(d, n) for d, x in texts.items() for n in (0, 1, 63, 64, 65, len(x))], "doc_id long, n_chars long")
    for r in token_counts.counts_at(table, asked).collect():
        known = r.n_chars <= len(texts[r.doc_id])
        assert r.n_tokens == (len(library.encode(texts[r.doc_id][: r.n_chars], add_special_tokens=False).ids) if known else None)
    for r in token_counts.longest_within(table, 20).collect():
        fits = [i for i in range(min(400, len(texts[r.doc_id])) + 1) if len(library.encode(texts[r.doc_id][:i], add_special_tokens=False).ids) <= 20]
        assert r.n_chars == max(fits)


def test_token_counts_of_odd_rows(odd, vocabulary):
    got = token_counts.totals(odd).collect()
    want = [(r.doc_id, len((r.text or "").encode()), int(token_counts.batch_totals(vocabulary, iter([r.text]))[0])) for r in odd.collect()]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_counts.totals(odd.limit(0)).count() == 0 and token_counts.prefix_table(odd.limit(0)).count() == 0


# --- long texts ------------------------------------------------------------------------------------------------------


def long_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = " ".join(word() + rng.choice(["", "", ".", "\n", "\n\n"]) for _ in range(500_000))
    return {"prose": prose, "lines": "\n".join(["the same line of words"] * 90_000), "one word": "x" * 1_600_000, "word at the end": "a b c d " * 10 + "y" * 1_500_000, "blanks": " \n" * 800_000, "words in a row": "zz " * 500_000}


@pytest.fixture(scope="module")
def long():
    return {k: np.frombuffer(x.encode(), np.uint8) for k, x in long_texts().items()}


def test_stretches_cover_and_end_well(long):
    for buf in long.values():
        ends = byte_class((10, 32))
        cuts = list(stretches(buf, ends, 5000))
        assert [a for a, _ in cuts] == [0] + [b for _, b in cuts[:-1]] and cuts[-1][1] == len(buf)
        assert all(ends[buf[b - 1]] for _, b in cuts[:-1])


@pytest.mark.parametrize("which", ["prose", "lines", "one word", "word at the end", "blanks", "words in a row"])
def test_long_text_in_stretches_is_the_whole(long, which):
    t = one_text(long[which])
    assert len(t.buf) > CHUNK_BYTES
    for k in (1, 3, 5):
        assert (simhash.shingle_hashes(t, k)[0] == simhash.short_hashes(t, k, simhash.SEED)[0]).all()
    for a, b in zip(multiset_hash.paragraph_sums(t), multiset_hash._sums(t), strict=True):
        assert (a == b).all()
    words = toxicity_chain.word_pairs(t)[0]
    rng = np.random.default_rng(1)
    vocabulary = np.sort(np.unique(np.concatenate([words[:: max(1, len(words) // 50)], rng.integers(0, 1 << 62, 50).astype(np.uint64)])))
    chain = toxicity_chain.Chain(vocabulary, [rng.normal(size=1 + k + len(vocabulary)) for k in range(3)])
    two = Texts(np.concatenate([t.buf, t.buf[:0]]), np.array([0, len(t.buf), len(t.buf)]))  # two texts go the short way
    assert np.allclose(toxicity_chain.predict(chain, t)[0], toxicity_chain.predict(chain, two)[0])
