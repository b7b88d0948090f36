"""Registered queries that SQL can't express, computed plainly on the same tables."""

import html
import re
import unicodedata
from html.parser import HTMLParser

import numpy as np
import pytest

from fathomline.functions import chunkers as C
from fathomline.operators import analytics as A
from fathomline.plans import catalog, q_search
from fathomline.sources import views


@pytest.fixture(scope="module")
def rows(spark, sf):
    return lambda name: catalog.queries()[name](spark, sf).collect()


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def tokens(text):
    return re.findall(r"[^\W_]+", text.lower())


def test_text_dedup(spark, sf, rows):
    texts = {r["page_id"]: r["compiled_truth"] or "" for r in views.pages(spark, sf).select("page_id", "compiled_truth").collect()}
    found = {}
    for r in q_search._keyword(spark, sf).collect():
        found.setdefault(r["source_id"], []).append((-round(r["score"], 9), r["page_id"]))
    want = set()
    for source, hits in found.items():
        kept = []
        for rank, (_, page) in enumerate(sorted(hits)[:100], 1):
            words = set(texts[page].lower().split())
            if not any(len(words & k) / max(1, len(words | k)) > 0.85 for k in kept):
                kept.append(words)
                want.add((source, page, rank))
    assert {tuple(r) for r in rows("d2_text_dedup")} == want and want


def test_mentions(spark, sf, rows, documents):
    names = {}
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = tokens(r["text"])
        for gram, target in ((" ".join(w[:3]), f"b/{r['item_id']}"), (" ".join(w[:1]), f"w/{r['item_id']}")):
            names[gram] = min(target, names.get(gram, target))
    want = set()
    for doc, text in documents.items():
        w, at, seen = tokens(text), 0, set()
        while at < len(w):
            n = next((n for n in (3, 2, 1) if at + n <= len(w) and " ".join(w[at : at + n]) in names), 0)
            if n:
                target = names[" ".join(w[at : at + n])]
                if target not in seen:
                    seen.add(target)
                    want.add((doc, target, at + 1))
            at += n or 1
    assert {tuple(r) for r in rows("j15_mentions")} == want and want


def test_aliases(rows, spark, sf):
    plain = {r["page_id"]: r["compiled_truth"] for r in views.pages(spark, sf).select("page_id", "compiled_truth").collect()}
    for r in rows("f1_aliases"):
        text = plain[r["page_id"]]
        if text is not None:
            bare = " ".join(unicodedata.normalize("NFKC", text).lower().split())
            assert r["compiled_truth_alias"] == bare.strip("\"'`“”‘’()[]{}<>").strip()


class Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_html_text(rows, spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    got = {r["page_id"]: r["text"] for r in rows("f20_html_text")}
    assert got.keys() == pages.keys()
    for page, source in pages.items():
        reader = Visible()
        reader.feed(source or "")
        assert "".join(html.unescape(got[page] or "").split()) == "".join("".join(reader.out).split())


def luhn(digits):
    odd = [int(c) for c in digits[::-1][::2]]
    even = [sum(divmod(2 * int(c), 10)) for c in digits[::-1][1::2]]
    return (sum(odd) + sum(even)) % 10 == 0


def test_scrub(rows, documents):
    for r in rows("f21_scrub"):
        text = documents[r["doc_id"]]
        text = re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]", text)
        text = re.sub(r"(?<![A-Za-z0-9_.])\+?[0-9]{1,3}[ .-]?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "[PHONE]", text)
        text = re.sub(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])", "[SSN]", text)
        text = re.sub(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[JWT]", text)
        text = re.sub(r"(?i)bearer\s+[A-Za-z0-9._~+/-]+=*", "Bearer [TOKEN]", text)
        cards = dict.fromkeys(m for m in re.findall(r"(?<![0-9])([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", text) if luhn(re.sub("[ -]", "", m)))
        for card in cards:
            text = text.replace(card, "[CARD]")
        assert (r["text"] or "") == text


def test_bootstrap(spark, sf, rows):
    s = spark.read.parquet(f"{sf}/supplier.parquet").toPandas()
    d = s["s_acctbal"].to_numpy() / 1000 - s["s_suppkey"].to_numpy() % 9
    w = A.resample_weights(s["s_suppkey"].to_numpy(), 1000, 1)
    assert abs(w.mean() - 1) < 0.05 and abs(w.var() - 1) < 0.1
    (r,) = rows("a51_paired_bootstrap")
    assert np.isclose(r["difference"], d.mean()) and np.isclose(r["p_value"], np.mean(d @ w <= 0)) and r["resamples"] == 1000


def test_recursive_chunks(rows, documents):
    """Without the words that a chunk repeats of the one before, the chunks are the text's words in order."""
    by = {}
    for r in rows("x1_recursive_chunks"):
        by.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk_text"]))
    for doc, text in documents.items():
        chunks = [c for _, c in sorted(by.get(doc, []))]
        assert all(len(c) <= C.HARD_CHARS for c in chunks)
        if C.is_cjk(text) or any(len(c) == C.HARD_CHARS for c in chunks):
            continue
        words, at = text.split(), 0
        for c in chunks:
            own = c.split()
            back = next(k for k in range(min(C.OVERLAP, at, len(own)), -1, -1) if words[at - k : at - k + len(own)] == own)
            at += len(own) - back
        assert at == len(words)
