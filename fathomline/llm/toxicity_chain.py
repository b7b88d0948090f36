"""Toxicity (5): a classifier chain over toxicity categories.

Categories are predicted in order - ``kind_a``, ``kind_b``, ``toxic`` (the label) - by logistic regressions on the
presence of words. Each later model also gets the earlier categories' probabilities as inputs. In training those
probabilities are out-of-fold predictions (``FOLDS`` folds by a hash of doc_id), so that a later model doesn't rely on an
earlier one's memory of its training rows; for scoring, the earlier models are fitted again on the whole sample. The
threshold of the last category is the one with the best F1 on out-of-fold predictions.

The label table has one category only; the two earlier ones are induced from the sample. The words that speak for
toxic the most, and stand in toxic documents nearly alone, are parted in two by which of them occur together (spectral
bisection of their correlations among toxic documents); a toxic document is of a kind if it holds more of the kind's
words than of the other's, or as many. So every toxic document with such a word is of at least one kind.

The chain is fitted on the driver on a bounded sample of at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_BYTES`` bytes each, from rows whose crc32(doc_id) mod 3 is not 1. Its vocabulary is at most ``VOCABULARY``
words and word beginnings: those that tell the sample's toxic documents from the others best. Scoring reads whole texts in one narrow pass.

Defined cases: null and empty texts have no words and score as the models' intercepts say; with no usable label every
probability is e**-50 and no document is toxic; very long texts are read whole; repeated rows score alike; an empty table gives no rows; null labels aren't
learnt from; a null doc_id is scored; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.crf_quality import held_out
from fathomline.llm.textbatch import Texts, byte_class, chunks, is_long, lower_ascii, map_texts, mix, one_text, span_hash, stretches, words

TRAIN_DOCS = 6000
TRAIN_BYTES = 32_768
VOCABULARY = 1024
LEAST_DOCS = 3
LEAST_Z = 4.0
FOLDS = 5
ROUNDS = 300
RATE = 0.3
L2 = 1e-5
#: Bytes of the word beginnings that count as features beside whole words: endings vary more than stems.
STEMS = (4, 5, 6)

CATEGORIES = ("kind_a", "kind_b", "toxic")
#: Words from which the kinds are induced at most, and the least share of a word's documents that are toxic.
KIND_WORDS = 128
KIND_PURITY = 0.8

#: Bytes that are not part of a word: all of ASCII but letters and digits.
BETWEEN = byte_class(tuple(b for b in range(128) if not chr(b).isalnum()))


def word_pairs(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each distinct lower-cased word and word beginning of each document."""
    t = Texts(lower_ascii(t.buf), t.offsets)
    starts, ends, doc = words(t, BETWEEN)
    prefix = t.prefix_hash()
    h, docs = [span_hash(prefix, starts, ends)], [doc]
    for size in STEMS:
        use = ends - starts > size
        h.append(mix(span_hash(prefix, starts[use], starts[use] + size) ^ np.uint64(size)))
        docs.append(doc[use])
    h, doc = np.concatenate(h), np.concatenate(docs)
    if not len(h):
        return h, doc
    key = mix(h ^ mix(doc.astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    first.sort()
    return h[first], doc[first]


@dataclass
class Chain:
    vocabulary: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    #: For each category: intercept, a weight for each earlier category's probability, a weight for each word.
    models: list[np.ndarray] = field(default_factory=list)
    #: p_toxic from which a document counts as toxic.
    threshold: float = 0.5


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 on out-of-fold probabilities, half-way (in log-odds) to the next one below; 0.5 at most."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True))
    k = ends[np.argmax(f1[ends])]
    z = np.log(np.clip(p[order], 1e-12, 1 - 1e-12) / (1 - np.clip(p[order], 1e-12, 1 - 1e-12)))
    return float(min(0.5, sigmoid(np.array((z[k] + z[min(k + 1, len(z) - 1)]) / 2))))


@dataclass
class Rows:
    """Sparse 0/1 rows over the vocabulary."""

    doc: np.ndarray
    word: np.ndarray
    n: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, weights=w[self.word], minlength=self.n)

    def back(self, d: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.word, weights=d[self.doc], minlength=width)


def rows_of(h: np.ndarray, doc: np.ndarray, n: int, vocabulary: np.ndarray) -> Rows:
    if not len(vocabulary):
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), n)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    hit = vocabulary[at] == h
    return Rows(doc[hit], at[hit], n)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def logits(model: np.ndarray, x: Rows, earlier: np.ndarray) -> np.ndarray:
    k = earlier.shape[1]
    return model[0] + earlier @ model[1 : 1 + k] + x.dot(model[1 + k :])


def logistic(x: Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, width: int) -> np.ndarray:
    """Penalised logistic regression on the rows marked in ``use``; the intercept is not penalised."""
    k = earlier.shape[1]
    theta = np.zeros(1 + k + width)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    n = max(1, int(use.sum()))
    for at in range(1, ROUNDS + 1):
        d = np.where(use, y - sigmoid(logits(theta, x, earlier)), 0.0)
        grad = np.concatenate([[d.sum()], earlier.T @ d, x.back(d, width)]) / n
        grad[1:] -= L2 * theta[1:]
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad * grad
        theta = theta + RATE * (mean / (1 - 0.9**at)) / (np.sqrt(square / (1 - 0.999**at)) + 1e-8)
    return theta


def choose(h: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The words with the largest absolute z-value between the two classes, sorted by hash."""
    names, inverse = np.unique(h, return_inverse=True)
    pos = np.bincount(inverse, weights=y[doc], minlength=len(names))
    both = np.bincount(inverse, minlength=len(names)).astype(float)
    n, p = len(y), max(float(y.sum()), 1.0)
    share = both / n
    z = (pos - p * share) / np.sqrt(p * share * (1 - share) * (1 - p / n) + 1e-9)
    z[(both < LEAST_DOCS) | (np.abs(z) < LEAST_Z)] = 0.0
    best = np.argsort(-np.abs(z), kind="stable")[:VOCABULARY]
    return np.sort(names[best[z[best] != 0]])


def kinds(x: Rows, y: np.ndarray, width: int) -> list[np.ndarray]:
    """Targets of the two induced categories, from rows over the vocabulary and the labels."""
    both = x.back(np.ones(x.n), width)
    toxic = x.back(y, width)
    pure = np.flatnonzero((toxic >= KIND_PURITY * both) & (toxic >= LEAST_DOCS))
    pure = np.sort(pure[np.argsort(-toxic[pure], kind="stable")[:KIND_WORDS]])
    if len(pure) < 2:
        return [y, y]
    slot = np.full(width, -1)
    slot[pure] = np.arange(len(pure))
    use = (y[x.doc] > 0) & (slot[x.word] >= 0)
    seen = np.zeros((x.n, len(pure)), np.float32)
    seen[x.doc[use], slot[x.word[use]]] = 1.0
    own = seen[y > 0] - seen[y > 0].mean(axis=0)
    scale = np.sqrt(np.maximum((own * own).sum(axis=0), 1e-9))
    side = np.linalg.eigh((own.T @ own) / np.outer(scale, scale))[1][:, -1]
    # a vector's sign is free: the word that is most often toxic is of the first kind
    first = side * np.sign(side[np.argmax(toxic[pure])] or 1.0) >= 0
    a, b = seen[:, first].sum(axis=1), seen[:, ~first].sum(axis=1)
    return [y * ((a > 0) & (a >= b)), y * ((b > 0) & (b >= a))]


def fit(ids: list[int], texts: list[str], toxic: np.ndarray) -> Chain:
    hs, docs = [], []
    for row, t in chunks(pa.array(texts, pa.string())):
        h, doc = word_pairs(t)
        hs.append(h)
        docs.append(doc + row)
    if not hs or not 0 < toxic.sum() < len(toxic):
        return Chain(models=[np.append([-50.0], np.zeros(k)) for k in range(len(CATEGORIES))])
    h, doc = np.concatenate(hs), np.concatenate(docs)
    y = toxic.astype(float)
    vocabulary = choose(h, doc, y)
    x = rows_of(h, doc, len(y), vocabulary)
    targets = [*kinds(x, y, len(vocabulary)), y]
    fold = (mix(np.asarray(ids, np.int64).astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    everyone = np.ones(len(y), bool)
    earlier = np.zeros((len(y), 0))
    models = []
    for target in targets:
        models.append(logistic(x, earlier, target, everyone, len(vocabulary)))
        unseen = np.zeros(len(y))
        for f in range(FOLDS):
            apart = fold == f
            unseen[apart] = sigmoid(logits(logistic(x, earlier, target, ~apart, len(vocabulary)), x, earlier))[apart]
        earlier = np.concatenate([earlier, unseen[:, None]], axis=1)
    return Chain(vocabulary, models, best_threshold(earlier[:, -1], y))


def predict(c: Chain, t: Texts) -> np.ndarray:
    """A row of category probabilities for each text."""
    if is_long(t):  # of each stretch of whole words, those of the vocabulary; each counts once
        parts = [rows_of(*word_pairs(one_text(t.buf[a:b])), 1, c.vocabulary).word for a, b in stretches(t.buf, BETWEEN)]
        word = np.unique(np.concatenate(parts))
        x = Rows(np.zeros(len(word), np.int64), word, 1)
    else:
        x = rows_of(*word_pairs(t), len(t), c.vocabulary)
    out = np.zeros((len(t), 0))
    for model in c.models:
        out = np.concatenate([out, sigmoid(logits(model, x, out))[:, None]], axis=1)
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Chain:
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "toxic").limit(most)
    sample = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.orderBy(F.xxhash64("doc_id", "text"), "toxic").limit(4 * most).collect())
    return fit([r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows]))


def score(docs: DataFrame, c: Chain) -> DataFrame:
    """doc_id, held_out, p_kind_a, p_kind_b, p_toxic, toxic (1 from the fitted threshold of p_toxic on) of each row."""
    names = [f"p_{k}" for k in CATEGORIES]

    def of(t: Texts) -> dict[str, object]:
        p = predict(c, t)
        return {k: np.ascontiguousarray(p[:, i]) for i, k in enumerate(names)}

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_texts(docs, "text", ["doc_id"], of, f"doc_id {kind}, " + ", ".join(f"{k} double" for k in names))
    return out.select("doc_id", held_out().alias("held_out"), *names, (F.col("p_toxic") >= c.threshold).cast("int").alias("toxic"))


def op5(spark, sf_dir: str) -> DataFrame:
    """One row per document; planted cases are found by ``toxic``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
