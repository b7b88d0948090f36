"""Quality classifier (1): a linear-chain conditional random field over the lines of a document.

Each line with a word is good or bad. Its features are shares of kinds of bytes and words, cut at fixed steps, of the
line itself and of the lines before and after it; the transition weights tie neighbours together. The labels of lines are
latent in training: documents alone are labelled. They begin as their document's; after each fit, the lines of which the model
is surest that they are of the other kind change over, as long as lines of the document's label keep over half of its word
characters, and the model is fitted on. So a good document may hold a bad line and the reverse, and the transitions
between the two are learnt. The score of a document is the mean of its lines' forward-backward marginals of "good", weighted
by the lines' word characters.

The model is fitted on the driver on a bounded sample: at most ``TRAIN_DOCS`` labelled documents of at most
``TRAIN_BYTES`` bytes each, chosen by a hash of doc_id from the rows whose crc32(doc_id) mod 3 is not 1 (rows that repeat a doc_id are bounded by
four times that number, by a hash of the text). Scoring reads
whole texts of any length in one narrow pass. Only the text is an input of a score.

Defined cases: null and empty texts and texts without a word score as one line without features; with no usable label
at all the model has zero weights and every score is 0.5; rows that repeat are scored alike; an empty table gives no
rows; null labels aren't learnt from; a null doc_id is scored and is not held out; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.quality_rules import Lines
from fathomline.llm.textbatch import Texts, byte_class, chunks, give_back, map_texts, mix, small_batches

TRAIN_DOCS = 4000
TRAIN_BYTES = 32_768
#: Steps of the first fit, and of each fit after the line labels have been drawn anew.
ROUNDS = (140, 40, 40)
RATE = 0.1
#: Marginal of the other label from which a line may change over.
SURE = 0.8
#: Penalties: of a line's own features; of its neighbours' features and of transitions, which labels of whole documents
#: would else raise without limit, as documents show too few changes from line to line.
L2 = 1e-3
L2_NEAR = 3e-2
L2_STEPS = 1e-1

#: Steps at which shares are cut.
SHARES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75)
#: Steps at which counts are cut.
COUNTS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0)
SIZES = (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0)

UPPER = tuple(range(65, 91))
LETTERS = UPPER + tuple(range(97, 123))
DIGITS = tuple(range(48, 58))
HIGH = tuple(range(128, 256))


def line_features(t: Texts, x: Lines) -> np.ndarray:
    """A row of 0/1 features for each line that has a word."""
    if not len(x.first):
        return np.zeros((0, N_OWN), np.float32)
    size = np.maximum(x.end - x.start, 1)
    count = lambda members: x._bytes(t, members)
    key = mix(x.hash ^ mix(x.doc.astype(np.uint64)))
    _, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
    columns = []
    for value, steps in (
        (count(UPPER) / np.maximum(count(LETTERS), 1), SHARES),
        (x.symbols / size, SHARES),
        (x.entries / x.n_words, SHARES),
        (x.shouts / x.n_words, SHARES),
        (x.again / x.n_words, SHARES),
        (x.marks / x.n_words, SHARES),
        (count(DIGITS) / size, SHARES),
        (count(HIGH) / size, SHARES),
        (x.chars / x.n_words, SIZES),
        (x.n_words, COUNTS),
        (often[inverse], COUNTS),
    ):
        columns.append(np.asarray(value)[:, None] > np.asarray(steps)[None, :])
    last = t.buf[np.maximum(x.end - 1, 0)]
    columns.append(byte_class(tuple(b".!?"))[last][:, None])
    return np.concatenate(columns, axis=1).astype(np.float32)


N_OWN = 8 * len(SHARES) + len(SIZES) + 2 * len(COUNTS) + 1


@dataclass
class Model:
    """Weights of the state "good" against "bad"; transitions and starts are log-potentials [from][to]."""

    own: np.ndarray = field(default_factory=lambda: np.zeros(N_OWN))
    before: np.ndarray = field(default_factory=lambda: np.zeros(N_OWN))
    after: np.ndarray = field(default_factory=lambda: np.zeros(N_OWN))
    bias: float = 0.0
    start: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))


def emissions(m: Model, f: np.ndarray, doc: np.ndarray) -> np.ndarray:
    out = f @ m.own + m.bias
    if len(f) > 1:
        same = doc[1:] == doc[:-1]
        out[1:] += np.where(same, f[:-1] @ m.before, 0.0)
        out[:-1] += np.where(same, f[1:] @ m.after, 0.0)
    return out


def forward_backward(score: np.ndarray, doc: np.ndarray, start: float, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions summed over all documents; sequences run side by side."""
    n = len(score)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(first, n))
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")  # sequences longer than t
    e = np.stack([np.exp(-np.maximum(score, 0)), np.exp(np.minimum(score, 0))], axis=1)
    e = np.maximum(e, 1e-300)
    move = np.exp(steps - steps.max())
    alpha, beta = np.empty((n, 2)), np.empty((n, 2))
    s = np.exp(np.array([0.0, start]) - max(0.0, start))
    for t in range(length[0]):
        at = first[: active[t]] + t
        a = e[at] * (s if t == 0 else alpha[at - 1] @ move)
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((2, 2))
    for t in range(length[0] - 1, -1, -1):
        at = first[: active[t]] + t
        b = np.ones((len(at), 2))
        if t + 1 < length[0]:
            k = active[t + 1]
            up = e[at[:k] + 1] * beta[at[:k] + 1]
            b[:k] = up @ move.T
            joint = alpha[at[:k], :, None] * move[None] * up[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        beta[at] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1), pairs


def latent(p: np.ndarray, good: np.ndarray, doc: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Line labels: the document's, but for the lines surest to be of the other kind, which hold under half of its characters.

    ``p`` are the lines' marginals of "good", ``good`` the labels of the lines' documents.
    """
    other = np.where(good, 1 - p, p)
    order = np.lexsort((-other, doc))
    heads = np.flatnonzero(np.diff(doc[order], prepend=-1))
    running = np.cumsum(chars[order])
    before = np.repeat(running[heads] - chars[order][heads], np.diff(np.append(heads, len(order))))
    total = np.repeat(np.add.reduceat(chars[order], heads), np.diff(np.append(heads, len(order))))
    change = np.zeros(len(p), bool)
    change[order] = (2 * (running - before) < total) & (other[order] > SURE)
    return np.where(change, ~good, good)


def fit(texts: list[str], good: np.ndarray) -> Model:
    """Maximum likelihood with a quadratic penalty, by Adam over the whole sample, with latent line labels."""
    m = Model()
    if not len(texts):
        return m
    features, docs, sizes, at = [], [], [], 0
    for row, t in chunks(pa.array(texts, pa.string())):
        x = Lines(t)
        features.append(line_features(t, x))
        docs.append(x.doc + row)
        sizes.append(x.chars)
    f, doc, chars = np.concatenate(features), np.concatenate(docs), np.concatenate(sizes)
    if not len(f):
        return m
    of_doc = good.astype(bool)[doc]
    label = of_doc
    same = doc[1:] == doc[:-1]
    heads = np.flatnonzero(np.diff(doc, prepend=-1))
    theta = np.zeros(3 * N_OWN + 6)
    scale = 1.0 / len(heads)
    penalty = np.concatenate([np.full(N_OWN, L2), np.full(2 * N_OWN, L2_NEAR), np.full(6, L2_STEPS)])
    for rounds in ROUNDS:
        y = label.astype(float)
        observed = np.zeros((2, 2))
        np.add.at(observed, (label[:-1][same].astype(int), label[1:][same].astype(int)), 1)
        mean, square = np.zeros_like(theta), np.zeros_like(theta)
        for at in range(1, rounds + 1):
            m = unpack(theta)
            p, pairs = forward_backward(emissions(m, f, doc), doc, m.start, m.steps)
            d = y - p
            grad = np.concatenate([
                f.T @ d,
                f[:-1].T @ np.where(same, d[1:], 0.0),
                f[1:].T @ np.where(same, d[:-1], 0.0),
                [d.sum(), d[heads].sum()],
                (observed - pairs).ravel(),
            ])
            grad = grad * scale - penalty * theta
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad * grad
            theta = theta + RATE * (mean / (1 - 0.9**at)) / (np.sqrt(square / (1 - 0.999**at)) + 1e-8)
        m = unpack(theta)
        label = latent(forward_backward(emissions(m, f, doc), doc, m.start, m.steps)[0], of_doc, doc, chars)
    return m


def unpack(theta: np.ndarray) -> Model:
    k = N_OWN
    return Model(theta[:k], theta[k : 2 * k], theta[2 * k : 3 * k], float(theta[3 * k]), float(theta[3 * k + 1]), theta[3 * k + 2 :].reshape(2, 2))


def scores(m: Model, t: Texts) -> dict[str, np.ndarray]:
    """Score and number of lines of each document of a chunk."""
    n, x = len(t), Lines(t)
    p, _ = forward_backward(emissions(m, line_features(t, x), x.doc), x.doc, m.start, m.steps)
    weight = np.bincount(x.doc, weights=x.chars, minlength=n)
    alone, _ = forward_backward(np.array([m.bias]), np.zeros(1, np.int64), m.start, m.steps)
    total = np.bincount(x.doc, weights=x.chars * p, minlength=n)
    return {"score": np.clip(np.where(weight > 0, total / np.maximum(weight, 1), alone[0]), 0.0, 1.0), "n_lines": np.bincount(x.doc, minlength=n).astype(np.int64), "n_bad_lines": np.bincount(x.doc[p < 0.5], minlength=n).astype(np.int64)}


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "quality").limit(most)
    sample = docs.select("doc_id", "text").filter(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    rows = sorted((r["doc_id"], r["text"], r["quality"]) for r in sample.orderBy(F.xxhash64("doc_id", "text"), "quality").limit(4 * most).collect())
    return fit([r[1] for r in rows], np.array([r[2] for r in rows]))


def classify(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_lines, n_bad_lines of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = map_texts(docs, "text", ["doc_id"], lambda t: scores(m, t), f"doc_id {kind}, score double, n_lines long, n_bad_lines long")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


def accepted(docs: DataFrame, m: Model) -> DataFrame:
    """The rows that the model takes for good, all columns as they were: one narrow pass."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for row, t in chunks(batch.column(at)):
                yield batch.slice(row, len(t)).filter(pa.array(scores(m, t)["score"] >= 0.5))
        give_back()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
