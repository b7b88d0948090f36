"""Document fingerprints (2) by a homomorphic multiset hash.

A paragraph (a line with at least one byte) is hashed to a wide vector; a document's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo a power of two. So it doesn't depend on their order, and a paragraph is
inserted or deleted by one addition or subtraction (``combine``, ``remove``), without the rest of the text.

The vector has two parts:

* 4 lanes modulo 2**64 from BLAKE2b of the paragraph: fingerprints are equal for equal multisets of paragraphs, and
  otherwise differ but for a chance of 2**-256;
* 256 lanes modulo 2**32 that add +1 or -1 for each five-word shingle of the paragraph (all its words where it has
  fewer): the cosine of two documents' lanes estimates that of their shingle counts, with an error of about 1/16. Lanes
  are read as signed, which holds for texts of up to 2**31 shingles, more than a string can hold.

Defined cases: null and empty texts and texts of line breaks only have the zero fingerprint; likeness of equal
fingerprints is 1, of a zero to another one 0; texts of any length are hashed whole, in stretches of
whole paragraphs; rows that repeat a doc_id are
ordered by the text's hash (then the text) and each is the next of the one before; the only document is its own next; a null doc_id comes before
all numbers; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import collections
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import Texts, byte_class, chunks, is_long, map_texts, mix, one_text, small_batches, span_hash, stretches, words

LANES = 4
SKETCH = 256
SHINGLE = 5
ROWS_AT_ONCE = 512
LOWEST = -(1 << 63)

Fingerprints = tuple[np.ndarray, np.ndarray]


def paragraph_sums(t: Texts) -> Fingerprints:
    """(n x LANES uint64, n x SKETCH uint32) of each text."""
    if is_long(t):  # sums of sums, of whole paragraphs each
        total = np.zeros((1, LANES), np.uint64), np.zeros((1, SKETCH), np.uint32)
        for a, b in stretches(t.buf, byte_class((10,))):
            total = combine(total, _sums(one_text(t.buf[a:b])))
        return total
    return _sums(t)


def _sums(t: Texts) -> Fingerprints:
    n = len(t)
    exact = np.zeros((n, LANES), np.uint64)
    sketch = np.zeros((n, SKETCH), np.uint32)
    if not len(t.buf):
        return exact, sketch
    data = t.buf.tobytes()
    edges = t.offsets.tolist()
    for i in range(n):
        digests = [hashlib.blake2b(p, digest_size=8 * LANES).digest() for p in data[edges[i] : edges[i + 1]].split(b"\n") if p]
        if digests:
            exact[i] = np.frombuffer(b"".join(digests), "<u8").reshape(-1, LANES).sum(axis=0, dtype=np.uint64)
    starts, ends, doc = words(t)
    if len(starts):
        # the number of a paragraph: line breaks before it, and one for each document before it
        line = np.concatenate([[0], np.cumsum(t.buf == 10)])[starts] + doc
        h = span_hash(t.prefix_hash(), starts, ends)
        left = np.searchsorted(line, line, side="right") - np.arange(len(line))  # words to the paragraph's end
        first = np.concatenate([[True], line[1:] != line[:-1]])
        key = np.zeros(len(h), np.uint64)
        for k in range(SHINGLE):
            inside = left > k
            key[inside] = mix(key[inside] + h[np.flatnonzero(inside) + k])
        use = (left >= SHINGLE) | first
        key, owner = key[use], doc[use]
        slot = owner * SKETCH + (key & np.uint64(SKETCH - 1)).astype(np.int64)
        sign = np.where(key >> np.uint64(63), 1.0, -1.0)
        sketch = np.bincount(slot, weights=sign, minlength=n * SKETCH).astype(np.int64).astype(np.uint32).reshape(n, SKETCH)
    return exact, sketch


def combine(a: Fingerprints, b: Fingerprints) -> Fingerprints:
    """Fingerprints of the union of two multisets of paragraphs."""
    return a[0] + b[0], a[1] + b[1]


def remove(a: Fingerprints, b: Fingerprints) -> Fingerprints:
    """Fingerprints of what is left of ``a`` without the paragraphs of ``b``."""
    return a[0] - b[0], a[1] - b[1]


def to_hex(x: Fingerprints) -> list[str]:
    raw = np.concatenate([x[0].astype("<u8").view(np.uint8).reshape(len(x[0]), -1), x[1].astype("<u4").view(np.uint8).reshape(len(x[1]), -1)], axis=1)
    return [row.tobytes().hex() for row in raw]


def from_hex(texts: list[str]) -> Fingerprints:
    raw = np.frombuffer(b"".join(map(bytes.fromhex, texts)), np.uint8).reshape(len(texts), -1)
    return np.ascontiguousarray(raw[:, : 8 * LANES]).view("<u8").astype(np.uint64), np.ascontiguousarray(raw[:, 8 * LANES :]).view("<u4").astype(np.uint32)


def likeness(a: Fingerprints, b: Fingerprints) -> np.ndarray:
    """0 to 1: the cosine of the sketch lanes, 1 for equal fingerprints."""
    x, y = (s.view(np.int32).astype(np.float64) for s in (a[1], b[1]))
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cosine = np.where(norm > 0, (x * y).sum(axis=1) / np.where(norm > 0, norm, 1), 0.0)
    equal = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    return np.where(equal, 1.0, np.clip(cosine, 0.0, 1.0))


def of_texts(texts: list[str | None]) -> Fingerprints:
    parts = [paragraph_sums(t) for _, t in chunks(pa.array(texts, pa.string()))]
    if not parts:
        return np.zeros((0, LANES), np.uint64), np.zeros((0, SKETCH), np.uint32)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as hex) of every row: one narrow pass."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs, text_col, [id_col], lambda t: {"fingerprint": to_hex(paragraph_sums(t))}, f"`{id_col}` {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, head) so that in each bucket, ordered by (head, doc_id, hash of the text, text), the row after
    each row is the document that follows it in the whole table; a bucket's last row (head) is only that, of the next bucket.

    Buckets are ranges between quantiles of doc_id, so the texts are shuffled once; no window runs over the table. A
    doc_id (or null) with so many rows that it spans several quantiles is parted into that many ranges of the hash.
    What reaches the driver is some numbers for each bucket.
    """
    spark = docs.sparkSession
    buckets = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(LOWEST)).alias("k")).withColumn("h", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("k", [i / buckets for i in range(1, buckets)], min(100 * buckets, 1_000_000))).first()[0] or []
    often = collections.Counter(cuts)
    edges = sorted(often) or [0]
    # range i holds the ids from edges[i - 1] on; where that id is frequent, its rows come first, in as many parts as it has cuts
    table, at = [(0, LOWEST, 1, 0)], 1
    for i, k in enumerate(edges, 1):
        table.append((i, k, often[k], at))
        at += often[k] + (often[k] > 1)
    ranges = F.broadcast(spark.createDataFrame(table, "b int, edge long, parts long, first long"))
    rows = Bucketizer(splits=[-float("inf"), *map(float, edges), float("inf")], inputCol="kd", outputCol="bd").transform(rows.withColumn("kd", F.col("k").cast("double")))
    rows = rows.withColumn("b", F.col("bd").cast("int")).drop("kd", "bd").join(ranges, "b")
    part = F.floor((F.shiftright("h", 32) + F.lit(1 << 31)) * F.col("parts") / F.lit(float(1 << 32)))
    within = F.when(F.col("parts") == 1, 0).when(F.col("k") == F.col("edge"), part).otherwise(F.col("parts"))
    rows = rows.select("doc_id", "k", "h", "text", (F.col("first") + within).cast("int").alias("bucket"))
    first = sorted((r["bucket"], tuple(r["x"])) for r in rows.groupBy("bucket").agg(F.min(F.struct("k", "h")).alias("x")).collect())
    before = spark.createDataFrame([(n, k, h, first[i - 1][0]) for i, (n, (k, h)) in enumerate(first)] or [(0, 0, 0, 0)], "bucket int, k long, h long, into int")
    heads = rows.join(F.broadcast(before), ["bucket", "k", "h"]).groupBy("into", "doc_id", "k", "h").agg(F.min("text").alias("text"))
    both = rows.select("doc_id", "k", "h", "text", "bucket", F.lit(False).alias("head")).union(heads.select("doc_id", "k", "h", "text", F.col("into").alias("bucket"), F.lit(True)))
    # neighbouring buckets, four to a partition: as even as the quantiles are
    return both.repartitionById(-(-at // 4), F.floor(F.col("bucket") / 4).cast("int")).sortWithinPartitions("bucket", "head", "k", "h", "text").select("doc_id", "text", "bucket", "head")


def edited_text(text: str, following: str) -> str:
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def compared(rows: DataFrame) -> DataFrame:
    """The query's columns from the rows that ``with_next`` lays out."""

    def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
        own, following = texts[:-1], texts[1:]
        edited = [edited_text(a, b) for a, b in zip(own, following, strict=True)]
        a, e = of_texts(texts), of_texts(edited)
        mine, after = (a[0][:-1], a[1][:-1]), (a[0][1:], a[1][1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(x) for x in own], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array(to_hex(mine)),
                pa.array(to_hex(e)),
                pa.array(likeness(mine, e)),
                pa.array(likeness(mine, after)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                for i, x, head in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    texts.append(x)
                    if head:  # the rows before it are complete, and it is no row itself
                        if ids:
                            yield emit(ids, texts)
                        ids, texts = [], []
                    else:
                        ids.append(i)
                if len(ids) > 1:
                    yield emit(ids[:-1], texts)
                    ids, texts = ids[-1:], texts[-1:]

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2(spark, sf_dir: str) -> DataFrame:
    return compared(with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
