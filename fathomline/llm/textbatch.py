"""Vectorised access to batches of texts: UTF-8 bytes, words and hashes as numpy arrays.

A batch is one contiguous byte buffer plus document offsets, taken from Arrow without copying. Batches are cut to
``CHUNK_BYTES`` so that temporaries stay bounded whatever the number or length of documents; one longer document
makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: The multipliers of the splitmix64 finaliser.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)

#: Base of the rolling hash (odd, so that it has an inverse modulo 2**64).
BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX_2
    return x ^ (x >> np.uint64(31))


@cache
def byte_table(seed: int = 0) -> np.ndarray:
    """A random-looking uint64 for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN + np.uint64(seed))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Texts:
    """Documents back to back: ``buf`` (uint8) and ``offsets`` (one more than there are documents)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.buf, self.offsets = buf, offsets.astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Texts:
        return next(iter(chunks(pa.array(texts, pa.string()), CHUNK_BYTES << 10)))[1] if texts else cls(np.zeros(0, np.uint8), np.zeros(1))

    def bytes(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def per_byte_doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.lengths())

    def prefix_hash(self, buf: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        """H with H[j] the sum of table[byte i] * BASE**i over i < j."""
        buf = self.buf if buf is None else buf
        up, _ = powers(len(buf) + 1)
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(byte_table(seed)[buf] * up[:-1], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * GOLDEN)


#: The bytes between words (space and 09 to 0D).
SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)


@cache
def byte_class(members: tuple[int, ...]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


def words(t: Texts, separator: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of bytes that aren't separators, in order."""
    if not len(t.buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~(byte_class(SEPARATORS) if separator is None else separator)[t.buf]
    first = np.zeros(len(t.buf) + 1, bool)
    first[t.offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(t.offsets, starts, side="right") - 1


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all else stays."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def per_doc(n_docs: int, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (else the count) by document, as int64."""
    return np.bincount(doc, weights=weights, minlength=n_docs).astype(np.int64)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) of a string column, null as empty; each holds at most ``most`` bytes or one document."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, Texts(whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def stretches(buf: np.ndarray, ends: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of about ``most`` bytes, each but the last ending with a byte of the class ``ends``: what stands between such bytes stays whole."""
    at, n = 0, len(buf)
    while at < n:
        to = min(at + most, n)
        if to < n:
            near = np.flatnonzero(ends[buf[at:to]])
            if len(near):
                to = at + int(near[-1]) + 1
            else:
                while to < n and not ends[buf[to - 1]]:
                    more = np.flatnonzero(ends[buf[to : to + most]])
                    to = to + int(more[0]) + 1 if len(more) else min(to + most, n)
        yield at, to
        at = to


def is_long(t: Texts) -> bool:
    """One text that is over a chunk: its temporaries are kept to stretches."""
    return len(t) == 1 and len(t.buf) > CHUNK_BYTES


def one_text(buf: np.ndarray) -> Texts:
    return Texts(buf, np.array([0, len(buf)]))


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in batches of some MB: at Spark's default of 10,000 rows, two tasks of an executor hold
    hundreds of MB in Arrow buffers. This sets the session's option, for its other queries too, unless the user has set
    it, to whatever number: plans read it when they run, so it can't be set for one plan alone."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_ROWS):
        spark.conf.set(BATCH_ROWS, "2000")


def give_back() -> None:
    """Return freed memory to the system; a worker that waits for its next task would hold its peak otherwise."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, text: str, keep: list[str], f: Callable[[Texts], dict[str, object]], schema: str) -> DataFrame:
    """Columns ``keep`` of each row beside the columns that ``f`` makes of its text, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keep))
            for at, t in chunks(column):
                made = f(t)
                arrays = [batch.column(i).slice(at, len(t)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(arrays + [x if isinstance(x, pa.Array) else pa.array(x) for x in made.values()], names=[*keep, *made])
        give_back()

    small_batches(df.sparkSession)
    return df.select(*keep, df[text].alias("__text")).mapInArrow(run, schema)
