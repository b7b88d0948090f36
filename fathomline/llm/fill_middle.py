"""Fill-in-middle transformation (11): a text's units are cut at two chosen ranks and put in a new order.

A text is decoded to a UTF-32 code point array; comparing the classes of neighbouring code points gives the places where units
begin (``flatnonzero``), the chosen ranks are looked up among them, and the three pieces are sliced from the text and
joined in the form's order: prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``), each after its marker.
The numbers that choose ranks and form come from a hash of seed and doc_id, so that a lost task makes the same again.

Decoding goes by windows of ``WINDOW`` bytes: a first pass counts the units of each window, a second decodes the windows that hold
the two ranks. A text of any length costs its own bytes and a window's arrays.

``restored`` rebuilds a text from output and form alone, with functions of Spark's own. That is exact, as a text that holds a
marker stays plain, and no marker can arise where pieces meet: a marker has ``<`` and ``>`` at its ends only.

Defined cases: null and empty texts are plain, the empty text; a null doc_id hashes as ``''``; rows that repeat a doc_id
choose by the same numbers; a text of one unit may have empty pieces; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import SEPARATORS, give_back, small_batches

MARKERS = ("<P>", "<S>", "<M>")
SEED = "7"
RATE = 100
SPM_RATE = 50
WINDOW = 1 << 20
#: Bytes of output sent back in one batch, or one longer text.
BATCH_BYTES = 4 << 20
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(data: bytes | memoryview) -> np.ndarray:
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4")


def classes(points: np.ndarray, unit: str) -> np.ndarray:
    """Whether each code point is of the kind that parts units: line feeds, or blanks."""
    return points == 10 if unit == "lines" else np.isin(points, SEPARATORS)


def begins(kind: np.ndarray, before: bool | None, unit: str) -> np.ndarray:
    """Places in the window where a unit begins; ``before`` is the class of the code point ahead of it, None at the text's start.

    A line ends with its line feed; a word takes the blanks ahead of it.
    """
    left = np.concatenate(([bool(before)], kind[:-1]))
    new = left if unit == "lines" else ~left & kind
    if before is None and len(new):
        new[0] = True
    return np.flatnonzero(new)


def windows(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Spans of at most ``most`` bytes that end at the end of a code point."""
    at = 0
    while at < len(data):
        to = min(at + most, len(data))
        while to < len(data) and data[to] & 0xC0 == 0x80:
            to -= 1
        yield at, to
        at = to


def places(data: np.ndarray, choose, unit: str = "lines", window: int = WINDOW) -> tuple[int, list[tuple[int, int]]]:
    """Number of units, and (byte, code point) of where each chosen unit begins; ``choose(n)`` gives the ranks, n being the end."""
    seen: list[tuple[int, int, int, int, bool | None]] = []
    n, chars, before = 0, 0, None
    for a, b in windows(data, window):
        points = code_points(data[a:b].data)
        kind = classes(points, unit)
        seen.append((n, a, b, chars, before))
        n += len(begins(kind, before, unit))
        chars += len(points)
        before = bool(kind[-1])
    out = []
    for rank in choose(n):
        if rank >= n:
            out.append((len(data), chars))
            continue
        first, a, b, at, ahead = next(x for x in reversed(seen) if x[0] <= rank)
        points = code_points(data[a:b].data)
        k = int(begins(classes(points, unit), ahead, unit)[rank - first])
        out.append((a + len(points[:k].tobytes().decode("utf-32-le").encode()), at + k))
    return n, out


def transform(data: np.ndarray, h: tuple[int, int, int, int], unit: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, window: int = WINDOW) -> tuple:
    """(n, form, prefix_chars, middle_chars, output pieces) of one text's UTF-8 bytes."""
    n, ((a, a_chars), (b, b_chars)) = places(data, lambda n: sorted((h[0] % (n + 1), h[1] % (n + 1))), unit, window)
    whole = data.data
    held = bytes(whole)
    if not len(data) or h[2] % 100 >= rate or any(m.encode() in held for m in MARKERS):
        return n, "plain", None, None, [whole]
    prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
    p, s, m = (x.encode() for x in MARKERS)
    pieces = [s, suffix, p, prefix, m, middle] if h[3] % 100 < spm_rate else [p, prefix, s, suffix, m, middle]
    return n, "spm" if h[3] % 100 < spm_rate else "psm", a_chars, b_chars - a_chars, pieces


def numbers(key: Column, seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: str = SEED, unit: str = "lines", rate: int = RATE, spm_rate: int = SPM_RATE, window: int = WINDOW) -> DataFrame:
    """A row for each document with its output; of 100 documents about ``rate`` are cut, and ``spm_rate`` of 100 of these are spm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            hashes = list(zip(*(batch.column(1 + i).to_pylist() for i in range(4)), strict=True))
            texts = batch.column(5)
            wide = pa.types.is_large_string(texts.type)
            _, where, data = texts.buffers()
            ends = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
            buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
            rows: list[tuple] = []
            size = first = 0
            for i in range(len(texts)):
                rows.append(transform(buf[ends[i] : ends[i + 1]], hashes[i], unit, rate, spm_rate, window))
                size += int(ends[i + 1] - ends[i])
                if size > BATCH_BYTES or i + 1 == len(texts):
                    yield emitted(ids.slice(first, len(rows)), rows)
                    first, size, rows = i + 1, 0, []
        give_back()

    small_batches(docs.sparkSession)
    key = F.col("doc_id").cast("long")
    return docs.select(key.alias("doc_id"), *[x.alias(f"h{i}") for i, x in enumerate(numbers(key, seed))], F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, MADE)


def emitted(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    """Outputs are written piece by piece into one buffer, which the column takes as it is."""
    data = b"".join(piece for r in rows for piece in r[4])
    ends = np.concatenate(([0], np.cumsum([sum(map(len, r[4])) for r in rows]))).astype(np.int64)
    output = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(ends), pa.py_buffer(data)).cast(pa.string())
    made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))]
    return pa.RecordBatch.from_arrays([ids, *made, output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column) -> Column:
    """The text that output and form came from."""
    p, s, m = MARKERS
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, m, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(between(p, s), middle, between(s, m))).otherwise(F.concat(between(p, m), middle, between(s, p)))


def op11(spark, sf_dir: str) -> DataFrame:
    """Every document's form and pieces, and digests of its output and of the text restored from it."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    out, form = F.col("output"), F.col("form")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(out).alias("output_sha256"), sha(restored(out, form)).alias("restored_sha256"))


def _h(i: int) -> str:
    return f"('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), {8 * i + 1}, 8))::BIGINT"


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, {_h(0)} AS h1, {_h(1)} AS h2, {_h(2)} AS h3, {_h(3)} AS h4 FROM documents),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM d),
f AS (SELECT doc_id, text, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf,
      CASE WHEN text = '' OR {' OR '.join(f"contains(text, '{m}')" for m in MARKERS)} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
