"""Best-fit packing (3): bound-certified repacking of token sequences.

Every text becomes token ids and one end id; pieces of at most ``CAPACITY`` tokens are packed into sequences. Pieces
are dealt by hash to partitions of about ``PART_ROWS`` pieces, and each partition is packed by best-fit decreasing. Dual
feasible functions give a lower bound of each partition's number of sequences; where it is met, the partition is
certified optimal. The documents of unfilled sequences of the other partitions are dealt anew among them (the exchange)
and packed again; an exchange is kept only if it saves sequences. ``bound_all`` is the same lower bound for all pieces
together, from their numbers by length: while the sequences of certified partitions add up to more, all partitions'
unfilled sequences are exchanged. Exchanges end when the bound is met or nothing is saved. A full sequence stays where it
is, and is its own certificate.

Only whole documents move; one longer than the capacity is cut into pieces of the capacity, its first piece holding what
is left over. Memory is bounded by a partition's lengths; what reaches the driver is sums and a count for each length.

Ids come from the vocabulary of a byte-level BPE file of the ``tokenizers`` library (its path is a parameter), run by
``tiktoken``, which gives the same ids about four times as fast (the tests compare the two). The file's added tokens
are single ids wherever a text holds them, as in the library.

Defined cases: null and empty texts are the end id alone; texts of any length are tokenised whole; pieces of equal
length are placed in order of doc_id and piece; repeated rows are packed each by itself; a null doc_id is packed like any
other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import small_batches
from fathomline.session import cut_lineage

CAPACITY = 1024
END_ID = 2
PART_ROWS = 20_000
TOKENIZER = "byte_bpe_50k.json"
#: Runs of blanks (Unicode's, without the four control characters that Python adds) that are encoded by themselves.
LONG_RUN = re.compile(r"[^\S\x1c-\x1f]{10000,}")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, fill long, partition long, bins long, bound long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@cache
def encoding(path: str):
    """The file's byte-level BPE as a tiktoken encoding: vocabulary ids are its merge ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    if any(x.get(flag) for x in spec.get("added_tokens", []) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} has added tokens that take in blanks or stand alone only")
    # byte-level files write printable bytes as themselves and the others, in order, from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str) -> np.ndarray:
    """uint32 ids of a text, the end id last.

    The pattern that cuts words looks ahead from a run of blanks, which on a long run is more than its matcher can hold. Such a run,
    but for its last blank where more text (other than an added token) follows, is a word of its own: the library encodes it.
    """
    text = text or ""
    made: list[np.ndarray] = []
    at = 0
    for m in LONG_RUN.finditer(text):
        last = m.end() == len(text) or text.startswith(tuple(encoding(path).special_tokens_set), m.end())
        end = m.end() if last else m.end() - 1
        made.append(encoding(path).encode_to_numpy(text[at : m.start()], allowed_special="all"))
        made.append(np.array(library(path).encode(text[m.start() : end], add_special_tokens=False).ids))
        at = end
    made += [encoding(path).encode_to_numpy(text[at:], allowed_special="all"), [END_ID]]
    return np.concatenate(made).astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece; ``with_ids`` adds the token ids themselves."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = token_ids(text, path)
                    for k, (a, n) in enumerate(cut(len(ids), capacity)):
                        own = ids[a : a + n]
                        rows.append((doc, k, a, n, zlib.crc32(own.tobytes()), own) if with_ids else (doc, k, a, n, zlib.crc32(own.tobytes())))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


@cache
def dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of dual feasible functions over lengths 0..capacity, and the value of a full bin in each.

    In each, lengths that fit in a bin together have values that add up to the bin's value at most.
    """
    x = np.arange(capacity + 1)
    rows, full = [x.astype(float)], [float(capacity)]
    for a in range(1, capacity // 2 + 1):  # small lengths count nothing, those that leave no room for more count a bin
        rows.append(np.where(x > capacity - a, capacity, np.where(x < a, 0, x)).astype(float))
        full.append(float(capacity))
    for a in range(1, capacity // 2 + 1):  # lengths in units of a, rounded down below half a bin and up above it
        units = capacity // a
        value = np.where(2 * x > capacity, 2 * (units - (capacity - x) // a), np.where(2 * x == capacity, units, 2 * (x // a)))
        rows.append(value.astype(float))
        full.append(2.0 * units)
    for k in range(1, 101):  # multiples of 1 / (k + 1) of a bin stay, others are rounded to 1 / k from below
        share = x * (k + 1)
        value = np.where(share % capacity == 0, x * k, share // capacity * capacity)
        rows.append(value.astype(float))
        full.append(float(capacity * k))
    return np.array(rows), np.array(full)


def bound_of(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins for ``counts[n]`` pieces of each length n."""
    rows, full = dual_feasible(capacity)
    return int(np.max(-(-(rows @ counts) // full)))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    return bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each length, longest first in the order given, and the number of bins.

    Bins are kept by free space, and the non-empty spaces as the bits of one integer: the tightest fit is a bit scan.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, count = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_rooms >> n
        if fits:
            room = (fits & -fits).bit_length() - 1 + n
            b = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, b, count = capacity, count, count + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            by_room[room - n].append(b)
            open_rooms |= 1 << (room - n)
    return bins, offsets, count


def pack_parts(rows: DataFrame, parts: int, exchange: int, capacity: int = CAPACITY) -> DataFrame:
    """Deal the pieces to ``parts`` partitions and pack each."""
    name = F.pmod(F.xxhash64("doc_id", "piece", F.lit(exchange)), F.lit(parts)) + exchange * (1 << 24)

    def pack(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("doc_id", "piece", "start")], null_placement="at_start"))
        lengths = np.asarray(table.column("length").combine_chunks())
        bins, offsets, count = best_fit(lengths, capacity)
        part = table.column("partition")[0].as_py()
        fill = np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)
        made = {"sequence_id": part * (1 << 32) + bins, "offset": offsets, "fill": fill[bins], "partition": np.full(len(bins), part), "bins": np.full(len(bins), count), "bound": np.full(len(bins), lower_bound(lengths, capacity))}
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.table({n: table.column(n) for n in names} | {n: pa.array(v.astype(np.int64)) for n, v in made.items()})

    return rows.select(*(c.split()[0] for c in PIECES.split(", ")), name.cast("long").alias("partition")).groupBy("partition").applyInArrow(pack, PLACED)


def pack(rows: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """Place the pieces; ``bins`` and ``bound`` of a row's partition, as it was last packed, certify its place."""
    counts = np.zeros(capacity + 1)
    for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["length"]] = r["n"]
    least = bound_of(counts, capacity)
    placed = cut_lineage(pack_parts(rows, max(1, -(-int(counts.sum()) // part_rows)), 0, capacity))
    open_gap, k = F.col("bins") > F.col("bound"), 0
    everywhere = F.lit(True)
    for among in (open_gap, everywhere):
        while True:
            total = placed.groupBy("partition").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0] or 0
            loose = placed.filter(among & (F.col("fill") < capacity))
            by = loose.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"))
            n, before = by.agg(F.sum("n"), F.count(F.lit(1))).first()
            if total <= least or not before:
                break
            k += 1
            again = cut_lineage(pack_parts(loose, max(1, -(-n // part_rows)), k, capacity))
            after = again.groupBy("partition").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
            if after >= before:
                break
            # full sequences stay behind: their partition is now those sequences alone, as many as its pieces need
            full = placed.filter(among & (F.col("fill") == capacity))
            left = full.groupBy("partition").agg(F.count_distinct("sequence_id").alias("bins"))
            full = full.drop("bins", "bound").join(left, "partition").withColumn("bound", F.col("bins")).select(*placed.columns)
            placed = cut_lineage(placed.filter(~among).unionByName(full).unionByName(again))
    return placed.withColumn("bound_all", F.lit(least).cast("long"))


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    placed = pack(cut_lineage(pieces(docs, path)))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "partition", "bins", "bound", "bound_all")


def op3(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
