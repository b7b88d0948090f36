"""Suffix-array dedup (10): remove bytes covered by a long string that also starts in an earlier document.

A byte goes if a ``LENGTH``-byte string over it also occurs in a document with a smaller doc_id. The work is cut into
shards whose suffix arrays are built by induced sorting (``suffix_array``); permuted common prefixes of at least
``LENGTH`` mark equal strings. What brings equal strings into one shard are anchors: in every ``LENGTH``-byte window the
leftmost ``GRAM``-byte string with the smallest hash. Equal windows have the same anchor at the same place, so:

1. anchors of all texts, about one in 14 bytes, are dealt by hash to buckets, as packed arrays; a bucket returns those
   that stand in two documents or more;
2. beside its text, each returned anchor gets its context, the at most ``2 * LENGTH - GRAM`` bytes of all windows that
   can hold it; equal contexts of an anchor are one from here on, with their smallest and largest doc_id;
3. contexts are dealt to shards by anchor. A shard's suffix array gives, for each window of each context, the smallest
   doc_id that has it;
4. joined to the places of the contexts, windows found in an earlier document become spans, and the spans are cut from the texts.

Texts equal to an earlier document's are set aside before (2). Anchors that stand in ``LEAST_HOT`` documents of a sample
could fill a bucket: they skip (1). Anchors with more than ``MOST_CONTEXTS`` contexts could fill a shard: in
(3), their windows are compared by a plain aggregation instead, which sums before it shuffles. Either way is exact.
Anchors are told apart by 64-bit hashes and contexts of an anchor by 64 more; windows are compared byte for byte.

Buckets, shards and parts of documents are as many as keep each at about ``PART_BYTES`` of text, and a few to a task at
least, so what one task holds does not grow with the input.

Steps are joined through tables written to the cluster's shared folder, so a lost executor repeats one step at most; each
table goes when the step that reads it is done, and so do a step's shuffle files (Spark's own clean-up, switched on while
the steps run). (3) and (4) are done in ``TURNS`` turns over the anchors, each with its share of the contexts, to halve the
disk needed.

Defined cases: null and empty texts have 0 bytes, and texts below ``LENGTH`` bytes lose nothing; among equal texts the
smallest doc_id keeps its bytes (as far as no other document has them); rows that repeat a doc_id are no earlier
documents of one another; a null doc_id comes before all numbers; texts of any length are read whole; an empty table gives no
rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.llm.suffix_array import permuted_prefixes, suffix_array
from fathomline.llm.textbatch import Texts, chunks, mix, powers, small_batches, span_hash
from fathomline.session import cut_lineage, ensure_checkpoint_dir, remove_folder

LENGTH = 50
GRAM = 24
REACH = LENGTH - GRAM
#: Bytes of text in a bucket or part, about.
PART_BYTES = 32 << 20
#: Bytes of text that are sampled for hot anchors (a share of the text between a least and a most), and the documents of the
#: sample from which an anchor is hot: of these there are as many as the sample's anchors over that number at most.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 1 / 64, 16 << 20, 1 << 30
LEAST_HOT = 50
#: Contexts of one anchor up to which a suffix array compares them: as many as fill one of ``SHARD_BYTES``.
MOST_CONTEXTS = 50_000
#: Turns in which the anchors are compared, so that a quarter of the contexts are on disk at once.
TURNS = 4
#: Anchors with many contexts up to which their table is broadcast.
BROADCAST_ANCHORS = 100_000
LOWEST = -(1 << 63)
#: Bytes of text whose anchors go into one set of packed arrays.
PACK_BYTES = 16 << 20
#: Bytes of contexts in one suffix array.
SHARD_BYTES = 4 << 20


def anchors(t: Texts, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the anchors of all windows of a chunk; windows don't cross documents."""
    n, w = len(t.buf), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    prefix = t.prefix_hash()
    _, down = powers(n + 1)
    h = mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])

    def sliding(x: np.ndarray, best: np.ufunc) -> np.ndarray:
        """Of x[i..i+w-1] for each i, by doubling."""
        x, size = x.copy(), 1
        while size * 2 <= w:
            x[: len(x) - size] = best(x[: len(x) - size], x[size:])
            size *= 2
        rest = w - size
        return best(x[: len(x) - rest], x[rest:])[: len(x) - w + 1] if rest else x[: len(x) - w + 1]

    key = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # half the bits choose as well, in half the memory; none is 0
    low = sliding(key, np.minimum)
    over = (t.offsets[1:-1, None] - np.arange(1, length)).ravel()  # windows that would cross into the next document
    low[over[(over >= 0) & (over < len(low))]] = 0
    pad = np.zeros(w - 1, np.uint32)
    # a place is an anchor if its hash is the smallest of some window over it; equal hashes in a window all count
    reached = sliding(np.concatenate([pad, low, pad]), np.maximum)
    at = np.flatnonzero((key == reached) & (reached > 0))
    return at, h[at]


def _parts(spark: SparkSession, size: int) -> int:
    """Buckets, shards and parts of documents: as their bytes ask for and two to a task at least, an odd number so that strides in doc_id don't matter."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return max(2 * tasks, -(-size // (2 * PART_BYTES)) * 2) + 1


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within, a finished query's shuffle files are deleted: all that is read again here is a table or a checkpoint."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def written(df: DataFrame, by: str | None = None) -> tuple[DataFrame, str]:
    """A table in the shared folder (a folder for each value of ``by``) in place of ``df``, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sampled_hot(docs: DataFrame, size: int, length: int, gram: int) -> np.ndarray:
    """Hashes of anchors that stand in many documents of a sample of about a ``SAMPLE_SHARE`` of the text, sorted."""
    wanted = min(max(SAMPLE_LEAST, int(size * SAMPLE_SHARE)), SAMPLE_MOST)
    every = max(1, size // wanted)
    sample = docs.filter(F.pmod(F.xxhash64("k", F.lit(10)), F.lit(every)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, t in chunks(batch.column(0)):
                at, h = anchors(t, length, gram)
                doc = np.searchsorted(t.offsets, at, side="right") - 1
                key = np.unique(np.stack([doc.astype(np.int64), h.view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key[1])], names=["h"])

    hot = sample.select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_HOT)
    return np.sort(np.array([r["h"] for r in hot.select("h").toLocalIterator()], np.int64).view(np.uint64))


def member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def packed_places(k: np.ndarray, pos: np.ndarray) -> bytes:
    """doc keys and positions, small: differences of the keys, and the positions, deflated."""
    return zlib.compress(np.diff(k, prepend=0).astype("<i8").tobytes() + pos.astype("<i4").tobytes(), 1)


def unpacked_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(raw)
    n = len(data) // 12
    return np.cumsum(np.frombuffer(data, "<i8", n)), np.frombuffer(data, "<i4", n, 8 * n).astype(np.int64)


def repeated_anchors(docs: DataFrame, hot: np.ndarray, parts: int, length: int, gram: int) -> DataFrame:
    """(part, places): packed (k, position) of the anchors that stand in two documents or more, by the document's part."""
    def emit(k: np.ndarray, pos: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        rows: list[tuple[int, bool, bytes, bytes]] = []
        known = member(h, hot)
        for which in (False, True):
            use = known == which
            own_k, own_pos, own_h = k[use], pos[use], h[use]
            bucket = ((mix(own_h) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64) if not which else part_of(own_k, parts)
            order = np.argsort(bucket.astype(np.uint16) if parts < 1 << 16 else bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(parts + 1))
            for b in np.flatnonzero(np.diff(edges)):
                at = order[edges[b] : edges[b + 1]]
                six = own_h[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if not which else b""
                rows.append((int(b), which, six, packed_places(own_k[at], own_pos[at])))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "known", "hashes", "places"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for row, t in chunks(batch.column(1)):
                at, h = anchors(t, length, gram)
                doc = np.searchsorted(t.offsets, at, side="right") - 1
                have.append((keys[row + doc], at - t.offsets[doc], h))
                size += len(t.buf)
                if size >= PACK_BYTES:
                    yield emit(*map(np.concatenate, zip(*have, strict=True)))
                    have, size = [], 0
        if have:
            yield emit(*map(np.concatenate, zip(*have, strict=True)))

    def returned(k: np.ndarray, pos: np.ndarray) -> list[tuple[int, bytes]]:
        part = part_of(k, parts)
        order = np.lexsort((pos, k, part))
        part, k, pos = part[order], k[order], pos[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        return [(int(p), packed_places(k[edges[p] : edges[p + 1]], pos[edges[p] : edges[p + 1]])) for p in np.flatnonzero(np.diff(edges))]

    def resolve(table: pa.Table) -> pa.Table:
        known = table.column("known").to_pylist()
        out = [(table.column("bucket")[0].as_py(), x) for x, kn in zip(table.column("places").to_pylist(), known, strict=True) if kn]
        hs, ks, ps = [], [], []
        for six, places, kn in zip(table.column("hashes").to_pylist(), table.column("places").to_pylist(), known, strict=True):
            if not kn:
                k, pos = unpacked_places(places)
                wide = np.zeros((len(k), 8), np.uint8)
                wide[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
                hs.append(wide.view("<u8").ravel())
                ks.append(k)
                ps.append(pos)
        if hs:
            h, k, pos = np.concatenate(hs), np.concatenate(ks), np.concatenate(ps)
            order = np.argsort(h)
            h, k, pos = h[order], k[order], pos[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            several = np.minimum.reduceat(k, first) < np.maximum.reduceat(k, first)
            use = np.repeat(several, np.diff(np.append(first, len(h))))
            out += returned(k[use], pos[use])
        return pa.table({"part": pa.array([x[0] for x in out], pa.int32()), "places": pa.array([x[1] for x in out], pa.binary())})

    sent = docs.select("k", "text").mapInArrow(gather, "bucket int, known boolean, hashes binary, places binary")
    return sent.groupBy("bucket").applyInArrow(resolve, "part int, places binary")


def part_of(k: np.ndarray, parts: int) -> np.ndarray:
    """The part of a document key; ``with_part`` computes the same in Spark."""
    k = k.astype(np.int64)
    return np.mod(k ^ (k >> 15) ^ (k >> 31), parts)


def with_part(rows: DataFrame, parts: int) -> DataFrame:
    mixed = F.col("k").bitwiseXOR(F.shiftright("k", 15)).bitwiseXOR(F.shiftright("k", 31))
    return rows.withColumn("part", F.pmod(mixed, F.lit(parts)).cast("int"))


OCCURRENCES = "h long, c long, k long, v int, pos int, ctx binary, anchor int, low long, high long"


def occurrences(texts: DataFrame, marks: DataFrame, length: int, gram: int) -> DataFrame:
    """A row for each repeated anchor; the first of each (anchor, context) of a chunk also carries the context.

    ``marks`` has packed places, and keys of texts that are copies (flag), by part. ``low`` and ``high`` are the
    smallest and largest document key of the context in the chunk.
    """
    reach = length - gram

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("k", pa.int64()), ("v", pa.int32()), ("pos", pa.int32()), ("ctx", pa.binary()), ("anchor", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
        blobs = [x for x in right.column("places").to_pylist() if x is not None]
        copies = np.unique(np.array([x for x in right.column("copy").to_pylist() if x is not None], np.int64))
        if not blobs or not left.num_rows:
            return schema.empty_table()
        k, pos = map(np.concatenate, zip(*map(unpacked_places, blobs), strict=True))
        keep = ~np.isin(k, copies)
        k, pos = k[keep], pos[keep]
        order = np.lexsort((pos, k))
        k, pos = k[order], pos[order]
        keys, variants = np.asarray(left.column("k").combine_chunks()), np.asarray(left.column("v").combine_chunks())
        out: list[pa.Table] = []
        for row, t in chunks(left.column("text")):
            own = keys[row : row + len(t)]
            begin, end = np.searchsorted(k, own, side="left"), np.searchsorted(k, own, side="right")
            many = end - begin
            if not many.sum():
                continue
            doc = np.repeat(np.arange(len(t)), many)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many) + begin[doc]
            here = pos[at]
            fits = here + gram <= t.lengths()[doc]  # rows that repeat a doc_id can have other texts
            doc, here = doc[fits], here[fits]
            place = here + t.offsets[doc]
            a, b = np.maximum(place - reach, t.offsets[doc]), np.minimum(place + length, t.offsets[doc + 1])
            h = anchor_hash(t, place, gram)
            c = mix(span_hash(t.prefix_hash(seed=1), a, b) ^ mix((place - a).astype(np.uint64)))
            order = np.lexsort((own[doc], c, h))
            doc, here, place, a, b, h, c = (x[order] for x in (doc, here, place, a, b, h, c))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            if not len(first):
                continue
            last = np.append(first[1:], len(h)) - 1
            data = t.buf.tobytes()
            ctx: list[bytes | None] = [None] * len(h)
            for i, x, y in zip(first.tolist(), a[first].tolist(), b[first].tolist(), strict=True):
                ctx[i] = data[x:y]
            high = np.zeros(len(h), np.int64)
            high[first] = own[doc[last]]
            out.append(pa.Table.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(own[doc]), pa.array(variants[row + doc]), pa.array(here.astype(np.int32)), pa.array(ctx, pa.binary()), pa.array((place - a).astype(np.int32)), pa.array(own[doc]), pa.array(high)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(rows, OCCURRENCES)


def anchor_hash(t: Texts, place: np.ndarray, gram: int) -> np.ndarray:
    prefix = t.prefix_hash()
    _, down = powers(len(prefix))
    return mix((prefix[place + gram] - prefix[place]) * down[place])


def earliest_windows(contexts: list[bytes], anchor: np.ndarray, low: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bytes from the window's start to the anchor, smallest key that has the window) for each window over an anchor."""
    size = np.array([len(x) for x in contexts])
    start = np.concatenate([[0], np.cumsum(size + 1)])
    s = np.zeros(start[-1] + 1, np.uint16)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    inside = np.ones(start[-1], bool)
    inside[start[1:] - 1] = False
    s[:-1][inside] = flat.astype(np.uint16) + 2
    s[start[1:] - 1] = 1
    sa = suffix_array(s, 258)
    # suffixes that share ``length`` characters with the one before them are of its group
    group = np.cumsum(permuted_prefixes(s, sa)[sa] < length)
    owner = np.repeat(np.arange(len(contexts)), size + 1)
    sa, group = sa[1:], group[1:]  # without the end
    ctx = owner[sa]
    shift = start[ctx] + anchor[ctx] - sa
    whole = (sa + length < start[ctx + 1]) & (shift >= 0) & (shift <= length - gram)
    ctx, shift, group = ctx[whole], shift[whole], group[whole]
    if not len(ctx):
        return ctx, shift, np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(low[ctx], first)
    return ctx, shift, np.repeat(least, np.diff(np.append(first, len(ctx))))


FOUND = "h long, c long, begin int, stop int, least long"


def shard_spans(shards: DataFrame, length: int, gram: int) -> DataFrame:
    """Spans about the anchor, by (h, c), that occur in a document with the key ``least``: one suffix array a batch."""
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("begin", pa.int32()), ("stop", pa.int32()), ("least", pa.int64())])

    def rows(table: pa.Table) -> pa.Table:
        h, c, low, high, anchor = (np.asarray(table.column(x).combine_chunks()) for x in ("h", "c", "low", "high", "anchor"))
        order = np.lexsort((c, h))
        h, c, low, high = h[order], c[order], low[order], high[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
        low, high = np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
        pick = order[first]
        h, c, anchor = h[first], c[first], anchor[pick].astype(np.int64)
        group = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        members = np.diff(np.append(group, len(h)))
        several = np.repeat(np.minimum.reduceat(low, group) < np.maximum.reduceat(high, group), members)
        alone = np.repeat(members == 1, members)
        ctx_column = table.column("ctx").combine_chunks()
        out: list[tuple[np.ndarray, ...]] = []

        def add(i: np.ndarray, shift: np.ndarray, least: np.ndarray) -> None:
            """Runs of neighbouring windows with one key become spans."""
            use = least < high[i]
            i, shift, least = i[use], shift[use], least[use]
            order = np.lexsort((shift, i))
            i, shift, least = i[order], shift[order], least[order]
            if len(i):
                new = np.concatenate([[True], (i[1:] != i[:-1]) | (least[1:] != least[:-1]) | (shift[1:] != shift[:-1] + 1)])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(i)) - 1
                out.append((h[i[a]], c[i[a]], -shift[b], length - shift[a], least[a]))

        single = np.flatnonzero(several & alone)
        if len(single):  # one context in several documents: all its windows are repeated
            sizes = np.array([len(ctx_column[int(j)].as_py()) for j in pick[single]])
            lo, hi = np.maximum(0, anchor[single] + length - sizes), np.minimum(anchor[single], length - gram)
            many = np.maximum(hi - lo + 1, 0)
            at = np.repeat(np.arange(len(single)), many)
            add(single[at], np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + lo[at], low[single][at])
        todo = np.flatnonzero(several & ~alone)
        if len(todo):
            # cut into batches between anchors, so that a batch's suffix array fits in memory
            edge = np.flatnonzero(np.concatenate([[True], h[todo][1:] != h[todo][:-1]]))
            batch = (edge * (2 * length - gram + 1)) // SHARD_BYTES
            cuts = edge[np.flatnonzero(np.diff(batch, prepend=-1))].tolist() + [len(todo)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                some = todo[x:y]
                ctx, shift, least = earliest_windows(ctx_column.take(pa.array(pick[some])).to_pylist(), anchor[some], low[some], length, gram)
                # windows of contexts with other anchors in the batch are equal bytes too: they count alike
                add(some[ctx], shift, least)
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate([x[i] for x in out]), f.type) for i, f in enumerate(schema)], schema=schema)

    return shards.groupBy("shard").applyInArrow(rows, FOUND)


def large_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with many contexts: every window of every context, compared by aggregation."""
    merged = contexts.groupBy("h", "c", "ctx", "anchor").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    windows = merged.withColumn("shift", F.explode(F.sequence(F.greatest(F.lit(0), F.col("anchor") + length - F.octet_length("ctx")), F.least(F.col("anchor"), F.lit(length - gram)))))
    windows = windows.filter(F.octet_length("ctx") >= length).select("h", "c", "high", "shift", "low", F.expr(f"substring(ctx, anchor - shift + 1, {length})").alias("w"))
    least = windows.groupBy("w").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("w", "least")
    found = windows.join(least, "w").filter("least < high")
    by = found.groupBy("h", "c", "least").agg(F.sort_array(F.collect_set("shift")).alias("x"))
    # neighbouring windows of one key become one span: a run ends where the next shift isn't one more
    ends = F.filter(F.col("x"), lambda v: ~F.array_contains(F.col("x"), v + 1))
    heads = F.filter(F.col("x"), lambda v: ~F.array_contains(F.col("x"), v - 1))
    return by.select("h", "c", F.explode(F.arrays_zip(heads.alias("a"), ends.alias("b"))).alias("r"), "least").select("h", "c", (-F.col("r.b")).cast("int").alias("begin"), (length - F.col("r.a")).cast("int").alias("stop"), "least")


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def cut_texts(texts: DataFrame, marks: DataFrame, length: int, with_text: bool = False) -> DataFrame:
    """The result rows: texts without their spans; ``marks`` has (k, v, begin, stop), or k with a negative begin for copies."""
    more = ", kept_text binary" if with_text else ""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        k, v, begin, stop = (np.asarray(right.column(x).combine_chunks()) for x in ("k", "v", "begin", "stop"))
        order = np.lexsort((begin, v, k))
        k, v, begin, stop = k[order], v[order], begin[order].astype(np.int64), stop[order].astype(np.int64)
        variants = np.asarray(left.column("v").combine_chunks()) if left.num_rows else np.zeros(0, np.int32)
        keys = np.asarray(left.column("k").combine_chunks()) if left.num_rows else np.zeros(0, np.int64)
        out: list[tuple] = []
        for row, t in chunks(left.column("text")):
            ids = left.column("doc_id").slice(row, len(t)).to_pylist()
            own = keys[row : row + len(t)]
            lo, hi = np.searchsorted(k, own, side="left"), np.searchsorted(k, own, side="right")
            for i in range(len(t)):
                data = t.bytes(i)
                n = len(data)
                mine = v[lo[i] : hi[i]] == variants[row + i]
                a, b = begin[lo[i] : hi[i]][mine], stop[lo[i] : hi[i]][mine]
                if len(a) and a[0] < 0:  # a copy of an earlier text
                    a, b = (np.array([0]), np.array([n])) if n >= length else (a[:0], b[:0])
                removed = spans = 0
                kept = data
                if len(a):
                    b = np.minimum(b, n)
                    top = np.maximum.accumulate(b)
                    new = np.concatenate([[True], a[1:] > top[:-1]])
                    first = np.flatnonzero(new)
                    x, y = a[first], top[np.append(first[1:], len(a)) - 1]
                    removed, spans = int((y - x).sum()), len(x)
                    edges = np.concatenate([[0], np.stack([x, y], axis=1).ravel(), [n]]).tolist()
                    kept = b"".join(data[p:q] for p, q in zip(edges[::2], edges[1::2], strict=True))
                out.append((ids[i], n, removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * with_text
        return pa.table({n: pa.array([r[i] for r in out], kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))})

    return texts.groupBy("part").cogroup(marks.groupBy("part")).applyInArrow(rows, RESULT + more)


def copies_of_earlier(docs: DataFrame) -> DataFrame:
    """Keys of the documents whose text is a document's with a smaller key (128-bit hash of the text)."""
    h = docs.select("k", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("fathomline"), "text").alias("b"), F.octet_length("text").alias("n"))
    h = h.groupBy("a", "b", "n", "k").agg(F.count(F.lit(1)).alias("rows"))
    least = h.groupBy("a", "b", "n").agg(F.min("k").alias("least"), F.max("k").alias("most")).filter("least < most")
    return h.join(least, ["a", "b", "n"]).filter("k > least").select("k")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, hot: np.ndarray | None = None, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    with shuffles_go(spark):
        return _remove_repeats(docs, length, gram, with_text, hot, most_contexts)


def _remove_repeats(docs: DataFrame, length: int, gram: int, with_text: bool, hot: np.ndarray | None, most_contexts: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = _parts(spark, size)
    if hot is None:
        hot = sampled_hot(rows, size, length, gram)
    # a key with several texts isn't a copy, though one of its texts may be: such texts go the general way, numbered by v
    several = cut_lineage(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k"))
    copies = cut_lineage(with_part(copies_of_earlier(rows).join(several, "k", "left_anti"), parts))
    if several.isEmpty():
        texts = with_part(rows.withColumn("v", F.lit(0)), parts)
    else:
        named = rows.withColumn("__t", F.xxhash64("text"))
        numbers = named.select("k", "__t").join(several, "k", "left_semi").distinct().withColumn("__v", F.row_number().over(W.partitionBy("k").orderBy("__t")))
        texts = with_part(named.join(numbers, ["k", "__t"], "left").withColumn("v", F.coalesce("__v", F.lit(0))).drop("__t", "__v"), parts)
    repeated, repeated_path = written(repeated_anchors(rows, hot, parts, length, gram))
    marks = repeated.select("part", "places", F.lit(None).cast("long").alias("copy")).union(copies.select("part", F.lit(None).cast("binary"), "k"))
    found = occurrences(texts, marks, length, gram).withColumn("turn", F.pmod(F.xxhash64("h", F.lit(4)), F.lit(TURNS)).cast("int"))
    found, found_path = written(found, by="turn")
    remove_folder(spark, repeated_path)
    places = [written(with_part(placed(found.filter(F.col("turn") == t), parts, length, gram, most_contexts), parts)) for t in range(TURNS)]
    remove_folder(spark, found_path)
    spans = places[0][0]
    for more, _ in places[1:]:
        spans = spans.union(more)
    marks = spans.select("part", "k", "v", "begin", "stop").union(copies.select("part", "k", F.lit(0), F.lit(-1), F.lit(-1)))
    out = cut_lineage(cut_texts(texts, marks, length, with_text))
    for _, path in places:
        remove_folder(spark, path)
    return out


def placed(found: DataFrame, shards: int, length: int, gram: int, most_contexts: int) -> DataFrame:
    """(k, v, begin, stop): repeated spans of the documents, from the occurrences of some anchors."""
    contexts = found.filter("ctx is not null").select("h", "c", "ctx", "anchor", "low", "high")
    large = cut_lineage(contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most_contexts).select("h"))
    number = large.count()
    side = F.broadcast(large) if number <= BROADCAST_ANCHORS else large
    small = contexts.join(side, "h", "left_anti") if number else contexts
    spans = shard_spans(small.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int")), length, gram)
    if number:
        spans = spans.unionByName(large_spans(contexts.join(side, "h", "left_semi"), length, gram))
    return found.select("h", "c", "k", "v", "pos").join(spans, ["h", "c"]).filter("least < k").select("k", "v", (F.col("pos") + F.col("begin")).alias("begin"), (F.col("pos") + F.col("stop")).alias("stop"))


def op10(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
