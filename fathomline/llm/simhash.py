"""SimHash near-duplicates (9) by tiled exact comparison.

Texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+`` and shingles; a fingerprint bit is 1 where over half
the shingles' hashes have it. Distinct fingerprints are dealt to tiles by a key of population counts. A tile is compared
with another by numpy exclusive-or and bit counts only if their keys can hold fingerprints within the radius: the
Hamming distance is at least the sum of the blocks' differences of population counts, so no link is lost. Within a pair
of tiles only a spanning forest of the links goes on, never all pairs; components follow by star contraction.

Tiles, not single rows, are sent to the tiles they are compared with, and neighbouring keys are found by constant steps from
each key, so what is broadcast is a number for each key (17**4 keys, or some hundred).

Two keys are offered. ``block_key``: the population count of each quarter of the fingerprint, for small radii.
``size_key``: the total population count and the number of distinct shingles on a logarithmic scale, for wide
fingerprints with a large radius: texts whose shingle sets have a similarity of 0.8 differ by a quarter in size at most.
Fingerprints beside this key count every distinct shingle once, so that a repeated passage changes neither. They only
choose candidates: a link holds if the sets of shingles themselves have that similarity.

Comparison is exact, so its cost grows with the square of the number of distinct fingerprints times the share of tile
pairs that the keys let through; keys and tiles spread the pairs evenly over tasks, whatever the sizes of the groups.

Defined cases: null and empty texts and texts without words have fingerprint zero and are linked like any other; texts
with fewer words than a shingle give one shingle of all words; very long texts are read whole; rows that repeat a doc_id fall
into one component; a row without a doc_id links like any other, but has no say in its component's number, which is null
if no row has one; an empty table gives no rows; columns other than
doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.textbatch import CHUNK_BYTES, GOLDEN, SEPARATORS, Texts, byte_class, is_long, lower_ascii, map_texts, mix, one_text, stretches, words
from fathomline.operators.components import connected_components
from fathomline.session import cut_lineage

SEED = 42
#: Fingerprints to a tile, and shingles to a tile whose sets are compared.
TILE = 8192
TILE_ITEMS = 4 << 20
#: Pairs compared at once.
AT_ONCE = 1 << 20
BLOCKS = 4
#: Ratio of two neighbouring steps of the shingle count: 1 / 0.8.
STEP = 1.25


def shingle_hashes(t: Texts, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle, words joined by one space, and its document.

    A long text goes in stretches of whole words, each with the last words of the one before ahead of it.
    """
    if is_long(t):
        h = _long_hashes(t.buf, shingle, seed)
        return h, np.zeros(len(h), np.int64)
    return short_hashes(t, shingle, seed)


def short_hashes(t: Texts, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    t = Texts(lower_ascii(t.buf), t.offsets)
    starts, ends, doc = words(t)
    if not len(starts):
        return np.zeros(0, np.uint64), doc
    keep = np.zeros(len(t.buf) + 1, bool)
    depth = np.zeros(len(t.buf) + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    keep[:] = np.cumsum(depth) > 0
    gap = ends[:-1][doc[1:] == doc[:-1]]  # one separator after each word that has a next one in its document
    keep[gap] = True
    flat = np.append(t.buf, np.uint8(32))
    flat[gap] = 32
    at = np.concatenate([[0], np.cumsum(keep)])
    data = flat[keep].tobytes()
    per = np.bincount(doc, minlength=len(t))
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    number = np.where(per == 0, 0, np.maximum(per - shingle + 1, 1))
    owner = np.repeat(np.arange(len(t)), number)
    begin = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number) + first[owner]
    stop = np.minimum(begin + shingle, (first + per)[owner]) - 1
    digest = xxhash.xxh64_intdigest
    a, b = at[starts[begin]].tolist(), at[ends[stop]].tolist()
    return np.fromiter((digest(data[i:j], seed) for i, j in zip(a, b, strict=True)), np.uint64, len(a)), owner


def _long_hashes(buf: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    found: list[np.ndarray] = []
    last = np.zeros(0, np.uint8)
    for a, b in stretches(buf, byte_class(SEPARATORS), CHUNK_BYTES // 2):
        part = one_text(np.concatenate([last, np.array([32], np.uint8), buf[a:b]]))
        starts, ends, _ = words(part)
        if len(starts) >= shingle:
            found.append(short_hashes(part, shingle, seed)[0])
        keep = (shingle - 1) if len(starts) >= shingle else len(starts)
        last = part.buf[starts[-keep] :] if keep and len(starts) else np.zeros(0, np.uint8)
    return np.concatenate(found) if found else short_hashes(one_text(last), shingle, seed)[0]


def shingle_sets(t: Texts, shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, sorted as int64, and their document."""
    h, owner = shingle_hashes(t, shingle, seed)
    order = np.lexsort((h.view(np.int64), owner))
    h, owner = h[order], owner[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[first], owner[first]


def fingerprints(t: Texts, shingle: int, n_words: int = 1, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(documents x n_words) uint64 fingerprints, and the number of shingles of each document."""
    return fold(*shingle_hashes(t, shingle, seed), len(t), n_words)


def fold(h: np.ndarray, owner: np.ndarray, n_docs: int, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and numbers of shingles from the shingles' hashes."""
    number = np.bincount(owner, minlength=n_docs)
    out = np.zeros((n_docs, n_words), np.uint64)
    for k in range(n_words):
        ones = np.zeros((n_docs, 64), np.int64)
        for at in range(0, len(h), AT_ONCE // 8):  # a hash is 64 bytes as bits
            part, of = h[at : at + AT_ONCE // 8], owner[at : at + AT_ONCE // 8]
            own = part if k == 0 else mix(part + np.uint64(k * int(GOLDEN) % (1 << 64)))
            bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            edges = np.flatnonzero(np.diff(of, prepend=-1))
            ones[of[edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int32)
        out[:, k] = np.packbits(2 * ones > number[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out, number


#: Digits of a key are this far apart, so that a step beyond 0 or 16 meets no key.
DIGIT = 32


def block_key(fp: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters of a one-word fingerprint, as digits."""
    counts = np.bitwise_count(np.ascontiguousarray(fp[:, 0]).view(np.uint16).reshape(-1, BLOCKS)).astype(np.int64)
    return (counts + 4) @ (DIGIT ** np.arange(BLOCKS))


def block_steps(radius: int) -> list[int]:
    """Steps from a key to those whose fingerprints can lie within the radius (4 at most)."""
    return sorted(sum(m * DIGIT**i for i, m in enumerate(move)) for move in product(range(-radius, radius + 1), repeat=BLOCKS) if sum(map(abs, move)) <= radius)


def size_key(radius: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Steps of the shingle count on a logarithmic scale times 1000, plus the total population count by the radius."""

    def key(fp: np.ndarray, number: np.ndarray) -> np.ndarray:
        step = np.where(number > 0, 1 + np.floor(np.log(np.maximum(number, 1)) / math.log(STEP)), -8).astype(np.int64)
        return step * 1000 + 500 + np.bitwise_count(fp).sum(axis=1).astype(np.int64) // (radius + 1)

    return key


SIZE_STEPS = [1000 * i + j for i in (-1, 0, 1) for j in (-1, 0, 1)]


def spanning(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the labels of linked nodes in place: each node's label is the smallest index known to be linked."""
    while len(u):
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        labels[np.maximum(a, b)] = np.minimum(a, b)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up


def tile_links(a: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links between two tiles (or within one), as indices into a followed by b."""
    n, m = len(a), len(b)
    labels = np.arange(n if same else n + m)
    rows = max(1, AT_ONCE // max(m, 1))
    for at in range(0, n, rows):
        part = a[at : at + rows]
        far = np.zeros((len(part), m), np.uint16)
        for k in range(a.shape[1]):
            far += np.bitwise_count(part[:, k, None] ^ b[None, :, k])
        i, j = np.nonzero(far <= radius)
        spanning(labels, i + at, j if same else j + n)
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return moved, labels[moved]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    far = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        far += np.bitwise_count(a[:, k, None] ^ b[None, :, k])
    return far


def near_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs whose sets' sizes allow a similarity of 0.8."""
    return (5 * a[:, None] >= 4 * b[None, :]) & (5 * b[None, :] >= 4 * a[:, None])


def partners(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two tiles have a candidate in the other one (or in their own)."""
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    rows = max(1, AT_ONCE // max(len(b), 1))
    for at in range(0, len(a), rows):
        i, j = np.nonzero(distances(a[at : at + rows], b) <= radius)
        fit = (5 * size_a[i + at] >= 4 * size_b[j]) & (5 * size_b[j] >= 4 * size_a[i + at])
        if same:
            fit &= i + at != j
        in_a[i[fit] + at] = True
        in_b[j[fit]] = True
    return in_a, in_b


def set_links(fp: np.ndarray, side: np.ndarray, edges: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of side 0 and 1 (within side 0 if there is no other) whose sets have a similarity of 0.8.

    Row i's set is ``items[edges[i] : edges[i + 1]]``, sorted. Candidates by ``radius`` are checked unless links
    found before join them already, so that the result has the components of all links.
    """
    size = np.diff(edges)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    right = left if same else right
    labels = np.arange(len(fp))
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []
    rows = max(1, AT_ONCE // max(len(right), 1))
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        near = (distances(fp[part], fp[right]) <= radius) & near_sizes(size[part], size[right])
        if same:
            near &= part[:, None] < right[None, :]
        for k in np.flatnonzero(near.any(axis=1)):
            i, others = part[k], right[near[k]]
            others = others[labels[others] != labels[i]]
            if not len(others):
                continue
            own = items[edges[i] : edges[i + 1]]
            cuts = np.flatnonzero(np.diff(np.cumsum(size[others]) // AT_ONCE)) + 1
            alike = []
            for js in np.split(others, cuts):
                n = size[js]
                first = np.cumsum(n) - n
                values = items[np.arange(n.sum()) + np.repeat(edges[js] - first, n)]
                hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                both = np.add.reduceat(hit.astype(np.int64), first)
                alike.append(js[9 * both >= 4 * (n + len(own))])
            js = np.concatenate(alike)
            if len(js):
                joined, at_first = np.unique(labels[js], return_index=True)
                u.append(np.full(len(at_first), i))
                v.append(js[at_first])
                joined = np.append(joined, labels[i])
                labels[np.isin(labels, joined)] = joined.min()
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *u]), np.concatenate([none, *v])


def fingerprint_table(docs: DataFrame, shingle: int, n_words: int, key: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp as big-endian bytes, tile_key), one pass over the texts."""

    def of(t: Texts) -> dict[str, object]:
        fp, number = fingerprints(t, shingle, n_words)
        raw = fp.astype(">u8").tobytes()
        width = 8 * n_words
        return {"fp": pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), "tile_key": key(fp, number)}

    return map_texts(docs, text_col, [id_col], of, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp binary, tile_key long")


def tile_pairs(reps: DataFrame, steps: list[int], names: tuple[str, ...], tile: int = TILE) -> DataFrame:
    """Pairs of tiles that can hold links: the columns ``names`` of ``reps`` as arrays ``*_a`` and ``*_b``, the pair's name, and whether it is one tile with itself.

    A tile has about ``tile`` rows, and ``TILE_ITEMS`` shingles where the rows have a size.
    """
    n = F.ceil(F.count(F.lit(1)) / tile)
    if "size" in names:
        n = F.greatest(n, F.ceil(F.sum("size") / TILE_ITEMS))
    # as many rows as there are keys at most, a number that the key function bounds (17**4, or a few hundred)
    keys = cut_lineage(reps.groupBy("tile_key").agg(n.cast("int").alias("parts")))
    spread = reps.join(F.broadcast(keys), "tile_key").withColumn("part", F.pmod(F.xxhash64(names[-1]), F.col("parts")).cast("int"))
    tiles = cut_lineage(
        spread.groupBy("tile_key", "part")
        .agg(F.collect_list(F.struct(*names)).alias("x"))
        .select("tile_key", "part", *(F.col(f"x.{c}").alias(c) for c in names))
    )
    step = F.explode(F.array(*[F.lit(x).cast("long") for x in steps if x >= 0])).alias("step")
    others = F.broadcast(keys.select(F.col("tile_key").alias("to_key"), F.col("parts").alias("to_parts")))
    left = tiles.select("*", step).withColumn("to_key", F.col("tile_key") + F.col("step")).join(others, "to_key")
    left = left.select(
        "to_key",
        F.explode(F.sequence(F.lit(0), F.col("to_parts") - 1)).alias("to_part"),
        F.col("tile_key").alias("from_key"),
        F.col("part").alias("from_part"),
        *(F.col(c).alias(f"{c}_a") for c in names),
    )
    left = left.filter("to_key > from_key or to_part >= from_part")
    right = tiles.select(F.col("tile_key").alias("to_key"), F.col("part").alias("to_part"), *(F.col(c).alias(f"{c}_b") for c in names))
    pair = F.concat_ws(":", "from_key", "from_part", "to_key", "to_part").alias("pair")
    same = ((F.col("from_key") == F.col("to_key")) & (F.col("from_part") == F.col("to_part"))).alias("same")
    return left.join(right.hint("shuffle_hash"), ["to_key", "to_part"]).select(*(f"{c}_{side}" for side in "ab" for c in names), same, pair)


def linked(reps: DataFrame, radius: int, steps: list[int], n_words: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between rows (rep, fp, tile_key) with links: a spanning forest for each pair of tiles."""
    pairs = tile_pairs(reps, steps, ("rep", "fp"), tile).drop("pair")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            columns = [batch.column(i) for i in range(4)]
            ids = [np.asarray(c.flatten()) for c in columns[::2]]
            fps = [np.frombuffer(b"".join(c.flatten().to_pylist()), ">u8").astype(np.uint64).reshape(-1, n_words) for c in columns[1::2]]
            edges = [np.concatenate([[0], np.cumsum(np.asarray(c.value_lengths()))]) for c in columns[::2]]
            for k, same in enumerate(batch.column(4).to_pylist()):
                (a0, a1), (b0, b1) = (e[k : k + 2] for e in edges)
                u, v = tile_links(fps[0][a0:a1], fps[1][b0:b1], same, radius)
                if len(u):
                    names = ids[0][a0:a1] if same else np.concatenate([ids[0][a0:a1], ids[1][b0:b1]])
                    found.append((names[u], names[v]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in found])) for i in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(compare, "a long, b long")


def same_id(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that tie together the fingerprints of rows with one doc_id."""
    several = prints.groupBy(F.col("doc_id").alias("id")).agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("id is not null and a <> z")
    return prints.join(several, F.col("doc_id") == F.col("id")).select("a", F.col("rep").alias("b"))


def components(docs: DataFrame, shingle: int = 3, radius: int = 2, tile: int = TILE) -> DataFrame:
    """(doc_id, fingerprint as hex, component_id) of every row of ``docs``.

    Fingerprints of one word are their own names in the graph, so that a row without an id links as any other does; a component's
    number is its smallest doc_id, null if none of its rows has one.
    """
    name = F.conv(F.hex("fp"), 16, -10).cast("long")
    prints = cut_lineage(fingerprint_table(docs, shingle, 1, block_key).withColumn("rep", name))
    reps = cut_lineage(prints.groupBy("rep", "fp", "tile_key").agg(F.min("doc_id").alias("least")))
    found = connected_components(linked(reps, radius, block_steps(radius), 1, tile).unionByName(same_id(prints)))
    named = reps.join(found, reps["rep"] == found["node"], "left").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    number = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(number, "component").select("rep", "component_id"), "rep").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def set_table(rows: DataFrame, shingle: int, radius: int, n_words: int, with_items: bool = False) -> DataFrame:
    """(doc_id, t, fp, tile_key, size, digest) of each text's set of shingles; ``with_items`` adds the set itself."""
    key = size_key(radius)

    def of(t: Texts) -> dict[str, object]:
        h, owner = shingle_sets(t, shingle)
        fp, number = fold(h, owner, len(t), n_words)
        raw, width = fp.astype(">u8").tobytes(), 8 * n_words
        edges = np.concatenate([[0], np.cumsum(number)])
        digests = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        made = {"fp": pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary()), "tile_key": key(fp, number), "size": number.astype(np.int64), "digest": pa.array(digests, pa.binary())}
        return made | ({"items": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h.view(np.int64)))} if with_items else {})

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t long, fp binary, tile_key long, size long, digest binary"
    return map_texts(rows, "text", ["doc_id", "t"], of, schema + ", items array<long>" * with_items)


def verified(rows: DataFrame, reps: DataFrame, shingle: int, radius: int, n_words: int, tile: int = TILE) -> DataFrame:
    """Edges (a, b) between the digests of rows (first, fp, tile_key, size, digest) whose sets of shingles have a similarity of 0.8.

    Fingerprints choose the candidates; only those texts' sets are made again, and go once to each pair of tiles in
    which the text has a candidate.
    """
    pairs = tile_pairs(reps, SIZE_STEPS, ("fp", "size", "digest"), tile)

    def as_words(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, n_words)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                one = batch.slice(row, 1)
                fp_a, size_a, digest_a, fp_b, size_b, digest_b = (one.column(i).flatten() for i in range(6))
                same, pair = one.column(6)[0].as_py(), one.column(7)[0].as_py()
                in_a, in_b = partners(as_words(fp_a), np.asarray(size_a), as_words(fp_b), np.asarray(size_b), same, radius)
                for side, digest, chosen in ((0, digest_a, in_a), (1, digest_b, in_b))[: 1 if same else 2]:
                    digest = digest.filter(pa.array(chosen))
                    if len(digest):
                        yield pa.RecordBatch.from_arrays([pa.array([pair] * len(digest)), pa.array(np.full(len(digest), side, np.int32)), digest], names=["pair", "side", "digest"])

    chosen = cut_lineage(pairs.mapInArrow(candidates, "pair string, side int, digest binary"))
    wanted = reps.join(chosen.select("digest").distinct(), "digest", "left_semi").select("first.doc_id", "first.t").withColumnRenamed("doc_id", "id").withColumnRenamed("t", "own_t")
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t") == F.col("own_t")), "left_semi")
    sets = set_table(texts, shingle, radius, n_words, with_items=True).select("digest", "fp", "items").dropDuplicates(["digest"])

    def verify(table: pa.Table) -> pa.Table:
        names, items = table.column("digest").combine_chunks(), table.column("items").combine_chunks()
        edges = np.concatenate([[0], np.cumsum(np.asarray(items.value_lengths()))])
        u, v = set_links(as_words(table.column("fp")), np.asarray(table.column("side")), edges, np.asarray(items.flatten()), radius)
        return pa.table({"a": names.take(pa.array(u)), "b": names.take(pa.array(v))})

    return chosen.join(sets, "digest").groupBy("pair").applyInArrow(verify, "a binary, b binary")


def set_components(rows: DataFrame, shingle: int, radius: int, n_words: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t, digest) of every row (doc_id, t, text), and (digest, component) of every digest of a set of shingles.

    Components are those of the pairs of sets with a similarity of 0.8.
    """
    prints = cut_lineage(set_table(rows, shingle, radius, n_words))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    reps = cut_lineage(prints.groupBy("digest").agg(first, *(F.min(c).alias(c) for c in ("fp", "tile_key", "size"))))
    # sets of under four differ from any other set by more than a fifth
    found = connected_components(verified(rows, reps.filter("size >= 4"), shingle, radius, n_words, tile))
    named = reps.select("digest").join(found, F.col("digest") == F.col("node"), "left").select("digest", F.coalesce("component", "digest").alias("component"))
    return prints.select("doc_id", "t", "digest"), named


def op9(spark, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The pipeline's stage: five-word shingles, 256-bit fingerprints. A bit of two sets with a similarity of 0.8 differs with
#: a chance of 0.15 (39 bits), or 0.19 for sets of four and five: of such pairs under 1 in 10 million, or 1 in 10,000, are
#: over 72 bits apart.
STAGE = {"shingle": 5, "radius": 72, "n_words": 4}


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents with one of each group of near-duplicates: that with the smallest doc_id, null last.

    Rows that share a doc_id but not the text are documents of their own. Rows that share both are copies: of those, and of
    a group's rows with its smallest doc_id, the one with the smallest hash of text and then of the other columns stays, so
    that a task that runs again chooses alike. Null and empty texts and texts without words are one group.
    """
    t = F.xxhash64(F.coalesce("text", F.lit("")))
    prints, named = set_components(docs.select("doc_id", "text", t.alias("t")), **(STAGE | options))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")).alias("first")
    keep = prints.join(named, "digest").groupBy("component").agg(first).select(F.col("first.doc_id").alias("id"), F.col("first.t").alias("t"))
    several = cut_lineage(prints.groupBy(F.col("doc_id").alias("id"), "t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "t"))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), t.alias("t"), F.xxhash64(*plain).alias("tie"))

    def within(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("id").alias("other"), F.col("t").alias("other_t"))
        return left.join(right, F.col("id").eqNullSafe(F.col("other")) & (F.col("t") == F.col("other_t")), how)

    kept = within(rows, keep, "left_semi")
    if not several.isEmpty():
        again = within(kept, several, "left_semi").groupBy("id", "t").agg(F.min_by("row", "tie").alias("row"))
        kept = within(kept, several, "left_anti").select("row").unionByName(again.select("row"))
    return kept.select("row.*")
