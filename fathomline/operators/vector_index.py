"""A vector index kept in files: two levels of centres, product-quantised codes by list, exact scores for a short list.

Vectors are brought to length 1. A bounded sample fits the centres (cells, and lists within each cell; their number grows as the
square root of the rows) and, for each of some groups of coordinates, a code book. Every row is then written once, under the
folder of its list, with a byte for each group beside its vector. A search of many queries compares them with the centres, reads the
codes alone of the lists it looks into, and the vectors of the rows alone whose coded scores are best, which are scored exactly.

``nearest``, the search of one query, finds the same rows as a comparison with all: the k-th cosine of such a short list is a
bound, a row's distance from its code and a list's widest angle say what they can reach at most, and whatever can reach the
bound is scored exactly.

How many lists are looked into and how many rows are scored exactly is measured when the index is written: exact neighbours of some
of the sample's vectors must be found in the share ``target``. Where vectors have no clusters that is most lists (their codes are
an eighth or less of the vectors' bytes), where they have it is few.

Null, empty and zero vectors are left out; ties go to the smaller id; an empty table makes an index that finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators.retrieval import best_per, block_matches
from fathomline.session import bounded_batches, cut_lineage

#: Vectors on which centres and code books are fitted, those of them compared at once, and queries on which the index is measured, at most.
FIT_MOST, FIT_ROWS = 1 << 16, 1 << 12
MEASURED = 64
MEASURED_K = 10
#: Coordinates to a group, entries to a code book, lists at most, folders at most.
GROUP, ENTRIES, MOST_LISTS, FOLDERS = 4, 256, 1 << 14, 256
#: Queries and coded rows that one task compares at once.
QUERIES, ROWS = 256, 1 << 14
#: What bounds allow for rounding.
SLACK = 1e-6


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-150)[:, None]


def own_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, some thousand rows at once: the driver holds no table of all rows by all centres."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + FIT_ROWS] @ centres.T - half, axis=1) for i in range(0, len(x), FIT_ROWS)])


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres by plain k-means, begun at rows spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        own = own_centre(x, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    path: str
    #: Centres of the cells, of the lists, and the cell of each list.
    cells: np.ndarray
    lists: np.ndarray
    cell_of: np.ndarray
    #: (groups, entries, coordinates)
    books: np.ndarray
    #: Lists that a search looks into, and rows that it scores exactly.
    probed: int
    short: int
    rows: int
    #: The widest angle between each list's centre and a row of it.
    spread: np.ndarray | None = None

    def own_list(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector: the best of its best cell."""
        cell = np.argmax(x @ self.cells.T, axis=1)
        score = np.where(cell[:, None] == self.cell_of[None, :], x @ self.lists.T, -np.inf)
        return np.argmax(score, axis=1)

    def looked_into(self, x: np.ndarray, n: int | None = None) -> np.ndarray:
        """The lists that each query looks into, best first."""
        return np.argsort(-(x @ self.lists.T), axis=1, kind="stable")[:, : n or self.probed]

    def reaching(self, x: np.ndarray, least: float) -> np.ndarray:
        """The lists that may hold a row with a cosine of ``least`` to one query."""
        angle = np.arccos(np.clip(self.lists @ x, -1, 1)) - self.spread
        return np.flatnonzero(np.cos(np.maximum(angle - SLACK, 0)) >= least - SLACK)

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(self.books)), np.uint8)
        for g, book in enumerate(self.books):
            part = x[:, g * GROUP : (g + 1) * GROUP]
            out[:, g] = np.argmax(part @ book.T - (book * book).sum(axis=1) / 2, axis=1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, g]] for g, book in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, groups, entries): what each code adds to a query's score."""
        return np.stack([q[:, g * GROUP : (g + 1) * GROUP] @ book.T for g, book in enumerate(self.books)], axis=1)

    def for_(self, k: int) -> int:
        """Rows to score exactly for k neighbours."""
        return max(k, -(-self.short * k // MEASURED_K))

    def folder(self, which: np.ndarray) -> np.ndarray:
        return which * min(FOLDERS, len(self.lists)) // max(1, len(self.lists))


def coded_scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows) scores of coded rows."""
    out = np.zeros((len(tables), len(codes)))
    for g in range(tables.shape[1]):
        out += tables[:, g, :][:, codes[:, g]]
    return out


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows to one query, summed one coordinate after another as SQL's are: what ties there ties here."""
    dot, length, q_length = np.zeros(len(x)), np.zeros(len(x)), 0.0
    for v, w in zip(x.T, q, strict=True):
        dot, length, q_length = dot + v * w, length + v * v, q_length + w * w
    return np.clip(dot / np.sqrt(length * q_length), -1, 1)


def as_codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def as_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, width)


def usable(rows: DataFrame) -> DataFrame:
    """(id, vector) with a vector that has a direction, as doubles."""
    vector = F.col("vector").cast("array<double>")
    some = F.col("vector").isNotNull() & F.exists(vector, lambda v: v != 0)
    return rows.filter(some).select(F.col("id").cast("long").alias("id"), vector.alias("vector"))


def fit(sample: np.ndarray, rows: int, path: str) -> VectorIndex:
    x = unit(sample)
    n = int(np.clip(round(rows**0.5), 1, min(MOST_LISTS, max(1, len(x) // 4))))
    cells = unit(k_means(x, max(1, round(n**0.5))))
    own = np.argmax(x @ cells.T, axis=1)
    lists, cell_of = [], []
    for c in range(len(cells)):
        mine = x[own == c]
        centres = unit(k_means(mine, max(1, round(n * len(mine) / len(x))))) if len(mine) else cells[c : c + 1]
        lists.append(centres)
        cell_of += [c] * len(centres)
    width = x.shape[1]
    padded = np.pad(x, ((0, 0), (0, -width % GROUP)))
    books = np.stack([k_means(padded[:, g : g + GROUP], min(ENTRIES, max(1, len(x) // 2))) for g in range(0, padded.shape[1], GROUP)])
    return VectorIndex(path, cells, np.concatenate(lists), np.array(cell_of), books, 1, 1, rows)


def build(rows: DataFrame, path: str, target: float = 0.95, fit_most: int = FIT_MOST) -> VectorIndex:
    """Write the index of (id, vector) under ``path`` and return it, measured for ten neighbours."""
    ready = usable(rows)
    n = ready.count()
    # the sample goes by a hash of the id: any part of the table may be in it
    share = min(1.0, 1.2 * fit_most / max(n, 1))
    sample = ready.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(fit_most).toArrow()
    spark = rows.sparkSession
    if not len(sample):
        index = VectorIndex(path, *(np.zeros((0, 0)),) * 2, np.zeros(0, int), np.zeros((0, 0, 0)), 0, 0, 0)
        ready.select("id", F.lit(0).alias("list"), F.lit(b"").alias("code"), F.lit(0.0).alias("off"), F.lit(0.0).alias("angle"), "vector", F.lit(0).alias("folder")).limit(0).write.partitionBy("folder").parquet(f"{path}/rows")
        return index
    width = len(sample["vector"][0])
    index = fit(as_matrix(sample["vector"].combine_chunks(), width), n, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unit(as_matrix(batch.column(1), width)) if len(batch) else np.zeros((0, width))
            own = index.own_list(x)
            padded = np.pad(x, ((0, 0), (0, -width % GROUP)))
            codes = index.encode(padded)
            off = np.sqrt(((padded - index.decode(codes)) ** 2).sum(axis=1))
            angle = np.arccos(np.clip((x * index.lists[own]).sum(axis=1), -1, 1))
            made = [batch.column(0), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array(angle), batch.column(1), pa.array(index.folder(own).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, names=["id", "list", "code", "off", "angle", "vector", "folder"])

    coded = ready.mapInArrow(run, "id long, list int, code binary, off double, angle double, vector array<double>, folder int")
    # a large list is dealt over several tasks and files
    coded.repartition(F.col("folder"), F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("folder", "list", "id").write.partitionBy("folder").parquet(f"{path}/rows")
    index = replace(measured(spark, index, sample, target), spread=spread_of(spark, index))
    meta = {"cells": index.cells, "lists": index.lists, "books": index.books.reshape(-1, index.books.shape[2])}
    flat = [(name, i, [float(v) for v in row]) for name, m in meta.items() for i, row in enumerate(m)]
    flat += [("cell_of", 0, [float(c) for c in index.cell_of]), ("spread", 0, index.spread.tolist()), ("numbers", 0, [float(v) for v in (index.probed, index.short, index.rows, len(index.books))])]
    spark.createDataFrame(flat, "name string, i int, v array<double>").coalesce(1).write.parquet(f"{path}/meta")
    return index


def read(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``build`` has written: its centres and code books are bounded, its rows stay in their files."""
    found: dict[str, list] = {}
    for r in spark.read.parquet(f"{path}/meta").orderBy("name", "i").collect():
        found.setdefault(r["name"], []).append(r["v"])
    probed, short, rows, groups = (int(v) for v in found["numbers"][0])
    books = np.array(found["books"]).reshape(groups, -1, GROUP)
    return VectorIndex(path, np.array(found["cells"]), np.array(found["lists"]), np.array(found["cell_of"][0], int), books, probed, short, rows, np.array(found["spread"][0]))


def spread_of(spark: SparkSession, index: VectorIndex) -> np.ndarray:
    """The widest angle in each list: a number a list."""
    out = np.zeros(len(index.lists))
    for r in rows_of(spark, index).groupBy("list").agg(F.max("angle").alias("angle")).collect():
        out[r["list"]] = r["angle"]
    return out


def rows_of(spark: SparkSession, index: VectorIndex, lists: np.ndarray | None = None) -> DataFrame:
    """The index's rows, or those of some lists: their folders are pruned, the lists' numbers pushed to the files."""
    rows = spark.read.parquet(f"{index.path}/rows")
    if lists is None or len(lists) == len(index.lists):
        return rows
    return rows.filter(F.col("folder").isin(np.unique(index.folder(lists)).tolist()) & F.col("list").isin(np.unique(lists).tolist()))


def measured(spark: SparkSession, index: VectorIndex, sample, target: float, k: int = MEASURED_K) -> VectorIndex:
    """The index with the least numbers that find ``target`` of the exact neighbours of some sampled vectors."""
    few = sample.take(np.arange(0, len(sample), max(1, len(sample) // MEASURED))[:MEASURED]).to_pandas()
    q = unit(np.stack(few["vector"].to_list()))
    width = q.shape[1]
    asked = spark.createDataFrame([(0, int(i), [float(v) for v in x]) for i, x in zip(few["id"], few["vector"], strict=True)], "bucket int, id long, vector array<double>")
    rows = rows_of(spark, index)
    near = block_matches(asked, rows.select(F.lit(0).alias("bucket"), "id", "vector"), k)  # k rows at most for each of the sampled
    true = rows.select(F.col("id").alias("other"), "list", "code").join(F.broadcast(near), "other").select("id", "other", "list", "code").toPandas()
    if not len(true):
        return replace(index, probed=len(index.lists), short=max(1, k))
    at = {int(i): n for n, i in enumerate(few["id"])}
    number = true["id"].map(at).to_numpy()
    place = np.argsort(index.looked_into(q, len(index.lists)), axis=1)
    needed = np.sort(place[number, true["list"].to_numpy()])
    half = (1 + target) / 2  # each of the two steps may lose half of what may be lost
    probed = int(needed[min(len(needed) - 1, int(np.ceil(half * len(needed))) - 1)]) + 1
    tables = index.tables(np.pad(q, ((0, 0), (0, -width % GROUP))))
    codes = np.frombuffer(b"".join(true["code"]), np.uint8).reshape(len(true), -1)
    least = np.array([coded_scores(tables[n : n + 1], c[None, :])[0, 0] for n, c in zip(number, codes, strict=True)])
    chosen = index.looked_into(q, probed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = np.zeros(len(least), np.int64)
        for batch in batches:
            if len(batch):
                scores = coded_scores(tables, as_codes(batch.column(1)))
                own = np.asarray(batch.column(0))
                scores[~np.any(chosen[:, :, None] == own[None, None, :], axis=1)] = -np.inf
                above += (scores[number] > least[:, None]).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(least))), pa.array(above)], names=["i", "n"])

    above = rows.select("list", "code").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()["n"].to_numpy()
    short = max(k, int(np.sort(above)[min(len(above) - 1, int(np.ceil(half * len(above))) - 1)]) + 1)
    return replace(index, probed=probed, short=short)


def nearest(spark: SparkSession, index: VectorIndex, query: list[float], k: int) -> DataFrame:
    """(id, score): the k rows nearest to one query, with exact cosines; equal ones by id.

    Rows of the lists looked into with the best coded scores give a bound, the k-th of their cosines (none where they are fewer);
    then all lists and rows that may reach it are scored, in tasks that keep k rows of a batch.
    """
    given = np.array(query, float)
    q = unit(given[None, :]) if index.rows else np.zeros((1, 0))
    if not index.rows or not np.any(q):
        return spark.createDataFrame([], "id long, score double")
    short, width = index.for_(k), q.shape[1]
    lists = index.looked_into(q)[0]
    table = index.tables(np.pad(q, ((0, 0), (0, -q.shape[1] % GROUP))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                scores = coded_scores(table, as_codes(batch.column(1)))[0]
                ids = np.asarray(batch.column(0))
                best = np.lexsort((ids, -scores))[:short]
                yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(scores[best])], names=["id", "coded"])

    rows = rows_of(spark, index, lists)
    found = rows.select("id", "code").mapInArrow(run, "id long, coded double").orderBy(F.desc("coded"), "id").limit(short)
    vectors = rows.select("id", "vector").join(F.broadcast(found), "id")
    best = exact(vectors.withColumn("q", F.lit(q[0].tolist())), "q").orderBy(F.desc("score")).limit(k)
    first = best.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    least = first["least"] if first["n"] == k else -np.inf

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = coded_scores(table, as_codes(batch.column(1)))[0] + np.asarray(batch.column(2)) if len(batch) else np.zeros(0)
            some = batch.filter(pa.array(reach >= least - SLACK))
            if len(some):
                scores = cosines(as_matrix(some.column(3), width), given)
                ids = np.asarray(some.column(0))
                nearest_ones = np.lexsort((ids, -scores))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[nearest_ones]), pa.array(scores[nearest_ones])], names=["id", "score"])

    bounded_batches(spark)
    may = rows_of(spark, index, index.reaching(q[0], least)).select("id", "code", "off", "vector")
    return may.mapInArrow(score, "id long, score double").orderBy(F.desc("score"), "id").limit(k)


def exact(df: DataFrame, query: str) -> DataFrame:
    dot = F.aggregate(F.zip_with("vector", query, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("score", dot / length)


def search(queries: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(id, other, sim): about the k rows nearest to each query (id, vector), but for itself.

    Lists and the queries that look into them meet in blocks of bounded size, dealt over tasks: neither an uneven list nor
    many queries make a long task.
    """
    spark = queries.sparkSession
    ready = usable(queries)
    if not index.rows:
        return ready.select("id", F.col("id").alias("other"), F.lit(0.0).alias("sim")).limit(0)
    width = index.lists.shape[1]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = unit(as_matrix(batch.column(1), width))
                lists = index.looked_into(x)
                at = pa.array(np.repeat(np.arange(len(batch)), lists.shape[1]))
                unit_x = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), unit_x.take(at), pa.array(lists.ravel().astype(np.int32))], names=["id", "vector", "list"])

    asked = cut_lineage(ready.mapInArrow(choose, "id long, vector array<double>, list int"))
    rows = rows_of(spark, index)
    by = lambda d, most: F.broadcast(d.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")))
    q = asked.join(by(asked, QUERIES), "list").withColumn("q_part", F.pmod(F.xxhash64("id"), F.col("parts"))).groupBy("list", "q_part").agg(F.collect_list("id").alias("ids"), F.collect_list("vector").alias("vectors"))
    sizes = by(rows.select("list"), ROWS)
    r = rows.select("id", "list", "code").join(sizes, "list").withColumn("r_part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).groupBy("list", "r_part").agg(F.collect_list("id").alias("others"), F.collect_list("code").alias("codes"))
    # arrays are planned as one element: without the hints blocks and the index's vectors are taken for small and broadcast
    pairs = q.join(sizes, "list").withColumn("r_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(r.hint("merge"), ["list", "r_part"])
    short = index.for_(k) + 1

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                ids, others = (np.asarray(one.column(c).flatten()) for c in (0, 2))
                x = as_matrix(one.column(1).flatten(), width)
                codes = np.frombuffer(b"".join(one.column(3).flatten().to_pylist()), np.uint8).reshape(len(others), -1)
                scores = coded_scores(index.tables(np.pad(x, ((0, 0), (0, -width % GROUP)))), codes)
                best = np.lexsort((np.broadcast_to(others, scores.shape), -scores), axis=1)[:, :short]
                at = np.repeat(np.arange(len(ids)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(others[best.ravel()]), pa.array(scores[at, best.ravel()])], names=["id", "other", "coded"])

    bounded_batches(spark)
    coded = pairs.select("ids", "vectors", "others", "codes").mapInArrow(compare, "id long, other long, coded double").filter("id <> other")
    kept = cut_lineage(best_per(coded, ["id"], [F.desc("coded"), F.asc("other")], index.for_(k)).select("id", "other"))
    own = ready.select("id", F.col("vector").alias("q"))
    scored = kept.join(rows.select(F.col("id").alias("other"), "vector").hint("merge"), "other").join(own, "id")
    q_length = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, x: s + x * x))
    sims = exact(scored, "q").select("id", "other", (F.col("score") / q_length).alias("sim"))
    return best_per(sims, ["id"], [F.desc("sim"), F.asc("other")], k)
