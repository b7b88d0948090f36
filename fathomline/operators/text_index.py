"""A full-text index in files: postings with positions, in generations that are brought up to date in part.

A posting is (key, term, class, positions): where the term stands in the document's tokens, classes one after another. Terms
may be stems (``stemmer``). Postings are files by generation and folder of the term, sorted by term; Parquet's second version
keeps positions in delta-coded blocks. A search reads the folders of its terms alone and settles words, phrases and nearness
from positions: no text is read.

A change to some documents is a new generation of their postings and a row for each of them that takes back what older generations
hold (``gone``). ``manifest`` names the generations that count; a reader takes its newest version, so a search sees one state
while the next is written. ``compact`` merges generations that have become many.

Null texts have no terms; an empty index finds nothing; document keys are of any type.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text as T
from fathomline.functions.stemmer import stem
from fathomline.operators.retrieval import CLASS_WEIGHTS, folder_of, parse_query
from fathomline.session import bounded_batches, remove_folder

#: Generations up to which nothing is merged, and rows of ``gone`` up to which they are broadcast.
GENERATIONS, BROADCAST_GONE = 8, 100_000


def postings(docs: DataFrame, key: str, classes: dict[str, Column], stems: bool = False) -> DataFrame:
    """(key, term, class, positions) of the documents; a document is taken whole, so nothing is shuffled.

    Rows of one key are documents that a search takes as one.
    """
    names = list(classes)
    tokens = [T.tokens(F.coalesce(col, F.lit(""))).alias(f"__{i}") for i, col in enumerate(classes.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.zeros(len(batch), np.int64)
            for i, name in enumerate(names):
                lists = batch.column(1 + i)
                sizes = np.asarray(lists.value_lengths())
                doc = np.repeat(np.arange(len(batch)), sizes)
                at = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + before[doc]
                before += sizes
                once = lists.flatten().dictionary_encode()
                words, codes = once.dictionary, np.asarray(once.indices)
                if stems:
                    stemmed = pa.array([stem(w) for w in words.to_pylist()], pa.string()).dictionary_encode()
                    words, codes = stemmed.dictionary, np.asarray(stemmed.indices)[codes]
                # the words of a document in turn, each word's places in order
                order = np.argsort(doc * max(1, len(words)) + codes, kind="stable")
                doc, codes = doc[order], codes[order]
                first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(codes, prepend=-1) != 0))
                ends = pa.array(np.append(first, len(doc)).astype(np.int32))
                places = pa.ListArray.from_arrays(ends, pa.array(at[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[first])), words.take(pa.array(codes[first])), pa.array([name] * len(first), pa.string()), places], names=["key", "term", "class", "positions"])

    bounded_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), *tokens).mapInArrow(run, f"key {kind}, term string, class string, positions array<int>")


@dataclass(frozen=True)
class TextIndex:
    path: str
    stems: bool = False

    def terms(self, query: str) -> list[str]:
        return sorted({self.term(w) for w in parse_query(query).terms()})

    def term(self, word: str) -> str:
        return stem(word) if self.stems else word


def _manifest(spark: SparkSession, index: TextIndex) -> tuple[int, list[int]]:
    """The newest version and its generations."""
    rows = spark.read.parquet(f"{index.path}/manifest").collect()  # a row for each generation of each version kept
    version = max(r["version"] for r in rows)
    return version, sorted(r["generation"] for r in rows if r["version"] == version)


def _state(spark: SparkSession, index: TextIndex, version: int, generations: Sequence[int]) -> None:
    spark.createDataFrame([(version, g) for g in generations], "version int, generation int").coalesce(1).write.mode("append").parquet(f"{index.path}/manifest")


def _write(rows: DataFrame, index: TextIndex, generation: int, few: bool = True) -> None:
    parts = rows.withColumn("folder", folder_of(F.col("term")))
    # few rows share a folder's files: a frequent term's are dealt over several tasks by document; of many, each task writes its own
    spread = parts.repartition(F.col("folder"), F.pmod(F.xxhash64("key"), F.lit(8))) if few else parts
    spread.sortWithinPartitions("folder", "term", "key").write.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").partitionBy("folder").parquet(f"{index.path}/postings/generation={generation}")


def _gone(keys: DataFrame, index: TextIndex, generation: int) -> None:
    keys.select("key").distinct().write.parquet(f"{index.path}/gone/generation={generation}")


def create(docs: DataFrame, path: str, key: str, classes: dict[str, Column], stems: bool = False) -> TextIndex:
    index = TextIndex(path, stems)
    rows = postings(docs, key, classes, stems)
    _write(rows, index, 0, few=False)
    _gone(rows.limit(0), index, 0)
    _state(docs.sparkSession, index, 0, [0])
    return index


def update(index: TextIndex, changed: DataFrame, key: str, classes: dict[str, Column], deleted: DataFrame | None = None) -> None:
    """Bring in the documents ``changed`` (new ones too) and take out those of ``deleted``: their postings alone are written."""
    spark = changed.sparkSession
    version, generations = _manifest(spark, index)
    new = max(generations) + 1
    _write(postings(changed, key, classes, index.stems), index, new)
    keys = changed.select(F.col(key).alias("key"))
    _gone(keys if deleted is None else keys.unionByName(deleted.select(F.col(key).alias("key"))), index, new)
    _state(spark, index, version + 1, [*generations, new])
    if len(generations) + 1 > GENERATIONS:
        compact(spark, index)


def live(spark: SparkSession, index: TextIndex, terms: Sequence[str] | None = None) -> DataFrame:
    """(key, term, class, positions, generation) of what counts, of some terms or all: folders and generations are pruned."""
    _, generations = _manifest(spark, index)
    rows = spark.read.option("basePath", f"{index.path}/postings").parquet(f"{index.path}/postings").filter(F.col("generation").isin(generations))
    if terms is not None:
        folders = [r[0] for r in spark.range(1).select(F.explode(F.array(*[folder_of(F.lit(t)) for t in terms]))).distinct().collect()] if terms else []
        rows = rows.filter(F.col("folder").isin(folders) & F.col("term").isin(list(terms)))
    gone = spark.read.parquet(f"{index.path}/gone").filter(F.col("generation").isin(generations)).groupBy("key").agg(F.max("generation").alias("until"))
    if len(generations) > 1:
        gone = F.broadcast(gone) if gone.count() <= BROADCAST_GONE else gone
        rows = rows.join(gone, "key", "left").filter(F.col("until").isNull() | (F.col("until") <= F.col("generation")))
    return rows.select("key", "term", "class", "positions", "generation")


def compact(spark: SparkSession, index: TextIndex) -> None:
    """Merge the small generations: all of them but a first one that holds most of the postings; then all, if it doesn't.

    The merged rows are the next generation; what stood for no document any more is left out. Old files go once the new
    state is written.
    """
    version, generations = _manifest(spark, index)
    sizes = {r["generation"]: r["n"] for r in live(spark, index).groupBy("generation").agg(F.count(F.lit(1)).alias("n")).collect()}
    small = generations[1:]
    if sum(sizes.get(g, 0) for g in small) > sizes.get(generations[0], 0) // 2:
        small = generations
    new = max(generations) + 1
    kept = live(spark, index).filter(F.col("generation").isin(small)).drop("generation")
    _write(kept, index, new)
    # the first generation's rows that were taken back stay taken back
    taken = spark.read.parquet(f"{index.path}/gone").filter(F.col("generation").isin(small)).select("key").distinct()
    _gone(taken if small != generations else taken.limit(0), index, new)
    _state(spark, index, version + 1, [g for g in generations if g not in small] + [new])
    for g in small:
        remove_folder(spark, f"{index.path}/postings/generation={g}")
        remove_folder(spark, f"{index.path}/gone/generation={g}")


def _at(terms: Column, term: str) -> Column:
    """All positions of a term, from the array of (term, class, positions)."""
    return F.flatten(F.transform(F.filter(terms, lambda x: x["term"] == term), lambda x: x["positions"]))


def _phrase(terms: Column, words: Sequence[str]) -> Column:
    """Whether the words stand one after another."""

    def begins(i: int) -> Column:
        """Where the phrase would begin by its i-th word."""
        return F.transform(_at(terms, words[i]), lambda x: x - i)

    at = begins(0)
    for i in range(1, len(words)):
        at = F.array_intersect(at, begins(i))
    return F.size(at) > 0


def nearest_pair(terms: Column, a: str, b: str) -> Column:
    """The smallest distance between two terms: neighbours among all their places in order that aren't of one term."""
    places = F.array_sort(F.concat(F.transform(_at(terms, a), lambda x: F.struct(x.alias("at"), F.lit(0).alias("which"))), F.transform(_at(terms, b), lambda x: F.struct(x.alias("at"), F.lit(1).alias("which")))))
    pairs = F.zip_with(F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), lambda x, y: F.when(x["which"] != y["which"], x["at"] - y["at"]))
    return F.array_min(pairs)


def scores(spark: SparkSession, index: TextIndex, query: str, classes: Sequence[str] | None = None, near_weight: float = 0.0) -> DataFrame:
    """(key, score) of the documents that satisfy the query, phrases and exclusions too, as ``keyword_scores`` gives them.

    ``near_weight`` adds, for each two required words in a row, that weight over the smallest distance between them.
    """
    q = parse_query(query)
    if not q.groups:
        return live(spark, index, []).select("key").withColumn("score", F.lit(0.0))
    rows = live(spark, index, index.terms(query))
    if classes is not None:
        rows = rows.filter(F.col("class").isin(*classes))
    wanted = sorted({index.term(w) for g in q.groups for t in g for w in t.split()})
    # rows of one key are one document
    rows = rows.repartition("key").groupBy("key", "term", "class").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    tf = F.size("positions")
    part = F.when(F.col("term").isin(wanted), F.create_map(*[F.lit(x) for k, w in CLASS_WEIGHTS.items() for x in (k, w)])[F.col("class")] * tf / (tf + 1)).otherwise(0.0)
    # a document's list holds the query's terms alone
    seen = rows.groupBy("key").agg(F.sum(part).alias("score"), F.collect_list(F.struct("term", "class", "positions")).alias("terms"))
    has = lambda t: _phrase(F.col("terms"), [index.term(w) for w in t.split()])
    for group in q.groups:
        test = has(group[0])
        for t in group[1:]:
            test = test | has(t)
        seen = seen.filter(test)
    for t in q.excluded:
        seen = seen.filter(~has(t))
    score = F.col("score")
    if near_weight:
        alone = [index.term(g[0]) for g in q.groups if len(g) == 1 and " " not in g[0]]
        for a, b in zip(alone, alone[1:], strict=False):
            if a != b:
                score = score + F.coalesce(near_weight / nearest_pair(F.col("terms"), a, b), F.lit(0.0))
    return seen.select("key", score.alias("score"))
