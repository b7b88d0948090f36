"""Ranked retrieval: full text over an inverted index, exact vector search, fusion, rescoring."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, StructField, StructType

from fathomline.functions import text as T
from fathomline.functions import vector as V
from fathomline.session import bounded_batches

# Weights of the index's classes (title, body, appendix).
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
RRF_K = 60
TRUTH_BOOST = 2.0


@dataclass
class TextQuery:
    """All groups are required; a group is a list of alternatives; a phrase is a term with blanks."""

    groups: list[list[str]] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    def terms(self) -> list[str]:
        return sorted({w for g in self.groups for t in g for w in t.split()} | {w for t in self.excluded for w in t.split()})


def parse_query(text: str) -> TextQuery:
    """Words are required, ``or`` makes alternatives, quotes a phrase, a leading ``-`` excludes."""
    q, joining = TextQuery(), False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus and q.groups:
            joining = True
            continue
        term = " ".join(re.findall(r"[^\W_]+", (phrase or word).lower()))
        if not term:
            continue
        if minus:
            q.excluded.append(term)
        elif joining:
            q.groups[-1].append(term)
        else:
            q.groups.append([term])
        joining = False
    return q


def inverted_index(docs: DataFrame, key: Sequence[str], classes: dict[str, Column]) -> DataFrame:
    """(key, term, class, tf): one row for each term of each class of a document."""
    parts = [docs.select(*key, F.lit(c).alias("class"), F.explode(T.tokens(col)).alias("term")) for c, col in classes.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*key, "term", "class").agg(F.count(F.lit(1)).alias("tf"))


def token_line(*cols: Column) -> Column:
    """The lower-cased tokens of the texts in a row, a blank on either side of each two: one generated expression, no array."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.concat_ws(" ", *cols)), T.TOKEN_GAP, "  "), F.lit(" "))


def occurrences(line: Column, word: str) -> Column:
    """How often a word stands in a token line."""
    return ((F.length(line) - F.length(F.replace(line, F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)).cast("long")


def keyword_scores(docs: DataFrame, query: str, key: Sequence[str], classes: dict[str, Column]) -> DataFrame:
    """(key, score) of documents that satisfy the query: sum over terms and classes of weight * tf / (1 + tf).

    A plain search for the words in the lower-cased texts leaves out most rows before any text is cut into tokens; terms
    and phrases are then checked on the tokens.
    """
    q = parse_query(query)
    if not q.groups:
        return docs.select(*key).limit(0).withColumn("score", F.lit(0.0))
    flat = token_line(*classes.values())
    has = lambda term: F.contains(F.col("__flat"), F.lit(" " + term.replace(" ", "  ") + " "))
    low = F.lower(F.concat_ws(" ", *classes.values()))
    for group in q.groups:
        some = F.lit(False)
        for t in group:
            every = F.lit(True)
            for w in t.split():
                every = every & F.contains(low, F.lit(w))
            some = some | every
        docs = docs.filter(some)
    kept = docs.withColumn("__flat", flat)
    for group in q.groups:
        test = has(group[0])
        for t in group[1:]:
            test = test | has(t)
        kept = kept.filter(test)
    for t in q.excluded:
        kept = kept.filter(~has(t))
    words = sorted({w for g in q.groups for t in g for w in t.split()})
    score = F.lit(0.0)
    for c, col in classes.items():
        own = token_line(col)
        for w in words:
            tf = occurrences(own, w)
            score = score + F.lit(CLASS_WEIGHTS[c]) * tf / (tf + 1)
    return kept.select(*key, score.alias("score"))


#: Folders of a written index: a term is looked up in one of them.
INDEX_FOLDERS = 64


def folder_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_FOLDERS)).cast("int")


#: Terms of a written index stand together by shelf; a folder has some of them.
INDEX_SHELVES = 16 * INDEX_FOLDERS


def shelf_of(term: str) -> int:
    return zlib.crc32(term.encode()) % INDEX_SHELVES


def posting_blocks(docs: DataFrame, key: Sequence[str], classes: dict[str, Column]) -> DataFrame:
    """Rows (shelf, class, and as lists the key's columns, term, tf): the postings of ``inverted_index``, many in a row.

    They are counted in a batch of documents and a row is of one batch, so nothing is shuffled; what is written later is a few
    hundred times fewer rows than postings. Documents of one key may be in several rows; ``read_index`` adds them up.
    """
    names = list(classes)
    lowered = [F.lower(F.coalesce(col, F.lit(""))).alias(f"__{i}") for i, col in enumerate(classes.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, name in enumerate(names):
                words, doc = T.arrow_tokens(batch.column(len(key) + i))
                once = words.dictionary_encode()
                shelves = np.array([shelf_of(w) for w in once.dictionary.to_numpy(zero_copy_only=False)], np.int64)
                # terms by shelf; a term's place there and its document as one number: equal ones are one posting
                order = np.argsort(shelves, kind="stable")
                place = np.argsort(order)
                pairs, tf = np.unique(place[np.asarray(once.indices)] * len(batch) + doc, return_counts=True)
                at, doc = np.divmod(pairs, max(1, len(batch)))
                at = order[at]
                starts = np.flatnonzero(np.diff(shelves[at], prepend=-1))
                ends = pa.array(np.append(starts, len(at)).astype(np.int32))
                values = [*(batch.column(k).take(pa.array(doc)) for k in range(len(key))), once.dictionary.take(pa.array(at)), pa.array(tf.astype(np.int32))]
                shelf = pa.array(shelves[at][starts].astype(np.int32))
                yield pa.RecordBatch.from_arrays([shelf, pa.array([name] * len(shelf), pa.string()), *(pa.ListArray.from_arrays(ends, v) for v in values)], names=["shelf", "class", *key, "term", "tf"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(*key, *lowered)
    kinds = "".join(f"`{k}` array<{rows.schema[k].dataType.simpleString()}>, " for k in key)
    return rows.mapInArrow(run, f"shelf int, class string, {kinds}term array<string>, tf array<int>")


def write_index(blocks: DataFrame, path: str) -> None:
    """``posting_blocks`` as files by folder, sorted by shelf: a lookup reads one folder's few row groups."""
    parts = blocks.withColumn("folder", F.col("shelf") % INDEX_FOLDERS)
    # a frequent term's postings are dealt over several tasks by their documents, which its folder's files then share
    spread = parts.repartition(F.col("folder"), F.pmod(F.xxhash64(*[c for c in blocks.columns if c not in ("shelf", "class", "term", "tf")]), F.lit(8)))
    spread.sortWithinPartitions("folder", "shelf").write.partitionBy("folder").parquet(path)


def read_index(blocks: DataFrame, path: str, query: str) -> DataFrame:
    """The postings of the query's terms, as ``inverted_index`` has them: folders are pruned, and the filter on the shelf is pushed to the files.

    Of ``blocks``, what was written, only the schema is used: an index without a posting has no files that tell it.
    """
    terms = parse_query(query).terms()
    shelves = sorted({shelf_of(t) for t in terms})
    key = [c for c in blocks.columns if c not in ("shelf", "class", "term", "tf")]
    found = blocks.sparkSession.read.schema(StructType([*blocks.schema, StructField("folder", IntegerType())])).parquet(path)
    found = found.filter(F.col("folder").isin([s % INDEX_FOLDERS for s in shelves]) & F.col("shelf").isin(shelves))
    rows = found.select("class", F.inline(F.arrays_zip(*key, "term", "tf"))).filter(F.col("term").isin(terms))
    # dealt by key alone, so that a score needs no second shuffle
    return rows.repartition(*key).groupBy(*key, "class", "term").agg(F.sum("tf").alias("tf"))


def indexed_scores(postings: DataFrame, query: str, key: Sequence[str]) -> DataFrame:
    """(key, score) as ``keyword_scores``, from an inverted index; of a phrase, its words are required here (see ``with_phrases``)."""
    q = parse_query(query)
    if not q.groups:
        return postings.select(*key).limit(0).withColumn("score", F.lit(0.0))
    wanted = sorted({w for g in q.groups for t in g for w in t.split()})
    alone = [t for t in q.excluded if " " not in t]
    weight = F.create_map(*[F.lit(x) for k, w in CLASS_WEIGHTS.items() for x in (k, w)])[F.col("class")]
    part = F.when(F.col("term").isin(wanted), weight * F.col("tf") / (F.col("tf") + 1)).otherwise(0.0)
    seen = postings.filter(F.col("term").isin([*wanted, *alone])).groupBy(*key).agg(F.sum(part).alias("score"), F.collect_set("term").alias("terms"))
    for group in q.groups:
        test = F.lit(False)
        for t in group:
            test = test | (F.size(F.array_intersect("terms", F.array(*map(F.lit, t.split())))) == len(set(t.split())))
        seen = seen.filter(test)
    for t in alone:
        seen = seen.filter(~F.array_contains("terms", t))
    return seen.select(*key, "score")


def with_phrases(found: DataFrame, query: str, classes: dict[str, Column]) -> DataFrame:
    """The candidates of ``indexed_scores``, joined to their texts, that hold the query's phrases; untouched where it has none."""
    q = parse_query(query)
    if not any(" " in t for g in [*q.groups, q.excluded] for t in g):
        return found
    low = F.lower(F.concat_ws(" ", *classes.values()))
    # a search that ends where it finds the words in a row: no text is cut into tokens
    has = lambda term: F.rlike(low, F.lit(rf"(?<![\p{{L}}\p{{N}}]){T.TOKEN_GAP.join(term.split())}(?![\p{{L}}\p{{N}}])"))
    for group in q.groups:
        if any(" " in t for t in group):
            test = F.lit(False)
            for t in group:
                test = test | has(t)
            found = found.filter(test)
    for t in q.excluded:
        if " " in t:
            found = found.filter(~has(t))
    return found


def best_per(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def vector_scores(chunks: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """Every row with its exact cosine ``score``; the query is a literal, so this is one projection."""
    return chunks.withColumn("score", V.cosine(F.col(column), V.literal(query)))


def vector_search(chunks: DataFrame, query: list[float], limit: int, page: str = "page_id") -> DataFrame:
    """Best chunk of each page, then the best pages."""
    scored = vector_scores(chunks, query).select("chunk_id", page, "score")
    return top(best_per(scored, [page], [F.desc("score"), F.asc("chunk_id")]), limit, F.desc("score"), F.asc(page))


def ranked(df: DataFrame, key: Sequence[str], first_rank: int = 0) -> DataFrame:
    """A list in rank order: (key, rank)."""
    w = W.orderBy(F.desc("score"), *[F.asc(k) for k in key])
    return df.select(*key, (F.row_number().over(w) - 1 + first_rank).alias("rank"))


def effective_k(k: float, weight: float) -> float:
    """A weight changes k, not the numerator; weights that aren't positive leave k."""
    return k / weight if weight > 0 else k


def rrf(lists: Sequence[tuple[DataFrame, float]], key: Sequence[str], k: float = RRF_K, first_rank: int = 0, normalize: bool = True, boosted: Column | None = None) -> DataFrame:
    """Reciprocal-rank fusion of short ranked lists (key, score): the sum of 1 / (k / weight + rank) over the lists.

    Scores are divided by the largest and, where ``boosted`` holds, doubled afterwards.
    """
    parts = [ranked(d, key, first_rank).select(*key, (1.0 / (F.lit(effective_k(k, w)) + F.col("rank"))).alias("part")) for d, w in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    fused = out.groupBy(*key).agg(F.sum("part").alias("score"))
    if normalize:
        fused = fused.withColumn("score", F.col("score") / fused.agg(F.max("score")).scalar())
    return fused if boosted is None else fused.withColumn("score", F.when(boosted, F.col("score") * TRUTH_BOOST).otherwise(F.col("score")))


def rescore(results: DataFrame, chunks: DataFrame, query: list[float], on: str, share: float = 0.3) -> DataFrame:
    """0.7 of the normalised score plus 0.3 of the cosine; rows without an embedding keep their score."""
    cos = chunks.select(on, V.cosine(F.col("embedding"), V.literal(query)).alias("__cos"))
    joined = results.join(cos, on, "left")
    best = results.agg(F.max("score")).scalar()
    blend = F.when(F.col("__cos").isNotNull() & (best > 0), (1 - share) * F.col("score") / best + share * F.col("__cos")).otherwise(F.col("score"))
    return joined.withColumn("score", blend).drop("__cos")


def alias_hop(results: DataFrame, aliases: DataFrame, alias: str, most: int = 3, factor: float = 1.10) -> DataFrame:
    """Pages whose alias is the whole query: present ones gain a factor, absent ones enter just above the best score."""
    if len(alias.split()) > 6:
        return results.withColumn("alias_hit", F.lit(False))
    hits = top(aliases.filter(F.col("alias_norm") == alias).select("source_id", "slug").distinct(), most, F.asc("source_id"), F.asc("slug"))
    numbered = hits.withColumn("i", F.row_number().over(W.orderBy("source_id", "slug")) - 1)
    present = results.join(hits.withColumn("alias_hit", F.lit(True)), ["source_id", "slug"], "left").withColumn("alias_hit", F.coalesce("alias_hit", F.lit(False)))
    scored = present.withColumn("score", F.when(F.col("alias_hit"), F.col("score") * factor).otherwise(F.col("score")))
    # the injected pages stand above everything that was found
    best = scored.agg(F.coalesce(F.max("score"), F.lit(0.0))).scalar()
    absent = numbered.join(results.select("source_id", "slug"), ["source_id", "slug"], "left_anti")
    injected = absent.select("source_id", "slug", (best + (most - F.col("i")) * 1e-6).alias("score"), F.lit(True).alias("alias_hit"))
    return scored.select("source_id", "slug", "score", "alias_hit").unionByName(injected)


def rerank(results: DataFrame, scorer, head: int, keep: int, order: Sequence[Column]) -> DataFrame:
    """Order the head by a pluggable scorer (pandas Series of texts -> scores); the tail keeps its order behind it.

    A scorer that fails leaves the ranking as it was.
    """
    w = W.orderBy(*order)
    placed = results.withColumn("__pos", F.row_number().over(w))
    names = placed.schema

    def run(frames):
        for pdf in frames:
            try:
                pdf["rerank_score"] = pdf["text"].map(scorer).where(pdf["__pos"] <= head)
            except Exception:  # fail open: the ranking is still a ranking
                pdf["rerank_score"] = None
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names) + ", rerank_score double"
    scored = placed.mapInPandas(run, schema)
    return scored.orderBy(F.desc_nulls_last("rerank_score"), "__pos").limit(keep).drop("__pos")


#: Vectors to a block, and queries of a block that are compared at once.
BLOCK, STRIP = 4096, 256


def block_pairs(queries: DataFrame, rows: DataFrame, choose, block: int = BLOCK) -> DataFrame:
    """(bucket, id, other, sim) of the pairs of a query and a row of its bucket that ``choose`` takes of two blocks.

    Both tables have (bucket, id, vector). A bucket's queries and rows are dealt to blocks of about ``block`` vectors, and a
    task compares one block with one other by matrix products of some queries at once, so a hot bucket makes many tasks and
    nothing gathers it. ``choose`` gets the cosines (-inf for vectors without a direction) of some queries and a block of rows
    and both ids, and returns indices of queries and rows. Vectors that are null, empty or zero match nothing.
    """
    usable = lambda d: d.filter("vector is not null and size(vector) > 0")
    queries, rows = usable(queries), usable(rows)

    def large(d: DataFrame, name: str) -> DataFrame:
        """Buckets of more than one block: at most a ``block``-th of the rows, so few enough to broadcast."""
        return F.broadcast(d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias(name)))

    def blocks(d: DataFrame, own: str, side: str) -> DataFrame:
        """Rows gathered by block, each with the numbers of blocks of its bucket on both sides."""
        d = d.join(large(queries, "q_parts"), "bucket", "left").join(large(rows, "r_parts"), "bucket", "left").fillna(1, ["q_parts", "r_parts"])
        d = d.withColumn("part", F.pmod(F.xxhash64("id"), F.col(own)).cast("int"))
        return d.groupBy("bucket", "part").agg(F.first("r_parts").alias("r_parts"), F.collect_list("id").alias(f"id_{side}"), F.collect_list("vector").alias(f"vector_{side}"))

    q = blocks(queries, "q_parts", "q").select("bucket", F.explode(F.sequence(F.lit(0), F.col("r_parts") - 1)).alias("part"), "id_q", "vector_q")
    r = blocks(rows, "r_parts", "r").select("bucket", "part", "id_r", "vector_r")
    # an array is planned as one element: without the hint whole blocks of vectors are taken for small and broadcast
    pairs = q.join(r.hint("merge"), ["bucket", "part"]).select("bucket", "id_q", "vector_q", "id_r", "vector_r")
    kind = rows.schema["bucket"].dataType.simpleString()
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                ids = [np.asarray(one.column(c).flatten()) for c in (1, 3)]
                vectors = [np.asarray(one.column(c).flatten().flatten(), float).reshape(len(x), -1) for c, x in zip((2, 4), ids, strict=True)]
                norms = [np.sqrt((v * v).sum(axis=1)) for v in vectors]
                unit = [v / np.where(n > 0, n, 1)[:, None] for v, n in zip(vectors, norms, strict=True)]
                for first in range(0, len(ids[0]), STRIP):
                    some = slice(first, first + STRIP)
                    own, sim = ids[0][some], unit[0][some] @ unit[1].T
                    sim[(norms[0][some] == 0)[:, None] | (norms[1] == 0)[None, :]] = -np.inf
                    at, to = choose(sim, own, ids[1])
                    bucket = one.column(0).take(pa.array(np.zeros(len(at), np.int64)))
                    yield pa.RecordBatch.from_arrays([bucket, pa.array(own[at].astype(np.int64)), pa.array(ids[1][to].astype(np.int64)), pa.array(sim[at, to])], names=["bucket", "id", "other", "sim"])

    return pairs.mapInArrow(run, f"bucket {kind}, id long, other long, sim double")


def block_matches(queries: DataFrame, rows: DataFrame, k: int, earlier_only: bool = False, block: int = BLOCK) -> DataFrame:
    """(bucket, id, other, sim): the k rows of the same bucket nearest to each query by cosine, but for itself.

    ``earlier_only`` leaves out rows with an id from the query's on. Ties go to the smaller id.
    """

    def choose(sim: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sim[(others[None, :] >= ids[:, None]) if earlier_only else others[None, :] == ids[:, None]] = -np.inf
        order = np.lexsort((np.broadcast_to(others, sim.shape), -sim), axis=1)[:, :k]
        at = np.repeat(np.arange(len(ids)), order.shape[1])
        to = order.ravel()
        use = np.isfinite(sim[at, to])
        return at[use], to[use]

    return best_per(block_pairs(queries, rows, choose, block), ["bucket", "id"], [F.desc("sim"), F.asc("other")], k)


def block_first(queries: DataFrame, rows: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(bucket, id, other): the row with the smallest id under the query's own whose cosine is ``least`` or more."""

    def choose(sim: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fits = np.where((sim >= least) & (others[None, :] < ids[:, None]), others[None, :].astype(float), np.inf)
        to = np.argmin(fits, axis=1)
        at = np.flatnonzero(np.isfinite(fits[np.arange(len(ids)), to]))
        return at, to[at]

    return block_pairs(queries, rows, choose, block).groupBy("bucket", "id").agg(F.min("other").alias("other"))


#: Cosine from which a kept answer is taken for a question.
CACHE_LEAST = 0.92


def cache_hits(questions: DataFrame, cache: DataFrame, pages: DataFrame, clock: int, now, least: float = CACHE_LEAST) -> DataFrame:
    """(id, entry, sim, age_seconds): the nearest kept answer to each question (id, source_id, knobs, vector) that may be used.

    A kept answer (entry, source_id, knobs, embedding, created_at, ttl_seconds, generation, page_generations) is of the question's source and
    knobs, within its time to live, and still true: either no page has changed since it was kept (``clock``, the newest
    change, is at most its generation), or it names its pages, and each is there with the generation it had.
    """
    at = F.lit(now).cast("timestamp")
    fresh = cache.filter(F.col("knobs").isNotNull() & (F.unix_seconds(F.col("created_at")) + F.col("ttl_seconds") > F.unix_seconds(at)))
    older = fresh.filter(F.col("generation") < clock)
    named = older.select("entry", F.explode("page_generations").alias("page_id", "then"))
    now_there = pages.select("page_id", F.col("generation").alias("now"))
    # all pages are there: read by a few columns, their files are planned as small at any number of rows
    true = named.join(now_there.hint("merge"), "page_id", "left").groupBy("entry").agg(F.bool_and(F.col("now").isNotNull() & (F.col("now") == F.col("then"))).alias("holds")).filter("holds").select("entry")
    usable = fresh.filter(F.col("generation") >= clock).unionByName(older.join(true, "entry", "left_semi"))
    bucket = lambda d: F.to_json(F.struct(d["source_id"], d["knobs"]))
    kept = usable.select(bucket(usable).alias("bucket"), F.col("entry").alias("id"), F.col("embedding").alias("vector"))
    asked = questions.select(bucket(questions).alias("bucket"), "id", "vector")

    def choose(sim: np.ndarray, ids: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = sim.max(axis=1)
        at = np.flatnonzero(most > least)
        return at, np.argmin(np.where(sim[at] == most[at, None], others[None, :], np.iinfo(np.int64).max), axis=1)

    near = best_per(block_pairs(asked, kept, choose), ["id"], [F.desc("sim"), F.asc("other")])
    age = usable.select(F.col("entry").alias("other"), (F.unix_seconds(at) - F.unix_seconds(F.col("created_at"))).alias("age_seconds"))
    return near.join(age, "other").select("id", F.col("other").alias("entry"), "sim", "age_seconds")


# Confidence of the three ways that a name points at a page, what a salient page gains, and the most there is.
POINTER_ARMS = (("alias", 0.9), ("title", 0.8), ("suffix", 0.6))
POINTER_BOOST, POINTER_MOST = 0.1, 0.99


def entity_pointers(names: DataFrame, pages: DataFrame, aliases: DataFrame, salient: DataFrame) -> DataFrame:
    """(name, slug, arm, confidence): the page that each name points at, by alias, title or the slug's last part.

    ``salient``: slugs of pages that gain. Ties go to the stronger arm, then to the smaller slug.
    """
    asked = names.select("name").distinct()
    by = {
        "alias": aliases.select(F.col("alias_norm").alias("name"), "slug"),
        "title": pages.select(F.lower(F.trim("title")).alias("name"), "slug"),
        "suffix": pages.select(T.basename(F.col("slug")).alias("name"), "slug"),
    }
    found = None
    for i, (arm, base) in enumerate(POINTER_ARMS):
        one = asked.join(by[arm].distinct(), "name").select("name", "slug", F.lit(arm).alias("arm"), F.lit(i).alias("i"), F.lit(base).alias("base"))
        found = one if found is None else found.unionByName(one)
    gains = salient.select("slug").distinct().withColumn("gain", F.lit(POINTER_BOOST))
    scored = found.join(gains, "slug", "left").withColumn("confidence", F.least(F.lit(POINTER_MOST), F.col("base") + F.coalesce("gain", F.lit(0.0))))
    return best_per(scored, ["name"], [F.desc("confidence"), F.asc("i"), F.asc("slug")]).select("name", "slug", "arm", "confidence")
