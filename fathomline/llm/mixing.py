"""Mixing sources to target weights (7): Poisson replication, DataFrame functions only.

A source's target repetition rate is its target weight's share of the mixture, times the mixture's size, over the number of its
documents. Each document is given a count from a Poisson distribution with that mean, by inverting the distribution at a number in [0, 1)
from the MD5 of seed, doc_id and the draw's number; the document is repeated by its count, whole, and the copies are put in
a global order by another hash. Counts depend on the document alone, so a lost task is recomputed alike and no source is
gathered anywhere. Rows travel as one struct column, so no column of the input can clash with a name used here.

A rate above ``STEP`` is inverted as the sum of several draws of at most that mean, so that exp(-rate) stays in range.

Defined cases: a null source is a source of its own; sources without a weight have weight ``default_weight``; weights that
are negative are an error; null and empty texts are documents like any other; a row without doc_id draws by the MD5 of its text; rows that repeat
a doc_id draw the same count each; texts of any length stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import cut_lineage

STEP = 8.0
#: Terms of the distribution that are summed: beyond them, the chance at a mean of ``STEP`` is below 2**-60.
TERMS = 48
SEED = "mix-1"
#: Sources up to which their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 100_000


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) of 48 bits, from the MD5 of the parts joined by ``|``."""
    text = F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def poisson(rate: Column, key: Column, seed: str = SEED) -> Column:
    """A Poisson count with the mean ``rate`` for each row; equal keys and rates give equal counts."""
    draws = F.greatest(F.lit(1), F.ceil(rate / STEP).cast("int"))

    def one(i: Column) -> Column:
        mean, u = rate / draws, uniform(seed, key, i.cast("string"))
        # add up probabilities until they pass u; each term follows from the one before
        start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("sum"), F.lit(0).alias("n"))
        end = F.aggregate(
            F.sequence(F.lit(1), F.lit(TERMS)),
            start,
            lambda s, k: F.struct(
                (s["p"] * mean / k).alias("p"),
                (s["sum"] + s["p"] * mean / k).alias("sum"),
                (s["n"] + F.when(u >= s["sum"], 1).otherwise(0)).alias("n"),
            ),
        )
        return end["n"]

    return F.when(rate > 0, F.aggregate(F.transform(F.sequence(F.lit(1), draws), one), F.lit(0), lambda a, b: a + b)).otherwise(F.lit(0))


def rates(docs: DataFrame, weights: dict[str, float] | None, default_weight: float, source: str, size: float | None) -> DataFrame:
    """(site key, rate): one row for each source."""
    if any(w < 0 for w in [*(weights or {}).values(), default_weight]) or default_weight == math.inf:
        raise ValueError("weights are numbers from 0 on")
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("\0")).alias("site")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(float(default_weight))
    if weights:
        table = F.create_map(*[F.lit(x) for k, w in sorted(weights.items()) for x in (k, float(w))])
        weight = F.coalesce(table[F.col("site")], weight)
    counts = counts.withColumn("w", weight)
    counts = cut_lineage(counts)
    sources, all_n, all_w = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum("w")).first()
    wanted = float(all_n or 0) if size is None else float(size)
    rate = F.col("w") / F.lit(all_w) * F.lit(wanted) / F.col("n") if all_w else F.lit(0.0)
    table = counts.select("site", rate.alias("rate"))
    return F.broadcast(table) if sources <= BROADCAST_SOURCES else table


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, source: str = "source", size: float | None = None, seed: str = SEED, detail: bool = False) -> DataFrame:
    """The documents repeated to the target weights, in a global random order.

    ``size``: expected number of rows (as many as there are, by default). ``detail`` adds copy, rate and shuffle_key, in
    place of columns of these names.
    """
    names = docs.columns
    table = rates(docs, weights, default_weight, source, size)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.md5(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")) if "text" in names else F.lit(""))
    own = rows.withColumn("site", F.coalesce(F.col(f"row.`{source}`"), F.lit("\0"))).join(table, "site")
    counted = own.withColumn("count", poisson(F.col("rate"), key, seed)).filter("count > 0")
    copies = counted.select("row", "rate", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", uniform(seed, F.lit("order"), key, F.col("copy").cast("string")))
    # parts are made by their bytes: rows that share an id have the same keys, and may be a large share of the table
    ordered = keyed.hint("rebalance", "shuffle_key").sortWithinPartitions("shuffle_key", F.col("row.doc_id"))
    more = {"copy": F.col("copy"), "rate": F.round("rate", 9), "shuffle_key": F.col("shuffle_key")} if detail else {}
    return ordered.select(*[F.col(f"row.`{c}`").alias(c) for c in names if c not in more], *[c.alias(n) for n, c in more.items()])


#: The mixture of the query and the pipeline: a hot source is brought down to twice an ordinary source's share.
WEIGHTS = {"src0": 2.0, "src1": 0.5, "src2": 1.5}


def op7(spark, sf_dir: str) -> DataFrame:
    """The mixture itself: whole documents, once for each copy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang", "n_chars")
    return mixed(docs, WEIGHTS, detail=True)


def _u(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT::DOUBLE / {float(1 << 48)!r})"


OP7_SQL = f"""
WITH RECURSIVE c AS (SELECT coalesce(source, chr(0)) AS site, count(*) AS n, CASE coalesce(source, chr(0)) {' '.join(f"WHEN '{k}' THEN {w!r}::DOUBLE" for k, w in WEIGHTS.items())} ELSE 1.0::DOUBLE END AS w FROM documents GROUP BY 1),
r AS (SELECT site, w / (SELECT sum(w) FROM c) * (SELECT sum(n) FROM c)::DOUBLE / n AS rate FROM c),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) AS key, text, source, lang, n_chars, rate, greatest(1, ceil(rate / {STEP!r}))::INT AS draws FROM documents JOIN r ON coalesce(source, chr(0)) = site),
u AS (SELECT DISTINCT key, rate, draws, i, {_u(f"'{SEED}'", "key", "i::VARCHAR")} AS u, rate / draws AS mean FROM d, unnest(generate_series(1, draws)) AS g(i)),
p AS (SELECT key, rate, i, u, mean, exp(-mean) AS p, exp(-mean) AS s, 0 AS k, 0 AS n FROM u
      UNION ALL SELECT key, rate, i, u, mean, p * mean / (k + 1), s + p * mean / (k + 1), k + 1, n + CASE WHEN u >= s THEN 1 ELSE 0 END FROM p WHERE k < {TERMS}),
t AS (SELECT key, rate, sum(n) AS n FROM p WHERE k = {TERMS} GROUP BY key, rate)
SELECT d.doc_id, d.text, source, lang, n_chars, (g.copy)::INT AS copy, round(d.rate, 9) AS rate, {_u(f"'{SEED}'", "'order'", "d.key", "g.copy::VARCHAR")} AS shuffle_key
FROM d JOIN t ON t.key = d.key AND t.rate = d.rate, unnest(generate_series(0, t.n::BIGINT - 1)) AS g(copy)
"""
