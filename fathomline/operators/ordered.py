"""Running totals over a whole table or a hot group, without a window that gathers it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def spans(df: DataFrame, by: str, name: str) -> DataFrame:
    """Rows with the number of their span of ``by``: ranges between quantiles, a few to a task.

    The quantiles, some hundred numbers, are settled on the driver; they needn't be exact, as any ranges will do.
    """
    spark = df.sparkSession
    n = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = df.agg(F.percentile_approx(F.col(by).cast("double"), [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    edges = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    dealt = Bucketizer(splits=edges, inputCol=f"{name}_by", outputCol=f"{name}_at", handleInvalid="keep").transform(df.withColumn(f"{name}_by", F.col(by).cast("double")))
    return dealt.withColumn(name, F.col(f"{name}_at").cast("int")).drop(f"{name}_by", f"{name}_at")


def running_total(df: DataFrame, value: Column, by: str, ties: Sequence[str] = (), group: Sequence[str] = (), name: str = "total") -> DataFrame:
    """The sum of ``value`` over the rows of the group up to and with each row, in order of ``by`` (a number) and ``ties``.

    Sums by span are added up first, a small table; a window then runs within a span of a group only. Rows with an equal
    ``by`` share a span.
    """
    rows = spans(df.withColumn("__value", value), by, "__span")
    keys = [F.col(f"`{g}`") for g in group]
    each = rows.groupBy(*keys, "__span").agg(F.sum("__value").alias("__sum"))
    before = W.partitionBy(*keys).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    offsets = each.select(*[k.alias(f"__g{i}") for i, k in enumerate(keys)], F.col("__span").alias("__s"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    same = F.col("__span") == F.col("__s")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__g{i}"))
    own = F.sum("__value").over(W.partitionBy(*keys, "__span").orderBy(by, *ties).rowsBetween(W.unboundedPreceding, 0))
    out = rows.withColumn("__own", own).join(offsets, same)
    return out.withColumn(name, F.col("__own") + F.col("__before")).drop("__value", "__span", "__own", "__s", "__before", *[f"__g{i}" for i in range(len(keys))])


def row_number(df: DataFrame, by: str, ties: Sequence[str] = (), group: Sequence[str] = (), name: str = "n") -> DataFrame:
    """The number, from 1, of each row of the group in order of ``by`` and ``ties``."""
    return running_total(df, F.lit(1), by, ties, group, name)
