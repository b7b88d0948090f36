"""Payloads for a model with a token budget: documents in clusters that fit, and a hook that sums each cluster up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators import ordered
from fathomline.operators import vector_index as VI
from fathomline.session import cut_lineage

#: Vectors on which the order of likeness is fitted at most, and the share of clusters that must be summed up.
FIT_MOST, LEAST_SUCCESS = 1 << 14, 0.75


def clusters(rows: DataFrame, budget: int, fit_most: int = FIT_MOST) -> DataFrame:
    """(bucket, id, tokens, cluster): each row of (bucket, id, tokens, vector) in one cluster of its bucket, none over the budget.

    Rows are put in an order that keeps like vectors together, by their list of a fitted set of centres and the cosine to its
    centre, and the order is cut by running totals. A row of over half the budget is a cluster of its own; of the others a
    cluster begins with each half of a budget, so with its last row it is within the whole. A row that is over the budget
    itself stays alone; ``over`` of ``summed_up`` says so. Rows without a direction come last. No bucket is gathered.
    """
    plain = rows.select("bucket", F.col("id").cast("long").alias("id"), F.col("tokens").cast("long").alias("tokens"), F.col("vector").cast("array<double>").alias("vector"))
    plain = cut_lineage(plain)
    known = VI.usable(plain)
    n = known.count()
    share = min(1.0, 1.2 * fit_most / max(n, 1))
    sample = known.filter(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))).limit(fit_most).toPandas()
    index = VI.fit(np.stack(sample["vector"].to_list()), n, "") if len(sample) else None

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3).to_pylist()
            has = np.array([index is not None and bool(v) and any(v) for v in vectors], bool)
            at = np.full(len(batch), 0.0 if index is None else float(len(index.lists)))
            if has.any():
                x = VI.unit(np.array([v for v, h in zip(vectors, has, strict=True) if h]))
                own = index.own_list(x)
                at[has] = own + 0.999 * (1 - (x * index.lists[own]).sum(axis=1)) / 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(at)], names=["bucket", "id", "tokens", "at"])

    kind = plain.schema["bucket"].dataType.simpleString()
    placed = cut_lineage(plain.mapInArrow(place, f"bucket {kind}, id long, tokens long, at double"))
    half = budget // 2
    large = placed.filter(F.col("tokens") > half).select("bucket", "id", "tokens", F.concat(F.lit("x"), F.col("id").cast("string")).alias("cluster"))
    upto = ordered.running_total(placed.filter(F.col("tokens") <= half), F.col("tokens"), "at", ["id"], ["bucket"], "upto")
    number = F.floor((F.col("upto") - F.col("tokens")) / max(half, 1))
    return upto.select("bucket", "id", "tokens", F.concat(F.lit("c"), number.cast("string")).alias("cluster")).unionByName(large)


def summed_up(members: DataFrame, texts: DataFrame, hook: Callable[[list[str]], str], budget: int) -> DataFrame:
    """(bucket, cluster, n, tokens, over, summary): what the hook makes of each cluster's texts (id, text), in order of id.

    A cluster for which the hook fails has no summary. Texts of a cluster are within the budget, or one.
    """
    kind = members.schema["bucket"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("id")
        try:
            summary = hook([t or "" for t in rows.column("text").to_pylist()])
        except Exception:  # one cluster's failure isn't the others'
            summary = None
        total = sum(rows.column("tokens").to_pylist())
        made = {"bucket": rows.column("bucket").slice(0, 1).combine_chunks(), "cluster": rows.column("cluster").slice(0, 1).combine_chunks(), "n": pa.array([len(rows)], pa.int64()), "tokens": pa.array([total], pa.int64())}
        return pa.table(made | {"over": pa.array([total > budget]), "summary": pa.array([summary], pa.string())})

    joined = members.join(texts.select(F.col("id").cast("long").alias("id"), "text"), "id").select("bucket", "cluster", "id", "tokens", "text")
    return joined.groupBy("bucket", "cluster").applyInArrow(run, f"bucket {kind}, cluster string, n long, tokens long, over boolean, summary string")


def outcome(summaries: DataFrame, least: float = LEAST_SUCCESS) -> DataFrame:
    """(clusters, dropped, success_ratio, degraded) of a run; one without clusters is a success."""
    counted = summaries.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("summary").isNull()).alias("dropped"))
    ratio = F.when(F.col("clusters") == 0, 1.0).otherwise((F.col("clusters") - F.col("dropped")) / F.col("clusters"))
    return counted.withColumn("success_ratio", ratio).withColumn("degraded", F.col("success_ratio") < least)
