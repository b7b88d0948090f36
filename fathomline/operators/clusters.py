"""Greedy leader clustering and semantic boundaries, the results of sequential rules found in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.operators import ordered
from fathomline.operators.retrieval import block_first
from fathomline.session import cut_lineage


def leader_clusters(rows: DataFrame, least: float, newest_first: bool = True) -> DataFrame:
    """(bucket, id, head): the cluster that each row (bucket, id, vector) joins when rows come one after another.

    A row joins the first cluster whose head has a cosine of ``least`` or more with it, else it heads a cluster of its own. Heads
    are found in rounds: an undecided row without an earlier undecided neighbour is a head, its later neighbours aren't; rounds
    grow with the longest chain of neighbours in order, which is short, not with the rows. Each round compares blocks of
    vectors (``block_first``), so a large bucket makes many tasks. Then each other row takes its earliest head.

    Rows without a direction (null, empty, zero) head clusters of their own; ids are unique in a bucket.
    """
    sign = -1 if newest_first else 1
    # the number by which rows come, smallest first
    all_rows = cut_lineage(rows.select("bucket", (sign * F.col("id")).alias("id"), "vector"))
    open_rows, heads = all_rows, all_rows.limit(0)
    key = ["bucket", "id"]
    while not open_rows.isEmpty():
        waits = cut_lineage(block_first(open_rows, open_rows, least).select(*key))
        new = open_rows.join(waits, key, "left_anti")
        left = open_rows.join(waits, key, "left_semi")
        covered = block_first(left, new, least).select(*key)
        heads = cut_lineage(heads.unionByName(new))
        open_rows = cut_lineage(left.join(covered, key, "left_anti"))
    others = all_rows.join(heads.select(*key), key, "left_anti")
    found = block_first(others, heads, least).select("bucket", "id", F.col("other").alias("head"))
    out = found.unionByName(heads.select("bucket", "id", F.col("id").alias("head")))
    return out.select("bucket", (sign * F.col("id")).alias("id"), (sign * F.col("head")).alias("head"))


#: Places to a span, and of its neighbours' places that a span also sees on either side: all that a decision looks at.
SPAN, HALO = 4096, 8


def neighbour_sims(rows: DataFrame, group: Sequence[str], order: str, vector: str) -> DataFrame:
    """(group, i, sim): the cosine of the vectors at places i and i + 1 of each group, in order."""
    placed = ordered.row_number(rows.select(*group, order, F.col(vector).cast("array<double>").alias("v")), order, [order], group, "i").select(*group, (F.col("i") - 1).alias("i"), "v")
    placed = cut_lineage(placed)
    ahead = placed.select(*group, (F.col("i") - 1).alias("i"), F.col("v").alias("w"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))
    return placed.join(ahead, [*group, "i"]).select(*group, "i", (dot("v", "w") / F.greatest(length, F.lit(1e-12))).alias("sim"))


def semantic_boundaries(rows: DataFrame, group: Sequence[str], order: str, vector: str, share: float = 0.2, span: int = SPAN) -> DataFrame:
    """(group, boundary): places ahead of which a group's sequence of vectors changes its subject.

    There the smoothed slope of the neighbours' similarity (Savitzky-Golay over five) turns from falling to rising while the
    similarity is at or under the group's ``share`` percentile; a boundary right after another goes. No group is gathered:
    places and percentiles come from counts by span of the values, and slopes from windows over spans of places that also see
    ``HALO`` places of the spans beside them.
    """
    sims = cut_lineage(neighbour_sims(rows, group, order, vector))
    ranks = ordered.row_number(sims, "sim", ["i"], group, "rank")
    sizes = sims.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    limits = ranks.join(sizes, list(group)).filter(F.col("rank") == F.floor((F.col("n") - 1) * share) + 1).select(*group, F.col("sim").alias("limit"))
    own = F.floor(F.col("i") / span)
    at = F.pmod(F.col("i"), F.lit(span))
    seen = F.array_compact(F.array(own, F.when(at < HALO, own - 1), F.when(at >= span - HALO, own + 1)))
    spread = sims.withColumn("own", own).withColumn("span", F.explode(seen))
    w = W.partitionBy(*group, "span").orderBy("i")
    s = F.col("sim")
    before, ahead = F.coalesce(F.lag("sim", 1).over(w), s), F.coalesce(F.lead("sim", 1).over(w), s)
    before2, ahead2 = F.coalesce(F.lag("sim", 2).over(w), before), F.coalesce(F.lead("sim", 2).over(w), ahead)
    # the filter's weights for the first derivative of degree two or three: -2, -1, 0, 1, 2 tenths
    sloped = spread.withColumn("slope", -0.2 * before2 - 0.1 * before + 0.1 * ahead + 0.2 * ahead2).withColumn("last", F.lag("sim", 1).over(w))
    turns = (F.lag("slope", 1).over(w) < 0) & (F.col("slope") >= 0)
    low = sloped.withColumn("turns", turns).join(limits, list(group)).withColumn("low", F.col("turns") & (F.least("sim", "last") <= F.col("limit")))
    placed = low.withColumn("boundary", F.when(F.col("low"), F.when(s <= F.col("last"), F.col("i") + 1).otherwise(F.col("i"))))
    # turns are two places apart at least, so only the one before can stand right ahead
    near = F.col("boundary") - F.lag("boundary", 2).over(w) < 2
    return placed.withColumn("near", F.coalesce(near, F.lit(False))).filter((F.col("span") == F.col("own")) & F.col("low") & ~F.col("near")).select(*group, "boundary")


def semantic_parts(rows: DataFrame, group: Sequence[str], order: str, vector: str, share: float = 0.2, span: int = SPAN) -> DataFrame:
    """(group, order, part): the number of boundaries up to each row's place."""
    cuts = semantic_boundaries(rows, group, order, vector, share, span).select(*group, F.col("boundary").alias("i"), F.lit(1).alias("cut"))
    placed = ordered.row_number(rows.select(*group, order), order, [order], group, "i").withColumn("i", F.col("i") - 1)
    met = placed.join(cuts, [*group, "i"], "left").withColumn("cut", F.coalesce("cut", F.lit(0)))
    return ordered.running_total(met, F.col("cut"), "i", group=group, name="part").select(*group, order, "part")
