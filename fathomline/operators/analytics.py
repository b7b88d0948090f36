"""Aggregates over claims, facts, usage and evaluations."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

OUTCOMES = ("correct", "incorrect", "partial", "unresolvable")


def share(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0))


def binary_outcome() -> Column:
    return F.when(F.col("quality") == "correct", 1.0).when(F.col("quality") == "incorrect", 0.0)


def scorecard(takes: DataFrame, by: Sequence[str] = (), holders: Sequence[str] | None = None) -> DataFrame:
    """Counts by outcome, accuracy, Brier score over binary outcomes, partial rate; hidden holders never enter a sum."""
    t = takes if holders is None else takes.filter(F.col("holder").isin(*holders))
    o = binary_outcome()
    n = {q: F.count(F.when(F.col("quality") == q, 1)) for q in OUTCOMES[:3]}
    resolved = n["correct"] + n["incorrect"] + n["partial"]
    return t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        resolved.alias("resolved"),
        *[c.alias(q) for q, c in n.items()],
        share(n["correct"], n["correct"] + n["incorrect"]).alias("accuracy"),
        F.avg(F.pow(F.col("weight") - o, F.lit(2))).alias("brier"),
        share(n["partial"], resolved).alias("partial_rate"),
    )


def calibration_curve(takes: DataFrame, width: float = 0.1) -> DataFrame:
    """Per bin of the weight (the last closed): count, observed and predicted rate over binary outcomes."""
    last = round(1 / width) - 1
    o = binary_outcome()
    b = F.least(F.floor(F.col("weight") / width + 1e-9), F.lit(last))
    return takes.filter(o.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(o).alias("observed"), F.avg("weight").alias("predicted"))


def conviction_brier(takes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Squared errors weighted by conviction, abs(weight - 0.5) * 2."""
    o = binary_outcome()
    c = F.abs(F.col("weight") - 0.5) * 2
    se = F.pow(F.col("weight") - o, F.lit(2))
    return takes.filter(o.isNotNull()).groupBy(*by).agg(share(F.sum(se * c), F.sum(c)).alias("brier"), F.count(F.lit(1)).alias("n"))


def forecast(takes: DataFrame, by: Sequence[str], least: int = 5) -> DataFrame:
    """Open claims with the Brier score of their bucket's resolved ones; null below ``least`` of them."""
    o = binary_outcome()
    card = takes.groupBy(*by).agg(F.count(o).alias("n"), F.avg(F.pow(F.col("weight") - o, F.lit(2))).alias("b"))
    return takes.filter("quality is null").join(card, list(by), "left").withColumn("forecast", F.when(F.col("n") >= least, F.col("b")))


def daily_cohorts(events: DataFrame, cohort: str, day: str) -> DataFrame:
    """Counts by cohort and day with zeros for days without any, from the first to the last day of all."""
    counts = events.groupBy(F.col(cohort).alias("cohort"), F.col(day).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if ends["a"] is None:
        return counts
    days = F.sequence(F.lit(ends["a"]), F.lit(ends["b"]))
    full = counts.select("cohort").distinct().withColumn("day", F.explode(days))
    return full.join(counts, ["cohort", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def anomalies(daily: DataFrame, today: Column, sigma: float = 3.0, most: int = 20) -> DataFrame:
    """Cohorts whose count today stands over the mean of the days before by ``sigma`` sample deviations.

    Without any spread, a count over the mean plus one is one; strongest first.
    """
    base = daily.filter(F.col("day") < today).groupBy("cohort").agg(F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"))
    now = daily.filter(F.col("day") == today).select("cohort", F.col("n").alias("today"))
    j = now.join(base, "cohort")
    score = F.when(F.col("sd") > 0, (F.col("today") - F.col("mean")) / F.col("sd")).otherwise(F.col("today") - F.col("mean"))
    hit = F.when(F.col("sd") > 0, F.col("today") > F.col("mean") + sigma * F.col("sd")).otherwise(F.col("today") > F.col("mean") + 1)
    return j.withColumn("sigma", score).filter(hit).orderBy(F.desc("sigma"), "cohort").limit(most)


def emotional_weight(tagged: Column, n_takes: Column, mean_weight: Column, holder_share: Column) -> Column:
    total = F.when(tagged, 0.5).otherwise(0.0) + F.least(F.lit(0.3), 0.1 * n_takes) + 0.1 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean_weight)) + 0.1 * holder_share
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def salience(weight: Column, n_takes: Column, days_old: Column) -> Column:
    return 5 * weight + F.log(1 + n_takes) + 1 / (1 + F.greatest(F.lit(0.0), days_old))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Bounds of Wilson's score interval (95 % by default); null without trials."""
    p, m = share(hits, n), F.nullif(n, F.lit(0))
    mid = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / (1 + z * z / m)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)), F.when(n > 0, F.least(F.lit(1.0), mid + half))


def retrieval_metrics(ranked: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Per query: P@k (over k), R@k (over the relevant), reciprocal rank, nDCG@k with linear gains."""
    hits = ranked.join(qrels.filter("grade > 0"), ["query", "doc"])
    gain = F.col("grade") / F.log2(F.col("rank") + 1)
    got = hits.groupBy("query").agg(F.count(F.when(F.col("rank") <= k, 1)).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, gain)).alias("dcg"))
    ideal = qrels.filter("grade > 0").withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy(F.desc("grade"), "doc")))
    best = ideal.groupBy("query").agg(F.count(F.lit(1)).alias("relevant"), F.sum(F.when(F.col("pos") <= k, F.col("grade") / F.log2(F.col("pos") + 1))).alias("idcg"))
    j = best.join(got, "query", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select("query", zero(F.col("hits") / k).alias("p_at_k"), zero(F.col("hits") / F.col("relevant")).alias("r_at_k"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def replay_stability(before: Column, after: Column) -> tuple[Column, Column]:
    """(Jaccard of the two slug lists, same first slug); two empty lists are alike."""
    both = F.size(F.array_union(before, after))
    jaccard = F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(before, after)) / both)
    return jaccard, F.try_element_at(before, F.lit(1)).eqNullSafe(F.try_element_at(after, F.lit(1)))


def consensus(scores: DataFrame, least_raters: int, mean_floor: float = 7.0, min_floor: float = 5.0) -> DataFrame:
    """Per dimension: mean to one decimal, extremes, and whether it passes; dimensions with too few raters are left out."""
    s = scores.groupBy("dimension").agg(F.countDistinct("rater").alias("raters"), F.round(F.avg("score"), 1).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))
    return s.filter(F.col("raters") >= least_raters).withColumn("passes", (F.col("mean") >= mean_floor) & (F.col("low") >= min_floor))


def tier(n: Column, tiers: Mapping[str, int]) -> Column:
    out = None
    for name, least in sorted(tiers.items(), key=lambda x: -x[1]):
        out = F.when(n >= least, name) if out is None else out.when(n >= least, name)
    return out


#: Chances of up to k events at a mean of one.
POISSON_ONE = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def resample_weights(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """Poisson(1) weights, a row for each key and a column for each resample, from a hash of seed, key and resample."""
    with np.errstate(over="ignore"):
        x = (keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None] + (np.arange(resamples, dtype=np.uint64) + np.uint64(1 + (seed << 32)))[None, :] * np.uint64(0xD1342543DE82EF95)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the splitmix64 finaliser
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON_ONE, (x >> np.uint64(11)).astype(float) / float(1 << 53), side="right").astype(float)


def paired_bootstrap(pairs: DataFrame, resamples: int = 1000, seed: int = 1) -> DataFrame:
    """Mean difference of two systems and the share of Poisson resamples in which it isn't positive.

    Each pair gets a Poisson(1) weight in each resample from a hash of its key, so partitions work apart and only sums by
    resample are shuffled.
    """

    def run(frames):
        import pandas as pd

        total, weight = np.zeros(resamples), np.zeros(resamples)
        for pdf in frames:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                w = resample_weights(part["key"].to_numpy(), resamples, seed)
                total += (part["a"] - part["b"]).to_numpy(float) @ w
                weight += w.sum(axis=0)
        yield pd.DataFrame({"resample": np.arange(resamples), "total": total, "weight": weight})

    sums = pairs.select("key", "a", "b").mapInPandas(run, "resample int, total double, weight double").groupBy("resample").agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    mean = pairs.agg(F.avg(F.col("a") - F.col("b")).alias("difference"))
    p = sums.agg(F.avg((F.col("t") <= 0).cast("double")).alias("p_value"), F.count(F.lit(1)).alias("resamples"))
    return mean.withColumn("one", F.lit(1)).join(p.withColumn("one", F.lit(1)), "one").drop("one")


def bonferroni(p: float, tests: int) -> float:
    return min(1.0, p * max(1, tests))


def backoff_seconds(kind: str, attempt: Column, base: float, most: float = math.inf) -> Column:
    """Delay before the next attempt, without jitter: fixed, or doubled with each attempt."""
    raw = F.lit(float(base)) if kind == "fixed" else F.lit(float(base)) * F.pow(F.lit(2.0), attempt - 1)
    return F.least(raw, F.lit(most)) if most != math.inf else raw
