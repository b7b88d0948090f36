"""Score modifiers, de-duplication and cut-offs of ranked results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomline.functions import text as T
from fathomline.operators.ordered import running_total
from fathomline.operators.scope import prefix_case


def over_all(df: DataFrame, value: Column) -> Column:
    """An aggregate of the whole table as a scalar subquery: one number, and no row is moved for it."""
    return df.agg(value).scalar()

# Half-life in days and coefficient of the recency boost by slug prefix.
RECENCY = {
    "concepts/": (0, 0.0),
    "originals/": (180, 0.5),
    "writing/": (365, 0.4),
    "daily/": (14, 1.5),
    "meetings/": (60, 1.0),
    "chat/": (7, 1.0),
    "media/x/": (7, 1.5),
    "media/articles/": (90, 0.5),
    "people/": (365, 0.3),
    "companies/": (365, 0.3),
    "deals/": (180, 0.5),
}
RECENCY_DEFAULT = (90, 0.5)


def floor_threshold(df: DataFrame, ratio: float | None) -> DataFrame:
    """``floor``: the top score times the ratio, fixed before any boost; null where it is off."""
    best = over_all(df, F.max("score"))
    on = ratio is not None and 0 <= ratio <= 1
    return df.withColumn("floor", F.when(best > 0, best * ratio) if on else F.lit(None).cast("double"))


def boost(df: DataFrame, factor: Column) -> DataFrame:
    """Multiply the scores that reach the floor (all, where it is off)."""
    return df.withColumn("score", F.when(F.col("floor").isNull() | (F.col("score") >= F.col("floor")), F.col("score") * factor).otherwise(F.col("score")))


def backlink_factor(n: Column) -> Column:
    return F.when(n > 0, 1 + 0.05 * F.log(1 + n)).otherwise(1.0)


def salience_factor(s: Column, strong: bool = False) -> Column:
    return F.when(s > 0, 1 + (0.30 if strong else 0.15) * F.log(1 + s)).otherwise(1.0)


def recency_factor(slug: Column, days: Column, strong: bool = False, table: Mapping[str, tuple[float, float]] = RECENCY, default: tuple[float, float] = RECENCY_DEFAULT) -> Column:
    """1 + m * c * h / (h + days), with (h, c) of the longest prefix; 1 for evergreen prefixes (h = 0)."""
    h = prefix_case(slug, {k: float(v[0]) for k, v in table.items()}, float(default[0]))
    c = prefix_case(slug, {k: float(v[1]) for k, v in table.items()}, float(default[1]))
    d = F.greatest(F.lit(0.0), days)
    return F.when(h > 0, 1 + (1.5 if strong else 1.0) * c * h / (h + d)).otherwise(1.0)


def chronicle_factor(kind: Column, strong: bool = False) -> Column:
    return F.when(kind.isin("event", "diary"), 1.25 if strong else 1.15).otherwise(1.0)


def title_factor(title: Column, query: Column) -> Column:
    """1.25 where the query's tokens stand in the title as a run."""
    line = lambda c: F.concat(F.lit(" "), F.array_join(T.tokens(c), " "), F.lit(" "))
    return F.when((F.size(T.tokens(query)) > 0) & F.contains(line(title), line(query)), 1.25).otherwise(1.0)


def exact_factor(slug: Column, title: Column, query: str, intent: str) -> Column:
    q = " ".join(query.lower().split())
    hit = (F.lower(title) == q) | (slug == q) | (T.basename(slug) == q.replace(" ", "-")) | (slug == q.replace(" ", "-"))
    return F.when(hit, {"entity": 1.25, "event": 1.10}.get(intent, 1.0)).otherwise(1.0)


def graph_signals(df: DataFrame, head: int = 20) -> DataFrame:
    """Within the head: 1.05 for two adjacent hits or more, 1.10 for two other sources or more; 0.95 for all but the best of a session.

    Needs ``hits``, ``cross_hits`` and ``session``; rows outside the head stay.
    """
    best = df.orderBy(F.desc("score"), "slug").limit(head)
    nth = F.row_number().over(W.partitionBy("session").orderBy(F.desc("score"), "slug"))
    factor = F.when(F.col("hits") >= 2, 1.05).otherwise(1.0) * F.when(F.col("cross_hits") >= 2, 1.10).otherwise(1.0) * F.when(F.col("session").isNotNull() & (nth > 1), 0.95).otherwise(1.0)
    factors = best.select("slug", *[c for c in ("source_id",) if c in df.columns], factor.alias("__factor"))
    keys = [c for c in factors.columns if c != "__factor"]
    return df.join(F.broadcast(factors), keys, "left").withColumn("score", F.col("score") * F.coalesce("__factor", F.lit(1.0))).select(*df.columns)


def score_distribution(df: DataFrame) -> DataFrame:
    """Nearest-rank percentiles of the scores: the value at index round((n - 1) q), half up.

    The rows of each score are counted first, and counts are added up in spans of scores, so no task or array holds all.
    """
    each = df.filter("score is not null").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = running_total(each, F.col("n"), "score", name="upto")
    whole = each.agg(F.sum("n")).scalar()
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((whole - 1) * q + 0.5), F.col("score")))
    out = upto.agg(F.sum("n").alias("n"), *[at(q / 100).alias(f"p{q}") for q in (25, 50, 75, 90, 95)]).filter("n > 0")
    return out.withColumn("band", F.col("p75") - F.col("p25"))


def evidence(alias_hit: Column, exact: Column, score: Column) -> Column:
    return F.when(alias_hit, "alias_hit").when(exact, "exact_title").when(score >= 0.85, "strong").when(score >= 0.6, "solid").otherwise("weak")


def create_safety(evidence_class: Column) -> Column:
    return F.when(evidence_class.isin("alias_hit", "exact_title", "strong"), "exists").when(evidence_class == "solid", "probable").otherwise("unknown")


def diversify(df: DataFrame, kind: str, share: float = 0.6) -> DataFrame:
    """At most max(1, ceil(share * n)) rows of a kind, in rank order."""
    cap = F.greatest(F.lit(1), F.ceil(share * over_all(df, F.count(F.lit(1)))))
    nth = F.row_number().over(W.partitionBy(kind).orderBy("rank"))
    return df.withColumn("__n", nth).withColumn("__cap", cap).filter("__n <= __cap").drop("__n", "__cap")


def text_dedup(df: DataFrame, by: str, most: float = 0.85) -> DataFrame:
    """Greedy, in rank order: a row goes if its word set is too similar to a kept one's. ``by`` groups short result lists."""
    schema = df.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[set] = []
        keep = []
        pdf = pdf.sort_values("rank", kind="stable")
        for text in pdf["text"]:
            words = set((text or "").lower().split())
            close = any(len(words & k) / max(1, len(words | k)) > most for k in kept)
            keep.append(not close)
            if not close:
                kept.append(words)
        return pdf[keep]

    return df.groupBy(by).applyInPandas(run, schema)


def truth_guarantee(kept: DataFrame, pool: DataFrame, page: str = "page_id") -> DataFrame:
    """A page without a chunk of the main text swaps its lowest chunk for the best such one of the pool."""
    w = W.partitionBy(page)
    flagged = kept.withColumn("__has", F.max((F.col("chunk_source") == "compiled_truth").cast("int")).over(w)).withColumn("__low", F.row_number().over(w.orderBy("score", F.desc("chunk_id"))))
    candidate = pool.filter("chunk_source = 'compiled_truth'").withColumn("__n", F.row_number().over(w.orderBy(F.desc("score"), "chunk_id"))).filter("__n = 1").drop("__n")
    needy = flagged.filter("__has = 0").select(page).distinct().join(candidate.select(page), page, "left_semi")
    out = flagged.join(needy.withColumn("__swap", F.lit(True)), page, "left").filter("__swap is null or __low > 1").select(*kept.columns)
    return out.unionByName(candidate.join(needy, page, "left_semi").select(*kept.columns))


def autocut(df: DataFrame, jump: float = 0.2, min_keep: int = 1) -> DataFrame:
    """Cut after the largest gap of normalised rerank scores, if it reaches ``jump``; ties and alias hits stay."""
    best = over_all(df, F.max("rerank_score"))
    top = F.when(best > 0, best)
    w = W.orderBy(F.desc("rerank_score"), F.asc("slug"))
    scored = df.filter("rerank_score is not null").withColumn("__i", F.row_number().over(w)).withColumn("__gap", (F.col("rerank_score") - F.lead("rerank_score").over(w)) / top)
    cut = scored.filter((F.col("__i") >= max(1, min_keep)) & F.col("__gap").isNotNull()).agg(F.max_by(F.struct("__gap", "rerank_score"), F.struct(F.col("__gap"), -F.col("__i"))).alias("c"))
    joined = df.join(F.broadcast(cut), F.lit(True), "left")
    keep = F.col("c").isNull() | (F.col("c.__gap") < jump) | F.coalesce(F.col("alias_hit"), F.lit(False)) | (F.col("rerank_score") >= F.col("c.rerank_score"))
    return joined.filter(keep).select(*df.columns)


def adaptive_limit(intent: str) -> int:
    return 2 if intent == "entity" else 6


def token_budget(df: DataFrame, budget: int, order: Sequence[Column]) -> DataFrame:
    """Rows up to the first that would pass the budget; the cost is a token for four characters of title and text."""
    cost = T.token_estimate(F.concat(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))))
    spent = F.sum(cost).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("spent", spent).filter(F.col("spent") <= budget)


def page_of(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
