"""Writes as DataFrame -> DataFrame: upserts, insert-ignore, soft deletion, versions, rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], first_write_wins: Sequence[str] = ()) -> DataFrame:
    """New values replace old ones by key; columns in ``first_write_wins`` keep the old value unless it is null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    touched = F.col("n.__new").isNotNull()
    joined = o.join(new.withColumn("__new", F.lit(True)).alias("n"), on, "full_outer") if n is not None else o
    out = []
    for c in old.columns:
        a, b = F.col(f"o.{c}"), F.col(f"n.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            out.append(F.coalesce(a, b).alias(c))
        elif c in first_write_wins:
            out.append(F.coalesce(a, b).alias(c))
        else:
            out.append((F.when(touched, b).otherwise(a) if c in new.columns else a).alias(c))
    return joined.select(*out)


def replace_set(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of an owner are replaced by its new rows; other owners' rows stay."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` that go in: one for each key (null equals null) that isn't there yet."""
    fresh = new.dropDuplicates(list(keys)).alias("n")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return fresh.join(old.select(*keys).alias("o"), on, "left_anti")


def soft_delete(df: DataFrame, which: DataFrame, keys: Sequence[str], at: Column) -> DataFrame:
    hit = which.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return df.join(hit, list(keys), "left").withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("__hit"), at))).drop("__hit").select(*df.columns)


def purge(df: DataFrame, cutoff: Column) -> DataFrame:
    """Rows deleted before the cutoff go for good."""
    return df.filter(F.col("deleted_at").isNull() | (F.col("deleted_at") >= cutoff))


def add_counts(table: DataFrame, deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive upsert: counters of equal keys are summed."""
    counters = [c for c in table.columns if c not in keys]
    return table.unionByName(deltas.select(*table.columns)).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def latest_version(versions: DataFrame, key: str, at: str) -> DataFrame:
    """The newest snapshot of each key (greatest time, then greatest version id)."""
    w = W.partitionBy(key).orderBy(F.col(at).desc(), F.col("version").desc())
    return versions.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def rename(df: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """Rewrite a slug column by a table (old, new)."""
    r = renames.select(F.col("old").alias(column), F.col("new").alias("__to"))
    return df.join(r, column, "left").withColumn(column, F.coalesce("__to", column)).drop("__to").select(*df.columns)


def keep_smallest_id(df: DataFrame, keys: Sequence[str], id_col: str = "id") -> DataFrame:
    """One row for each key: that with the smallest id."""
    best = df.groupBy(*keys).agg(F.min(id_col).alias(id_col)).select(id_col)
    return df.join(best, id_col, "left_semi")


def set_field(df: DataFrame, column: str, field: str, value: str) -> DataFrame:
    """Set one text field of a JSON object of text fields."""
    parsed = F.from_json(F.coalesce(F.col(column), F.lit("{}")), "map<string,string>")
    rest = F.map_filter(parsed, lambda k, _: k != field)
    return df.withColumn(column, F.to_json(F.map_concat(rest, F.create_map(F.lit(field), F.lit(value)))))


def manifest_diff(old: DataFrame, new: DataFrame, path: str = "path", digest: str = "hash") -> DataFrame:
    """added, modified, deleted and renamed paths between two manifests; a rename keeps its content's hash."""
    o, n = old.select(F.col(path).alias("op"), F.col(digest).alias("oh")), new.select(F.col(path).alias("np"), F.col(digest).alias("nh"))
    both = o.join(n, F.col("op") == F.col("np"), "full_outer")
    added, gone = both.filter("op is null").select("np", "nh"), both.filter("np is null").select("op", "oh")
    once = lambda d, k: d.withColumn("__i", F.row_number().over(W.partitionBy(k).orderBy(d.columns[0])))
    a, g = once(added, "nh"), once(gone, "oh")
    pairs = a.join(g, (F.col("nh") == F.col("oh")) & (a["__i"] == g["__i"]), "full_outer")
    moved = pairs.select(
        F.when(F.col("op").isNull(), "added").when(F.col("np").isNull(), "deleted").otherwise("renamed").alias("change"),
        F.coalesce("np", "op").alias("path"),
        F.when(F.col("np").isNotNull(), F.col("op")).alias("old_path"),
    )
    changed = both.filter("op is not null and np is not null and oh <> nh").select(F.lit("modified").alias("change"), F.col("np").alias("path"), F.lit(None).cast("string").alias("old_path"))
    return moved.union(changed)
