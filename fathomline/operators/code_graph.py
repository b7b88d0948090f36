"""Calls bound to definitions: which of the functions with a name a call means, by scopes and imports, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The ways a call is bound, nearest first.
WAYS = ("class", "file", "import", "unique")


def module_of(path: Column) -> Column:
    """A file's path without its extension."""
    return F.regexp_replace(path, r"\.[A-Za-z0-9]+$", "")


def import_path(target: Column, relative: Column) -> Column:
    """An import's target as a path: dots, colons and backslashes part it, but in one that is a relative or quoted path."""
    plain = F.when(relative, F.regexp_replace(module_of(target), r"^(\./|\.\./)+", "")).otherwise(F.regexp_replace(target, r"(\.|::|\\)+", "/"))
    return F.regexp_replace(plain, "^/+|/+$", "")


def bound_calls(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, from_symbol, name, to_file, to_symbol, way) of every call of ``edges`` (file, from_symbol, to_symbol, kind).

    ``definitions``: (file, symbol). A call of a bare name means, in this order: a method of the caller's class in its file; a
    definition of its file; one of a file that its file imports (an import names a file by the end of its path, or a definition
    in it); the only definition of that name anywhere. Of several in one way the first by file and symbol is taken, but
    several anywhere are nobody's: such a call, and one of a name that isn't defined, has nulls. Calls of one name are dealt by
    name and file; the count of a name's definitions is summed before it is joined.
    """
    d = definitions.filter("symbol <> ''").select(F.col("file").alias("to_file"), F.col("symbol").alias("to_symbol"), F.element_at(F.split("symbol", r"\."), -1).alias("name")).distinct()
    calls = edges.filter("kind = 'calls'").select("file", "from_symbol", F.element_at(F.split("to_symbol", r"\."), -1).alias("name")).distinct()
    # each name stands for itself in its own file; within a class as the class's method
    own = calls.join(d.withColumn("file", F.col("to_file")), ["file", "name"])
    holder = F.regexp_extract("from_symbol", r"^(.*)\.[^.]*$", 1)
    in_class = own.filter((holder != "") & (F.col("to_symbol") == F.concat(holder, F.lit("."), "name"))).withColumn("way", F.lit("class"))
    in_file = own.filter(F.col("to_symbol") == F.col("name")).withColumn("way", F.lit("file"))
    # an import names the end of a file's path, or that of a file and one of its definitions
    target = F.col("to_symbol")
    relative = target.rlike(r"^\.{1,2}/|/|\.(js|ts|h|hpp|php|rb|c)$")
    imports = edges.filter("kind = 'imports'").select("file", import_path(target, relative).alias("whole")).filter("whole <> ''")
    tails = imports.select("file", "whole", F.explode(F.array("whole", F.regexp_replace("whole", "/[^/]*$", ""))).alias("path")).filter("path <> ''").distinct()
    files = d.select("to_file").distinct().withColumn("module", module_of(F.col("to_file")))
    # a file stands under each end of its path, so that an import meets those files alone that it may mean
    parts = F.split("module", "/")
    ends = files.select("to_file", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("path"))
    seen = tails.join(ends, "path").filter("file <> to_file").select("file", "to_file").distinct()
    imported = calls.join(seen, "file").join(d, ["to_file", "name"]).filter(F.col("to_symbol") == F.col("name")).withColumn("way", F.lit("import"))
    once = d.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.first("to_file").alias("to_file"), F.first("to_symbol").alias("to_symbol")).filter("n = 1").drop("n")
    unique = calls.join(once, "name").withColumn("way", F.lit("unique"))
    columns = ["file", "from_symbol", "name", "to_file", "to_symbol", "way"]
    found = in_class.select(*columns).unionByName(in_file.select(*columns)).unionByName(imported.select(*columns)).unionByName(unique.select(*columns))
    order = F.array_position(F.array(*map(F.lit, WAYS)), F.col("way"))
    w = W.partitionBy("file", "from_symbol", "name").orderBy(order, "to_file", "to_symbol")
    best = found.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return calls.join(best, ["file", "from_symbol", "name"], "left").select(*columns)
