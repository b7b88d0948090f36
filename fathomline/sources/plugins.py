"""Sources by plug-in (Python Data Source API), binary objects, and aggregates by name."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from fathomline.operators.analytics import binary_outcome, share


class PluginReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.target, self.parts = options["function"], int(options.get("partitions", "1"))

    def partitions(self):
        return [InputPartition(i) for i in range(self.parts)]

    def read(self, partition):
        module, name = self.target.rsplit(":", 1)
        yield from getattr(importlib.import_module(module), name)(partition.value, self.parts)


class PluginSource(DataSource):
    """``spark.read.format("fathomline_plugin").schema(...).option("function", "module:name")``: the function gets
    (partition, partitions) and yields tuples."""

    @classmethod
    def name(cls) -> str:
        return "fathomline_plugin"

    def reader(self, schema):
        return PluginReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PluginSource)


def resolved(df: DataFrame, column: str, target: str) -> DataFrame:
    """``df`` with ``resolved``: what the plug-in ``module:name`` makes of the values of a text column, a batch's different ones at once.

    A plug-in that can't be imported is an error; null stays null.
    """
    module, name = target.rsplit(":", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = getattr(importlib.import_module(module), name)
        for batch in batches:
            once = batch.column(column).dictionary_encode()
            made = pa.array(f(once.dictionary.to_pylist()), pa.string())
            yield batch.append_column("resolved", made.take(once.indices))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("resolved", StringType())]))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of binary objects under any URI that Hadoop's file systems open: local, S3, HDFS."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def _square() -> Column:
    return F.pow(F.col("weight") - binary_outcome(), F.lit(2))


#: Aggregates of claims by name; callers may add their own.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "scalar_brier": lambda: F.avg(_square()),
    "conviction_brier": lambda: share(F.sum(_square() * F.abs(F.col("weight") - 0.5) * 2), F.sum(F.when(binary_outcome().isNotNull(), F.abs(F.col("weight") - 0.5) * 2))),
    "count_accuracy": lambda: F.avg(binary_outcome()),
}


def aggregate_by_name(takes: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    unknown = [n for n in names if n not in AGGREGATES]
    if unknown:
        raise ValueError(f"no such aggregate: {', '.join(unknown)}")
    return takes.groupBy(*by).agg(*[AGGREGATES[n]().alias(n) for n in names])
