"""A training corpus from raw documents, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame on the whole output of the one before. All but the last
return the columns of documents; the last returns a row for each packed piece. ``run`` writes each stage's rows as
Parquet in the cluster's shared folder and reads them again for the next; a stage's table goes when the next one is written.

Defined cases, in every stage: an empty table gives no rows; columns beside those that a stage reads pass through, whatever
their names; texts of any length are read whole; rows that repeat are judged each by itself but in (9), which keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import crf_quality, line_dedup, mixing, packing, simhash
from fathomline.session import ensure_checkpoint_dir, remove_folder


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(1) Documents whose lines the conditional random field takes for good; the others go.

    Null and empty texts have the score of one line without features. Without a usable label every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return crf_quality.accepted(docs, crf_quality.train(docs, labels))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(6) Lines that stand in many different texts of their source go; n_chars follows the text.

    Copies of a document are left to (9). A null text stays null, and n_chars with it; a null source is a source of its own; a
    text of nothing but such lines becomes empty.
    """
    out = line_dedup.drop_boilerplate(docs, by_text=True)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(9) One document of each group of near-duplicates stays: that with the smallest doc_id, null last.

    Null and empty texts and texts without words are one group. Rows with one doc_id and other texts are documents of their own.
    """
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(7) Documents repeated by Poisson counts to the sources' target weights, in a global random order.

    Null sources and sources without a weight have a weight of 1; a null doc_id draws as the text ``''``.
    """
    return mixing.mixed(docs, mixing.WEIGHTS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(3) Token sequences of at most 1024 tokens: a row for each piece with its place.

    Null and empty texts are the end id alone; copies of a document are packed each by itself.
    """
    return packing.packed(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_site_lines),
    ("simhash near-dedup", one_of_each_group),
    ("mix sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained models, connected components and bin packing aren't SQL: the tests check each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{shared}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{shared}/{k}")
        if k:
            remove_folder(spark, f"{shared}/{k - 1}")
    return docs
