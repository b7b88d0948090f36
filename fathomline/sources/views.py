"""The engine's tables (pages, chunks, links, claims, facts, ...) projected from the star-schema input tables.

Each view is a plain projection, so filters and column pruning reach the parquet scan. ``SQL`` holds the same views as
common table expressions for the DuckDB twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.session import table

EPOCH = "2024-01-01 00:00:00"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: identity (source_id, slug); some soft-deleted, quarantined or undated."""
    d = table(spark, sf_dir, "documents")
    at = F.to_timestamp(F.lit(EPOCH))
    return d.select(
        F.col("doc_id").alias("page_id"),
        F.col("source").alias("source_id"),
        F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("slug"),
        F.col("lang").alias("type"),
        F.regexp_extract("text", r"^([^\n.]{0,60})", 1).alias("title"),
        F.col("text").alias("compiled_truth"),
        F.when(F.col("doc_id") % 29 == 0, F.lit(None)).when(F.col("doc_id") % 23 == 0, F.lit('{"quarantine":{"reason":"junk"},"domain":" ops "}')).otherwise(F.lit('{"tags":["a","b"]}')).cast("string").alias("frontmatter"),
        F.timestamp_add("HOUR", F.col("doc_id").cast("int"), at).alias("created_at"),
        F.timestamp_add("HOUR", (F.col("doc_id") + 24 * (F.col("doc_id") % 30)).cast("int"), at).alias("updated_at"),
        F.when(F.col("doc_id") % 17 == 0, at).alias("deleted_at"),
        F.when(F.col("doc_id") % 3 == 0, F.timestamp_add("DAY", (F.col("doc_id") % 700).cast("int") - 300, at)).alias("effective_date"),
        F.col("n_chars"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("n_pages")).withColumn("archived", F.col("id").isin("src3", "src11"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as chunks: the label stands for the page, vec_id for the chunk."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("page_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed, directed edges: customers and suppliers to nations to regions, and customers to the suppliers of their urgent orders."""
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    c = table(spark, sf_dir, "customer")
    s = table(spark, sf_dir, "supplier")
    o = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    li = table(spark, sf_dir, "lineitem")

    def edge(df, src, dst, kind, origin):
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("link_type"), origin.alias("link_source"))

    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    md = F.lit("markdown")
    # what is shuffled is keys, not names: one row for each link before it is named
    lines = li.select("l_orderkey", "l_suppkey", F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).when(F.col("l_partkey") % 3 == 1, F.lit(1)).otherwise(F.lit(2)).cast("byte").alias("m"))
    bought = o.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey", "m").distinct()
    return (
        edge(n.join(r, n["n_regionkey"] == r["r_regionkey"]), name("nations/", "n_nationkey"), name("regions/", "r_regionkey"), "part_of", md)
        .union(edge(c, name("customers/", "c_custkey"), name("nations/", "c_nationkey"), "located_in", md))
        .union(edge(s, name("suppliers/", "s_suppkey"), name("nations/", "s_nationkey"), "located_in", md))
        .union(edge(bought, name("customers/", "o_custkey"), name("suppliers/", "l_suppkey"), "buys_from", F.when(F.col("m") == 0, "mentions").when(F.col("m") == 1, "markdown")))
    )


def takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as weighted claims with outcomes."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_partkey").alias("page_id"),
        F.concat(F.lit("h"), (F.col("l_suppkey") % 7).cast("string")).alias("holder"),
        F.concat(F.lit("d"), (F.col("l_partkey") % 5).cast("string")).alias("domain"),
        F.round(F.col("l_discount") * 10, 2).alias("weight"),
        F.when(F.col("l_returnflag") == "R", "incorrect").when(F.col("l_returnflag") == "A", "correct").when(F.col("l_linestatus") == "F", "partial").alias("quality"),
        F.col("l_shipdate").alias("since_date"),
        (F.col("l_tax") < 0.07).alias("active"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as dated claims about users."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("entity"),
        F.col("event_type").alias("metric"),
        F.col("value"),
        F.col("ts").alias("valid_from"),
        (F.col("event_id") % 100 / 100.0).alias("confidence"),
        F.when(F.col("event_id") % 11 == 0, F.timestamp_add("DAY", F.lit(3), F.col("ts"))).alias("expired_at"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("queue"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "waiting").otherwise("active").alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_totalprice").alias("cost"),
    )


#: The views as DuckDB common table expressions; use as f"WITH {SQL['pages']}, {SQL['takes']} SELECT ...".
SQL = {
    "pages": """pages_v AS (SELECT doc_id AS page_id, source AS source_id, lang || '/' || doc_id AS slug, lang AS type,
  regexp_extract(text, '^([^\\n.]{0,60})', 1) AS title, text AS compiled_truth,
  CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 23 = 0 THEN '{"quarantine":{"reason":"junk"},"domain":" ops "}' ELSE '{"tags":["a","b"]}' END AS frontmatter,
  TIMESTAMP '2024-01-01' + to_hours(doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_hours(doc_id + 24 * (doc_id % 30)) AS updated_at,
  CASE WHEN doc_id % 17 = 0 THEN TIMESTAMP '2024-01-01' END AS deleted_at,
  CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days((doc_id % 700)::INT - 300) END AS effective_date, n_chars FROM documents)""",
    "sources": """sources_v AS (SELECT source AS id, count(*) AS n_pages, source IN ('src3', 'src11') AS archived FROM documents GROUP BY source)""",
    "chunks": """chunks_v AS (SELECT vec_id AS chunk_id, label AS page_id, embedding::DOUBLE[] AS embedding FROM embeddings)""",
    "links": """links_v AS (SELECT 'nations/' || n_nationkey AS src, 'regions/' || r_regionkey AS dst, 'part_of' AS link_type, 'markdown' AS link_source FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'customers/' || c_custkey, 'nations/' || c_nationkey, 'located_in', 'markdown' FROM customer
  UNION ALL SELECT 'suppliers/' || s_suppkey, 'nations/' || s_nationkey, 'located_in', 'markdown' FROM supplier
  UNION ALL SELECT DISTINCT 'customers/' || o_custkey, 'suppliers/' || l_suppkey, 'buys_from', CASE l_partkey % 3 WHEN 0 THEN 'mentions' WHEN 1 THEN 'markdown' END
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT')""",
    "takes": """takes_v AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS page_id, 'h' || (l_suppkey % 7) AS holder, 'd' || (l_partkey % 5) AS domain,
  round(l_discount * 10, 2) AS weight, CASE WHEN l_returnflag = 'R' THEN 'incorrect' WHEN l_returnflag = 'A' THEN 'correct' WHEN l_linestatus = 'F' THEN 'partial' END AS quality,
  l_shipdate AS since_date, l_tax < 0.07 AS active FROM lineitem)""",
    "facts": """facts_v AS (SELECT event_id AS id, user_id AS entity, event_type AS metric, value, ts AS valid_from, event_id % 100 / 100.0::DOUBLE AS confidence,
  CASE WHEN event_id % 11 = 0 THEN ts + to_days(3) END AS expired_at FROM events)""",
    "jobs": """jobs_v AS (SELECT o_orderkey AS id, o_custkey AS queue, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'waiting' ELSE 'active' END AS status,
  substr(o_orderpriority, 1, 1)::INT AS priority, o_orderdate AS created_at, o_totalprice AS cost FROM orders)""",
}


def with_views(*names: str, more: str = "") -> str:
    """A WITH clause of the named views and further expressions."""
    return "WITH RECURSIVE " + ", ".join([*(SQL[n] for n in names), *([more] if more else [])])
