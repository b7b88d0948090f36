"""Line dedup (6): site-relative line frequency.

A line's share is the number of its site's documents that contain it over the number of the site's documents. Lines whose
share exceeds ``MAX_SHARE``, and that stand in at least ``LEAST_PAGES`` documents of the site, are boilerplate and are
dropped from that site's documents; the other lines stay, in order. Lines are cut at ``\\n`` and compared byte for byte
but for blanks around them; lines of blanks only are never boilerplate.

The counting shuffle carries a 128-bit hash for each line of each document, summed before it is sent, so neither a hot
site nor a hot line makes a large group. A site can have at most (lines a document) / ``MAX_SHARE`` boilerplate
lines, and a document is searched for them by a hash set. Their table is broadcast where it is small; otherwise documents
and lists are joined by site, and sites that hold over 1 / ``HOT_SITES`` of all documents, of which there can't be more
than ``HOT_SITES``, are dealt over as many tasks as their size asks for.

Defined cases: a null text stays null; an empty text stays empty; a text of nothing but boilerplate becomes empty; a null
site is a site of its own; texts of any length are read whole; repeated rows each count as a document, or (``by_text``) all rows of a site with one
text count once, so that copies of a document don't make its lines boilerplate; an empty table gives
no rows; columns other than the site and the text are not touched, whatever their names, as rows travel as one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.session import cut_lineage

MAX_SHARE = 0.05
LEAST_PAGES = 3
#: Rows of boilerplate lines up to which their table is broadcast.
BROADCAST_ROWS = 100_000
HOT_SITES = 10_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, for tables of pages."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def line_key(line: Column) -> Column:
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit("fathomline"), bare).alias("b"))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def boilerplate(docs: DataFrame, site: str, text: str, max_share: float, least_pages: int, by_text: bool = False) -> DataFrame:
    """(site, a, b, pages, total) of every line over the limit."""
    own = docs.select(F.coalesce(F.col(site), F.lit("\0")).alias("site"), F.col(text).alias("text"))
    keys = F.array_distinct(F.transform(F.filter(lines_of("text"), lambda x: F.length(F.trim(x)) > 0), line_key))
    if by_text:
        whole = F.coalesce("text", F.lit(""))
        own = cut_lineage(own.groupBy("site", F.xxhash64(whole).alias("h"), F.xxhash64(F.lit("fathomline"), whole).alias("h2")).agg(F.first(keys).alias("keys")))
        keys = F.col("keys")
    total = own.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    lines = own.select("site", F.explode(keys).alias("k"))
    counts = lines.groupBy("site", "k.a", "k.b").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    return counts.join(total, "site").filter(F.col("pages") > max_share * F.col("total"))


def with_lists(rows: DataFrame, found: DataFrame, broadcast_rows: int = BROADCAST_ROWS, hot_sites: int = HOT_SITES) -> DataFrame:
    """``rows`` (site, row, text) with the site's boilerplate lines as ``drop``, null where it has none."""
    lists = found.groupBy("site").agg(F.collect_list(F.struct("a", "b")).alias("drop"))
    if found.count() <= broadcast_rows:
        return rows.join(F.broadcast(lists), "site", "left")
    sizes = cut_lineage(rows.groupBy("site").agg(F.count(F.lit(1)).alias("n")))
    most = max(1, (sizes.agg(F.sum("n")).first()[0] or 0) // hot_sites)
    hot = F.broadcast(sizes.filter(F.col("n") > most).select("site", F.ceil(F.col("n") / most).cast("int").alias("salts")))  # hot_sites rows at most
    salted = rows.join(hot, "site", "left").withColumn("salt", F.pmod(F.xxhash64("text"), F.coalesce("salts", F.lit(1))).cast("int"))
    copies = lists.join(hot, "site", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return salted.drop("salts").join(copies.drop("salts"), ["site", "salt"], "left")


def drop_boilerplate(docs: DataFrame, site: str = "source", text: str = "text", max_share: float = MAX_SHARE, least_pages: int = LEAST_PAGES, tally: bool = False, by_text: bool = False, broadcast_rows: int = BROADCAST_ROWS, hot_sites: int = HOT_SITES) -> DataFrame:
    """``docs`` without the boilerplate lines; ``tally`` adds n_lines and n_dropped, ``by_text`` counts equal texts of a site once."""
    found = cut_lineage(boilerplate(docs, site, text, max_share, least_pages, by_text))
    rows = docs.select(F.coalesce(F.col(site), F.lit("\0")).alias("site"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(0)]).alias("row"))
    joined = with_lists(rows, found, broadcast_rows, hot_sites)
    # by hash set which of the list's lines the text has, mostly none; then by both halves of the key which lines go
    met = F.array_intersect(F.transform(lines_of("text"), lambda x: line_key(x)["a"]), F.col("drop.a"))
    joined = joined.withColumn("met", F.when(F.col("drop").isNotNull() & F.col("text").isNotNull(), met))
    own_drop = F.when(F.size("met") > 0, F.filter("drop", lambda d: F.array_contains("met", d["a"])))
    joined = joined.withColumn("own", own_drop)
    kept = F.filter(lines_of("text"), lambda x: ~F.array_contains(F.col("own"), line_key(x)))
    clean = F.when(F.col("own").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [F.col(f"row.`{c}`").alias(c) if c != text else clean.alias(text) for c in docs.columns]
    if tally:
        n = F.size(lines_of("text"))
        out += [n.cast("long").alias("n_lines"), F.when(F.col("own").isNull(), F.lit(0)).otherwise(n - F.size(kept)).cast("long").alias("n_dropped")]
    return joined.select(*out)


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document with its site's boilerplate lines dropped, and how many there were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return drop_boilerplate(docs, tally=True).select("doc_id", "source", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("clean_text"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source, coalesce(source, chr(0)) AS site, row_number() OVER () AS r FROM documents),
l AS (SELECT r, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
t AS (SELECT site, count(*) AS total FROM d GROUP BY site),
f AS (SELECT l.site, trim(line) AS bare FROM l JOIN t ON l.site = t.site WHERE trim(line) <> ''
      GROUP BY l.site, trim(line), total HAVING count(DISTINCT r) >= {LEAST_PAGES} AND count(DISTINCT r) > {MAX_SHARE} * total),
x AS (SELECT l.r, count(*) AS n_lines, count(f.bare) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE f.bare IS NULL), '') AS clean_text
      FROM l LEFT JOIN f ON f.site = l.site AND f.bare = trim(l.line) GROUP BY l.r)
SELECT doc_id, source, n_lines, n_dropped, clean_text FROM d JOIN x ON d.r = x.r
"""
