"""Readers and writers of text formats: markdown with front matter, chat exports, fenced tables, NDJSON, exports."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRONT = r"(?s)^---\n(.*?)\n---\n?"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole files, from any file system that Spark reads."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def split_markdown(text: Column) -> dict[str, Column]:
    """front matter as map<string,string>, body, and the parts before and after a ``## Timeline`` heading."""
    front = F.regexp_extract(text, FRONT, 1)
    lines = F.filter(F.split(front, "\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([\w-]+):", 1).alias("key"), F.trim(F.regexp_replace(x, r"^[\w-]+:\s*[\"']?(.*?)[\"']?\s*$", "$1")).alias("value")))
    latest = F.aggregate(pairs, F.expr("cast(array() as array<struct<key:string,value:string>>)"), lambda acc, p: F.concat(F.filter(acc, lambda a: a["key"] != p["key"]), F.array(p)))
    body = F.regexp_replace(text, FRONT, "")
    mark = r"(?m)^## Timeline\s*$"
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return {
        "frontmatter": F.map_from_entries(latest),
        "body": body,
        "compiled_truth": bare(F.element_at(F.split(body, mark, 2), 1)),
        "timeline": bare(F.coalesce(F.try_element_at(F.split(body, mark, 2), F.lit(2)), F.lit(""))),
    }


def inferred(path: Column, text: Column) -> dict[str, Column]:
    """Title (first heading, else the file's name), date (file name) and type (first folder) where front matter has none."""
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.mdx?$", "")
    heading = F.nullif(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1), F.lit(""))
    bare = F.regexp_replace(name, r"^\d{4}-\d{2}-\d{2}[-_ ]*", "")
    return {
        "title": F.coalesce(heading, F.initcap(F.regexp_replace(bare, r"[-_]+", " "))),
        "date": F.nullif(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")),
        "type": F.regexp_replace(F.element_at(F.split(F.regexp_replace(path, r"^/", ""), "/"), 1), "s$", ""),
    }


def syncable(path: Column) -> Column:
    """Markdown files outside hidden folders and node_modules."""
    return path.rlike(r"\.mdx?$") & ~path.rlike(r"(^|/)\.[^/]") & ~path.contains("node_modules/")


def slug_of(path: Column) -> Column:
    lower = F.lower(F.regexp_replace(path, r"\.mdx?$", ""))
    return F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9/]+", "-"), r"(^|/)-+|-+(?=/|$)", "$1")


def table_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, cells) of pipe tables: header and separator lines are left out."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("at", "line")).filter(F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    bare = lines.filter(~F.col("line").rlike(r"^\s*\|[\s:|-]+\|\s*$"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\s*\||\|\s*$", ""), r"\|"), lambda x: F.trim(x))
    first = bare.groupBy(key).agg(F.min("at").alias("head"))
    return bare.join(first, key).filter("at > head").select(key, F.col("at").alias("row"), cells.alias("cells"))


def fenced(text: Column, kind: str) -> Column:
    """The inside of ``<!-- kind:begin -->`` ... ``<!-- kind:end -->``; empty where there is none."""
    return F.regexp_extract(text, rf"(?s)<!--\s*{kind}:begin\s*-->\s*\n(.*?)\n?\s*<!--\s*{kind}:end\s*-->", 1)


def without_fence(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, rf"(?s)<!--\s*{kind}:begin\s*-->.*?<!--\s*{kind}:end\s*-->\n?", "")


# Message patterns of chat exports; groups are time, speaker and text.
CHAT_FORMATS = {
    "bracket": r"^\[(?P<time>[^\]]+)\]\s*(?P<who>[^:]{1,40}):\s*(?P<text>.*)$",
    "dash": r"^(?P<time>\d{1,2}/\d{1,2}/\d{2,4},? \d{1,2}:\d{2}(?: ?[AP]M)?) - (?P<who>[^:]{1,40}): (?P<text>.*)$",
    "irc": r"^(?P<time>\d{1,2}:\d{2}(?::\d{2})?)\s+<(?P<who>[^>]+)>\s(?P<text>.*)$",
    "vtt": r"^<v (?P<who>[^>]+)>(?P<text>.*?)(?:</v>)?$",
    "bold": r"^\*\*(?P<who>[^*]{1,40})\*\*:?\s*(?P<text>.*)$",
    "plain": r"^(?P<who>[A-Z][\w .'-]{0,30}|user|assistant|system):\s+(?P<text>.*)$",
}


def parse_chat(text: str | None) -> tuple[str | None, list[tuple[str | None, str, str]]]:
    """(format, messages): the format that fits most lines, the earlier one in a tie; other lines continue a message."""
    lines = (text or "").split("\n")
    score = {name: sum(bool(re.match(p, x)) for x in lines) for name, p in CHAT_FORMATS.items()}
    best = max(score, key=lambda n: score[n])
    if not score[best]:
        return None, []
    out: list[list] = []
    for line in lines:
        m = re.match(CHAT_FORMATS[best], line)
        if m:
            g = m.groupdict()
            out.append([g.get("time"), g["who"].strip(), g["text"]])
        elif out and line.strip():
            out[-1][2] += "\n" + line
    return best, [tuple(x) for x in out]


def chats(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, format, turn, time, speaker, text) of every message of every export."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                fmt, messages = parse_chat(t)
                rows += [(k, fmt, i, *m) for i, m in enumerate(messages)]
            yield pd.DataFrame(rows, columns=[key, "format", "turn", "time", "speaker", "text"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, format string, turn int, time string, speaker string, text string")


def export_markdown(df: DataFrame, path: str) -> None:
    """A text file for each slug's folder: front matter, then the body."""
    front = F.concat(F.lit("---\ntype: "), "type", F.lit("\ntitle: "), "title", F.lit("\n---\n"), "compiled_truth")
    df.select(F.regexp_replace("slug", "/", "__").alias("slug"), front.alias("value")).write.partitionBy("slug").text(path)


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, grade) from NDJSON lines with ``relevant`` lists or ``grades`` objects."""
    raw = spark.read.schema("query string, relevant array<string>, grades map<string,double>").json(path)
    graded = F.coalesce(F.col("grades"), F.map_from_arrays(F.coalesce("relevant", F.array()), F.transform(F.coalesce("relevant", F.array()), lambda _: F.lit(1.0))))
    return raw.select("query", F.explode(graded).alias("doc", "grade"))


def write_ndjson(df: DataFrame, path: str) -> None:
    """One JSON object a line and row, nulls left out: captured queries, qrels, baselines."""
    df.write.json(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(query, rank, slug) from NDJSON lines with the result list of each query; ranks start at 1."""
    raw = spark.read.schema("query string, slugs array<string>").json(path)
    return raw.select("query", F.posexplode("slugs").alias("at", "slug")).select("query", (F.col("at") + 1).alias("rank"), "slug")
