"""Predicates and projections over pages: prefix factors, visibility, scoping, dates."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Score factors by slug prefix.
SOURCE_FACTORS = {
    "originals/": 1.5,
    "concepts/": 1.3,
    "writing/": 1.4,
    "people/": 1.2,
    "companies/": 1.2,
    "deals/": 1.2,
    "meetings/": 1.1,
    "media/articles/": 1.1,
    "media/repos/": 1.1,
    "yc/": 1.0,
    "civic/": 1.0,
    "daily/": 0.8,
    "media/x/": 0.7,
    "openclaw/chat/": 0.5,
    "archive/": 0.5,
    "extracts/": 0.3,
}
# Slug prefixes that never enter search results.
HARD_EXCLUDES = ("test/", "attachments/", ".raw/")
# Pages for which no inbound link is expected.
PSEUDO_SLUGS = ("_atlas", "_index", "_stats", "_orphans", "_scratch", "claude")
AUTO_SUFFIXES = ("/_index", "/log")
RAW_SEGMENT = "/raw/"
DENY_PREFIXES = ("output/", "dashboards/", "scripts/", "templates/")
FIRST_SEGMENTS = ("scratch", "thoughts", "catalog", "entities")

DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def prefix_case(col: Column, factors: Mapping[str, float], default: float = 1.0) -> Column:
    """The value of the longest prefix that fits, as one CASE: a pure expression that stays in generated code."""
    out = None
    for prefix in sorted(factors, key=lambda p: (-len(p), p)):
        hit = col.startswith(prefix)
        value = F.lit(factors[prefix])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def hard_exclude(df: DataFrame, slug: str = "slug", prefixes: Iterable[str] = HARD_EXCLUDES, include: Iterable[str] = ()) -> DataFrame:
    """Drop rows under excluded prefixes, unless the prefix is asked for."""
    for p in sorted(set(prefixes) - set(include)):
        df = df.filter(~F.col(slug).startswith(p))
    return df


def has_key(col: Column, key: str) -> Column:
    """Whether a JSON object has the key; a null object has none."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.coalesce(col, F.lit("{}"))), key), F.lit(False))


def visible(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages that aren't deleted or quarantined and whose source isn't archived."""
    gone = sources.filter("archived").select(F.col("id").alias("source_id"))
    live = pages.filter(F.col("deleted_at").isNull() & ~has_key(F.col("frontmatter"), "quarantine"))
    return live.join(gone, "source_id", "left_anti")


def scoped(df: DataFrame, source_ids: Iterable[str] | None = None, source_id: str | None = None) -> DataFrame:
    """A list of sources wins over a single one; neither means all."""
    if source_ids is not None:
        return df.filter(F.col("source_id").isin(*source_ids))
    return df if source_id is None else df.filter(F.col("source_id") == source_id)


def clamp_limit(n: float | None, default: int = DEFAULT_LIMIT, most: int = MAX_LIMIT) -> int:
    """Whole numbers from 1 to ``most``; what isn't a positive number is the default."""
    if n is None or n != n or n <= 0 or int(n) == 0:
        return default
    return min(int(n), most)


def parse_bound(text: str | None, now: dt.datetime, upper: bool = False) -> dt.datetime | None:
    """``7d``, ``2w`` and ``1y`` count back from now (a year is 365 days); a bare day as upper bound is its last microsecond."""
    if text is None or not text.strip():
        return None
    text = text.strip()
    if m := re.fullmatch(r"(\d+)([dwy])", text):
        return now - dt.timedelta(days=int(m[1]) * {"d": 1, "w": 7, "y": 365}[m[2]])
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = dt.datetime.fromisoformat(text)
        return day + dt.timedelta(days=1, microseconds=-1) if upper else day
    value = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return value.astimezone(dt.timezone.utc).replace(tzinfo=None) if value.tzinfo else value


def date_window(since: str | None, until: str | None, now: dt.datetime) -> tuple[dt.datetime | None, dt.datetime | None]:
    a, b = parse_bound(since, now), parse_bound(until, now, upper=True)
    if a and b and a > b:
        raise ValueError(f"since ({since}) is after until ({until})")
    return a, b


def page_date() -> Column:
    return F.coalesce("effective_date", "updated_at", "created_at")


def in_window(df: DataFrame, since: dt.datetime | None = None, until: dt.datetime | None = None, after: dt.datetime | None = None, before: dt.datetime | None = None) -> DataFrame:
    """``since`` and ``until`` are inclusive, ``after`` and ``before`` exclusive."""
    d = page_date()
    for bound, test in ((since, d.__ge__), (until, d.__le__), (after, d.__gt__), (before, d.__lt__)):
        if bound is not None:
            df = df.filter(test(F.to_timestamp(F.lit(bound.isoformat(sep=" ")))))
    return df


def effective_date(event: Column, date: Column, published: Column, filename: Column, updated: Column, created: Column, now: dt.datetime, filename_first: Column) -> tuple[Column, Column]:
    """(date, its source): the first candidate within 1990 and a year from now; updated, then created otherwise, whatever they are."""
    low, high = F.to_timestamp(F.lit("1990-01-01")), F.to_timestamp(F.lit((now + dt.timedelta(days=365)).isoformat(sep=" ")))
    valid = lambda c: F.when((c >= low) & (c <= high), c)
    named = F.try_to_timestamp(F.nullif(F.regexp_extract(filename, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    parsed = {"event_date": valid(F.try_to_timestamp(event)), "date": valid(F.try_to_timestamp(date)), "published": valid(F.try_to_timestamp(published)), "filename": valid(named)}
    order = ["event_date", "date", "published", "filename"]
    first = ["filename", *order[:3]]
    pick = lambda names: F.coalesce(*[parsed[n] for n in names], updated, created)
    label = lambda names: F.coalesce(*[F.when(parsed[n].isNotNull(), F.lit(n)) for n in names], F.lit("fallback"))
    return F.when(filename_first, pick(first)).otherwise(pick(order)), F.when(filename_first, label(first)).otherwise(label(order))


def orphan_exempt(slug: Column) -> Column:
    """Pages for which having no inbound link is no finding."""
    out = slug.isin(*PSEUDO_SLUGS) | slug.contains(RAW_SEGMENT) | F.split(slug, "/")[0].isin(*FIRST_SEGMENTS)
    for s in AUTO_SUFFIXES:
        out = out | slug.endswith(s)
    for p in DENY_PREFIXES:
        out = out | slug.startswith(p)
    return out


def domain_of(declared: Column, slug: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.nullif(F.split(slug, "/")[0], F.lit("")), F.lit("root"))


def thin_body(body: Column, least: int) -> Column:
    return F.length(F.trim(F.coalesce(body, F.lit("")))) < least


def like_escaped(text: str) -> str:
    r"""A LIKE pattern that means the text itself: ``\``, ``%`` and ``_`` are escaped."""
    return re.sub(r"([\\%_])", r"\\\1", text)


def prose_share(body: Column) -> tuple[Column, Column, Column]:
    """(prose_chars, total_chars, markup_ratio), without white space and without code."""
    code = F.regexp_replace(F.regexp_replace(body, r"```[^`]*```", " "), r"`[^`\n]*`", " ")
    total = F.length(F.regexp_replace(code, r"\s+", ""))
    prose = code
    for pattern, to in ((r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"<[^>]+>", " "), (r"(?m)^[#>*+-]+", " "), (r"\|", " "), (r"[*_~]", " ")):
        prose = F.regexp_replace(prose, pattern, to)
    chars = F.length(F.regexp_replace(prose, r"\s+", ""))
    ratio = F.when(total == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total - chars) / total)))
    return F.when(total == 0, 0).otherwise(chars), total, ratio


def stale(embedding: Column, signature: Column, current: str) -> Column:
    """Never embedded, or embedded by another model (a missing signature counts as another)."""
    return embedding.isNull() | ~signature.eqNullSafe(F.lit(current))
