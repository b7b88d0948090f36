"""Ontology facts: observations of (entity, dimension) folded in order of arrival into a history of values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that stand for a dimension, and the dimensions that are known.
ALIASES = {
    "job_role": "role", "position": "role", "title": "role", "job_title": "role", "relationship": "relation", "rel": "relation", "risk_appetite": "risk_tolerance",
    "comms_style": "communication_style", "communication": "communication_style", "employer_name": "employer", "company": "employer", "org": "employer",
}
KNOWN = ("role", "relation", "risk_tolerance", "decision_style", "communication_style", "reliability", "expertise", "affect", "location", "employer")

ACTIONS = "action string, closed array<long>, status string"


def dimension(name: Column) -> Column:
    """The dimension that a name stands for: lower case, blanks and hyphens as underscores, aliases resolved."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[\s-]+", "_")
    return F.coalesce(F.create_map(*[F.lit(x) for x in chain(*ALIASES.items())])[plain], plain)


def value_key(value: Column) -> Column:
    """What makes two values one: case and blanks around them don't count."""
    return F.lower(F.trim(value))


def merged(observations: DataFrame, group: Sequence[str] = ("source_id", "entity")) -> DataFrame:
    """Every observation (id, .., dimension, value, source, valid_from, arrived) with what it did to its dimension's history.

    In order of arrival (then id), an observation of an open value by a source that has told it is a ``noop``, by another source it
    is ``corroborated``. A new value that is valid from later than open ones closes them (``superseded_prior``; ``closed`` has
    their ids), one that isn't is ``inserted`` beside them: both stay open, a conflict. Values of dimensions that aren't known
    are kept apart (``status`` quarantined). valid_from null is the time of arrival; a null value is one like any other.

    The fold streams through sorted rows, a key's open values alone in memory. A key's observations have to come in order, so one
    key is one task; keys are dealt evenly.
    """
    keys = [*group, "dimension"]
    named = observations.withColumn("dimension", dimension(F.col("dimension"))).withColumn("valid_from", F.coalesce("valid_from", "arrived"))
    rows = named.select(
        F.struct("*").alias("row"), F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.col("id"), F.coalesce(value_key(F.col("value")), F.lit("")).alias("value"),
        F.coalesce("source", F.lit("")).alias("source"), F.unix_micros(F.col("valid_from").cast("timestamp")).alias("since"), (~F.col("dimension").isin(*KNOWN)).alias("novel"), F.col("arrived"),
    )
    ordered = rows.repartition("key").sortWithinPartitions("key", "arrived", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, live = None, {}
        for batch in batches:
            actions, closed, status = [], [], []
            for key, name, value, source, since, novel in zip(*(batch.column(i).to_pylist() for i in range(1, 7)), strict=True):
                if key != at:
                    at, live = key, {}
                gone: list[int] = []
                if value in live:
                    action = "noop" if source in live[value][2] else "corroborated"
                    live[value][2].add(source)
                else:
                    gone = sorted(v[0] for v in live.values() if v[1] < since)
                    live = {k: v for k, v in live.items() if v[1] >= since}
                    action = "superseded_prior" if gone else "inserted"
                    live[value] = (name, since, {source})
                actions.append(action)
                closed.append(gone)
                status.append("quarantined" if novel else "active")
            made = [pa.array(actions, pa.string()), pa.array(closed, pa.list_(pa.int64())), pa.array(status, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["row", "action", "closed", "status"])

    done = ordered.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {ACTIONS}")
    return done.select("row.*", "action", "closed", "status")


def history(merged_rows: DataFrame) -> DataFrame:
    """The values that were entered, each with the time until which it was valid: valid_until is that of the one that closed it."""
    entered = merged_rows.filter(F.col("action").isin("inserted", "superseded_prior"))
    ends = entered.select(F.explode("closed").alias("id"), F.col("valid_from").alias("valid_until"))
    return entered.drop("action", "closed").join(ends, "id", "left")


def values_at(history_rows: DataFrame, when=None, quarantined: bool = False) -> DataFrame:
    """The values that hold now, or held at a time; those of unknown dimensions only where they are asked for."""
    out = history_rows if quarantined else history_rows.filter("status = 'active'")
    if when is None:
        return out.filter("valid_until is null")
    t = F.lit(when).cast("timestamp")
    return out.filter((F.col("valid_from") <= t) & (F.col("valid_until").isNull() | (F.col("valid_until") > t)))


def conflicts(history_rows: DataFrame, group: Sequence[str] = ("source_id", "entity")) -> DataFrame:
    """Dimensions with more than one open value."""
    live = values_at(history_rows)
    each = live.groupBy(*group, "dimension").agg(F.sort_array(F.collect_set(value_key(F.col("value")))).alias("values"))
    return each.filter(F.size("values") > 1)
