"""Attributes as they were known at an event's time.

Change times become half-open validity intervals, the intervals are cut into time buckets,
and events meet them by an equi-join on entity and bucket. The join key holds the bucket, so
the events of one busy entity spread over the buckets of its history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(changes: DataFrame, entity: str, at: str, value: str) -> DataFrame:
    """``entity, value, start, end``: from each change until the next of the entity (null: open).

    Null entities and times are never known and drop out; of several values at one time the
    largest counts. Rows are reduced to one per entity and time before the window sorts them.
    """
    one = changes.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(at).alias("start")).agg(F.max(value).alias("value"))
    w = Window.partitionBy("entity").orderBy("start")
    return one.select("entity", "value", "start", F.lead("start").over(w).alias("end"))


def as_of_join(events: DataFrame, changes: DataFrame, *, event_entity: str, event_time: str, entity: str, at: str, value: str, width: int, out: str) -> DataFrame:
    """``events`` with column ``out``: the value of the latest change at or before the event's time.

    Times are integers (days, years). Events without entity, time or earlier change drop
    out. Repeated events stay repeated, each once; the events' other columns are kept
    whatever their names (one named ``out`` is replaced). Without events or changes the
    result is empty. Each interval is clipped to the range of event times before it is
    cut into buckets of ``width``, so an open one costs range / width rows.
    """
    kept = [c for c in events.columns if c != out]
    asked = events.where(F.col(event_entity).isNotNull() & F.col(event_time).isNotNull()).select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(event_entity).alias("who"), F.col(event_time).cast("bigint").alias("t"))
    lo, hi = asked.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        return events.limit(0).select(*(F.col(f"`{c}`") for c in kept), F.lit(None).cast(changes.schema[value].dataType).alias(out))
    cut = lambda c: F.floor(c / F.lit(width)).cast("bigint")
    spans = validity_intervals(changes, entity, at, value).select(
        "entity",
        "value",
        F.greatest(F.col("start").cast("bigint"), F.lit(lo)).alias("start"),
        F.least(F.coalesce(F.col("end").cast("bigint"), F.lit(hi + 1)), F.lit(hi + 1)).alias("end"),
    )
    buckets = spans.where("start < end").withColumn("bucket", F.explode(F.sequence(cut(F.col("start")), cut(F.col("end") - 1))))
    met = (F.col("who") == F.col("entity")) & (F.col("at") == F.col("bucket")) & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("end"))
    return asked.withColumn("at", cut(F.col("t"))).join(buckets.hint("merge"), met).select(*(F.col(f"row.`{c}`") for c in kept), F.col("value").alias(out))
