"""The study as one lazy plan: rows to panel, panel to buckets, buckets to z-scores and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import abnormal, windows


def study(rows: DataFrame, *, entity: list[str], day: Column, event: Column, sums: dict[str, Column], metrics: list[abnormal.Metric], spans: dict[str, tuple[int, int]] = windows.WINDOWS) -> DataFrame:
    """One row per entity with the mean z-score of each metric in each window.

    Rows meet the small date map by a broadcast join before they are summed, so only days
    of the windows are shuffled; an entity then has a row per day of the windows, so its
    baseline is one small window.
    """
    dated = rows.withColumn("_day", day)
    days = windows.date_map(dated.select("_day"), "_day", event, spans)
    cells = dated.join(F.broadcast(days), "_day").groupBy(*entity, *days.columns).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    z = abnormal.abnormal(cells, entity, "relative_day", spans["estimation"], metrics, small_keys=True)
    flags = [f"is_{n}" for n in spans if n != "estimation"]
    return windows.window_means(z, entity, [m.output for m in metrics], flags, "_day")
