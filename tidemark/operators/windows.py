"""Event windows: relative days, means by window, pooled summaries, announcement returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inclusive offsets in trading rows.
WINDOWS = {"estimation": (-120, -20), "pre_event": (-5, -1), "terminal": (-2, -1), "announcement": (0, 1)}


def in_window(relative: Column | str, bounds: tuple[int, int]) -> Column:
    return (F.col(relative) if isinstance(relative, str) else relative).between(*bounds)


def date_map(days: DataFrame, day: str, event: Column, windows: dict[str, tuple[int, int]] = WINDOWS, most: int = 100_000, strict: bool = True) -> DataFrame:
    """Each distinct day with its offset in present days to the event's day, the next day and window flags.

    The calendar is whatever days occur. It is counted in one aggregate and held as a local
    table of a row per day, ``most`` of them at most (270 years of days; more is a
    ``ValueError``), so that joining it moves and repeats nothing. Days outside all windows
    are left out. An event on a day that isn't there, or without all the days its windows
    ask for, is a ``ValueError`` too; where not ``strict`` it gives no or fewer rows.
    """
    spark = days.sparkSession
    have = sorted(r[0] for r in days.select(day).where(F.col(day).isNotNull()).distinct().limit(most + 1).collect())
    if len(have) > most:
        raise ValueError(f"more than {most} days")
    zero = spark.range(1).select(event.alias("e")).first()[0]
    at = have.index(zero) if zero in have else None
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    if strict and at is None:
        raise ValueError(f"{zero} is none of the days")
    if strict and not 0 <= at + lo <= at + hi < len(have):
        raise ValueError(f"the windows ask for {-lo} days before and {hi} after {zero}; there are {at} and {len(have) - at - 1}")
    rows = [] if at is None else [(d, i - at, have[i + 1] if i + 1 < len(have) else None) for i, d in enumerate(have) if lo <= i - at <= hi]
    kind = days.schema[day].dataType.simpleString()
    out = spark.createDataFrame(rows, f"`{day}` {kind}, relative_day bigint, next_day {kind}")
    return out.select("*", *(in_window("relative_day", b).alias(f"is_{n}") for n, b in windows.items()))


def window_means(df: DataFrame, keys: list[str], metrics: list[str], flags: list[str], days: str) -> DataFrame:
    """Per key the mean of each metric within each window and the number of days seen."""
    means = [F.avg(F.when(F.col(f), F.col(m))).alias(f"{m}_{f.removeprefix('is_')}") for f in flags for m in metrics]
    return df.groupBy(*keys).agg(*means, F.countDistinct(days).alias("observed_days"))


def pooled_windows(df: DataFrame, series: str, measures: dict[str, Column], flags: list[str], expected: list[str], pooled: str = "ALL") -> DataFrame:
    """For each window a pooled row and one per expected series, zero where a series wasn't seen.

    Rows are sent to their windows once and summed by grouping sets in one pass.
    """
    names = [f.removeprefix("is_") for f in flags]
    hits = df.withColumn("window", F.explode(F.array_compact(F.array(*(F.when(F.col(f), F.lit(n)) for f, n in zip(flags, names, strict=True))))))
    hits = hits.where(F.col(series).isin(expected)).select("window", F.col(series).alias("series"), *(m.alias(n) for n, m in measures.items()))
    sums = hits.groupingSets([["window"], ["window", "series"]], "window", "series").agg(F.count("*").alias("n_rows"), *(F.sum(n).alias(n) for n in measures))
    sums = sums.withColumn("series", F.coalesce("series", F.lit(pooled)))
    spark = df.sparkSession
    frame = spark.createDataFrame([(w, s) for w in names for s in [pooled, *expected]], "window string, series string")
    return F.broadcast(frame).join(sums, ["window", "series"], "left").fillna(0)


def window_returns(df: DataFrame, entity: str, relative: str, value: str) -> DataFrame:
    """Return on day 0 and compounded over days 0 and 1 (a missing leg counts 0; null without both)."""
    day = lambda k: F.max(F.when(F.col(relative) == k, F.col(value)))
    got = df.where(F.col(relative).isin(0, 1)).groupBy(entity).agg(day(0).alias("r0"), day(1).alias("r1"))
    both = (1 + F.coalesce("r0", F.lit(0.0))) * (1 + F.coalesce("r1", F.lit(0.0))) - 1
    return got.select(entity, F.col("r0").alias("return_day0"), F.when(F.coalesce("r0", "r1").isNotNull(), both).alias("return_window"))
