"""A trading calendar as a small table, and stamps aligned to it."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _nth(y: int, m: int, weekday: int, n: int) -> date:
    """The ``n``-th weekday of a month; from its end for a negative ``n``."""
    if n > 0:
        d = date(y, m, 1)
        return d + timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))
    d = date(y + m // 12, m % 12 + 1, 1) - timedelta(1)
    return d - timedelta((d.weekday() - weekday) % 7 + 7 * (-n - 1))


def _easter(y: int) -> date:
    """Gregorian Easter Sunday (anonymous algorithm)."""
    a, b, c = y % 19, y // 100, y % 100
    g = (8 * b + 13) // 25
    h = (19 * a + b - b // 4 - g + 15) % 30
    k = (2 * (b % 4) + 2 * (c // 4) - h - c % 4 + 32) % 7
    m = (a + 11 * h + 22 * k) // 451
    n = h + k - 7 * m + 114
    return date(y, n // 31, n % 31 + 1)


def holidays(y: int) -> set[date]:
    """Exchange holidays of a year; one on a Saturday is kept on Friday, on a Sunday on Monday."""
    fixed = [date(y, 1, 1), date(y, 7, 4), date(y, 12, 25)] + ([date(y, 6, 19)] if y >= 2022 else [])
    moved = {d - timedelta(1) if d.weekday() == 5 else d + timedelta(1) if d.weekday() == 6 else d for d in fixed}
    return moved | {_nth(y, 1, 0, 3), _nth(y, 2, 0, 3), _easter(y) - timedelta(2), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4)}


def trading_days(first: int, last: int) -> list[date]:
    """All trading days of the years, a holiday counting in its own year only."""
    out = []
    for y in range(first, last + 1):
        off, d = holidays(y), date(y, 1, 1)
        while d.year == y:
            if d.weekday() < 5 and d not in off:
                out.append(d)
            d += timedelta(1)
    return out


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """``day, is_trading, on_or_after, next_trading, previous_trading`` of every day of the years."""
    days = spark.createDataFrame([(d,) for d in trading_days(first, last)], "trading date")
    every = spark.sql(f"SELECT explode(sequence(date'{first}-01-01', date'{last}-12-31')) AS day")
    j = every.join(days, every["day"] == days["trading"], "left")
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    after = w.rowsBetween(1, Window.unboundedFollowing)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return j.select(
        "day",
        F.col("trading").isNotNull().alias("is_trading"),
        F.first("trading", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("on_or_after"),
        F.first("trading", True).over(after).alias("next_trading"),
        F.last("trading", True).over(before).alias("previous_trading"),
    )


def align(df: DataFrame, cal: DataFrame, local: Column, close: str = "16:00:00") -> DataFrame:
    """``df`` with ``trading_date`` (the same day before the close, else the next trading day) and the day before it.

    ``local`` is wall-clock time at the exchange. The close itself is after hours. Stamps
    outside the calendar get nulls. The calendar has a row per day and is broadcast.
    """
    late = F.date_format(local, "HH:mm:ss") >= F.lit(close)
    c = F.broadcast(cal)
    got = df.withColumn("_day", local.cast("date")).withColumn("_late", late).join(c, F.col("_day") == c["day"], "left")
    day = F.when(F.col("is_trading") & F.col("_late"), F.col("next_trading")).otherwise(F.col("on_or_after"))
    got = got.withColumn("trading_date", day).select(*(df[x] for x in df.columns), "trading_date")
    p = F.broadcast(cal.select(F.col("day").alias("_p"), F.col("previous_trading").alias("pre_event_end")))
    return got.join(p, F.col("trading_date") == F.col("_p"), "left").drop("_p")
