"""Abnormal activity: z-scores of metrics against their own estimation window."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quotes import log_plus_one


class Metric(NamedTuple):
    """A source column, the z-score made of it, and how it is transformed first."""

    source: str
    output: str
    transform: str = "identity"

    def column(self) -> Column:
        if self.transform == "log1p":
            return log_plus_one(self.source)
        if self.transform == "identity":
            return F.col(self.source).cast("double")
        raise ValueError(f"unknown transform {self.transform}")


def abnormal(df: DataFrame, keys: list[str], relative: str, estimation: tuple[int, int], metrics: list[Metric], count: str = "estimation_obs_count", small_keys: bool = False) -> DataFrame:
    """``df`` with a z-score for each metric and the rows of the baseline.

    ``(x - mean) / sample deviation`` over the estimation window of the key; null where the
    deviation is null or zero. ``count`` counts rows, null values too, and is null for none.
    The baseline is joined back from an aggregate: unlike a window over the key it is
    partially aggregated, so a key that holds a third of all rows sorts nowhere. Where the
    caller knows that a key has few rows, such as one a day, ``small_keys`` takes the
    window instead, which reads the rows once.
    """
    if small_keys:
        w, here = Window.partitionBy(*keys), F.col(relative).between(*estimation)
        wide = df.select("*", *(f(F.when(here, m.column())).over(w).alias(f"_{n}_{i}") for i, m in enumerate(metrics) for n, f in (("mu", F.avg), ("sd", F.stddev_samp))), F.nullif(F.count_if(here).over(w), F.lit(0)).alias(count))
        z = [F.when(F.col(f"_sd_{i}") > 0, (m.column() - F.col(f"_mu_{i}")) / F.col(f"_sd_{i}")).alias(m.output) for i, m in enumerate(metrics)]
        return wide.select(*df.columns, count, *z)
    inside = F.col(relative).between(*estimation)
    base = df.where(inside).groupBy(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys))).agg(F.count("*").alias(count), *(f(m.column()).alias(f"_{n}_{i}") for i, m in enumerate(metrics) for n, f in (("mu", F.avg), ("sd", F.stddev_samp))))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
    z = [F.when(F.col(f"_sd_{i}") > 0, (m.column() - F.col(f"_mu_{i}")) / F.col(f"_sd_{i}")).alias(m.output) for i, m in enumerate(metrics)]
    return df.join(base, on, "left").select(*df.columns, count, *z)


def scales(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the sample deviation of each column, 1 where it is null or zero."""
    return df.agg(*(F.coalesce(F.nullif(F.stddev_samp(c), F.lit(0.0)), F.lit(1.0)).alias(f"scale_{c}") for c in columns))


def nearest(candidates: DataFrame, target: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """The ``k`` candidates nearest the one target row by scaled L1 distance, ties by key.

    Candidates with a null feature are left out. Scales are those of the candidates. The
    two one-row sides are broadcast; the rest is a top-k, not a sort.
    """
    c = candidates.select(key, *features).dropna(subset=features)
    t = target.select(*(F.col(f).alias(f"target_{f}") for f in features)).limit(1)
    d = sum((F.abs(F.col(f) - F.col(f"target_{f}")) / F.col(f"scale_{f}") for f in features), F.lit(0.0))
    ranked = c.join(F.broadcast(t)).join(F.broadcast(scales(c, features))).withColumn("match_distance", d).orderBy("match_distance", key).limit(k)
    w = Window.partitionBy(F.lit(0)).orderBy("match_distance", key)
    return ranked.select(key, *features, "match_distance", F.row_number().over(w).cast("bigint").alias("match_rank"))
