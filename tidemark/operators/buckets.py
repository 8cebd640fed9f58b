"""Sums, guarded sums and weighted means by bucket, and shares of a group's total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the values present, weighted by what is positive; null without any."""
    use = value.isNotNull() & (weight > 0)
    return F.sum(F.when(use, value * weight)) / F.nullif(F.sum(F.when(use, weight)), F.lit(0))


def bucket_features(df: DataFrame, keys: list[str], *, sums: dict[str, Column], guarded: dict[str, Column], means: dict[str, tuple[Column, Column]], distinct: dict[str, str], ratios: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """One row per bucket: sums that are 0 for no values, guarded ones that are null, weighted means,
    distinct counts in which null is a value, and ratios of a sum to at least one."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]
    aggs += [F.sum(c).alias(n) for n, c in guarded.items()]
    aggs += [weighted_mean(v, w).alias(n) for n, (v, w) in means.items()]
    aggs += [(F.countDistinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(n) for n, c in distinct.items()]
    ratios = ratios or {}
    aggs += [F.greatest(F.lit(1.0), F.coalesce(F.sum(d), F.lit(0)).cast("double")).alias(f"_d_{n}") for n, (_, d) in ratios.items()]
    out = df.groupBy(*keys).agg(*aggs)
    return out.select("*", *((F.col(s) / F.col(f"_d_{n}")).alias(n) for n, (s, _) in ratios.items())).drop(*(f"_d_{n}" for n in ratios))


def group_share(df: DataFrame, value: str, groups: dict[str, list[str]]) -> DataFrame:
    """For each named group the value's share of the group's total; null where that isn't positive.

    Totals come from partial aggregates joined back, so busy groups aren't sorted.
    """
    out = df
    for name, keys in groups.items():
        total = df.groupBy(*(F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys))).agg(F.sum(value).alias(f"_t_{name}"))
        on = [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(keys)]
        out = out.join(total, on, "left").select(*out.columns, F.when(F.col(f"_t_{name}") > 0, F.col(value) / F.col(f"_t_{name}")).alias(name))
    return out
