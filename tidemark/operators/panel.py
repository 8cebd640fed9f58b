"""Rows to one row per entity and day, and what follows along an entity's days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_present(value: str, order: Column) -> Column:
    """The first non-null value in a declared order - not in whatever order rows arrive."""
    return F.min_by(F.col(value), F.when(F.col(value).isNotNull(), order))


def collapse(df: DataFrame, keys: list[str], order: list[str], *, first: list[str] = (), flags: list[str] = (), distinct: list[str] = (), snapshots: dict[str, list[str]] | None = None, count: str = "n_rows") -> DataFrame:
    """One row per key: row count, first non-null values, any-true flags, distinct counts.

    ``snapshots`` counts distinct structs, in which nulls count as values; ``distinct``
    leaves nulls out. More than one distinct value or snapshot sets ``<name>_inconsistent``.
    A flag without any true value is false. Rows are first reduced, within tasks, to the
    combinations of values that are told apart, of which a key mostly has few; only these
    are counted, so neither sets of values nor copies of rows are ever held or shuffled.
    """
    snapshots = snapshots or {}
    at = F.struct(*order)
    wide = list(dict.fromkeys([*distinct, *(c for cs in snapshots.values() for c in cs)]))
    other = [c for c in first if c not in wide]
    seen = [F.min(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("v")))).alias(f"_f_{c}") for c in other]
    few = df.groupBy(*keys, *wide).agg(F.count("*").alias("_n"), F.min(at).alias("_at"), *seen, *(F.bool_or(c).alias(f"_b_{c}") for c in flags))
    aggs = [F.sum("_n").alias(count)]
    aggs += [(F.min(f"_f_{c}")["v"] if c in other else first_present(c, F.col("_at"))).alias(c) for c in first]
    aggs += [F.coalesce(F.bool_or(f"_b_{c}"), F.lit(False)).alias(c) for c in flags]
    aggs += [F.countDistinct(c).alias(f"{c}_n") for c in distinct]
    aggs += [F.countDistinct(F.struct(*cs)).alias(f"{n}_n") for n, cs in snapshots.items()]
    out = few.groupBy(*keys).agg(*aggs) if wide else few.select(*keys, F.col("_n").alias(count), *(F.col(f"_f_{c}.v").alias(c) for c in first), *(F.coalesce(f"_b_{c}", F.lit(False)).alias(c) for c in flags))
    return out.select("*", *((F.col(f"{n}_n") > 1).alias(f"{n}_inconsistent") for n in [*distinct, *snapshots]))


def with_returns(df: DataFrame, entity: str, day: str, value: str, prior: str = "prior", out: str = "raw_return") -> DataFrame:
    """The previous row's value of the entity (after a gap too) and the return where both are positive."""
    w = Window.partitionBy(entity).orderBy(day)
    before = F.lag(value).over(w)
    return df.withColumn(prior, before).withColumn(out, F.when((F.col(prior) > 0) & (F.col(value) > 0), F.col(value) / F.col(prior) - 1))


def lead_change(df: DataFrame, entity: str, day: str, value: str, next_day: str, order: list[str] = (), out: str = "lead_change") -> DataFrame:
    """Change of the value to the entity's next row, if that row is on exactly the next day of the calendar."""
    w = Window.partitionBy(entity).orderBy(day, *order)
    ahead = F.when(F.lead(day).over(w) == F.col(next_day), F.lead(value).over(w) - F.col(value))
    return df.withColumn(out, ahead)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in the declared order."""
    cols = [c for c in df.columns if c not in keys]
    kept = F.max_by(F.struct(*cols), F.struct(*order)).alias("_kept")
    return df.groupBy(*keys).agg(kept).select(*keys, *(F.col(f"_kept.{c}").alias(c) for c in cols))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key. Spark limits the groups before it shuffles them."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def union_aligned(*frames: DataFrame, schema: dict[str, str]) -> DataFrame:
    """All rows of all frames in one schema: missing columns null, others cast leniently, extra ones left out."""
    parts = [f.select(*((F.col(c).try_cast(t) if c in f.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items())) for f in frames]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def narrow_if_any(df: DataFrame, condition: Column, keys: list[str]) -> DataFrame:
    """Of each key the rows that meet the condition, or all its rows if none does."""
    met = F.coalesce(condition, F.lit(False))
    hits = df.where(met).select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(hits, on, "left").where(met | F.col(f"_{keys[0]}").isNull()).select(*df.columns)


def nulls_first(df: DataFrame, order: list[tuple[str, bool]]) -> DataFrame:
    """Sorted by (column, descending) pairs, nulls first either way."""
    return df.orderBy(*(F.col(c).desc_nulls_first() if down else F.col(c).asc_nulls_first() for c, down in order))


def display_name(name: Column | str, fallback: Column | str) -> Column:
    """The name, or the fallback where it is null or blank."""
    name, fallback = (F.col(c) if isinstance(c, str) else c for c in (name, fallback))
    return F.when(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\s\u00a0]+", "") != "", name).otherwise(fallback)
