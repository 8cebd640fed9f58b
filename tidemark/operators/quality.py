"""Quality of a table in one pass, and reports of many files rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``metric, value``: rows, duplicate rows by key, and nulls and distinct values of each column.

    Duplicates are counted over partially aggregated keys.
    """
    dup = df.groupBy(*keys).agg(F.count("*").alias("n")).agg((F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("duplicate_rows"))
    one = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in columns), *(F.countDistinct(c).alias(f"{c}_distinct") for c in columns))
    wide = one.join(F.broadcast(dup))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in wide.columns))).alias("m")).select("m.*")


def roll_up(reports: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """Reports of many files by one column: sums, also of per-file distinct counts (not distinct again)."""
    return reports.groupBy(by).agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums))


def require(df: DataFrame, checks: dict[str, str], sample: str, most: int = 3) -> None:
    """Raises ``ValueError`` naming the first failing check and up to ``most`` sorted ids; one aggregate for all."""
    row = df.agg(*(F.count_if(F.expr(bad)).alias(f"n{i}") for i, bad in enumerate(checks.values()))).first()
    for i, (name, bad) in enumerate(checks.items()):
        if row[f"n{i}"]:
            ids = [r[0] for r in df.where(F.expr(bad)).select(sample).distinct().orderBy(sample).limit(most + 1).collect()]
            raise ValueError(f"{name}: {row[f'n{i}']} rows, such as {', '.join(map(str, ids[:most]))}{', ...' if len(ids) > most else ''}")
