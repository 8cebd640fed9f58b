"""Partitioned tables, Markdown tables and bundles."""

from __future__ import annotations

import zipfile
from datetime import date
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files


def partitions(spark: SparkSession, path: str, column: str) -> set[str]:
    """The values a partitioned table has, on any file system; a folder that isn't a partition is a ``ValueError``."""
    out = set()
    for name in files.folders(spark, path):
        if not name.startswith(f"{column}="):
            raise ValueError(f"{name} is no partition of {column}")
        out.add(unquote(name.split("=", 1)[1]))
    return out


def partition_paths(spark: SparkSession, path: str, column: str, first: date | None = None, last: date | None = None) -> list[str]:
    """The folders of a table partitioned by date within the bounds, both included, in order."""
    days = sorted((date.fromisoformat(v), v) for v in partitions(spark, path, column))
    return [f"{path.rstrip('/')}/{column}={v}" for d, v in days if (first is None or d >= first) and (last is None or d <= last)]


def date_bounds(df: DataFrame, day: str) -> tuple[date | None, date | None]:
    """The first and the last day of a table, null without any."""
    r = df.agg(F.min(day), F.max(day)).first()
    return r[0], r[1]


def write_partitions(df: DataFrame, path: str, column: str, *, overwrite: bool = False, sort: list[str] = ()) -> dict[str, int]:
    """Writes a partition for each value of ``column``; those there already are skipped, or replaced.

    Existing partitions are looked up in the file system that the path names. They leave
    the rows by an anti join, so their number doesn't matter. Rows are brought together by
    the partition column before they are written, in as many parts as a day's rows ask for
    (AQE splits large ones), so that there are few files. Returns how many partitions were
    written and skipped.
    """
    spark = df.sparkSession
    have = partitions(spark, path, column)
    values = df.select(F.col(column).cast("string").alias("v")).distinct()
    there = spark.createDataFrame([(v,) for v in sorted(have)], "v string")
    counted = values.join(F.broadcast(there.withColumn("old", F.lit(True))), "v", "left").agg(F.count("*").alias("n"), F.count("old").alias("old")).first()
    skipped = 0 if overwrite else counted["old"]
    new = df if not skipped else df.join(F.broadcast(there), F.col(column).cast("string") == F.col("v"), "left_anti")
    if counted["n"] > skipped:
        w = new.hint("rebalance", column)
        w = w.sortWithinPartitions(*sort) if sort else w
        w.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(column).parquet(path)
    return {"written": counted["n"] - skipped, "skipped": skipped}


def markdown_table(rows: list[dict], columns: list[str]) -> str:
    """A Markdown table; bars, backslashes and line breaks in cells are made harmless, null is ``n/a``."""
    esc = lambda v: "n/a" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\r", " ").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(esc(r.get(c)) for c in columns) + " |" for r in rows]) + "\n"


def bundle(path: str, root: str, files: list[str], note: str) -> None:
    """A zip of files in name order, with a README."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("README.md", note)
        for f in sorted(files):
            z.write(Path(root, f), f)
