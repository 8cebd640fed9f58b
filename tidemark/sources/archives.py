"""Zipped CSV archives: found by name, filtered by date, read on the executors."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import files

# What stands for a missing value.
NULL_TOKENS = ("", "NULL", "null", "NA", "N/A")
_DATE = re.compile(r"_(\d{4})-(\d{2})-(\d{2})\.zip$")


def discover(spark: SparkSession, root: str, suffix: str = ".zip") -> list[str]:
    """All files of that suffix below a folder of any file system, as full paths, sorted."""
    return files.files(spark, root, suffix)


def archive_date(path: str) -> date:
    """The date a file name ends in; ``ValueError`` if there is none."""
    m = _DATE.search(path)
    if not m:
        raise ValueError(f"no date in {path}")
    return date(*map(int, m.groups()))


def select(paths: list[str], first: date | None = None, last: date | None = None, most: int | None = None) -> list[str]:
    """Archives within the bounds, both included, then the first ``most``."""
    kept = [p for p in paths if (first is None or archive_date(p) >= first) and (last is None or archive_date(p) <= last)]
    return kept[:most]


def read_zipped(spark: SparkSession, paths: list[str], batch: int = 20_000) -> DataFrame:
    """``archive, member, row`` (a map of column text to value) of every line of every archive.

    An archive must hold exactly one CSV. Files are opened on the executors, one task each,
    and streamed in batches, so neither the driver nor a task holds a whole file's rows.
    """
    found = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = lambda rows: pd.DataFrame(rows, columns=["archive", "member", "row"])
        for b in batches:
            for path in b["path"]:
                system, at = FileSystem.from_uri(path)
                with system.open_input_file(at) as raw, zipfile.ZipFile(raw) as z:
                    members = [n for n in z.namelist() if n.lower().endswith(".csv")]
                    if len(members) != 1:
                        raise ValueError(f"{path} holds {len(members)} CSV files")
                    with z.open(members[0]) as f:
                        lines = csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline=""))
                        names, rows = next(lines, []), []
                        for line in lines:
                            if line:
                                values = [None if v in NULL_TOKENS else v for v in line[: len(names)]]
                                rows.append((path, members[0], dict(zip(names, values + [None] * (len(names) - len(values)), strict=True))))
                            if len(rows) == batch:
                                yield out(rows)
                                rows = []
                        if rows:
                            yield out(rows)

    return found.mapInPandas(run, "archive string, member string, row map<string,string>")


def canonical(name: str, aliases: dict[str, str] | None = None) -> str:
    """A column text as its canonical name: alias of its letters and digits, else snake case."""
    key = re.sub(r"[^a-z0-9]", "", name.strip().lower())
    return (aliases or {}).get(key) or re.sub(r"_+", "_", re.sub(r"[^a-z0-9]+", "_", name.strip().lower())).strip("_")


def typed(rows: DataFrame, kinds: dict[str, str], required: list[str] = (), aliases: dict[str, str] | None = None) -> DataFrame:
    """Maps of texts to typed columns; a value that can't be cast is null, whole numbers go by way of double.

    Columns beyond ``kinds`` are kept as text. A required column that no file has is a
    ``ValueError``.
    """
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("row"))).distinct().collect())
    found: dict[str, list[str]] = {}
    for n in names:
        found.setdefault(canonical(n, aliases), []).append(n)
    if missing := [c for c in required if c not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cell = lambda c: F.coalesce(*(F.col("row")[n] for n in found[c])) if c in found else F.lit(None).cast("string")

    def cast(c: str) -> F.Column:
        kind = kinds.get(c, "string")
        return cell(c).try_cast("double").try_cast("bigint") if kind == "bigint" else cell(c) if kind == "string" else cell(c).try_cast(kind)

    return rows.select("archive", *(cast(c).alias(c) for c in [*kinds, *(c for c in found if c not in kinds)]))
