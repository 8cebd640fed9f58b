"""Delimited and Parquet tables by file name, with several null tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.sources import files

NULL_TOKENS = ("", "NA", "NULL")
SUFFIXES = (".parquet", ".tsv", ".txt", ".csv")


def scan(spark: SparkSession, path: str, nulls: tuple[str, ...] = NULL_TOKENS) -> DataFrame:
    """A table of strings (or Parquet as it is): tab for .tsv and .txt, comma else. Lazy; nothing is inferred."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    sep = "\t" if path.endswith((".tsv", ".txt")) else ","
    df = spark.read.csv(path, header=True, sep=sep)
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*nulls), F.col(f"`{c}`")).alias(c) for c in df.columns))


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """``gvkey, iid, cik, seed_first_date, seed_last_date`` of a seed file; rows without number or cik are left out, a date that is none fails the job."""
    df = scan(spark, path)
    return df.select(K.gvkey("gvkey").alias("gvkey"), "iid", K.cik10("cik").alias("cik"), F.to_date("first_date", "yyyy-MM-dd").alias("seed_first_date"), F.to_date("last_date", "yyyy-MM-dd").alias("seed_last_date")).where("gvkey is not null and cik is not null")


def discover_links(spark: SparkSession, folder: str, kinds: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The one file of each kind below a folder of any file system; read-me files don't count, two of a kind are a ``ValueError``.

    ``kinds`` maps a kind to the words that tell it, tried in order.
    """
    out: dict[str, str] = {}
    for p in files.files(spark, folder):
        name = p.rsplit("/", 1)[-1].lower()
        if not name.endswith(SUFFIXES) or "readme" in name:
            continue
        kind = next((k for k, words in kinds.items() if any(w in name for w in words)), None)
        if kind is None:
            continue
        if kind in out:
            raise ValueError(f"two files of {kind}: {out[kind]} and {p}")
        out[kind] = p
    return out
