"""Rows out of JSON documents: cached pages, structs of parallel arrays, search hits, column-oriented lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.operators.panel import last_wins


def rows_of_arrays(df: DataFrame, struct: str, fields: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per position of the parallel arrays in ``struct``; shorter arrays are filled with null."""
    zipped = F.arrays_zip(*(F.col(f"{struct}.{f}").alias(f) for f in fields))
    return df.select(*keep, F.explode(zipped).alias("_r")).select(*keep, *(F.col(f"_r.{f}").alias(f) for f in fields))


def read_column_lists(spark: SparkSession, path: str) -> DataFrame:
    """A file ``{"fields": [...], "data": [[...], ...]}`` as a table of strings."""
    raw = spark.read.text(path, wholetext=True)
    j = raw.select(F.from_json("value", "struct<fields: array<string>, data: array<array<string>>>").alias("j"))
    names = j.select("j.fields").first()[0]
    return j.select(F.explode("j.data").alias("d")).select(*(F.col("d")[i].alias(n) for i, n in enumerate(names)))


def read_cached(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """``path, text`` of every file below a cache folder, each whole, bytes that are no UTF-8 replaced;
    with a ``schema`` also ``json``, null where a text isn't of that form."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return out if schema is None else out.withColumn("json", F.from_json("text", schema, {"mode": "PERMISSIVE"}))


FILING = "accessionNumber array<string>, form array<string>, filingDate array<string>, acceptanceDateTime array<string>, items array<string>, primaryDocDescription array<string>"


def read_submissions(spark: SparkSession, path: str, *, forms: list[str] = (), first: date | None = None, last: date | None = None) -> DataFrame:
    """``cik, name, accession_number, form, filing_date, accepted_at, items, description`` of a company's pages and the shards of its history.

    A page holds its recent filings as parallel arrays, a shard is such arrays alone and
    takes cik (of its file's name) and no company name. Filings are filtered by date and
    form and kept once by number: of several the one of the last file by name counts, and
    in it the last place.
    """
    schema = f"cik string, name string, filings struct<recent: struct<{FILING}>>, {FILING}"
    raw = read_cached(spark, path, schema).where("path like '%.json'")
    number = F.regexp_extract("path", r"CIK0*(\d+)", 1)
    of = lambda f: F.coalesce(F.col(f"json.filings.recent.{f}"), F.col(f"json.{f}"))
    names = [x.split()[0] for x in FILING.split(", ")]
    packed = raw.select("path", K.cik10(F.coalesce("json.cik", F.nullif(number, F.lit("")))).alias("cik"), F.col("json.name").alias("name"), F.arrays_zip(*(of(n).alias(n) for n in names)).alias("z"))
    rows = packed.select("path", "cik", "name", F.posexplode("z").alias("place", "r"))
    day = F.col("r.filingDate").try_cast("date")
    rows = rows.select("path", "place", "cik", "name", F.col("r.accessionNumber").alias("accession_number"), F.col("r.form").alias("form"), day.alias("filing_date"), F.try_to_timestamp(F.col("r.acceptanceDateTime")).alias("accepted_at"), F.col("r.items").alias("items"), F.col("r.primaryDocDescription").alias("description"))
    rows = rows.where("accession_number is not null")
    if forms:
        rows = rows.where(F.col("form").isin(*forms))
    if first is not None:
        rows = rows.where(F.col("filing_date") >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col("filing_date") <= F.lit(last))
    return last_wins(rows, ["accession_number"], ["path", "place"]).drop("path", "place").select("cik", "name", "accession_number", "form", "filing_date", "accepted_at", "items", "description")


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """``id, accession_number, cik, display_names`` of the pages of a full-text search, each hit once by its id (of several the one of the last page)."""
    hit = "struct<_id: string, _source: struct<adsh: string, ciks: array<string>, display_names: array<string>, form: string, file_date: string>>"
    raw = read_cached(spark, path, f"hits struct<hits: array<{hit}>>").where("path like '%.json'")
    rows = raw.select("path", F.posexplode("json.hits.hits").alias("place", "h")).select("path", "place", F.col("h._id").alias("id"), "h._source.*")
    accession = F.coalesce(F.nullif(F.trim("adsh"), F.lit("")), F.nullif(F.substring_index("id", ":", 1), F.lit("")))
    one = last_wins(rows.where("id is not null"), ["id"], ["path", "place"])
    return one.select("id", accession.alias("accession_number"), K.cik10(F.get("ciks", F.lit(0))).alias("cik"), "display_names", "form", F.col("file_date").try_cast("date").alias("file_date"))
