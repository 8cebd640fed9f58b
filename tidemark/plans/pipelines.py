"""Runs from raw archives to the tables of a study, each a composition of sources, operators and sinks."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import linktables, options, panel, quality
from tidemark.sources import archives, files, sinks, tabular

# What vendors send besides the keys, and what kind it is.
DOUBLES = (
    "strike", "open", "high", "low", "close", "bid_1545", "ask_1545", "underlying_bid_1545", "underlying_ask_1545", "implied_underlying_price_1545", "active_underlying_price_1545", "implied_volatility_1545",
    "delta_1545", "gamma_1545", "theta_1545", "vega_1545", "rho_1545", "bid_eod", "ask_eod", "underlying_bid_eod", "underlying_ask_eod", "vwap",
)
WHOLE = ("trade_volume", "open_interest", "bid_size_1545", "ask_size_1545", "bid_size_eod", "ask_size_eod")
KINDS = {"underlying_symbol": "string", "quote_date": "date", "root": "string", "expiration": "date", "option_type": "string", **dict.fromkeys(DOUBLES, "double"), **dict.fromkeys(WHOLE, "bigint")}
REQUIRED = ("underlying_symbol", "quote_date", "root", "expiration", "strike", "option_type", "trade_volume", "bid_1545", "ask_1545", "underlying_bid_1545", "underlying_ask_1545", "bid_eod", "ask_eod", "underlying_bid_eod", "underlying_ask_eod", "vwap", "open_interest")
CONTRACT = ["underlying_symbol", "root", "expiration", "strike", "option_type"]


class Written(NamedTuple):
    """What a run wrote: partitions written and left as they were, and the report beside them."""

    written: int
    skipped: int
    report: dict


def ingest_options(spark: SparkSession, raw: str, out: str, report: str, *, first: date | None = None, last: date | None = None, most: int | None = None, overwrite: bool = False, aliases: dict[str, str] | None = None) -> Written:
    """Archives of contract-days to a table partitioned by ``quote_date``, with a report of its quality.

    Which archives to read is decided by the dates in their names, before any is opened:
    days that are there already are left out unless ``overwrite``. No archive at all is a
    ``FileNotFoundError``, a missing core column a ``ValueError``.
    """
    found = archives.select(archives.discover(spark, raw), first, last, most)
    if not found:
        raise FileNotFoundError(f"no archives in {raw}")
    have = set() if overwrite else sinks.partitions(spark, out, "quote_date")
    new = [p for p in found if archives.archive_date(p).isoformat() not in have]
    if not new:
        return Written(0, len(found), {})
    rows = archives.typed(archives.read_zipped(spark, new), KINDS, REQUIRED, aliases)
    frame = options.option_frame(rows)
    done = sinks.write_partitions(frame, out, "quote_date", overwrite=overwrite, sort=CONTRACT)
    # The report is made of what was written, not of a second pass over the archives.
    stored = spark.read.parquet(out).where(F.col("quote_date").isin(*(archives.archive_date(p) for p in new)))
    profile = {r["metric"]: r["value"] for r in quality.profile(stored, ["quote_date", "series_id"], ["bid_1545", "ask_1545", "vwap"]).collect()}
    facts = {"archives": len(new), "skipped": len(found) - len(new), **profile}
    files.write_report(spark, f"{report}.json", facts)
    files.write_text(spark, f"{report}.md", files.markdown_report("Option ingest", facts.items()))
    return Written(done["written"], len(found) - len(new) + done["skipped"], facts)


def build_firm_days(spark: SparkSession, dataset: str, out: str, report: str, *, first: date | None = None, last: date | None = None, overwrite: bool = False) -> Written:
    """The firm-day table with returns from the partitions of the option table within the bounds, and its report.

    Without partitions it is a ``FileNotFoundError``, an existing table a ``FileExistsError``
    unless ``overwrite``.
    """
    paths = sinks.partition_paths(spark, dataset, "quote_date", first, last)
    if not paths:
        raise FileNotFoundError(f"no partitions in {dataset}")
    if not overwrite:
        files.refuse_existing(spark, out)
    frame = spark.read.option("basePath", dataset).parquet(*paths)
    days = options.firm_days(frame, CONTRACT)
    with_returns = panel.with_returns(days, "underlying_symbol", "quote_date", "s_eod", prior="prior_s_eod")
    with_returns.repartitionByRange("underlying_symbol", "quote_date").sortWithinPartitions("underlying_symbol", "quote_date").write.mode("overwrite").option("compression", "zstd").parquet(out)
    stored = spark.read.parquet(out)
    facts = stored.agg(
        F.count("*").alias("rows"), F.countDistinct("underlying_symbol").alias("symbols"), F.min("quote_date").alias("first_day"), F.max("quote_date").alias("last_day"),
        F.count_if("snapshot_1545_inconsistent").alias("inconsistent_1545"), F.count_if("snapshot_eod_inconsistent").alias("inconsistent_eod"), F.count_if(F.col("raw_return").isNull()).alias("without_return"),
    ).first().asDict()
    files.write_report(spark, f"{report}.json", facts)
    files.write_text(spark, f"{report}.md", files.markdown_report("Firm days", facts.items()))
    return Written(len(paths), 0, facts)


def build_linkages(spark: SparkSession, events: DataFrame, firm_days: DataFrame, folder: str, kinds: dict[str, tuple[str, ...]], bridge: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Linkage table and control candidates of dated events (source_firm_id, event_trading_date) from the vendors' files of a folder.

    Without a file it is a ``FileNotFoundError``.
    """
    found = tabular.discover_links(spark, folder, kinds)
    if not found:
        raise FileNotFoundError(f"no linkage files in {folder}")
    sources = linktables.source_years(events, "source_firm_id", "event_trading_date")
    firms = linktables.firm_years(firm_days, "underlying_symbol", "quote_date", sources)
    parts = [linktables.standard_links(tabular.scan(spark, path), kind, years=sources) for kind, path in sorted(found.items())]
    standard = parts[0]
    for p in parts[1:]:
        standard = standard.unionByName(p)
    table = linktables.linkage_table(standard, sources, firms, bridge)
    return table, linktables.control_candidates(sources, firms, table, sorted(found))


def study_case(frame: DataFrame, days: DataFrame, listed: DataFrame, focal: str, condition: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Enriched rows of an event's windows and the features of its listed contracts."""
    rows = options.enriched(frame if condition is None else frame.where(condition), days, listed, focal)
    return rows, options.contract_features(rows)
