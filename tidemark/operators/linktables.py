"""Yearly links from vendor files to firms: standard form, resolved by ticker and by number, with their controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.operators import links
from tidemark.operators.panel import first_present
from tidemark.session import bounded
from tidemark.sources.archives import canonical

#: Rows of the case's side of a join up to which it goes to all tasks; beyond, the join is merged.
MOST_SOURCES = 200_000
# The headers that vendors give the fields of a link, in the order they count.
ALIASES = {
    "link_year": ("year", "link_year", "fyear", "calyear"),
    "link_score": ("score", "link_score", "similarity", "weight", "tnic3", "tnic_score", "vtnic_score", "vertscore"),
    "source_ticker": ("ticker1", "tic1", "source_ticker", "firm1_ticker", "focal_ticker"),
    "linked_ticker": ("ticker2", "tic2", "linked_ticker", "firm2_ticker", "peer_ticker"),
    "source_gvkey": ("gvkey1", "source_gvkey", "firm1_gvkey"),
    "linked_gvkey": ("gvkey2", "linked_gvkey", "firm2_gvkey"),
    "source_name": ("name1", "firm1_name", "source_name"),
    "linked_name": ("name2", "firm2_name", "linked_name"),
}
SIDES = {"source_ticker": "linked_ticker", "source_gvkey": "linked_gvkey", "source_name": "linked_name"}
PAIR = ("source_firm_id", "linked_firm_id", "link_type", "link_year")
CARRIED = tuple(c for pair in SIDES.items() for c in pair)


def source_years(events: DataFrame, firm: str, day: str) -> DataFrame:
    """``source_firm_id, event_year, link_year`` of dated events, distinct: links count from the year before."""
    year = F.year(F.col(day).cast("date")).cast("bigint")
    return events.where(F.col(firm).isNotNull() & F.col(day).isNotNull()).select(F.col(firm).alias("source_firm_id"), year.alias("event_year"), (year - 1).alias("link_year")).distinct()


def firm_years(rows: DataFrame, symbol: str, day: str, sources: DataFrame) -> DataFrame:
    """``firm_id, event_year`` of the firms quoted in the sources' event years, distinct."""
    years = bounded(sources.select("event_year").distinct(), MOST_SOURCES)
    seen = rows.select(K.symbol(symbol).alias("firm_id"), F.year(day).cast("bigint").alias("event_year"))
    return seen.where("firm_id is not null").join(years, "event_year", "left_semi").distinct()


def source_numbers(sources: DataFrame, bridge: DataFrame) -> DataFrame:
    """The sources with the ``source_gvkey`` (and ticker and name) that the bridge has for their firm and event year, distinct."""
    b = bridge.select(F.col("firm_id").alias("source_firm_id"), "event_year", K.gvkey("gvkey").alias("source_gvkey"), F.col("underlying_symbol").alias("source_ticker"), F.col("issuer_name").alias("source_name")).distinct()
    return b.join(bounded(sources, MOST_SOURCES), ["source_firm_id", "event_year"]).where("source_gvkey is not null").select("source_firm_id", "event_year", "link_year", "source_gvkey", "source_ticker", "source_name").distinct()


def standard_links(df: DataFrame, link_type: Column | str, *, years: DataFrame | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """A vendor's table in the columns of ``ALIASES`` plus ``link_type``; rows without a whole pair are left out.

    Headers are matched in snake case. A table without year or score, or with neither both
    tickers nor both numbers, is a ``ValueError``. ``years`` (link_year) and ``numbers``
    (source_gvkey) keep only links of those years, and with those numbers on either side;
    both filters stand on the scan. Values that can't be cast are null.
    """
    have = {canonical(c): c for c in reversed(df.columns)}
    found = {n: have[next(a for a in aliases if a in have)] for n, aliases in ALIASES.items() if any(a in have for a in aliases)}
    if missing := {"link_year", "link_score"} - set(found):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    if not ({"source_ticker", "linked_ticker"} <= set(found) or {"source_gvkey", "linked_gvkey"} <= set(found)):
        raise ValueError("missing columns: tickers or numbers of both sides")
    text = lambda n: F.col(f"`{found[n]}`").cast("string") if n in found else F.lit(None).cast("string")
    out = df.select(
        text("link_year").try_cast("double").try_cast("bigint").alias("link_year"), text("link_score").try_cast("double").alias("link_score"),
        *(K.symbol(text(n)).alias(n) for n in ("source_ticker", "linked_ticker")), *(K.gvkey(text(n)).alias(n) for n in ("source_gvkey", "linked_gvkey")),
        *(text(n).alias(n) for n in ("source_name", "linked_name")), (F.lit(link_type) if isinstance(link_type, str) else link_type).alias("link_type"),
    )
    out = out.where("(source_ticker is not null and linked_ticker is not null) or (source_gvkey is not null and linked_gvkey is not null)")
    if years is not None:
        out = out.join(bounded(years.select("link_year").distinct(), MOST_SOURCES), "link_year", "left_semi")
    if numbers is not None and {"source_gvkey", "linked_gvkey"} <= set(found):
        # One side is enough: a semi join each, the second for the rows that the first lacks.
        n = bounded(numbers.select(F.col("source_gvkey").alias("_n")).distinct(), MOST_SOURCES)
        flagged = out.join(n.withColumn("_a", F.lit(True)), F.col("source_gvkey") == F.col("_n"), "left").drop("_n")
        flagged = flagged.join(n.withColumn("_b", F.lit(True)), F.col("linked_gvkey") == F.col("_n"), "left").drop("_n")
        out = flagged.where("_a or _b").drop("_a", "_b")
    return out


def _best(df: DataFrame) -> DataFrame:
    """One row per pair, type and year: the highest score, and of what else it carries the first value present, in the order of score and values."""
    kept = df.where("source_firm_id <> linked_firm_id")
    tie = F.struct(F.coalesce(-F.col("link_score"), F.lit(float("inf"))), *(F.coalesce(c, F.lit("")) for c in CARRIED))
    return kept.groupBy(*PAIR).agg(F.max("link_score").alias("link_score"), *(first_present(c, tie).alias(c) for c in CARRIED))


def by_ticker(both: DataFrame, sources: DataFrame, firms: DataFrame) -> DataFrame:
    """Links between firms by their tickers, of sources with an event in the year after to firms quoted in it."""
    rows = both.where("source_ticker is not null and linked_ticker is not null").withColumns({"source_firm_id": F.col("source_ticker"), "linked_firm_id": F.col("linked_ticker")})
    near = rows.join(bounded(sources, MOST_SOURCES), ["source_firm_id", "link_year"])
    return _best(near.join(firms.withColumnRenamed("firm_id", "linked_firm_id").hint("merge"), ["linked_firm_id", "event_year"], "left_semi"))


def by_number(both: DataFrame, numbers: DataFrame, bridge: DataFrame, firms: DataFrame) -> DataFrame:
    """Links between firms by their numbers, both sides led to firms by the bridge of the event year."""
    linked = bridge.select("event_year", K.gvkey("gvkey").alias("linked_gvkey"), F.col("firm_id").alias("linked_firm_id"), F.col("underlying_symbol").alias("linked_ticker"), F.col("issuer_name").alias("linked_name")).distinct()
    rows = both.where("source_gvkey is not null and linked_gvkey is not null").select("source_gvkey", "linked_gvkey", "link_year", "link_type", "link_score")
    near = rows.join(bounded(numbers, MOST_SOURCES), ["source_gvkey", "link_year"]).join(linked.hint("merge"), ["linked_gvkey", "event_year"])
    return _best(near.join(firms.withColumnRenamed("firm_id", "linked_firm_id").hint("merge"), ["linked_firm_id", "event_year"], "left_semi"))


def linkage_table(standard: DataFrame, sources: DataFrame, firms: DataFrame, bridge: DataFrame | None = None) -> DataFrame:
    """Links of the sources with ``link_rank`` by descending score within source, type and year.

    Each link counts both ways. Links resolved by ticker and by number stand side by side
    (a pair resolved either way has two rows), ranks run over both; ties go by the linked
    firm, a null score has no rank.
    """
    both = links.both_ways(standard.select("link_year", "link_score", "link_type", *CARRIED), SIDES)
    out = by_ticker(both, sources, firms)
    if bridge is not None:
        out = out.unionByName(by_number(both, source_numbers(sources, bridge), bridge, firms))
    r = links.ranked(out, ["source_firm_id", "link_type", "link_year"], "link_score", "linked_firm_id")
    return r.select(*PAIR, "link_score", *CARRIED, "link_rank")


def control_candidates(sources: DataFrame, firms: DataFrame, linkages: DataFrame, types: list[str]) -> DataFrame:
    """``source_firm_id, event_year, link_year, link_type, control_firm_id``: firms a source could be compared with.

    All firms quoted in the event year but the source itself and those it is linked with by
    that type; without links there are none. The rows are sources times firms of a year, so
    ``sources`` should be the cases under study: they are the side that is sent around.
    """
    per_type = sources.select("*", F.explode(F.array(*map(F.lit, types))).alias("link_type"))
    known = linkages.select("link_type").distinct()
    per_type = per_type.join(bounded(known, MOST_SOURCES), "link_type", "left_semi")
    universe = firms.select("event_year", F.col("firm_id").alias("control_firm_id")).join(bounded(per_type, MOST_SOURCES), "event_year").where("source_firm_id <> control_firm_id")
    linked = linkages.select("source_firm_id", F.col("linked_firm_id").alias("control_firm_id"), "link_type", "link_year").distinct()
    return universe.join(linked.hint("merge"), ["source_firm_id", "control_firm_id", "link_type", "link_year"], "left_anti").select("source_firm_id", "event_year", "link_year", "link_type", "control_firm_id")


def symbol_years(rows: DataFrame, symbol: str, day: str, sources: DataFrame) -> DataFrame:
    """Per symbol and event year its firm, first and last day quoted, and number of rows."""
    years = bounded(sources.select("event_year").distinct(), MOST_SOURCES)
    dated = rows.select(F.btrim(F.col(symbol), F.lit(K.SPACE)).alias("underlying_symbol"), K.symbol(symbol).alias("firm_id"), F.year(day).cast("bigint").alias("event_year"), F.col(day).alias("day"))
    seen = dated.where("firm_id is not null").join(years, "event_year", "left_semi")
    return seen.groupBy("underlying_symbol", "firm_id", "event_year").agg(F.min("day").alias("observed_start_date"), F.max("day").alias("observed_end_date"), F.count("*").alias("option_obs_count"))


def bridge_of(symbols: DataFrame, evidence: DataFrame, seed: DataFrame, priorities: dict[str, int], other: int) -> DataFrame:
    """The bridge from symbols and years to numbers: only what the evidence leaves no doubt of.

    ``evidence`` (cik, firm_id, issuer_ticker, issuer_name, issuer_source, evidence_id) tells
    whose firm a symbol was; of each symbol and year the sources of the best priority count.
    ``seed`` (gvkey, iid, cik, seed_first_date, seed_last_date) must overlap the days quoted.
    A symbol and year with several numbers or ciks is dropped, and so is a number whose year
    has several firms. Null keys match nothing.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])[F.col("issuer_source")], F.lit(other))
    near = symbols.join(evidence.where("cik is not null").hint("merge"), "firm_id")
    best = links.best_priority(near, ["underlying_symbol", "event_year"], rank)
    dated = best.join(seed.hint("merge"), "cik").where("observed_start_date <= seed_last_date and observed_end_date >= seed_first_date")
    sure = links.one_to_one(links.one_to_one(dated, ["underlying_symbol", "event_year"], "gvkey"), ["underlying_symbol", "event_year"], "cik")
    sure = links.one_to_one(sure, ["gvkey", "event_year"], "firm_id")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ";")
    tie = lambda c: F.struct("issuer_source", F.coalesce("evidence_id", F.lit("")), c)
    return sure.groupBy("gvkey", "iid", "cik", "event_year", "underlying_symbol", "firm_id").agg(
        F.min("observed_start_date").alias("observed_start_date"), F.max("observed_end_date").alias("observed_end_date"), F.max("option_obs_count").alias("option_obs_count"),
        F.min("seed_first_date").alias("seed_first_date"), F.max("seed_last_date").alias("seed_last_date"),
        first_present("issuer_ticker", tie("issuer_ticker")).alias("issuer_ticker"), first_present("issuer_name", tie("issuer_name")).alias("issuer_name"),
        joined("issuer_source").alias("issuer_sources"), joined("evidence_id").alias("evidence_ids"),
    )
