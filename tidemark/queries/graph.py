"""Queries of the linkage tables over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.operators import linktables
from tidemark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
TYPES = ["horizontal", "vertical"]
# How much the sources of evidence count.
PRIORITY = {"event_source": 1, "event_target": 2, "event_acquirer": 3}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _sym(c: str) -> str:
    return f"translate(upper(trim({c})), '/-', '..')"


def _gv(c: str) -> str:
    return f"nullif(regexp_extract(trim({c}), '^\\D*0*(\\d+)(?:\\.0*)?$', 1), '')"


def _cik(c: str) -> str:
    d = f"ltrim(regexp_replace(CAST({c} AS VARCHAR), '\\D', '', 'g'), '0')"
    return f"CASE WHEN length({d}) > 10 THEN {d} WHEN {d} <> '' THEN lpad({d}, 10, '0') END"


_SOURCES = """src AS (
    SELECT DISTINCT source_firm_id, CAST(year(event_trading_date) AS BIGINT) AS event_year, CAST(year(event_trading_date) - 1 AS BIGINT) AS link_year
    FROM event_alignment WHERE case_id IS NOT NULL AND source_firm_id IS NOT NULL AND event_trading_date IS NOT NULL)"""
_FIRMS = f"""firms AS (
    SELECT DISTINCT {_sym('underlying_symbol')} AS firm_id, CAST(year(quote_date) AS BIGINT) AS event_year
    FROM underlying_daily WHERE year(quote_date) IN (SELECT event_year FROM src) AND underlying_symbol IS NOT NULL)"""
_NUMBERS = f"""numbers AS (
    SELECT DISTINCT source_firm_id, event_year, link_year, source_gvkey, source_ticker, source_name FROM src JOIN (
        SELECT DISTINCT firm_id AS source_firm_id, event_year, {_gv('gvkey')} AS source_gvkey, underlying_symbol AS source_ticker, issuer_name AS source_name FROM gvkey_underlying_bridge) b
    USING (source_firm_id, event_year) WHERE source_gvkey IS NOT NULL)"""
_STANDARD = f"""std AS (
    SELECT * FROM (
        SELECT link_year, link_score, {_sym('source_ticker')} AS source_ticker, {_sym('linked_ticker')} AS linked_ticker,
            {_gv('source_gvkey')} AS source_gvkey, {_gv('linked_gvkey')} AS linked_gvkey, source_name, linked_name, link_type FROM linkages)
    WHERE ((source_ticker IS NOT NULL AND linked_ticker IS NOT NULL) OR (source_gvkey IS NOT NULL AND linked_gvkey IS NOT NULL))
        AND link_year IN (SELECT link_year FROM src))"""
_BEST = ", ".join(["max(link_score) AS link_score"] + [f"""arg_min({c}, ROW(coalesce(-link_score, CAST('Infinity' AS DOUBLE)), {', '.join(f"coalesce({x}, '')" for x in linktables.CARRIED)})) FILTER (WHERE {c} IS NOT NULL) AS {c}""" for c in linktables.CARRIED])
_TABLE = f"""{_SOURCES}, {_FIRMS}, {_NUMBERS}, {_STANDARD},
    two AS (SELECT link_year, link_score, link_type, source_ticker, linked_ticker, source_gvkey, linked_gvkey, source_name, linked_name FROM std
        UNION ALL SELECT link_year, link_score, link_type, linked_ticker, source_ticker, linked_gvkey, source_gvkey, linked_name, source_name FROM std),
    t AS (SELECT source_ticker AS source_firm_id, linked_ticker AS linked_firm_id, two.* FROM two
        JOIN src ON src.source_firm_id = source_ticker AND src.link_year = two.link_year JOIN firms ON firm_id = linked_ticker AND firms.event_year = src.event_year),
    lb AS (SELECT DISTINCT event_year, {_gv('gvkey')} AS linked_gvkey, firm_id AS linked_firm_id, underlying_symbol AS linked_ticker, issuer_name AS linked_name FROM gvkey_underlying_bridge),
    g AS (SELECT n.source_firm_id, lb.linked_firm_id, two.link_year, two.link_score, two.link_type, n.source_ticker, lb.linked_ticker, two.source_gvkey, two.linked_gvkey, n.source_name, lb.linked_name FROM two
        JOIN numbers n ON n.source_gvkey = two.source_gvkey AND n.link_year = two.link_year JOIN lb ON lb.linked_gvkey = two.linked_gvkey AND lb.event_year = n.event_year
        JOIN firms ON firms.firm_id = lb.linked_firm_id AND firms.event_year = n.event_year),
    resolved AS (SELECT source_firm_id, linked_firm_id, link_type, link_year, {_BEST} FROM t WHERE source_firm_id <> linked_firm_id GROUP BY 1, 2, 3, 4
        UNION ALL SELECT source_firm_id, linked_firm_id, link_type, link_year, {_BEST} FROM g WHERE source_firm_id <> linked_firm_id GROUP BY 1, 2, 3, 4)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Of all events those that a case is configured for."""
    return table(spark, d, "event_alignment", "case_id", "source_firm_id", "event_trading_date").where("case_id is not null")


def _bridge(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gvkey_underlying_bridge", "gvkey", "event_year", "underlying_symbol", "firm_id", "issuer_name")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return linktables.source_years(_events(spark, d), "source_firm_id", "event_trading_date")


def _firms(spark: SparkSession, d: str, sources: DataFrame) -> DataFrame:
    return linktables.firm_years(table(spark, d, "underlying_daily", "underlying_symbol", "quote_date"), "underlying_symbol", "quote_date", sources)


def _table(spark: SparkSession, d: str, sources: DataFrame, firms: DataFrame) -> DataFrame:
    standard = linktables.standard_links(table(spark, d, "linkages").drop("link_rank"), F.col("link_type"), years=sources)
    return linktables.linkage_table(standard, sources, firms, _bridge(spark, d))


@query(f"WITH {_SOURCES}, {_FIRMS} SELECT * FROM firms")
def option_firm_years(spark: SparkSession, d: str) -> DataFrame:
    """Firms quoted in the event years of the cases."""
    return _firms(spark, d, _sources(spark, d))


@query(f"WITH {_SOURCES}, {_NUMBERS} SELECT * FROM numbers")
def source_event_numbers(spark: SparkSession, d: str) -> DataFrame:
    """The numbers that the bridge has for the cases' firms in their event years."""
    return linktables.source_numbers(_sources(spark, d), _bridge(spark, d))


@query(f"WITH {_SOURCES}, {_NUMBERS}, {_STANDARD} SELECT * FROM std WHERE source_gvkey IN (SELECT source_gvkey FROM numbers) OR linked_gvkey IN (SELECT source_gvkey FROM numbers)")
def linkage_standardised(spark: SparkSession, d: str) -> DataFrame:
    """Vendor links in standard form, of the cases' years and numbers."""
    s = _sources(spark, d)
    return linktables.standard_links(table(spark, d, "linkages").drop("link_rank"), F.col("link_type"), years=s, numbers=linktables.source_numbers(s, _bridge(spark, d)))


@query(f"""WITH {_TABLE}, r AS (
        SELECT *, row_number() OVER (PARTITION BY source_firm_id, link_type, link_year ORDER BY link_score DESC NULLS LAST, linked_firm_id) AS rn FROM resolved)
    SELECT source_firm_id, linked_firm_id, link_type, link_year, link_score, count(*) AS n_rows, CAST(min(CASE WHEN link_score IS NOT NULL THEN rn END) AS BIGINT) AS best_rank,
        min(source_gvkey) AS source_gvkey, min(linked_gvkey) AS linked_gvkey, min(source_ticker) AS source_ticker, min(linked_ticker) AS linked_ticker
    FROM r GROUP BY 1, 2, 3, 4, 5""")
def linkage_tables(spark: SparkSession, d: str) -> DataFrame:
    """Links of the cases resolved by ticker and by number, ranked; a pair resolved either way with one score is one row."""
    s = _sources(spark, d)
    t = _table(spark, d, s, _firms(spark, d, s))
    return t.groupBy(*linktables.PAIR, "link_score").agg(F.count("*").alias("n_rows"), F.min("link_rank").alias("best_rank"), *(F.min(c).alias(c) for c in ("source_gvkey", "linked_gvkey", "source_ticker", "linked_ticker")))


@query(f"""WITH {_TABLE}, types AS (SELECT unnest(['horizontal', 'vertical']) AS link_type)
    SELECT src.source_firm_id, src.event_year, src.link_year, link_type, firms.firm_id AS control_firm_id FROM src CROSS JOIN types JOIN firms USING (event_year)
    WHERE src.source_firm_id <> firms.firm_id AND link_type IN (SELECT link_type FROM resolved) AND NOT EXISTS (
        SELECT 1 FROM resolved r WHERE r.source_firm_id = src.source_firm_id AND r.linked_firm_id = firms.firm_id AND r.link_type = types.link_type AND r.link_year = src.link_year)""")
def control_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Firms of the event year that each case could be compared with."""
    s = _sources(spark, d)
    firms = _firms(spark, d, s)
    return linktables.control_candidates(s, firms, _table(spark, d, s, firms), TYPES)


@query(f"""WITH years AS (SELECT DISTINCT year(event_trading_date) AS y FROM event_alignment WHERE case_id IS NOT NULL),
    s AS (SELECT trim(underlying_symbol) AS underlying_symbol, {_sym('underlying_symbol')} AS firm_id, CAST(year(quote_date) AS BIGINT) AS event_year,
        min(quote_date) AS a, max(quote_date) AS b, count(*) AS n FROM options_eod_summary WHERE year(quote_date) IN (SELECT y FROM years) AND underlying_symbol IS NOT NULL GROUP BY 1, 2, 3),
    e AS (SELECT {_cik('cik')} AS cik, {_sym('ticker')} AS firm_id, ticker AS issuer_ticker, name AS issuer_name, 'current' AS issuer_source, CAST(NULL AS VARCHAR) AS evidence_id FROM company_lookup
        UNION ALL SELECT {_cik('cik')}, {_sym('coalesce(underlying_symbol, ticker)')}, ticker, name, 'event_' || party_role, event_id FROM deal_party),
    seed AS (SELECT {_gv('gvkey')} AS gvkey, iid, {_cik('cik')} AS cik, min(observed_start_date) AS f, max(observed_end_date) AS l FROM gvkey_underlying_bridge GROUP BY 1, 2, 3),
    c AS (SELECT s.*, e.* EXCLUDE (firm_id), CASE issuer_source WHEN 'event_source' THEN 1 WHEN 'event_target' THEN 2 WHEN 'event_acquirer' THEN 3 ELSE 4 END AS pr FROM s JOIN e USING (firm_id) WHERE cik IS NOT NULL),
    p AS (SELECT * FROM c QUALIFY pr = min(pr) OVER (PARTITION BY underlying_symbol, event_year)),
    j AS (SELECT p.*, gvkey, iid, f, l FROM p JOIN seed USING (cik) WHERE a <= l AND b >= f AND gvkey IS NOT NULL),
    k AS (SELECT j.* FROM j JOIN (SELECT underlying_symbol, event_year FROM j GROUP BY 1, 2 HAVING count(DISTINCT gvkey) = 1 AND count(DISTINCT cik) = 1) USING (underlying_symbol, event_year)),
    m AS (SELECT k.* FROM k JOIN (SELECT gvkey, event_year FROM k GROUP BY 1, 2 HAVING count(DISTINCT firm_id) = 1) USING (gvkey, event_year))
    SELECT gvkey, iid, cik, event_year, underlying_symbol, firm_id, min(a) AS observed_start_date, max(b) AS observed_end_date, max(n) AS option_obs_count,
        min(f) AS seed_first_date, max(l) AS seed_last_date, arg_min(issuer_ticker, ROW(issuer_source, coalesce(evidence_id, ''), issuer_ticker)) FILTER (WHERE issuer_ticker IS NOT NULL) AS issuer_ticker,
        array_to_string(list_sort(list(DISTINCT issuer_source)), ';') AS issuer_sources, coalesce(array_to_string(list_sort(list(DISTINCT evidence_id) FILTER (WHERE evidence_id IS NOT NULL)), ';'), '') AS evidence_ids
    FROM m GROUP BY 1, 2, 3, 4, 5, 6""")
def bridge_built(spark: SparkSession, d: str) -> DataFrame:
    """The bridge from quoted symbols to numbers, built from issuer evidence and a seed of numbers and ciks."""
    s = linktables.symbol_years(table(spark, d, "options_eod_summary", "underlying_symbol", "quote_date"), "underlying_symbol", "quote_date", _sources_of_all(spark, d))
    now = table(spark, d, "company_lookup", "cik", "ticker", "name").select(K.cik10("cik").alias("cik"), K.symbol("ticker").alias("firm_id"), F.col("ticker").alias("issuer_ticker"), F.col("name").alias("issuer_name"), F.lit("current").alias("issuer_source"), F.lit(None).cast("string").alias("evidence_id"))
    party = table(spark, d, "deal_party", "cik", "underlying_symbol", "ticker", "name", "party_role", "event_id")
    filed = party.select(K.cik10("cik").alias("cik"), K.symbol(F.coalesce("underlying_symbol", "ticker")).alias("firm_id"), F.col("ticker").alias("issuer_ticker"), F.col("name").alias("issuer_name"), F.concat(F.lit("event_"), "party_role").alias("issuer_source"), F.col("event_id").alias("evidence_id"))
    seed = table(spark, d, "gvkey_underlying_bridge", "gvkey", "iid", "cik", "observed_start_date", "observed_end_date")
    seed = seed.groupBy(K.gvkey("gvkey").alias("gvkey"), "iid", K.cik10("cik").alias("cik")).agg(F.min("observed_start_date").alias("seed_first_date"), F.max("observed_end_date").alias("seed_last_date")).where("gvkey is not null")
    b = linktables.bridge_of(s, now.unionAll(filed), seed, PRIORITY, 4)
    return b.drop("issuer_name")


def _sources_of_all(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return e.select(F.year("event_trading_date").cast("bigint").alias("event_year")).distinct()
