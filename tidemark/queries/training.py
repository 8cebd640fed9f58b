"""Queries of the general training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.operators import asof, drift, skewed_keys, spikes, timestamps
from tidemark.session import materialise
from tidemark.tables import table

NEW_YORK = "America/New_York"
# The canonical columns of the panel files and their types.
PANEL = tuple(
    (n, k)
    for k, names in {
        "date": "quote_date expiration",
        "text": "underlying_symbol root option_type venue_code quote_condition",
        "decimal": "strike bid_1545 ask_1545 implied_underlying_price_1545 bid_eod ask_eod vwap active_underlying_price_1545 implied_volatility_1545 delta_1545 gamma_1545",
        "integer": "trade_volume open_interest bid_size_1545 ask_size_1545 settle_days",
        "boolean": "has_calcs is_adjusted",
    }.items()
    for n in names.split()
)


def _implausible(spark: SparkSession, d: str) -> DataFrame:
    """``source_table, row_id, reason`` of both tables."""
    o = table(spark, d, "options_eod_summary", "row_id", "quote_date", "series_id", "bid_1545", "ask_1545")
    u = table(spark, d, "underlying_daily", "row_id", "quote_date", "underlying_symbol", "s_eod")
    u = u.withColumn("underlying_symbol", K.symbol("underlying_symbol"))
    # A series has some twenty dates: what no quote of the table moves by chance is told by all of them.
    quotes = spikes.implausible(o, source="series_id", day="quote_date", row_id="row_id", readings=("bid_1545", "ask_1545"), zero_ok=(True, False), crossed=True, alpha=0.05, chance=5e-6)
    closes = spikes.implausible(u, source="underlying_symbol", day="quote_date", row_id="row_id", readings=("s_eod",), zero_ok=(False,))
    named = lambda df, name: df.select(F.lit(name).alias("source_table"), "row_id", "reason")
    return named(quotes, "options_eod_summary").unionAll(named(closes, "underlying_daily"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of both tables whose quote or close no market gave."""
    return _implausible(spark, d).select("source_table", "row_id").distinct()


def p2_ranges_and_runs(spark: SparkSession, d: str) -> DataFrame:
    """Of those rows the ones that SQL can tell too: readings out of range and constant runs."""
    return _implausible(spark, d).where("reason <> 'spike'").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One instant per event whose instant is determined."""
    e = table(spark, d, "event_alignment", "event_id", "feed", "feed_zone", "announcement_dt", "local_announcement_dt")
    stamps = {"feed": ("announcement_dt", F.coalesce("feed_zone", F.lit(NEW_YORK))), "local": ("local_announcement_dt", F.lit(NEW_YORK))}
    rows = timestamps.normalise_stamps(e, stamps, keep=("event_id",))
    return timestamps.one_instant(rows, "event_id", ("feed", "local"), "announcement_us")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The bridge row and link year known at each event's trading date."""
    e = table(spark, d, "event_alignment", "event_id", "source_firm_id", "event_trading_date", "link_year").distinct()
    e = e.withColumn("day", F.unix_date("event_trading_date"))
    b = table(spark, d, "gvkey_underlying_bridge", "bridge_id", "gvkey", "firm_id", "evidence_date")
    b = b.select("firm_id", F.unix_date("evidence_date").alias("at"), F.struct("bridge_id", K.gvkey("gvkey").alias("gvkey")).alias("bridge"))
    known = asof.as_of_join(e, b, event_entity="source_firm_id", event_time="day", entity="firm_id", at="at", value="bridge", width=366, out="bridge")
    known = known.select("event_id", F.col("bridge.bridge_id").alias("bridge_id"), F.col("bridge.gvkey").alias("gvkey"), F.least(F.year("event_trading_date").cast("bigint") - 1, F.col("link_year")).alias("until"))
    y = table(spark, d, "linkages", "source_gvkey", "link_year").select(K.gvkey("source_gvkey").alias("source_gvkey"), "link_year")
    linked = asof.as_of_join(known, y, event_entity="gvkey", event_time="until", entity="source_gvkey", at="link_year", value="link_year", width=1, out="year")
    found = lambda df, what, key: df.select("event_id", F.lit(what).alias("attribute"), F.col(key).cast("bigint").alias("value_key"))
    return found(known, "bridge", "bridge_id").unionAll(found(linked, "link_year", "year")).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change of a panel file against the previous one of its stream."""
    return drift.changes(drift.file_columns(table(spark, d, "panel_file_lines"), PANEL))


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """All panel lines in the canonical columns and types."""
    lines = table(spark, d, "panel_file_lines")
    return drift.consistent_table(lines, drift.file_columns(lines, PANEL), PANEL)


def _symbols(spark: SparkSession, d: str, *columns: str) -> skewed_keys.Accumulators:
    o = table(spark, d, "options_eod_summary", "underlying_symbol", *columns)
    return skewed_keys.Accumulators(o, K.symbol("underlying_symbol"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with at least one fortieth of all rows."""
    n = materialise(_symbols(spark, d).counts())
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).where("key is not null and n * 40 >= total").select(F.col("key").alias("underlying_symbol"))


def p7_stats(spark: SparkSession, d: str) -> DataFrame:
    """Rows, volume and exact median mid per symbol."""
    s = _symbols(spark, d, "trade_volume", "mid_1545").counts_and_medians({"volume": F.col("trade_volume")}, {"median_mid": F.col("mid_1545")})
    return s.select(F.col("key").alias("underlying_symbol"), F.col("n").alias("n_rows"), "volume", F.round("median_mid", 6).alias("median_mid"))


QUERIES = {f.__name__: f for f in (p2_found, p2_ranges_and_runs, p3_found, p5_found, p6_found, p6_table, p7_found, p7_stats)}

_SYMBOL = "translate(upper(trim(underlying_symbol)), '/-', '..')"
_GVKEY = "nullif(regexp_extract(trim(source_gvkey), '^\\D*0*(\\d+)(?:\\.0*)?$', 1), '')"


def _runs_sql(name: str, rows: str, values: list[str]) -> str:
    """Constant runs of five or more successive dates present, from the second on, of rows (row_id, s, d, values)."""
    v = ", ".join(values)
    same = " AND ".join(f"r.{x} = o.{x}" for x in values)
    return f"""SELECT '{name}' AS source_table, o.row_id, 'constant' AS reason FROM {rows} o JOIN {rows}_days y USING (s, d) JOIN (
        SELECT s, {v}, g, min(i) AS f, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY s, {v} ORDER BY i) AS g FROM (SELECT DISTINCT s, i, {v} FROM {rows} JOIN {rows}_days USING (s, d) WHERE {' AND '.join(f'{x} IS NOT NULL' for x in values)}))
        GROUP BY ALL HAVING count(*) >= 5) r ON r.s = o.s AND {same} AND y.i > r.f AND y.i < r.f + r.n"""


_DAYS = "{0}_days AS (SELECT s, d, dense_rank() OVER (PARTITION BY s ORDER BY d) AS i FROM (SELECT DISTINCT s, d FROM {0}))"
SQL = {
    "p2_ranges_and_runs": f"""
        WITH o AS (SELECT row_id, series_id AS s, quote_date AS d, bid_1545 AS b, ask_1545 AS a FROM options_eod_summary WHERE series_id IS NOT NULL AND quote_date IS NOT NULL),
        u AS (SELECT row_id, {_SYMBOL} AS s, quote_date AS d, s_eod AS x FROM underlying_daily WHERE underlying_symbol IS NOT NULL AND quote_date IS NOT NULL), {_DAYS.format('o')}, {_DAYS.format('u')}
        SELECT 'options_eod_summary' AS source_table, row_id, 'range' AS reason FROM o WHERE b < 0 OR a <= 0 OR a < b
        UNION SELECT 'underlying_daily', row_id, 'range' FROM u WHERE x <= 0
        UNION {_runs_sql('options_eod_summary', 'o', ['b', 'a'])} UNION {_runs_sql('underlying_daily', 'u', ['x'])}""",
    "p5_found": f"""
        WITH e AS (SELECT DISTINCT event_id, source_firm_id, event_trading_date, link_year FROM event_alignment),
        b AS (SELECT e.event_id, arg_max(g.bridge_id, g.evidence_date) AS bridge_id, arg_max(g.gvkey, g.evidence_date) AS gvkey,
                     any_value(least(year(e.event_trading_date) - 1, coalesce(e.link_year, 9999))) AS until
              FROM e JOIN gvkey_underlying_bridge g ON g.firm_id = e.source_firm_id AND g.evidence_date <= e.event_trading_date GROUP BY e.event_id),
        y AS (SELECT DISTINCT {_GVKEY} AS gvkey, link_year FROM linkages)
        SELECT event_id, 'bridge' AS attribute, CAST(bridge_id AS BIGINT) AS value_key FROM b
        UNION ALL SELECT b.event_id, 'link_year', CAST(max(y.link_year) AS BIGINT) FROM b JOIN y ON y.gvkey = CAST(CAST(b.gvkey AS BIGINT) AS VARCHAR) AND y.link_year <= b.until GROUP BY b.event_id""",
    "p7_found": f"SELECT {_SYMBOL} AS underlying_symbol FROM options_eod_summary GROUP BY 1 HAVING count(*) * 40 >= (SELECT count(*) FROM options_eod_summary)",
    "p7_stats": f"SELECT {_SYMBOL} AS underlying_symbol, count(*) AS n_rows, CAST(coalesce(sum(trade_volume), 0) AS BIGINT) AS volume, round(median(mid_1545), 6) AS median_mid FROM options_eod_summary GROUP BY 1",
}
