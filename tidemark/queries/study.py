"""Queries of the event-study operators over the domain tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import markup, quotes
from tidemark.functions import text_keys as K
from tidemark.operators import abnormal, buckets, calendar, clusters, entities, links, panel, quality, windows
from tidemark.tables import table

TYPES = {"CALL": "C", "PUT": "P"}
TENORS = [(7, "0_7"), (30, "8_30"), (90, "31_90")]
SYM = "translate(upper(trim({})), '/-', '..')"
TYPE = "CASE upper(trim(option_type)) WHEN 'CALL' THEN 'C' WHEN 'PUT' THEN 'P' ELSE upper(trim(option_type)) END"
TENOR = "CASE WHEN dte_cal <= 7 THEN '0_7' WHEN dte_cal <= 30 THEN '8_30' WHEN dte_cal <= 90 THEN '31_90' ELSE '91_plus' END"
SIDE = f"""CASE WHEN {TYPE} = 'C' AND delta_1545 BETWEEN 0.10 AND 0.40 THEN 'call_otm' WHEN {TYPE} = 'C' AND delta_1545 > 0.40 AND delta_1545 < 0.60 THEN 'call_atm'
    WHEN {TYPE} = 'P' AND delta_1545 BETWEEN -0.40 AND -0.10 THEN 'put_otm' WHEN {TYPE} = 'P' AND delta_1545 > -0.60 AND delta_1545 < -0.40 THEN 'put_atm' ELSE 'other' END"""
OK = "coalesce(bid_1545 > 0 AND ask_1545 > 0 AND ask_1545 >= bid_1545, false)"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _options(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "options_eod_summary", *columns)


def _side(delta: str = "delta_1545", kind: str = "option_type") -> F.Column:
    call, put = quotes.short_code(kind, TYPES) == "C", quotes.short_code(kind, TYPES) == "P"
    return quotes.within(delta, [(call, 0.10, 0.40, True, "call_otm"), (call, 0.40, 0.60, False, "call_atm"), (put, -0.40, -0.10, True, "put_otm"), (put, -0.60, -0.40, False, "put_atm")], "other")


@query(f"""SELECT row_id, {SYM.format('underlying_symbol')} AS symbol, {TYPE} AS kind, {OK} AS has_quote, round(CASE WHEN {OK} THEN (bid_1545 + ask_1545) / 2 END, 6) AS mid,
    round(CASE WHEN {OK} THEN (ask_1545 - bid_1545) / ((bid_1545 + ask_1545) / 2) END, 6) AS rel_spread,
    round(CASE WHEN coalesce(underlying_bid_1545 > 0 AND underlying_ask_1545 > 0 AND underlying_ask_1545 >= underlying_bid_1545, false) THEN (underlying_bid_1545 + underlying_ask_1545) / 2
        WHEN active_underlying_price_1545 > 0 THEN active_underlying_price_1545 END, 6) AS price, CAST(date_diff('day', quote_date, expiration) AS BIGINT) AS days_left,
    (implied_underlying_price_1545 IS NOT NULL OR active_underlying_price_1545 IS NOT NULL OR implied_volatility_1545 IS NOT NULL OR delta_1545 IS NOT NULL) AS calcs,
    {SYM.format('underlying_symbol')} || '|' || trim(root) || '|' || CAST(expiration AS VARCHAR) || '|' || CAST(round(strike, 4) AS VARCHAR) || '|' || {TYPE} AS series FROM options_eod_summary""")
def quote_clean(spark: SparkSession, d: str) -> DataFrame:
    """Quotes normalised: symbol, type, validity, midpoint, spread, price with fallback, days left, series key."""
    o = _options(spark, d)
    kind, symbol = quotes.short_code("option_type", TYPES), K.symbol("underlying_symbol")
    return o.select(
        "row_id", symbol.alias("symbol"), kind.alias("kind"), quotes.valid_quote("bid_1545", "ask_1545").alias("has_quote"),
        F.round(quotes.midpoint("bid_1545", "ask_1545"), 6).alias("mid"), F.round(quotes.relative_spread("bid_1545", "ask_1545"), 6).alias("rel_spread"),
        F.round(quotes.price_or("underlying_bid_1545", "underlying_ask_1545", "active_underlying_price_1545"), 6).alias("price"),
        F.datediff("expiration", "quote_date").cast("bigint").alias("days_left"),
        quotes.any_present("implied_underlying_price_1545", "active_underlying_price_1545", "implied_volatility_1545", "delta_1545").alias("calcs"),
        quotes.composite_key(symbol, F.trim("root"), "expiration", F.round("strike", 4), kind).alias("series"),
    )


@query(f"SELECT {TYPE} AS kind, count(*) AS n, count(*) FILTER (WHERE {OK}) AS valid FROM options_eod_summary GROUP BY 1")
def option_type_norm(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of the option type normalised and counted."""
    o = _options(spark, d, "option_type", "bid_1545", "ask_1545")
    return o.groupBy(quotes.short_code("option_type", TYPES).alias("kind")).agg(F.count("*").alias("n"), F.count_if(quotes.valid_quote("bid_1545", "ask_1545")).alias("valid"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    o = _options(spark, d, "row_id", "quote_date", "underlying_symbol", "s_1545", "implied_underlying_price_1545", "underlying_bid_1545", "underlying_ask_1545", "has_calcs").withColumn("symbol", K.symbol("underlying_symbol"))
    return panel.collapse(o, ["symbol", "quote_date"], ["row_id"], first=["s_1545", "implied_underlying_price_1545"], flags=["has_calcs"], distinct=["s_1545"], snapshots={"quote": ["underlying_bid_1545", "underlying_ask_1545"]})


@query(f"""SELECT {SYM.format('underlying_symbol')} AS symbol, quote_date, count(*) AS n_rows, arg_min(s_1545, row_id) FILTER (WHERE s_1545 IS NOT NULL) AS s_1545,
    arg_min(implied_underlying_price_1545, row_id) FILTER (WHERE implied_underlying_price_1545 IS NOT NULL) AS implied_underlying_price_1545, coalesce(bool_or(has_calcs), false) AS has_calcs,
    count(DISTINCT s_1545) AS s_1545_n, count(DISTINCT {{'a': underlying_bid_1545, 'b': underlying_ask_1545}}) AS quote_n, count(DISTINCT s_1545) > 1 AS s_1545_inconsistent,
    count(DISTINCT {{'a': underlying_bid_1545, 'b': underlying_ask_1545}}) > 1 AS quote_inconsistent FROM options_eod_summary GROUP BY 1, 2""")
def daily_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Contract-days to one row per symbol and day, with consistency flags."""
    return _daily(spark, d)


@query(f"""WITH u AS (SELECT {SYM.format('underlying_symbol')} AS symbol, quote_date, arg_min(s_eod, row_id) FILTER (WHERE s_eod IS NOT NULL) AS s_eod FROM underlying_daily GROUP BY 1, 2),
    l AS (SELECT *, lag(s_eod) OVER (PARTITION BY symbol ORDER BY quote_date) AS prior FROM u)
    SELECT symbol, quote_date, s_eod, prior, round(CASE WHEN prior > 0 AND s_eod > 0 THEN s_eod / prior - 1 END, 6) AS raw_return FROM l""")
def daily_returns(spark: SparkSession, d: str) -> DataFrame:
    """Close-to-close returns of each symbol along its days present."""
    u = table(spark, d, "underlying_daily", "row_id", "quote_date", "underlying_symbol", "s_eod").withColumn("symbol", K.symbol("underlying_symbol"))
    one = panel.collapse(u, ["symbol", "quote_date"], ["row_id"], first=["s_eod"]).drop("n_rows")
    return panel.with_returns(one, "symbol", "quote_date", "s_eod").withColumn("raw_return", F.round("raw_return", 6))


# Fixed values of the studies below: the event's place among the days of the events table, and its windows.
EVENT_DAY = "DATE '2024-01-21'"
STUDY = {"estimation": (-15, -6), "pre_event": (-5, -1), "terminal": (-2, -1), "announcement": (0, 1)}
_MAP = f"""WITH dn AS (SELECT day, row_number() OVER (ORDER BY day) AS n, lead(day) OVER (ORDER BY day) AS next_day FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events)),
    dm AS (SELECT day, CAST(n - (SELECT n FROM dn WHERE day = {EVENT_DAY}) AS BIGINT) AS relative_day, next_day FROM dn),
    map AS (SELECT day, relative_day, next_day, relative_day BETWEEN -15 AND -6 AS is_estimation, relative_day BETWEEN -5 AND -1 AS is_pre_event, relative_day BETWEEN -2 AND -1 AS is_terminal,
        relative_day BETWEEN 0 AND 1 AS is_announcement FROM dm WHERE relative_day BETWEEN -15 AND 1)"""
_EV = f"""{_MAP}, cell AS (SELECT user_id, event_type, map.*, count(*) AS volume, sum(value) AS premium FROM events JOIN map ON map.day = CAST(ts AS DATE) GROUP BY ALL)"""


def _map(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events", "ts").select(F.to_date("ts").alias("day"))
    return windows.date_map(days, "day", F.expr(EVENT_DAY), STUDY)


def _cells(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    e = table(spark, d, "events", "ts", "user_id", "event_type", "value").withColumn("day", F.to_date("ts"))
    m = _map(spark, d)
    return e.join(F.broadcast(m), "day").groupBy(*keys, *m.columns).agg(F.count("*").alias("volume"), F.sum("value").alias("premium"))


METRICS = [abnormal.Metric("volume", "z_volume", "log1p"), abnormal.Metric("premium", "z_premium", "log1p"), abnormal.Metric("premium", "z_plain")]
_ZSQL = """SELECT {keys}, day, relative_day, is_pre_event, is_announcement, n AS estimation_obs_count, {z} FROM (SELECT c.*, b.* EXCLUDE ({keys}) FROM cell c LEFT JOIN (SELECT {keys}, count(*) AS n,
    avg(ln(volume + 1)) AS m0, stddev_samp(ln(volume + 1)) AS s0, avg(CASE WHEN premium >= 0 THEN ln(premium + 1) END) AS m1, stddev_samp(CASE WHEN premium >= 0 THEN ln(premium + 1) END) AS s1,
    avg(premium) AS m2, stddev_samp(premium) AS s2 FROM cell WHERE relative_day BETWEEN -15 AND -6 GROUP BY {keys}) b USING ({keys}))"""
_Z = "round(CASE WHEN s0 > 1e-9 THEN (ln(volume + 1) - m0) / s0 END, 5) AS z_volume, round(CASE WHEN s1 > 1e-9 AND premium >= 0 THEN (ln(premium + 1) - m1) / s1 END, 5) AS z_premium, round(CASE WHEN s2 > 1e-9 THEN (premium - m2) / s2 END, 5) AS z_plain"


def _z(df: DataFrame, keys: list[str]) -> DataFrame:
    z = abnormal.abnormal(df, keys, "relative_day", STUDY["estimation"], METRICS, small_keys=True)
    return z.select(*keys, "day", "relative_day", "is_pre_event", "is_announcement", "estimation_obs_count", *(F.round(m.output, 5).alias(m.output) for m in METRICS))


@query(f"{_MAP} SELECT * FROM map")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The days of the event's windows with their offsets in days present."""
    return _map(spark, d)


@query(f"{_EV.replace('user_id, event_type, map', 'event_type, map')} {_ZSQL.format(keys='event_type', z=_Z)}")
def abnormal_z_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Abnormal volume and value of each event type."""
    return _z(_cells(spark, d, "event_type"), ["event_type"])


@query(f"""{_EV}, z AS ({_ZSQL.format(keys='user_id, event_type', z=_Z)}) SELECT user_id, event_type, round(avg(CASE WHEN is_pre_event THEN z_plain END), 3) AS z_plain_pre_event,
    round(avg(CASE WHEN is_announcement THEN z_plain END), 3) AS z_plain_announcement, count(DISTINCT day) AS observed_days FROM z GROUP BY ALL""")
def focal_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean z-score before and at the event of each user and event type."""
    z = _z(_cells(spark, d, "user_id", "event_type"), ["user_id", "event_type"])
    m = windows.window_means(z, ["user_id", "event_type"], ["z_plain"], ["is_pre_event", "is_announcement"], "day")
    return m.select("user_id", "event_type", *(F.round(c, 3).alias(c) for c in ("z_plain_pre_event", "z_plain_announcement")), "observed_days")


@query(f"""{_EV}, hit AS (SELECT unnest(list_filter([CASE WHEN is_pre_event THEN 'pre_event' END, CASE WHEN is_terminal THEN 'terminal' END, CASE WHEN is_announcement THEN 'announcement' END], lambda x: x IS NOT NULL)) AS w,
    event_type, volume, premium FROM cell WHERE event_type IN ('click', 'view', 'unseen')), s AS (SELECT w, coalesce(event_type, 'ALL') AS series, count(*) AS n_rows, sum(volume) AS volume, sum(premium) AS premium
    FROM hit GROUP BY GROUPING SETS ((w), (w, event_type))) SELECT f.w AS "window", g.s AS series, CAST(coalesce(n_rows, 0) AS BIGINT) AS n_rows, CAST(coalesce(volume, 0) AS BIGINT) AS volume, round(coalesce(premium, 0), 4) AS premium
    FROM (VALUES ('pre_event'), ('terminal'), ('announcement')) f(w) CROSS JOIN (VALUES ('ALL'), ('click'), ('view'), ('unseen')) g(s) LEFT JOIN s ON s.w = f.w AND s.series = g.s""")
def window_summary(spark: SparkSession, d: str) -> DataFrame:
    """Pooled and per-series sums of each window, zero where an expected series wasn't seen."""
    c = _cells(spark, d, "user_id", "event_type")
    s = windows.pooled_windows(c, "event_type", {"volume": F.col("volume"), "premium": F.col("premium")}, ["is_pre_event", "is_terminal", "is_announcement"], ["click", "view", "unseen"])
    return s.select("window", "series", "n_rows", "volume", F.round("premium", 4).alias("premium"))


@query(f"""{_EV}, r AS (SELECT user_id, relative_day, sum(premium) AS v FROM cell GROUP BY ALL), x AS (SELECT user_id, max(CASE WHEN relative_day = 0 THEN v END) AS r0, max(CASE WHEN relative_day = 1 THEN v END) AS r1
    FROM r WHERE relative_day IN (0, 1) GROUP BY 1) SELECT user_id, round(r0, 4) AS return_day0, round(CASE WHEN coalesce(r0, r1) IS NOT NULL THEN (1 + coalesce(r0, 0)) * (1 + coalesce(r1, 0)) - 1 END, 2) AS return_window FROM x""")
def announcement_returns(spark: SparkSession, d: str) -> DataFrame:
    """The value on day 0 and compounded over days 0 and 1 of each user."""
    c = _cells(spark, d, "user_id").withColumnRenamed("premium", "v")
    r = windows.window_returns(c, "user_id", "relative_day", "v")
    return r.select("user_id", F.round("return_day0", 4).alias("return_day0"), F.round("return_window", 2).alias("return_window"))


@query(f"SELECT {TENOR} AS tenor, {SIDE} AS moneyness, count(*) AS n FROM options_eod_summary GROUP BY 1, 2")
def bucket_counts(spark: SparkSession, d: str) -> DataFrame:
    """Contract-days by tenor and moneyness."""
    o = _options(spark, d, "dte_cal", "delta_1545", "option_type")
    return o.groupBy(quotes.tier("dte_cal", TENORS, "91_plus").alias("tenor"), _side().alias("moneyness")).agg(F.count("*").alias("n"))


@query(f"""SELECT quote_date, {SYM.format('underlying_symbol')} AS symbol, {TYPE} AS kind, {TENOR} AS tenor, {SIDE} AS moneyness, CAST(coalesce(sum(trade_volume), 0) AS BIGINT) AS volume,
    round(coalesce(sum(trade_volume * 100 * coalesce(vwap, mid_1545)), 0), 3) AS premium, round(sum(CASE WHEN s_1545 > 0 AND trade_volume > 0 THEN trade_volume * 100 * abs(delta_1545) * s_1545 END), 5) AS delta_notional,
    round(sum(CASE WHEN trade_volume > 0 THEN implied_volatility_1545 * trade_volume END) / nullif(sum(CASE WHEN trade_volume > 0 AND implied_volatility_1545 IS NOT NULL THEN trade_volume END), 0), 6) AS iv,
    round(sum(CASE WHEN trade_volume > 0 THEN rel_spread_1545 * trade_volume END) / nullif(sum(CASE WHEN trade_volume > 0 AND rel_spread_1545 IS NOT NULL THEN trade_volume END), 0), 6) AS spread,
    count(DISTINCT series_id) AS series, round(coalesce(sum(trade_volume), 0) / greatest(1.0, CAST(coalesce(sum(open_interest), 0) AS DOUBLE)), 6) AS vol_to_oi FROM options_eod_summary GROUP BY 1, 2, 3, 4, 5""")
def bucket_features(spark: SparkSession, d: str) -> DataFrame:
    """Sums, weighted means and ratios of each symbol, day, type, tenor and moneyness."""
    o = _options(spark, d, "quote_date", "underlying_symbol", "option_type", "dte_cal", "delta_1545", "trade_volume", "vwap", "mid_1545", "s_1545", "implied_volatility_1545", "rel_spread_1545", "series_id", "open_interest")
    o = o.withColumns({"symbol": K.symbol("underlying_symbol"), "kind": quotes.short_code("option_type", TYPES), "tenor": quotes.tier("dte_cal", TENORS, "91_plus"), "moneyness": _side()})
    v = F.col("trade_volume")
    f = buckets.bucket_features(
        o, ["quote_date", "symbol", "kind", "tenor", "moneyness"],
        sums={"volume": v, "premium": v * 100 * F.coalesce("vwap", "mid_1545")},
        guarded={"delta_notional": F.when((F.col("s_1545") > 0) & (v > 0), v * 100 * F.abs("delta_1545") * F.col("s_1545"))},
        means={"iv": (F.col("implied_volatility_1545"), v), "spread": (F.col("rel_spread_1545"), v)},
        distinct={"series": "series_id"}, ratios={"vol_to_oi": ("volume", F.col("open_interest"))},
    )
    return f.select("quote_date", "symbol", "kind", "tenor", "moneyness", "volume", F.round("premium", 3).alias("premium"), F.round("delta_notional", 5).alias("delta_notional"), F.round("iv", 6).alias("iv"), F.round("spread", 6).alias("spread"), "series", F.round("vol_to_oi", 6).alias("vol_to_oi"))


@query("""WITH cal AS (SELECT quote_date, lead(quote_date) OVER (ORDER BY quote_date) AS next_day FROM (SELECT DISTINCT quote_date FROM options_eod_summary)),
    l AS (SELECT o.row_id, o.series_id, next_day, open_interest, lead(o.quote_date) OVER w AS nq, lead(open_interest) OVER w AS no FROM options_eod_summary o JOIN cal USING (quote_date) WINDOW w AS (PARTITION BY series_id ORDER BY o.quote_date, o.row_id))
    SELECT row_id, CASE WHEN nq = next_day THEN no - open_interest END AS lead_change FROM l""")
def lead_change(spark: SparkSession, d: str) -> DataFrame:
    """Change of open interest to the next day, where the series' next row is on it."""
    o = _options(spark, d, "row_id", "series_id", "quote_date", "open_interest")
    from pyspark.sql import Window

    cal = o.select("quote_date").distinct().withColumn("next_day", F.lead("quote_date").over(Window.partitionBy(F.lit(0)).orderBy("quote_date")))
    j = o.join(F.broadcast(cal), "quote_date")
    return panel.lead_change(j, "series_id", "quote_date", "open_interest", "next_day", ["row_id"]).select("row_id", "lead_change")


@query(f"SELECT quote_date, {SYM.format('underlying_symbol')} AS symbol, CAST(sum(trade_volume) AS BIGINT) AS volume FROM options_eod_summary GROUP BY 1, 2")
def daily_volume(spark: SparkSession, d: str) -> DataFrame:
    """Option volume by symbol and day."""
    return _options(spark, d, "quote_date", "underlying_symbol", "trade_volume").groupBy("quote_date", K.symbol("underlying_symbol").alias("symbol")).agg(F.sum("trade_volume").alias("volume"))


@query(f"SELECT symbol, round(avg(CAST(volume AS DOUBLE)), 6) AS mean_volume, count(*) AS days FROM (SELECT quote_date, {SYM.format('underlying_symbol')} AS symbol, sum(trade_volume) AS volume FROM options_eod_summary GROUP BY 1, 2) GROUP BY 1")
def mean_daily_volume(spark: SparkSession, d: str) -> DataFrame:
    """Mean daily option volume of each symbol."""
    return daily_volume(spark, d).groupBy("symbol").agg(F.round(F.avg(F.col("volume").cast("double")), 6).alias("mean_volume"), F.count("*").alias("days"))


@query(f"""WITH o AS (SELECT row_id, quote_date, {SYM.format('underlying_symbol')} AS symbol, expiration, trade_volume AS v FROM options_eod_summary),
    a AS (SELECT symbol, quote_date, sum(v) AS t FROM o GROUP BY 1, 2), b AS (SELECT symbol, quote_date, expiration, sum(v) AS t FROM o GROUP BY 1, 2, 3)
    SELECT row_id, round(CASE WHEN a.t > 0 THEN v / a.t END, 6) AS of_day, round(CASE WHEN b.t > 0 THEN v / b.t END, 6) AS of_expiry FROM o JOIN a USING (symbol, quote_date) JOIN b USING (symbol, quote_date, expiration)""")
def volume_share(spark: SparkSession, d: str) -> DataFrame:
    """Each contract-day's share of its symbol's day and of its expiry."""
    o = _options(spark, d, "row_id", "quote_date", "underlying_symbol", "expiration", "trade_volume").withColumn("symbol", K.symbol("underlying_symbol"))
    s = buckets.group_share(o, "trade_volume", {"of_day": ["symbol", "quote_date"], "of_expiry": ["symbol", "quote_date", "expiration"]})
    return s.select("row_id", F.round("of_day", 6).alias("of_day"), F.round("of_expiry", 6).alias("of_expiry"))


@query("SELECT o.row_id, b.firm_id IS NOT NULL AS covered FROM options_eod_summary o LEFT JOIN (SELECT DISTINCT firm_id FROM gvkey_underlying_bridge WHERE firm_id IS NOT NULL) b ON b.firm_id = translate(upper(trim(o.underlying_symbol)), '/-', '..')")
def membership_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a row's symbol is in a list; a row that isn't, or has none, is false."""
    b = table(spark, d, "gvkey_underlying_bridge", "firm_id").where("firm_id is not null").distinct()
    o = _options(spark, d, "row_id", "underlying_symbol").withColumn("s", K.symbol("underlying_symbol"))
    return o.join(b, F.col("s") == F.col("firm_id"), "left").select("row_id", F.col("firm_id").isNotNull().alias("covered"))


def _gv(c: str) -> str:
    return f"nullif(regexp_extract(trim({c}), '^\\D*0*(\\d+)(?:\\.0*)?$', 1), '')"


_PAIRS = f"""l AS (SELECT DISTINCT link_id, {_gv('source_gvkey')} AS a, {_gv('linked_gvkey')} AS b, link_type, link_year, link_score, source_name AS na, linked_name AS nb FROM linkages),
    s AS (SELECT link_id, a, b, link_type, link_year, link_score, na, nb FROM l UNION ALL SELECT link_id, b, a, link_type, link_year, link_score, nb, na FROM l),
    p AS (SELECT a, b, link_type, link_year, max(link_score) AS link_score, arg_min(nb, link_id) FILTER (WHERE nb IS NOT NULL) AS nb FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b GROUP BY 1, 2, 3, 4)"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "linkages", "link_id", "source_gvkey", "linked_gvkey", "link_type", "link_year", "link_score", "source_name", "linked_name").distinct()
    one = raw.select("link_id", K.gvkey("source_gvkey").alias("a"), K.gvkey("linked_gvkey").alias("b"), "link_type", "link_year", "link_score", F.col("source_name").alias("na"), F.col("linked_name").alias("nb"))
    both = links.both_ways(one, {"a": "b", "na": "nb"}).where("a is not null and b is not null and a <> b")
    return links.best_pairs(both, ["a", "b", "link_type", "link_year"], "link_score", ["nb"], ["link_id"])


@query(f"WITH {_PAIRS} SELECT * FROM p")
def linkage_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Links in both directions, one row per pair, type and year with the best score and first name."""
    return _pairs(spark, d)


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a, link_type, link_year ORDER BY link_score DESC NULLS LAST, b) AS rn, count(*) OVER (PARTITION BY a, link_type, link_year) AS n FROM p)
    SELECT a, b, link_type, link_year, CASE WHEN link_score IS NOT NULL THEN rn END AS link_rank, n AS link_count, round(CASE WHEN n = 1 THEN 1.0 WHEN link_score IS NOT NULL THEN 1 - (rn - 1) / (n - 1) END, 6) AS rank_percentile FROM r""")
def linkage_rank(spark: SparkSession, d: str) -> DataFrame:
    """Ranks and rank percentiles of the links of each source, type and year."""
    r = links.ranked(_pairs(spark, d), ["a", "link_type", "link_year"], "link_score", "b")
    return r.select("a", "b", "link_type", "link_year", "link_rank", "link_count", F.round("rank_percentile", 6).alias("rank_percentile"))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY a, link_type, link_year ORDER BY link_score DESC NULLS LAST, b) AS rn FROM p)
    SELECT a, b, link_type, link_year, CASE WHEN b IN (SELECT {_gv('gvkey')} FROM gvkey_underlying_bridge WHERE bridge_confidence = 'high') THEN 'forced' WHEN link_type = 'vertical' THEN 'all' ELSE 'top' END AS kept_as FROM r
    WHERE b IN (SELECT {_gv('gvkey')} FROM gvkey_underlying_bridge WHERE bridge_confidence = 'high') OR link_type = 'vertical' OR (link_type = 'horizontal' AND link_score IS NOT NULL AND rn <= 2)""")
def related_firms(spark: SparkSession, d: str) -> DataFrame:
    """Of each source's links the best two of one type, all of the other, and those that are forced."""
    forced = table(spark, d, "gvkey_underlying_bridge", "gvkey", "bridge_confidence").where("bridge_confidence = 'high'").select(K.gvkey("gvkey").alias("b"), F.lit(True).alias("forced")).distinct()
    r = links.ranked(_pairs(spark, d), ["a", "link_type", "link_year"], "link_score", "b").join(forced, "b", "left")
    kept = links.related(r, 2, F.col("link_type") == "horizontal", F.col("link_type") == "vertical", F.coalesce("forced", F.lit(False)))
    return kept.select("a", "b", "link_type", "link_year", "kept_as")


@query(f"""WITH {_PAIRS}, f AS (SELECT DISTINCT event_year AS year, CAST(CAST(gvkey AS BIGINT) AS VARCHAR) AS firm FROM gvkey_underlying_bridge), src AS (SELECT DISTINCT a AS source, link_year AS year, link_type AS type FROM p)
    SELECT source, src.year, type, count(*) AS controls FROM src JOIN f USING (year) WHERE f.firm <> source AND NOT EXISTS (SELECT 1 FROM p WHERE p.a = source AND p.link_year = src.year AND p.link_type = type AND p.b = f.firm) GROUP BY 1, 2, 3""")
def control_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many firms each source, year and type could be compared with: not itself, not linked. None: no row."""
    p = _pairs(spark, d).select(F.col("a").alias("source"), F.col("b").alias("linked"), F.col("link_year").alias("year"), F.col("link_type").alias("type"))
    f = table(spark, d, "gvkey_underlying_bridge", "gvkey", "event_year").select(F.col("event_year").alias("year"), K.gvkey("gvkey").alias("firm"))
    return links.unlinked_counts(p.select("source", "year", "type").distinct(), f, p).where("controls > 0")


@query("""SELECT l_suppkey AS source, l_partkey AS part FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x WHERE NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_suppkey = x.l_suppkey AND y.l_partkey = x.l_partkey AND y.l_returnflag = 'R')""")
def anti_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that occur but not among those to leave out."""
    li = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_returnflag").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("part"), "l_returnflag")
    return links.without_linked(li.select("source", "part").distinct(), li.where("l_returnflag = 'R'"), ["source", "part"])


_SUP = """f AS (SELECT l_suppkey AS supplier, stddev_samp(l_discount) AS a, avg(l_quantity) AS b, CAST(count(DISTINCT l_shipdate) AS DOUBLE) AS c, avg(l_extendedprice) AS e FROM lineitem GROUP BY 1)"""
FEATURES = ["a", "b", "c", "e"]


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_suppkey", "l_discount", "l_quantity", "l_shipdate", "l_extendedprice")
    return li.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.stddev_samp("l_discount").alias("a"), F.avg("l_quantity").alias("b"), F.countDistinct("l_shipdate").cast("double").alias("c"), F.avg("l_extendedprice").alias("e"))


@query(f"""WITH {_SUP}, c AS (SELECT * FROM f WHERE supplier <> 1 AND a IS NOT NULL), s AS (SELECT stddev_samp(a) sa, stddev_samp(b) sb, stddev_samp(c) sc, stddev_samp(e) se FROM c), t AS (SELECT * FROM f WHERE supplier = 1)
    SELECT supplier, round(d, 6) AS match_distance, row_number() OVER (ORDER BY d, supplier) AS match_rank FROM (SELECT c.supplier, abs(c.a - t.a) / sa + abs(c.b - t.b) / sb + abs(c.c - t.c) / sc + abs(c.e - t.e) / se AS d FROM c, s, t) ORDER BY d, supplier LIMIT 10""")
def matched_controls(spark: SparkSession, d: str) -> DataFrame:
    """The ten suppliers most like one, by scaled distance over four features."""
    f = _suppliers(spark, d)
    n = abnormal.nearest(f.where("supplier <> 1"), f.where("supplier = 1"), "supplier", FEATURES, 10)
    return n.select("supplier", F.round("match_distance", 6).alias("match_distance"), "match_rank")


@query(f"""WITH {_SUP} SELECT 'source_benchmark' AS role, CAST(supplier AS VARCHAR) AS id, round(b, 6) AS b, CAST(NULL AS DOUBLE) AS distance FROM f WHERE supplier = 1
    UNION ALL SELECT 'other', CAST(supplier AS VARCHAR), round(b, 6), round(abs(b - (SELECT b FROM f WHERE supplier = 1)), 6) FROM f WHERE supplier <> 1""")
def comparison_table(spark: SparkSession, d: str) -> DataFrame:
    """One supplier and all others as roles of one table, in one schema."""
    f = _suppliers(spark, d)
    own = f.where("supplier = 1").select(F.lit("source_benchmark").alias("role"), F.col("supplier").alias("id"), F.round("b", 6).alias("b"))
    t = F.broadcast(f.where("supplier = 1").select(F.col("b").alias("tb")))
    other = f.where("supplier <> 1").join(t).select(F.lit("other").alias("role"), F.col("supplier").alias("id"), F.round("b", 6).alias("b"), F.round(F.abs(F.col("b") - F.col("tb")), 6).alias("distance"))
    return panel.union_aligned(own, other, schema={"role": "string", "id": "string", "b": "double", "distance": "double"})


@query("""WITH x AS (SELECT DISTINCT bridge_id, gvkey, firm_id, cik, event_year, CASE issuer_sources WHEN 'source' THEN 1 WHEN 'target' THEN 2 WHEN 'acquirer' THEN 3 ELSE 4 END AS pr FROM gvkey_underlying_bridge),
    y AS (SELECT * FROM x QUALIFY rank() OVER (PARTITION BY firm_id, event_year ORDER BY pr) = 1), g AS (SELECT firm_id, event_year FROM y GROUP BY 1, 2 HAVING count(DISTINCT gvkey) + max(CASE WHEN gvkey IS NULL THEN 1 ELSE 0 END) = 1),
    z AS (SELECT y.* FROM y JOIN g USING (firm_id, event_year)), h AS (SELECT gvkey, event_year FROM z GROUP BY 1, 2 HAVING count(DISTINCT firm_id) = 1) SELECT bridge_id, z.gvkey, firm_id, event_year FROM z JOIN h USING (gvkey, event_year)""")
def bridge_unique(spark: SparkSession, d: str) -> DataFrame:
    """Bridge rows of the best evidence whose firm has one gvkey in the year, and whose gvkey has one firm."""
    b = table(spark, d, "gvkey_underlying_bridge", "bridge_id", "gvkey", "firm_id", "cik", "event_year", "issuer_sources").distinct()
    pr = F.coalesce(F.create_map(*[F.lit(x) for kv in {"source": 1, "target": 2, "acquirer": 3}.items() for x in kv])[F.col("issuer_sources")], F.lit(4))
    best = links.best_priority(b, ["firm_id", "event_year"], pr)
    one = links.one_to_one(links.one_to_one(best, ["firm_id", "event_year"], "gvkey"), ["gvkey", "event_year"], "firm_id")
    return one.select("bridge_id", "gvkey", "firm_id", "event_year").distinct()


@query("""SELECT gvkey, firm_id, min(observed_start_date) AS first_day, max(observed_end_date) AS last_day, CAST(max(option_obs_count) AS BIGINT) AS most, arg_min(issuer_ticker, bridge_id) FILTER (WHERE issuer_ticker IS NOT NULL) AS ticker,
    array_to_string(list_sort(list(DISTINCT bridge_method)), ';') AS methods, coalesce(bool_or(starts_with(bridge_method, 'seed')), false) AS seeded FROM gvkey_underlying_bridge GROUP BY 1, 2""")
def bridge_collapse(spark: SparkSession, d: str) -> DataFrame:
    """One row per gvkey and firm: spans, counts, first ticker, joined methods."""
    b = table(spark, d, "gvkey_underlying_bridge")
    return b.groupBy("gvkey", "firm_id").agg(
        F.min("observed_start_date").alias("first_day"), F.max("observed_end_date").alias("last_day"), F.max("option_obs_count").alias("most"),
        panel.first_present("issuer_ticker", F.struct("bridge_id")).alias("ticker"),
        F.array_join(F.array_sort(F.collect_set("bridge_method")), ";").alias("methods"), F.coalesce(F.bool_or(F.col("bridge_method").startswith("seed")), F.lit(False)).alias("seeded"),
    )


@query("""WITH b AS (SELECT DISTINCT bridge_id, firm_id, observed_start_date AS s, observed_end_date AS e FROM gvkey_underlying_bridge), o AS (SELECT translate(upper(trim(underlying_symbol)), '/-', '..') AS firm_id, year(quote_date) AS y,
    min(quote_date) AS lo, max(quote_date) AS hi FROM options_eod_summary GROUP BY 1, 2) SELECT bridge_id, CAST(y AS BIGINT) AS seen_year FROM b JOIN o USING (firm_id) WHERE s <= hi AND coalesce(e, lo) >= lo""")
def bridge_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Bridge rows with the years in which their firm's options were seen while they held."""
    b = table(spark, d, "gvkey_underlying_bridge", "bridge_id", "firm_id", "observed_start_date", "observed_end_date").distinct()
    o = _options(spark, d, "underlying_symbol", "quote_date").groupBy(K.symbol("underlying_symbol").alias("firm_id"), F.year("quote_date").cast("bigint").alias("seen_year")).agg(F.min("quote_date").alias("lo"), F.max("quote_date").alias("hi"))
    return links.overlapping(b, o, ["firm_id"], ("observed_start_date", "observed_end_date", "lo", "hi")).select("bridge_id", "seen_year")


@query("""SELECT link_id, 'source' AS role, source_firm_id AS firm, source_ticker AS ticker FROM (SELECT DISTINCT link_id, source_firm_id, source_ticker FROM linkages)
    UNION ALL SELECT link_id, 'linked', linked_firm_id, linked_ticker FROM (SELECT DISTINCT link_id, source_firm_id, source_ticker, linked_firm_id, linked_ticker FROM linkages)""")
def evidence_unpivot(spark: SparkSession, d: str) -> DataFrame:
    """The two sides of each link as rows."""
    x = table(spark, d, "linkages", "link_id", "source_firm_id", "source_ticker", "linked_firm_id", "linked_ticker").distinct()
    return links.unpivot_roles(x, ["link_id"], {"source": {"firm": "source_firm_id", "ticker": "source_ticker"}, "linked": {"firm": "linked_firm_id", "ticker": "linked_ticker"}})


@query("""SELECT party_id, translate(upper(trim(ticker)), '/-', '..') AS ticker, CASE WHEN regexp_replace(cik, '\\D', '', 'g') <> '' THEN lpad(ltrim(regexp_replace(cik, '\\D', '', 'g'), '0'), 10, '0') END AS cik FROM deal_party""")
def key_norm(spark: SparkSession, d: str) -> DataFrame:
    """Tickers and numbers in one notation."""
    return table(spark, d, "deal_party", "party_id", "ticker", "cik").select("party_id", K.symbol("ticker").alias("ticker"), K.cik10("cik").alias("cik"))


@query("""SELECT party_id, nullif(array_to_string(list_slice(list_filter(string_split(trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ('inc','corp','corporation','co','company','ltd','limited','plc','holdings','group','llc','lp','incorporated')), 1, 8), '_'), '') AS slug FROM deal_party""")
def company_slug(spark: SparkSession, d: str) -> DataFrame:
    """Names as slugs without legal words."""
    return table(spark, d, "deal_party", "party_id", "name").select("party_id", K.slug("name").alias("slug"))


@query(r"""SELECT doc_id, trim(regexp_replace(text || ' &"', '[\s\x0b\x{00A0}]+', ' ', 'g')) AS plain FROM documents""")
def html_to_text(spark: SparkSession, d: str) -> DataFrame:
    """Every text escaped and wrapped in markup, and taken out of it again: itself with its white space collapsed."""
    t = table(spark, d, "documents", "doc_id", "text")
    escaped = F.col("text")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(entity))
    html = F.concat(F.lit('<head><script>var x = 1;</script></head><p class="t">'), escaped, F.lit("</p>&amp;&quot;<br/>"))
    return t.select("doc_id", markup.plain_text(html).alias("plain"))


@query()
def html_to_text_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document out of whatever markup it holds itself."""
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", markup.plain_text("text").alias("plain"))


# Labels and weights of the classifier below; patterns are a parameter of it.
LABELS = {"merger agreement": "merger agreement", "tender": "tender(?:ed)?", "to be acquired by": "to be acquired by", "will pay": "will pay", "record date": "record date"}
WEIGHTS = {"merger agreement": 2, "tender": 2, "to be acquired by": 2, "will pay": 1, "record date": -3}


def _label_sql(text: str = "coalesce(text, '')") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '(?i)\\b(?:{p})\\b') THEN '{n}' END" for n, p in LABELS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH h AS (SELECT doc_id, {_label_sql()} AS hits FROM documents) SELECT doc_id, array_to_string(hits, ';') AS labels, CAST(list_sum(list_transform(hits, lambda x: CASE x WHEN 'will pay' THEN 1 WHEN 'record date' THEN -3 ELSE 2 END)) AS BIGINT) AS score FROM h WHERE len(hits) > 0""")
def keyword_classify(spark: SparkSession, d: str) -> DataFrame:
    """Labels that occur in each document and their score."""
    h = table(spark, d, "documents", "doc_id", "text").select("doc_id", markup.label_hits("text", LABELS).alias("hits")).where(F.size("hits") > 0)
    return h.select("doc_id", F.array_join("hits", ";").alias("labels"), markup.label_score(F.col("hits"), WEIGHTS).cast("bigint").alias("score"))


@query(r"""SELECT doc_id, substr(text, greatest(length(h) - 40, 0) + 1, length(h) - greatest(length(h) - 40, 0) + 80) AS excerpt FROM (SELECT doc_id, text, regexp_extract(text, '(?is)^(.*?)\b(?:merger agreement)\b', 1) AS h FROM documents WHERE regexp_matches(text, '(?i)\b(?:merger agreement)\b'))""")
def keyword_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """The surroundings of a label's first occurrence."""
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", markup.excerpt("text", {"m": "merger agreement"}, 40, 80).alias("excerpt"))
    return t.where("excerpt is not null")


PARTY = (r"([A-Z][\w.& ]+?) said on [\w ]+ that it had signed a definitive agreement to be acquired by ([A-Z][\w.& ]+?) for",)
STOPS = ("for", "under", "pursuant", "through", "dated", "and", "at", "by and among", "upon", "to form", "for cash")


@query(r"""SELECT doc_id, a AS first, b AS second FROM (SELECT doc_id, trim(regexp_replace(CASE WHEN regexp_matches(x, '(?i)\b(?:for|under|pursuant|through|dated|and|at|by and among|upon|to form|for cash)\b') THEN regexp_extract(x, '(?is)^(.*?)\b(?:for|under|pursuant|through|dated|and|at|by and among|upon|to form|for cash)\b', 1) ELSE x END, '\s+', ' ', 'g'), ' ,.;:-') AS a, trim(regexp_replace(CASE WHEN regexp_matches(y, '(?i)\b(?:for|under|pursuant|through|dated|and|at|by and among|upon|to form|for cash)\b') THEN regexp_extract(y, '(?is)^(.*?)\b(?:for|under|pursuant|through|dated|and|at|by and among|upon|to form|for cash)\b', 1) ELSE y END, '\s+', ' ', 'g'), ' ,.;:-') AS b FROM (SELECT doc_id, regexp_extract(text, '([A-Z][\w.& ]+?) said on [\w ]+ that it had signed a definitive agreement to be acquired by ([A-Z][\w.& ]+?) for', 1) AS x,
    regexp_extract(text, '([A-Z][\w.& ]+?) said on [\w ]+ that it had signed a definitive agreement to be acquired by ([A-Z][\w.& ]+?) for', 2) AS y FROM documents)) WHERE a <> '' AND b <> '' AND len(string_split(a, ' ')) <= 12 AND len(string_split(b, ' ')) <= 12""")
def party_capture(spark: SparkSession, d: str) -> DataFrame:
    """The two parties a document names, where both captures are names."""
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", markup.parties("text", PARTY, STOPS).alias("p"))
    return t.where("p is not null").select("doc_id", "p.first", "p.second")


@query("""SELECT k AS key, min(cik) AS cik, min(name) AS name FROM (SELECT DISTINCT lower(ticker) AS k, lpad(ltrim(cik, '0'), 10, '0') AS cik, name FROM company_lookup WHERE ticker IS NOT NULL) GROUP BY 1 HAVING count(*) = 1""")
def lookup_unique(spark: SparkSession, d: str) -> DataFrame:
    """Tickers that name one company only, with it."""
    c = table(spark, d, "company_lookup", "ticker", "cik", "name").select(F.lower("ticker").alias("key"), K.cik10("cik").alias("cik"), "name")
    return entities.unique_lookup(c, "key", ["cik", "name"])


@query("""WITH c AS (SELECT DISTINCT lpad(ltrim(cik, '0'), 10, '0') AS cik, name, translate(upper(trim(ticker)), '/-', '..') AS t FROM company_lookup), bc AS (SELECT cik, min(name) AS name FROM c GROUP BY 1 HAVING count(DISTINCT name) = 1),
    bt AS (SELECT t, min(name) AS name FROM c WHERE t IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) = 1), p AS (SELECT party_id, CASE WHEN regexp_replace(cik, '\\D', '', 'g') <> '' THEN lpad(ltrim(regexp_replace(cik, '\\D', '', 'g'), '0'), 10, '0') END AS cik, translate(upper(trim(ticker)), '/-', '..') AS t FROM deal_party)
    SELECT party_id, CASE WHEN p.cik IS NOT NULL THEN bc.name WHEN p.t IS NOT NULL THEN bt.name END AS identity FROM p LEFT JOIN bc USING (cik) LEFT JOIN bt ON bt.t = p.t""")
def identity_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The listed name of each party by its number, else its ticker; a number that misses stays a miss."""
    c = table(spark, d, "company_lookup", "cik", "name", "ticker").select(K.cik10("cik").alias("cik"), "name", K.symbol("ticker").alias("t"))
    p = table(spark, d, "deal_party", "party_id", "cik", "ticker").select("party_id", K.cik10("cik").alias("cik"), K.symbol("ticker").alias("t"))
    got = entities.identify(p, [("cik", entities.unique_lookup(c, "cik", ["name"]), "name"), ("t", entities.unique_lookup(c, "t", ["name"]), "name")], "identity")
    return got.select("party_id", "identity")


@query("""WITH e AS (SELECT underlying_symbol AS q, matched_company_name AS c, support_score AS s FROM matched_company UNION ALL SELECT source_ticker, source_name, CAST(round(100 * link_score) AS BIGINT) FROM linkages WHERE source_ticker IS NOT NULL AND link_score IS NOT NULL),
    c AS (SELECT q, c, max(s) AS score, count(*) AS hits, count(*) FILTER (WHERE s >= 90) AS strong FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, strong DESC, hits DESC, c) AS rn FROM c),
    p AS (SELECT a.q, a.c, a.score, a.hits, a.strong, b.score AS s2, b.hits AS h2, b.strong AS t2 FROM r a LEFT JOIN r b ON b.q = a.q AND b.rn = 2 WHERE a.rn = 1)
    SELECT q AS query, c AS candidate, score, hits FROM p WHERE NOT coalesce(NOT (score >= s2 + 10 OR strong >= t2 + 2 OR hits >= greatest(2, 2 * h2)) AND s2 >= score - 5 AND t2 >= greatest(0, strong - 1) AND h2 >= greatest(1, floor(0.75 * hits)), false)""")
def candidate_select(spark: SparkSession, d: str) -> DataFrame:
    """For each symbol the name with the best evidence, unless another is too close."""
    m = table(spark, d, "matched_company").select(F.col("underlying_symbol").alias("query"), F.col("matched_company_name").alias("candidate"), F.col("support_score").alias("s"))
    x = table(spark, d, "linkages").where("source_ticker is not null and link_score is not null").select(F.col("source_ticker").alias("query"), F.col("source_name").alias("candidate"), F.round(100 * F.col("link_score")).cast("bigint").alias("s"))
    e = m.unionAll(x).withColumn("n", F.col("candidate"))
    return entities.clear_winner(e, "query", "candidate", "s", "n").select("query", "candidate", "score", "hits")


_FITS = """list_filter(generate_series(1, len(cl)), lambda i: CASE WHEN n.party IS NOT NULL AND len(cl[i].parties) > 0
    THEN list_contains(cl[i].parties, n.party) AND n.day - cl[i].last <= 3 ELSE n.day - cl[i].last <= 1 END)"""


@query(f"""WITH RECURSIVE rows AS (SELECT user_id, ts, CAST(ts AS DATE) AS day, CASE WHEN event_type <> 'view' THEN event_type END AS party, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    f AS (
        SELECT user_id, rn, ts, day, party, CAST(1 AS BIGINT) AS hit, [{{'last': day, 'parties': CASE WHEN party IS NULL THEN CAST([] AS VARCHAR[]) ELSE [party] END}}] AS cl FROM rows WHERE rn = 1
        UNION ALL SELECT user_id, rn, ts, day, party, hit, CASE WHEN hit > len(cl) THEN list_append(cl, {{'last': day, 'parties': CASE WHEN party IS NULL THEN CAST([] AS VARCHAR[]) ELSE [party] END}})
            ELSE list_transform(cl, lambda c, i: CASE WHEN i = hit THEN {{'last': greatest(c.last, day), 'parties': CASE WHEN party IS NULL OR list_contains(c.parties, party) THEN c.parties ELSE list_append(c.parties, party) END}} ELSE c END) END
        FROM (SELECT n.user_id, n.rn, n.ts, n.day, n.party, cl, coalesce(list_max({_FITS}), len(cl) + 1) AS hit FROM f JOIN rows n ON n.user_id = f.user_id AND n.rn = f.rn + 1)),
    c AS (SELECT user_id, hit, min(rn) AS rn, arg_min(ts, rn) AS first_at, max(day) AS last_day, count(*) AS n_rows, coalesce(array_to_string(list_sort(list(DISTINCT party) FILTER (WHERE party IS NOT NULL)), ';'), '') AS parties FROM f GROUP BY 1, 2)
    SELECT user_id, first_at, last_day, n_rows, parties, row_number() OVER (ORDER BY user_id, rn) AS event_index FROM c""")
def event_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user folded into clusters by type and time."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    party = F.when(F.col("event_type") != "view", F.col("event_type"))
    return clusters.cluster_events(e.withColumn("party", party), "user_id", "ts", "event_id", "party", long_gap=3, short_gap=1)


def _calendar_sql() -> str:
    days = ", ".join(f"DATE '{x}'" for x in calendar.trading_days(2000, 2035))
    return f"""WITH t AS (SELECT unnest([{days}]) AS d), e AS (SELECT DISTINCT event_id, event_trading_date AS x, during_market_hours AS m FROM event_alignment),
        s AS (SELECT event_id, CAST(x AS TIMESTAMP) + CASE WHEN m THEN INTERVAL 12 HOUR ELSE INTERVAL 17 HOUR END AS local FROM e)
        SELECT event_id, CASE WHEN CAST(local AS TIME) >= TIME '16:00:00' AND CAST(local AS DATE) IN (SELECT d FROM t) THEN (SELECT min(d) FROM t WHERE d > CAST(local AS DATE)) ELSE (SELECT min(d) FROM t WHERE d >= CAST(local AS DATE)) END AS trading_date,
        (SELECT max(d) FROM t WHERE d < CASE WHEN CAST(local AS TIME) >= TIME '16:00:00' AND CAST(local AS DATE) IN (SELECT d FROM t) THEN (SELECT min(d) FROM t WHERE d > CAST(local AS DATE)) ELSE (SELECT min(d) FROM t WHERE d >= CAST(local AS DATE)) END) AS pre_event_end FROM s"""


@query(_calendar_sql())
def calendar_align(spark: SparkSession, d: str) -> DataFrame:
    """Local stamps to trading dates: before the close the same day, else the next."""
    e = table(spark, d, "event_alignment", "event_id", "event_trading_date", "during_market_hours").distinct()
    local = F.col("event_trading_date").cast("timestamp_ntz") + F.when(F.col("during_market_hours"), F.expr("INTERVAL '12' HOUR")).otherwise(F.expr("INTERVAL '17' HOUR"))
    first, last = e.agg(F.min(F.year("event_trading_date")), F.max(F.year("event_trading_date"))).first()
    # A year on either side, for days before the first and after the last event.
    return calendar.align(e.withColumn("local", local), calendar.calendar(spark, (first or 2000) - 1, (last or 2000) + 1), F.col("local")).select("event_id", "trading_date", "pre_event_end")


@query("""WITH p AS (SELECT count(*) AS rows, count(*) - count(DISTINCT (quote_date, series_id)) AS dup, count(*) FILTER (WHERE bid_1545 IS NULL) AS bn, count(*) FILTER (WHERE delta_1545 IS NULL) AS dn, count(DISTINCT bid_1545) AS bd, count(DISTINCT delta_1545) AS dd FROM options_eod_summary)
    SELECT unnest(['rows', 'bid_1545_nulls', 'delta_1545_nulls', 'bid_1545_distinct', 'delta_1545_distinct', 'duplicate_rows']) AS metric, CAST(unnest([rows, bn, dn, bd, dd, dup]) AS BIGINT) AS value FROM p""")
def qc_frame(spark: SparkSession, d: str) -> DataFrame:
    """Rows, repeated contract-days, nulls and distinct values in one pass."""
    return quality.profile(_options(spark, d, "quote_date", "series_id", "bid_1545", "delta_1545"), ["quote_date", "series_id"], ["bid_1545", "delta_1545"])


@query("""WITH r AS (SELECT source_archive, min(quote_date) AS day, count(*) AS n, count(DISTINCT series_id) AS series FROM options_eod_summary GROUP BY 1) SELECT day, count(*) AS files, CAST(sum(n) AS BIGINT) AS n, CAST(sum(series) AS BIGINT) AS series FROM r GROUP BY 1""")
def qc_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Reports of the archives rolled up by day."""
    r = _options(spark, d, "source_archive", "quote_date", "series_id").groupBy("source_archive").agg(F.min("quote_date").alias("day"), F.count("*").alias("n"), F.countDistinct("series_id").alias("series"))
    return quality.roll_up(r, "day", ["n", "series"])


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def topk(spark: SparkSession, d: str) -> DataFrame:
    """The three largest orders of each customer."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return panel.top_k(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT series_id, quote_date, arg_max(row_id, ingested_at) AS row_id, arg_max(bid_1545, (ingested_at, row_id)) AS bid_1545 FROM (SELECT series_id, quote_date, row_id, ingested_at, coalesce(bid_1545, -9) AS bid_1545 FROM options_eod_summary) GROUP BY 1, 2")
def last_delivery(spark: SparkSession, d: str) -> DataFrame:
    """Of contract-days delivered again the last delivery."""
    o = _options(spark, d, "series_id", "quote_date", "row_id", "ingested_at", "bid_1545").withColumn("bid_1545", F.coalesce("bid_1545", F.lit(-9.0)))
    return panel.last_wins(o, ["series_id", "quote_date"], ["ingested_at", "row_id"]).drop("ingested_at")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders), h AS (SELECT DISTINCT o_custkey FROM x WHERE o_orderpriority = '1-URGENT') SELECT o_custkey, o_orderkey FROM x WHERE o_orderpriority = '1-URGENT' OR o_custkey NOT IN (SELECT o_custkey FROM h)""")
def narrow_conditionally(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer the urgent orders, or all of them if none is."""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderpriority")
    return panel.narrow_if_any(o, F.col("o_orderpriority") == "1-URGENT", ["o_custkey"]).select("o_custkey", "o_orderkey")


@query("SELECT user_id, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_parallel_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Rows from structs of parallel arrays, as filing indexes come, and a number out of their JSON."""
    from tidemark.sources.json_tables import rows_of_arrays

    e = table(spark, d, "events", "user_id", "event_id", "event_type", "props")
    # Pages of a thousand ids, as an index comes in shards: no array grows with a user's rows.
    page = F.floor(F.col("event_id") / 1000).alias("page")
    packed = e.groupBy("user_id", page).agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type", "props"))).alias("r")).select("user_id", F.struct(*(F.col(f"r.{c}").alias(c) for c in ("event_id", "event_type", "props"))).alias("recent"))
    rows = rows_of_arrays(packed, "recent", ["event_id", "event_type", "props"], ["user_id"])
    return rows.select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
