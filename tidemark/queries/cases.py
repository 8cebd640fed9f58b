"""Queries of the option rows of one event, end to end over the domain tables, each with its SQL.

The event of these queries is made of the data: the symbol with the most rows is the focal
one, the middle of its quote dates that the daily table has is the event's day, its three calls of most volume in the
windows are the listed contracts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import abnormal, links, options, panel, windows
from tidemark.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
SPANS = {"estimation": (-15, -6), "pre_event": (-5, -1), "terminal": (-2, -1), "announcement": (0, 1)}


def query(sql: str):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_TYPE = "CASE upper(trim(option_type)) WHEN 'CALL' THEN 'C' WHEN 'PUT' THEN 'P' ELSE upper(trim(option_type)) END"
_OK = "coalesce({0} > 0 AND {1} > 0 AND {1} >= {0}, false)"
_Q, _U = _OK.format("bid_1545", "ask_1545"), _OK.format("underlying_bid_1545", "underlying_ask_1545")
_FRAME = f"""frame AS (
    SELECT row_id, quote_date, expiration, trade_volume, open_interest, vwap, delta_1545, implied_volatility_1545, ingested_at, upper(trim(underlying_symbol)) AS underlying_symbol, upper(trim(root)) AS root, {_TYPE} AS option_type,
        {_Q} AS has_valid_1545_quote, {_U} AS has_valid_underlying_1545_quote, CASE WHEN {_Q} THEN (bid_1545 + ask_1545) / 2 END AS mid_1545,
        CASE WHEN {_Q} THEN (ask_1545 - bid_1545) / ((bid_1545 + ask_1545) / 2) END AS rel_spread_1545,
        CASE WHEN {_U} THEN (underlying_bid_1545 + underlying_ask_1545) / 2 WHEN active_underlying_price_1545 > 0 THEN active_underlying_price_1545 END AS s_1545,
        (implied_underlying_price_1545 IS NOT NULL OR active_underlying_price_1545 IS NOT NULL OR implied_volatility_1545 IS NOT NULL OR delta_1545 IS NOT NULL) AS has_calcs,
        CAST(date_diff('day', quote_date, expiration) AS BIGINT) AS dte_cal,
        upper(trim(underlying_symbol)) || '|' || upper(trim(root)) || '|' || CAST(expiration AS VARCHAR) || '|' || CAST(round(strike, 4) AS VARCHAR) || '|' || {_TYPE} AS series_id
    FROM options_eod_summary)"""
_CASE = f"""{_FRAME},
    focal AS (SELECT underlying_symbol AS f FROM frame WHERE underlying_symbol IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    fd AS (SELECT quote_date, row_number() OVER (ORDER BY quote_date) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT quote_date FROM frame WHERE underlying_symbol = (SELECT f FROM focal) AND quote_date IN (SELECT quote_date FROM underlying_daily))),
    dn AS (SELECT d, row_number() OVER (ORDER BY d) AS n, lead(d) OVER (ORDER BY d) AS next_day FROM (SELECT DISTINCT quote_date AS d FROM underlying_daily WHERE quote_date IS NOT NULL)),
    map AS (SELECT d AS quote_date, CAST(n - (SELECT n FROM dn WHERE d = (SELECT quote_date FROM fd WHERE rn = n // 2 + 1)) AS BIGINT) AS relative_day, next_day FROM dn),
    win AS (SELECT frame.*, relative_day, next_day FROM frame JOIN map USING (quote_date) WHERE relative_day BETWEEN -15 AND 1),
    listed AS (SELECT series_id FROM win WHERE underlying_symbol = (SELECT f FROM focal) AND option_type = 'C' AND series_id IS NOT NULL GROUP BY 1 ORDER BY coalesce(sum(trade_volume), 0) DESC, 1 LIMIT 3),
    rows AS (SELECT *, CASE WHEN lead(quote_date) OVER w = next_day THEN lead(open_interest) OVER w - open_interest END AS lead_open_interest_change,
            coalesce(underlying_symbol = (SELECT f FROM focal), false) AS is_focal, coalesce(series_id IN (SELECT series_id FROM listed), false) AS is_listed, trade_volume * 100 * coalesce(vwap, mid_1545) AS premium,
            CASE WHEN dte_cal <= 7 THEN '0_7' WHEN dte_cal <= 30 THEN '8_30' WHEN dte_cal <= 90 THEN '31_90' ELSE '91_plus' END AS tenor,
            CASE WHEN option_type = 'C' AND delta_1545 BETWEEN 0.10 AND 0.40 THEN 'call_otm' WHEN option_type = 'C' AND delta_1545 > 0.40 AND delta_1545 < 0.60 THEN 'call_atm'
                WHEN option_type = 'P' AND delta_1545 BETWEEN -0.40 AND -0.10 THEN 'put_otm' WHEN option_type = 'P' AND delta_1545 > -0.60 AND delta_1545 < -0.40 THEN 'put_atm' ELSE 'other' END AS moneyness
        FROM win WINDOW w AS (PARTITION BY series_id ORDER BY quote_date, ingested_at, row_id))"""
_CONTRACTS = f"""{_CASE},
    day_calls AS (SELECT underlying_symbol, quote_date, coalesce(sum(trade_volume), 0) AS call_volume FROM rows WHERE option_type = 'C' GROUP BY 1, 2),
    exp_calls AS (SELECT underlying_symbol, quote_date, expiration, coalesce(sum(trade_volume), 0) AS expiry_call_volume FROM rows WHERE option_type = 'C' GROUP BY 1, 2, 3),
    contracts AS (SELECT rows.*, call_volume, expiry_call_volume FROM rows LEFT JOIN day_calls USING (underlying_symbol, quote_date) LEFT JOIN exp_calls USING (underlying_symbol, quote_date, expiration) WHERE is_listed)"""


def _frame(spark: SparkSession, d: str) -> DataFrame:
    return options.option_frame(table(spark, d, "options_eod_summary"))


def _days(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "underlying_daily", "quote_date").distinct()


def _case(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    """Frame, date map and focal symbol; of the data one symbol and its middle day reach the driver."""
    f = _frame(spark, d)
    focal = f.where("underlying_symbol is not null").groupBy("underlying_symbol").count().orderBy(F.desc("count"), "underlying_symbol").first()[0]
    days = f.where(F.col("underlying_symbol") == focal).select("quote_date").distinct().join(_days(spark, d), "quote_date", "left_semi")
    n = days.count()
    event = days.orderBy("quote_date").limit(n // 2 + 1).agg(F.max("quote_date")).first()[0]
    return f, windows.date_map(_days(spark, d), "quote_date", F.lit(event), SPANS), focal


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    f, days, focal = _case(spark, d)
    volume = F.coalesce(F.sum("trade_volume"), F.lit(0)).alias("v")
    own = f.join(F.broadcast(days.select("quote_date")), "quote_date", "left_semi").where((F.col("underlying_symbol") == focal) & (F.col("option_type") == "C") & F.col("series_id").isNotNull())
    listed = own.groupBy("series_id").agg(volume).orderBy(F.desc("v"), "series_id").limit(3)
    return options.enriched(f, days, listed, focal, order=("ingested_at", "row_id"))


@query(f"""WITH {_FRAME} SELECT row_id, underlying_symbol, root, option_type, has_valid_1545_quote, has_valid_underlying_1545_quote, round(mid_1545, 6) AS mid_1545, round(rel_spread_1545, 6) AS rel_spread_1545,
    round(s_1545, 6) AS s_1545, has_calcs, dte_cal, series_id, false AS has_valid_eod_quote, CAST(NULL AS DOUBLE) AS mid_eod FROM frame""")
def option_frame(spark: SparkSession, d: str) -> DataFrame:
    """Contract-days in one notation with all that follows from their quotes; sides that the table lacks are null."""
    r = lambda c: F.round(c, 6).alias(c)
    return _frame(spark, d).select("row_id", "underlying_symbol", "root", "option_type", "has_valid_1545_quote", "has_valid_underlying_1545_quote", r("mid_1545"), r("rel_spread_1545"), r("s_1545"), "has_calcs", "dte_cal", "series_id", "has_valid_eod_quote", "mid_eod")


_DAY_FIRST = ", ".join(f"arg_min({c}, row_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("underlying_bid_1545", "underlying_ask_1545", "s_1545", "implied_underlying_price_1545", "active_underlying_price_1545"))
_DAY_N = ", ".join(f"count(DISTINCT {c}) AS {c}_n, count(DISTINCT {c}) > 1 AS {c}_inconsistent" for c in ("underlying_bid_1545", "underlying_ask_1545", "s_1545"))


@query(f"""WITH {_FRAME}, o AS (SELECT row_id, frame.quote_date, frame.underlying_symbol, frame.s_1545, has_valid_underlying_1545_quote, r.underlying_bid_1545, r.underlying_ask_1545, r.implied_underlying_price_1545, r.active_underlying_price_1545
        FROM frame JOIN (SELECT row_id, underlying_bid_1545, underlying_ask_1545, implied_underlying_price_1545, active_underlying_price_1545 FROM options_eod_summary) r USING (row_id))
    SELECT quote_date, underlying_symbol, count(*) AS option_series_count, {_DAY_FIRST}, coalesce(bool_or(has_valid_underlying_1545_quote), false) AS has_valid_underlying_1545_quote, {_DAY_N},
        count(DISTINCT {{'a': underlying_bid_1545, 'b': underlying_ask_1545}}) AS snapshot_1545_n, count(DISTINCT {{'a': underlying_bid_1545, 'b': underlying_ask_1545}}) > 1 AS snapshot_1545_inconsistent, CAST(NULL AS DOUBLE) AS s_eod, CAST(1 AS BIGINT) AS snapshot_eod_n
    FROM o GROUP BY 1, 2""")
def firm_days(spark: SparkSession, d: str) -> DataFrame:
    """Firms' days with first prices, validity and whether the day's rows agree."""
    f = options.firm_days(_frame(spark, d), ["row_id"])
    return f.drop(*(c for c in f.columns if "_eod" in c and c not in ("s_eod", "snapshot_eod_n")), "s_eod_n", "s_eod_inconsistent")


@query(f"""WITH {_CASE} SELECT row_id, quote_date, underlying_symbol FROM frame WHERE underlying_symbol = (SELECT f FROM focal) AND quote_date IN (SELECT quote_date FROM map WHERE relative_day BETWEEN -15 AND 1)""")
def option_slice(spark: SparkSession, d: str) -> DataFrame:
    """The focal symbol's rows on the days of the windows."""
    f, days, focal = _case(spark, d)
    return options.option_slice(f, [focal], [r[0] for r in days.select("quote_date").collect()]).select("row_id", "quote_date", "underlying_symbol")


@query(f"""WITH {_CASE} SELECT row_id, relative_day, lead_open_interest_change, is_focal, is_listed, round(premium, 4) AS premium, tenor, moneyness,
    relative_day BETWEEN -5 AND -1 AS is_pre_event, relative_day BETWEEN -2 AND -1 AS is_terminal, relative_day BETWEEN 0 AND 1 AS is_announcement FROM rows""")
def enriched_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the windows with offsets, flags, change of open interest, premium and buckets."""
    return _enriched(spark, d).select("row_id", "relative_day", "lead_open_interest_change", "is_focal", "is_listed", F.round("premium", 4).alias("premium"), "tenor", "moneyness", "is_pre_event", "is_terminal", "is_announcement")


@query(f"""WITH {_CONTRACTS} SELECT row_id, series_id, trade_volume, CAST(call_volume AS BIGINT) AS call_volume, CAST(expiry_call_volume AS BIGINT) AS expiry_call_volume,
    round(CASE WHEN call_volume > 0 THEN trade_volume / call_volume END, 8) AS share_of_call_volume, round(CASE WHEN expiry_call_volume > 0 THEN trade_volume / expiry_call_volume END, 8) AS share_of_expiry_call_volume FROM contracts""")
def contract_features(spark: SparkSession, d: str) -> DataFrame:
    """The listed contracts' rows with their shares of all calls of the day and of their expiry."""
    c = options.contract_features(_enriched(spark, d))
    return c.select("row_id", "series_id", "trade_volume", "call_volume", "expiry_call_volume", F.round("share_of_call_volume", 8).alias("share_of_call_volume"), F.round("share_of_expiry_call_volume", 8).alias("share_of_expiry_call_volume"))


@query(f"""WITH {_CONTRACTS}, g AS (SELECT relative_day BETWEEN -5 AND -1 AS is_pre_event, underlying_symbol, quote_date, coalesce(sum(trade_volume), 0) AS v, any_value(call_volume) AS t FROM contracts GROUP BY 1, 2, 3)
    SELECT is_pre_event, round(sum(v) FILTER (WHERE t > 0) / sum(t) FILTER (WHERE t > 0), 8) AS share FROM g GROUP BY 1""")
def pooled_share(spark: SparkSession, d: str) -> DataFrame:
    """The listed contracts' share of all calls, pooled over the days before the event and over the others."""
    c = options.contract_features(_enriched(spark, d))
    return options.pooled_share(c, ["is_pre_event"], ["underlying_symbol", "quote_date"], "trade_volume", "call_volume", F.struct("row_id")).select("is_pre_event", F.round("share", 8).alias("share"))


@query(f"""WITH {_CONTRACTS} SELECT series_id, CAST(coalesce(sum(trade_volume), 0) AS BIGINT) AS volume, round(coalesce(sum(premium), 0), 3) AS premium,
    CAST(coalesce(sum(lead_open_interest_change), 0) AS BIGINT) AS open_interest_change, count(*) AS n_rows FROM contracts GROUP BY 1""")
def contract_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Sums of each listed contract over the windows."""
    c = options.contract_features(_enriched(spark, d))
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return c.groupBy("series_id").agg(zero("trade_volume").alias("volume"), F.round(zero("premium"), 3).alias("premium"), zero("lead_open_interest_change").alias("open_interest_change"), F.count("*").alias("n_rows"))


@query(f"""WITH {_CASE}, cell AS (SELECT underlying_symbol, option_type, relative_day, CAST(coalesce(sum(trade_volume), 0) AS BIGINT) AS volume FROM rows WHERE underlying_symbol IS NOT NULL GROUP BY 1, 2, 3),
    b AS (SELECT underlying_symbol, option_type, count(*) AS n, avg(ln(volume + 1)) AS mu, stddev_samp(ln(volume + 1)) AS sd FROM cell WHERE relative_day BETWEEN -15 AND -6 GROUP BY 1, 2)
    SELECT cell.*, n AS estimation_obs_count, round(CASE WHEN sd > 1e-9 THEN (ln(volume + 1) - mu) / sd END, 5) AS z_volume FROM cell LEFT JOIN b ON b.underlying_symbol = cell.underlying_symbol AND b.option_type IS NOT DISTINCT FROM cell.option_type""")
def option_abnormal(spark: SparkSession, d: str) -> DataFrame:
    """Abnormal volume of each symbol and type, its baseline aggregated and joined back."""
    z = _abnormal(spark, d)
    return z.withColumn("z_volume", F.round("z_volume", 5))


def _abnormal(spark: SparkSession, d: str) -> DataFrame:
    cells = _enriched(spark, d).where("underlying_symbol is not null").groupBy("underlying_symbol", "option_type", "relative_day").agg(F.coalesce(F.sum("trade_volume"), F.lit(0)).alias("volume"))
    return abnormal.abnormal(cells, ["underlying_symbol", "option_type"], "relative_day", SPANS["estimation"], [abnormal.Metric("volume", "z_volume", "log1p")])


@query(f"""WITH {_CASE}, cell AS (SELECT is_focal, relative_day, CAST(coalesce(sum(trade_volume), 0) AS BIGINT) AS volume, round(coalesce(sum(premium), 0), 3) AS premium FROM rows GROUP BY 1, 2) SELECT * FROM cell""")
def plot_series(spark: SparkSession, d: str) -> DataFrame:
    """Volume and premium by day of the focal symbol and of all others, as figures show them."""
    return _enriched(spark, d).groupBy("is_focal", "relative_day").agg(F.coalesce(F.sum("trade_volume"), F.lit(0)).alias("volume"), F.round(F.coalesce(F.sum("premium"), F.lit(0)), 3).alias("premium"))


_SYM = "translate(upper(trim({})), '/-', '..')"
_FEATURES = f"""{_CASE},
    daily AS (SELECT {_SYM.format('underlying_symbol')} AS symbol, quote_date, arg_min(s_eod, row_id) FILTER (WHERE s_eod IS NOT NULL) AS s_eod FROM underlying_daily WHERE underlying_symbol IS NOT NULL AND quote_date IS NOT NULL GROUP BY 1, 2),
    ret AS (SELECT symbol, quote_date, CASE WHEN s_eod > 0 AND lag(s_eod) OVER w > 0 THEN s_eod / lag(s_eod) OVER w - 1 END AS r FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY quote_date)),
    rf AS (SELECT symbol, stddev_samp(r) AS return_std, avg(abs(r)) AS abs_return_mean, CAST(count(DISTINCT quote_date) AS DOUBLE) AS observed_days FROM ret JOIN map USING (quote_date) WHERE relative_day BETWEEN -15 AND -6 GROUP BY 1),
    dv AS (SELECT symbol, avg(CAST(v AS DOUBLE)) AS mean_volume FROM (SELECT {_SYM.format('underlying_symbol')} AS symbol, quote_date, coalesce(sum(trade_volume), 0) AS v FROM rows WHERE relative_day BETWEEN -15 AND -6 GROUP BY 1, 2) GROUP BY 1),
    feat AS (SELECT rf.*, mean_volume FROM rf LEFT JOIN dv USING (symbol)),
    own AS (SELECT {_SYM.format('f')} AS f FROM focal)"""
_MATCHED = f"""{_FEATURES},
    linked AS (SELECT {_SYM.format('linked_ticker')} AS symbol, link_type, max(link_score) AS link_score FROM linkages WHERE {_SYM.format('source_ticker')} = (SELECT f FROM own) AND linked_ticker IS NOT NULL GROUP BY 1, 2),
    cand AS (SELECT * FROM feat WHERE symbol <> (SELECT f FROM own) AND symbol NOT IN (SELECT symbol FROM linked) AND return_std IS NOT NULL AND abs_return_mean IS NOT NULL AND mean_volume IS NOT NULL),
    sc AS (SELECT coalesce(nullif(stddev_samp(return_std), 0), 1) AS a, coalesce(nullif(stddev_samp(abs_return_mean), 0), 1) AS b, coalesce(nullif(stddev_samp(observed_days), 0), 1) AS c, coalesce(nullif(stddev_samp(mean_volume), 0), 1) AS e FROM cand),
    dist AS (SELECT cand.symbol, abs(cand.return_std - t.return_std) / a + abs(cand.abs_return_mean - t.abs_return_mean) / b + abs(cand.observed_days - t.observed_days) / c + abs(cand.mean_volume - t.mean_volume) / e AS match_distance
        FROM cand, sc, (SELECT * FROM feat WHERE symbol = (SELECT f FROM own)) t),
    matched AS (SELECT symbol, match_distance, row_number() OVER (ORDER BY match_distance, symbol) AS match_rank FROM dist ORDER BY match_distance, symbol LIMIT 10)"""
NAMES = ["return_std", "abs_return_mean", "observed_days", "mean_volume"]


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    """Features of all symbols in the estimation window, returns of the days of the windows, and the focal symbol."""
    from tidemark.functions import text_keys as K

    _, days, focal = _case(spark, d)
    u = table(spark, d, "underlying_daily", "row_id", "quote_date", "underlying_symbol", "s_eod").withColumn("symbol", K.symbol("underlying_symbol")).where("symbol is not null and quote_date is not null")
    one = panel.collapse(u, ["symbol", "quote_date"], ["row_id"], first=["s_eod"]).drop("n_rows")
    returns = panel.with_returns(one, "symbol", "quote_date", "s_eod").join(F.broadcast(days), "quote_date")
    rows = _enriched(spark, d).where("is_estimation").groupBy(K.symbol("underlying_symbol").alias("symbol"), "quote_date").agg(F.coalesce(F.sum("trade_volume"), F.lit(0)).cast("double").alias("v"))
    volume = rows.groupBy("symbol").agg(F.avg("v").alias("mean_volume"))
    features = options.return_features(returns.where("is_estimation"), "symbol", "quote_date", "raw_return").join(volume, "symbol", "left")
    return features, returns, focal.translate(str.maketrans("/-", ".."))


def _matched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, str]:
    from tidemark.functions import text_keys as K

    features, returns, focal = _features(spark, d)
    x = table(spark, d, "linkages", "source_ticker", "linked_ticker", "link_type", "link_score")
    linked = x.where((K.symbol("source_ticker") == focal) & F.col("linked_ticker").isNotNull()).groupBy(K.symbol("linked_ticker").alias("symbol"), "link_type").agg(F.max("link_score").alias("link_score"))
    free = links.without_linked(features.where(F.col("symbol") != focal), linked, ["symbol"])
    return abnormal.nearest(free, features.where(F.col("symbol") == focal), "symbol", NAMES, 10), linked, returns, focal


@query(f"WITH {_MATCHED} SELECT symbol, round(match_distance, 5) AS match_distance, match_rank FROM matched")
def case_controls(spark: SparkSession, d: str) -> DataFrame:
    """The ten unlinked symbols most like the focal one by returns and option volume before the event."""
    return _matched(spark, d)[0].select("symbol", F.round("match_distance", 5).alias("match_distance"), "match_rank")


@query(f"""WITH {_MATCHED},
    cell AS (SELECT underlying_symbol, option_type, relative_day, CAST(coalesce(sum(trade_volume), 0) AS BIGINT) AS volume FROM rows WHERE underlying_symbol IS NOT NULL GROUP BY 1, 2, 3),
    b AS (SELECT underlying_symbol, option_type, avg(ln(volume + 1)) AS mu, stddev_samp(ln(volume + 1)) AS sd FROM cell WHERE relative_day BETWEEN -15 AND -6 GROUP BY 1, 2),
    bs AS (SELECT {_SYM.format('cell.underlying_symbol')} AS symbol, avg(CASE WHEN relative_day BETWEEN -5 AND -1 AND sd > 1e-9 THEN (ln(volume + 1) - mu) / sd END) AS z FROM cell LEFT JOIN b ON b.underlying_symbol = cell.underlying_symbol AND b.option_type IS NOT DISTINCT FROM cell.option_type WHERE cell.option_type = 'C' GROUP BY 1),
    rr AS (SELECT symbol, max(CASE WHEN relative_day = 0 THEN r END) AS r0, max(CASE WHEN relative_day = 1 THEN r END) AS r1 FROM ret JOIN map USING (quote_date) WHERE relative_day IN (0, 1) GROUP BY 1),
    rs AS (SELECT symbol, CASE WHEN coalesce(r0, r1) IS NOT NULL THEN (1 + coalesce(r0, 0)) * (1 + coalesce(r1, 0)) - 1 END AS r FROM rr),
    role AS (SELECT 'linked_firm' AS role, symbol, link_type, link_score, CAST(NULL AS BIGINT) AS match_rank, CAST(NULL AS DOUBLE) AS match_distance FROM linked
        UNION ALL SELECT 'matched_control', symbol, NULL, NULL, match_rank, match_distance FROM matched UNION ALL SELECT 'source_benchmark', f, NULL, NULL, NULL, NULL FROM own)
    SELECT role, symbol, link_type, round(link_score, 6) AS link_score, match_rank, round(match_distance, 5) AS match_distance, round(z, 4) AS z_volume_pre_event, round(rs.r, 6) AS return_window,
        round((SELECT r FROM rs WHERE symbol = (SELECT f FROM own)), 6) AS source_return FROM role LEFT JOIN bs USING (symbol) LEFT JOIN rs USING (symbol)""")
def case_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Linked firms, matched controls and the focal symbol beside each other, with their call volume before and their return at the event."""
    from tidemark.functions import text_keys as K

    controls, linked, returns, focal = _matched(spark, d)
    z = _abnormal(spark, d).where("option_type = 'C' and underlying_symbol is not null").withColumns({"symbol": K.symbol("underlying_symbol"), "is_pre_event": F.col("relative_day").between(*SPANS["pre_event"])})
    volume = windows.window_means(z, ["symbol"], ["z_volume"], ["is_pre_event"], "relative_day").drop("observed_days")
    moved = windows.window_returns(returns, "symbol", "relative_day", "raw_return").drop("return_day0")
    role = lambda df, name: df.withColumn("role", F.lit(name))
    own = spark.range(1).select(F.lit(focal).alias("symbol"))
    both = panel.union_aligned(
        role(linked, "linked_firm"), role(controls, "matched_control"), role(own, "source_benchmark"),
        schema={"role": "string", "symbol": "string", "link_type": "string", "link_score": "double", "match_rank": "bigint", "match_distance": "double"},
    )
    source = moved.where(F.col("symbol") == focal).agg(F.max("return_window").alias("source_return"))
    got = both.join(volume, "symbol", "left").join(moved, "symbol", "left").join(F.broadcast(source))
    return got.select("role", "symbol", "link_type", F.round("link_score", 6).alias("link_score"), "match_rank", F.round("match_distance", 5).alias("match_distance"), F.round("z_volume_pre_event", 4).alias("z_volume_pre_event"), F.round("return_window", 6).alias("return_window"), F.round("source_return", 6).alias("source_return"))
