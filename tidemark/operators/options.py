"""Option rows end to end: the normalised frame, slices, rows enriched for an event, contract features, shares."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import quotes
from tidemark.functions import text_keys as K
from tidemark.operators.panel import collapse, lead_change

# Long forms of the option types, the columns a frame can't do without, and those that show calculations.
TYPES = {"CALL": "C", "PUT": "P"}
CORE = ("underlying_symbol", "quote_date", "root", "expiration", "strike", "option_type")
CALCS = ("implied_underlying_price_1545", "active_underlying_price_1545", "implied_volatility_1545", "delta_1545", "gamma_1545", "theta_1545", "vega_1545", "rho_1545")
TENORS = [(7, "0_7"), (30, "8_30"), (90, "31_90")]
CONTRACT_SIZE = 100


def moneyness(delta: str = "delta_1545", kind: Column | str = "option_type") -> Column:
    """Out of the money, at the money or other, by the delta of calls and puts (the outer bounds count, the middle ones belong to the outside)."""
    code = quotes.short_code(kind, TYPES)
    call, put = code == "C", code == "P"
    return quotes.within(delta, [(call, 0.10, 0.40, True, "call_otm"), (call, 0.40, 0.60, False, "call_atm"), (put, -0.40, -0.10, True, "put_otm"), (put, -0.60, -0.40, False, "put_atm")], "other")


def option_frame(df: DataFrame) -> DataFrame:
    """``df`` with keys in one notation and what follows from its quotes, at 15:45 and at the end of day; one projection.

    Validity flags of both sides of option and underlying, midpoints and relative spreads of
    valid quotes, the underlying's price (at 15:45 with the active price in its place),
    whether calculations are there, calendar days left, and the series key (null where a
    part is). A missing core column is a ``ValueError``; other missing columns count as null.
    Columns of ``df`` that the frame makes anew are replaced, all others stay.
    """
    if missing := [c for c in CORE if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    col = lambda c: F.col(f"`{c}`").cast("double") if c in df.columns else F.lit(None).cast("double")
    text = lambda c: F.upper(F.btrim(F.col(c).cast("string"), F.lit(K.SPACE)))
    new: dict[str, Column] = {"underlying_symbol": text("underlying_symbol"), "root": text("root"), "option_type": quotes.short_code(F.btrim("option_type", F.lit(K.SPACE)), TYPES)}
    for at in ("1545", "eod"):
        bid, ask, ubid, uask = (col(f"{c}_{at}") for c in ("bid", "ask", "underlying_bid", "underlying_ask"))
        new[f"has_valid_{at}_quote"] = quotes.valid_quote(bid, ask)
        new[f"has_valid_underlying_{at}_quote"] = quotes.valid_quote(ubid, uask)
        new[f"mid_{at}"] = quotes.midpoint(bid, ask)
        new[f"rel_spread_{at}"] = quotes.relative_spread(bid, ask)
        new[f"s_{at}"] = quotes.price_or(ubid, uask, col("active_underlying_price_1545") if at == "1545" else None)
    new["has_calcs"] = quotes.any_present(*(c for c in CALCS if c in df.columns))
    new["dte_cal"] = F.datediff("expiration", "quote_date").cast("bigint")
    new["series_id"] = quotes.composite_key(new["underlying_symbol"], new["root"], "expiration", F.round(col("strike"), 4), new["option_type"])
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in new), *(c.alias(n) for n, c in new.items()))


# What a firm-day keeps of its option rows.
FIRM_DAY = ("underlying_bid_1545", "underlying_ask_1545", "s_1545", "underlying_bid_eod", "underlying_ask_eod", "s_eod")
FIRM_DAY_FIRST = ("implied_underlying_price_1545", "active_underlying_price_1545")
FIRM_DAY_FLAGS = ("has_valid_underlying_1545_quote", "has_valid_underlying_eod_quote")


def firm_days(frame: DataFrame, order: list[str]) -> DataFrame:
    """One row per day and symbol of an option frame: first prices in the declared order, validity, and how
    many distinct prices and snapshots of prices the day has. Columns the frame lacks count as null."""
    kinds = {**dict.fromkeys((*FIRM_DAY, *FIRM_DAY_FIRST), "double"), **dict.fromkeys(FIRM_DAY_FLAGS, "boolean")}
    whole = frame.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in frame.columns})
    return collapse(
        whole.select("quote_date", "underlying_symbol", *order, *kinds), ["quote_date", "underlying_symbol"], order, first=[*FIRM_DAY, *FIRM_DAY_FIRST], flags=list(FIRM_DAY_FLAGS), distinct=list(FIRM_DAY),
        snapshots={"snapshot_1545": ["underlying_bid_1545", "underlying_ask_1545"], "snapshot_eod": ["underlying_bid_eod", "underlying_ask_eod", "s_eod"]}, count="option_series_count",
    )


def option_slice(df: DataFrame, symbols: list[str], days: list[date]) -> DataFrame:
    """The rows of stated symbols on stated days: both lists reach the scan, days as partition filters where the table has them."""
    return df.where(F.col("quote_date").isin(*days) & F.col("underlying_symbol").isin(*symbols)) if symbols and days else df.limit(0)


def enriched(df: DataFrame, days: DataFrame, listed: DataFrame, focal: str, *, order: tuple[str, ...] = (), lead_first: bool = False) -> DataFrame:
    """Rows of the event's windows with offsets and flags, change of open interest to the next day, premium and buckets.

    ``days`` is a date map (a row per day of the windows), ``listed`` the ``series_id`` under
    study (a short list; both go to all tasks), ``focal`` the symbol. The change of open interest looks at the rows
    of the windows only, so that it is null on their last day; ``lead_first`` looks before
    the rows are cut. The premium is volume times contract size times the traded price, else
    the midpoint.
    """
    day = days.columns[0]
    nxt = F.broadcast(days.select(F.col(day).alias("quote_date"), *(c for c in days.columns if c != day)))
    change = lambda x: lead_change(x, "series_id", "quote_date", "open_interest", "next_day", list(order), "lead_open_interest_change")
    rows = change(df.join(nxt, "quote_date", "left")).where("relative_day is not null") if lead_first else change(df.join(nxt, "quote_date"))
    prices = [c for c in ("vwap", "mid_1545", "mid_eod") if c in df.columns]
    rows = rows.join(F.broadcast(listed.select("series_id", F.lit(True).alias("_listed")).distinct()), "series_id", "left")
    return rows.withColumns({
        "is_listed": F.coalesce("_listed", F.lit(False)),
        "is_focal": F.coalesce(F.col("underlying_symbol") == focal, F.lit(False)),
        "premium": F.col("trade_volume") * CONTRACT_SIZE * F.coalesce(*prices),
        "tenor": quotes.tier("dte_cal", TENORS, "91_plus"),
        "moneyness": moneyness(),
    }).drop("_listed")


def contract_features(rows: DataFrame) -> DataFrame:
    """Listed rows with the call volume of their symbol's day and of its expiry, and their shares in them (null where that isn't positive)."""
    calls = rows.where("option_type = 'C'")
    day, expiry = ["underlying_symbol", "quote_date"], ["underlying_symbol", "quote_date", "expiration"]
    out = rows.where("is_listed")
    for name, keys in (("call_volume", day), ("expiry_call_volume", expiry)):
        total = calls.groupBy(*keys).agg(F.coalesce(F.sum("trade_volume"), F.lit(0)).alias(name))
        out = out.join(total, keys, "left").withColumn(f"share_of_{name}", F.when(F.col(name) > 0, F.col("trade_volume") / F.col(name)))
    return out


def pooled_share(df: DataFrame, by: list[str], groups: list[str], volume: str, total: str, tie: Column) -> DataFrame:
    """``by, share``: all volume over all totals of the groups whose total is positive, each total counted once a group; null for no such group."""
    g = df.groupBy(*by, *groups).agg(F.coalesce(F.sum(volume), F.lit(0)).alias("v"), F.min_by(total, F.when(F.col(total).isNotNull(), tie)).alias("t"))
    return g.groupBy(*by).agg((F.sum(F.when(F.col("t") > 0, F.col("v"))) / F.sum(F.when(F.col("t") > 0, F.col("t")))).alias("share"))


def return_features(daily: DataFrame, symbol: str, day: str, value: str) -> DataFrame:
    """Per symbol the sample deviation of its returns, the mean of their sizes, and the days observed."""
    return daily.groupBy(symbol).agg(F.stddev_samp(value).alias("return_std"), F.avg(F.abs(value)).alias("abs_return_mean"), (F.countDistinct(day) + F.max(F.col(day).isNull().cast("int"))).cast("double").alias("observed_days"))


def exactly_one(df: DataFrame, condition: Column, what: str) -> dict:
    """The one row that meets the condition; a ``ValueError`` for none or several."""
    found = df.where(condition).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} {what}")
    return found[0].asDict()
