from datetime import date

from tidemark.functions.flooding import correspond
from tidemark.operators import drift
from tidemark.queries.training import PANEL

KIND = "line_id bigint, file_id bigint, stream string, file_name string, file_date date, line_no int, line_text string"


def lines(spark, files):
    rows, n = [], 0
    for i, (stream, text) in enumerate(files):
        for k, t in enumerate(text):
            n += 1
            rows.append((n, i, stream, f"f{i}", date(2020, 1, 1 + i), k, t))
    return spark.createDataFrame(rows, KIND)


FILES = [
    ("s", ["quote_date,strike,has_calcs,vwap", "2020-01-02,10.5,true,", "2020-01-02,10.5,true,N/A", "2020-01-02,11.5,false,3.5"]),
    ("s", ['"strike"|"QuoteDt"|"has_calcs"|"vwap"', '12.5|20200103|true|"4.5"', "", None]),
    ("s", ["QuoteDt;strike;calcs_flag;OI", "20200104;USD 9.5;Y;7", "20200104;USD 9.5;N;x;9"]),
    ("t", ["iv_1545", "0.5"]),
    ("u", [""]),
]


def test_changes(spark):
    files = drift.file_columns(lines(spark, FILES), PANEL)
    got = sorted((r.file_id, r.column_name, r.change_kind) for r in drift.changes(files).collect())
    assert got == sorted([
        (1, "quote_date", "renamed"), (1, "quote_date", "retyped"),
        (2, "strike", "retyped"), (2, "has_calcs", "renamed"), (2, "has_calcs", "retyped"), (2, "vwap", "removed"), (2, "open_interest", "added"),
    ])


def test_table(spark):
    df = lines(spark, FILES)
    t = drift.consistent_table(df, drift.file_columns(df, PANEL), PANEL)
    assert t.columns == ["line_id", "file_id", *(n for n, _ in PANEL)]
    rows = {r.line_id: r for r in t.collect()}
    assert (rows[2].quote_date, rows[2].strike, rows[2].has_calcs, rows[2].vwap) == (date(2020, 1, 2), 10.5, True, None)
    assert rows[3] == rows[3] and rows[2].asDict() | {"line_id": 3} == rows[3].asDict()  # repeated lines stay
    assert (rows[6].quote_date, rows[6].strike, rows[6].vwap) == (date(2020, 1, 3), 12.5, 4.5)
    assert (rows[10].strike, rows[10].has_calcs, rows[10].open_interest) == (9.5, True, 7)


def test_empty_and_odd_headers(spark):
    empty = spark.createDataFrame([], KIND)
    assert drift.changes(drift.file_columns(empty, PANEL)).count() == 0
    odd = lines(spark, [("s", ["zzz,zzz,qqq", "1,2,3"]), ("s", ["zzz,qqq", "1,2"])])
    files = drift.file_columns(odd, PANEL)
    assert drift.changes(files).count() == 0 and drift.consistent_table(odd, files, PANEL).count() == 2


def test_correspondences():
    names = ("trade_dt", "volume", "impl_und_px_1545", "ImplVol1545", "offer_1545", "closing_bid", "put_call", "bidqty_1545", "Ask 15:45", "avg_px_vw")
    got = correspond(names[:8] + names[9:], (None,) * 9, PANEL)
    assert got == ("quote_date", "trade_volume", "implied_underlying_price_1545", "implied_volatility_1545", "ask_1545", "bid_eod", "option_type", "bid_size_1545", "vwap")
    assert correspond(("Ask 15:45", "mystery"), (None, None), PANEL) == ("ask_1545", None)
