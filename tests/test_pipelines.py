import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import windows
from tidemark.plans import pipelines

HEADER = "Underlying Symbol,quote_date,root,expiration,strike,option_type,trade_volume,open_interest,bid_1545,ask_1545,underlying_bid_1545,underlying_ask_1545,bid_eod,ask_eod,underlying_bid_eod,underlying_ask_eod,vwap,delta_1545"


def archive(folder, day, rows):
    with zipfile.ZipFile(folder / f"eod_{day}.zip", "w") as z:
        z.writestr("x.csv", "\n".join([HEADER, *rows]) + "\n")


def row(symbol, day, kind="CALL", volume=10, bid=1.0, under=50.0):
    return f"{symbol},{day},{symbol.strip()},2020-06-19,65,{kind},{volume},5,{bid},{bid + 0.5},{under},{under + 1},{bid},{bid + 1},{under},{under + 2},N/A,0.2"


@pytest.fixture
def made(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    for i, day in enumerate(("2020-01-02", "2020-01-03", "2020-01-06")):
        archive(raw, day, [row(" aaa ", day, under=50.0 + i), row("aaa", day, "put", under=50.0 + i + (i == 1)), row("bbb", day, bid=0.0)])
    return str(raw), str(tmp_path / "out" / "options"), str(tmp_path / "out" / "days"), str(tmp_path / "qc" / "r")


def test_ingest_and_firm_days(spark, made):
    raw, out, days, report = made
    got = pipelines.ingest_options(spark, raw, out, report, most=2)
    assert (got.written, got.skipped) == (2, 0) and got.report["rows"] == 6 and got.report["duplicate_rows"] == 0 and got.report["vwap_nulls"] == 6
    assert json.load(open(f"{report}.json"))["rows"] == 6 and open(f"{report}.md").read().startswith("# Option ingest")
    again = pipelines.ingest_options(spark, raw, out, report)
    assert (again.written, again.skipped) == (1, 2) and pipelines.ingest_options(spark, raw, out, report).written == 0
    assert pipelines.ingest_options(spark, raw, out, report, last=date(2020, 1, 2), overwrite=True).written == 1
    t = spark.read.parquet(out)
    assert t.count() == 9 and dict(t.dtypes)["quote_date"] == "date"
    one = t.where("quote_date = '2020-01-02' and option_type = 'P'").first()
    assert (one.underlying_symbol, one.series_id, one.mid_1545, one.s_1545, one.s_eod, one.has_calcs) == ("AAA", "AAA|AAA|2020-06-19|65.0|P", 1.25, 50.5, 51.0, True)
    assert not t.where("underlying_symbol = 'BBB'").first().has_valid_1545_quote
    got = pipelines.build_firm_days(spark, out, days, report, last=date(2020, 1, 3))
    assert got.written == 2 and got.report["rows"] == 4 and got.report["inconsistent_1545"] == 1
    with pytest.raises(FileExistsError):
        pipelines.build_firm_days(spark, out, days, report)
    pipelines.build_firm_days(spark, out, days, report, overwrite=True)
    r = {(x.underlying_symbol, str(x.quote_date)): x for x in spark.read.parquet(days).collect()}
    a = r["AAA", "2020-01-03"]
    assert len(r) == 6 and a.option_series_count == 2 and a.snapshot_eod_n == 2 and a.underlying_bid_eod_n == 2 and a.prior_s_eod == 51.0 and abs(a.raw_return - 1 / 51) < 1e-12
    with pytest.raises(FileNotFoundError):
        pipelines.ingest_options(spark, raw + "x", out, report)
    with pytest.raises(FileNotFoundError):
        pipelines.build_firm_days(spark, out + "x", days, report)


def test_a_missing_column_fails(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "eod_2020-01-02.zip", "w") as z:
        z.writestr("x.csv", "underlying_symbol,quote_date\nA,2020-01-02\n")
    with pytest.raises(ValueError, match="strike"):
        pipelines.ingest_options(spark, str(tmp_path), str(tmp_path / "o"), str(tmp_path / "r"))


def test_linkages(spark, tmp_path):
    (tmp_path / "tnic.csv").write_text("year,score,ticker1,ticker2\n2019,0.8,aaa,bbb\n2019,0.3,bbb,aaa\n2018,0.9,aaa,ccc\n")
    (tmp_path / "vtnic.tsv").write_text("year\tvertscore\tgvkey1\tgvkey2\n2019\t0.5\t007\t8\n")
    events = spark.createDataFrame([("AAA", date(2020, 3, 2)), (None, date(2020, 1, 1))], "source_firm_id string, event_trading_date date")
    days = spark.createDataFrame([(s, date(2020, 1, 2)) for s in (" aaa", "bbb", "ccc", "ddd")], "underlying_symbol string, quote_date date")
    bridge = spark.createDataFrame([("7", 2020, "AAA", "AAA", "A"), ("8", 2020, "DDD", "DDD", "D")], "gvkey string, event_year bigint, underlying_symbol string, firm_id string, issuer_name string")
    table, controls = pipelines.build_linkages(spark, events, days, str(tmp_path), {"vertical": ("vtnic",), "horizontal": ("tnic",)}, bridge)
    assert sorted((r.linked_firm_id, r.link_type, r.link_score, r.link_rank) for r in table.collect()) == [("BBB", "horizontal", 0.8, 1), ("DDD", "vertical", 0.5, 1)]
    assert sorted((r.control_firm_id, r.link_type) for r in controls.collect()) == [("BBB", "vertical"), ("CCC", "horizontal"), ("CCC", "vertical"), ("DDD", "horizontal")]
    with pytest.raises(FileNotFoundError):
        pipelines.build_linkages(spark, events, days, str(tmp_path / "none"), {"h": ("tnic",)})


def test_case(spark, made):
    raw, out, _, report = made
    pipelines.ingest_options(spark, raw, out, report)
    frame = spark.read.parquet(out)
    days = windows.date_map(frame.select("quote_date"), "quote_date", F.lit(date(2020, 1, 3)), {"estimation": (-1, -1), "announcement": (0, 1)})
    listed = frame.where("series_id like 'AAA%C'").select("series_id").distinct()
    rows, features = pipelines.study_case(frame, days, listed, "AAA")
    assert rows.count() == 9 and sorted((r.relative_day, r.call_volume, r.share_of_call_volume) for r in features.collect()) == [(-1, 10, 1.0), (0, 10, 1.0), (1, 10, 1.0)]
