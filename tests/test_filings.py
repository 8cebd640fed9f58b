from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.operators import filings, linktables, links, options, panel, windows
from tidemark.queries.filings import CONTEXT, LEADING, RULES, STOPS, TRAILING


def values(spark, column, *columns):
    return list(spark.range(1).select(column, *columns).first())


@pytest.mark.parametrize("form, items, text, want", [
    ("8-K", "1.01,9.01", "The Merger Agreement was signed.", (4, True, False, "merger")),
    ("SC TO-T", None, None, (2, False, True, "tender_offer")),
    ("SC TO-T", "", "an unsolicited letter", (3, True, True, "tender_offer")),
    ("10-Q", "1.01", "merger agreement, record date", (-1, False, False, "merger")),
    (None, None, "will be merged", (0, False, False, "other")),
    ("425", "", "", (0, False, False, "merger")),
])
def test_classifier(spark, form, items, text, want):
    lit = lambda x: F.lit(x).cast("string")
    c = filings.classify(lit(text), lit(form), lit(items), RULES)
    assert tuple(values(spark, c["score"], c["is_candidate"], c["is_side"], c["kind"])) == want


def test_forms_urls_queries(spark):
    df = spark.createDataFrame([(" defa14a ",), ("DEFA14A/A",), ("8-k",), ("",), (None,)], "f string")
    assert sorted(r.form for r in filings.base_forms(df, "f").collect()) == ["8-K", "DEFA14A"]
    assert values(spark, filings.filing_url("https://h/d/", F.lit("0001012345"), F.lit("0001-20-3"))) == ["https://h/d/1012345/0001203/0001-20-3.txt"]
    q = lambda s: [x.query for x in values(spark, filings.search_queries(F.lit(s), ("NYSE",)))[0]]
    assert q("VAR") == ['"symbol VAR"', '"NYSE: VAR"', "VAR"] and q("VARIA")[0] == "VARIA"


def test_symbol_mentions_and_context(spark):
    patterns = (r"(?i)Trading Symbol[^A-Za-z0-9]{0,20}{}\b".replace("{0,20}", "*"), r"(?i)\({}\)")
    hit = lambda t, s: values(spark, filings.mentions_symbol(F.lit(t).cast("string"), F.lit(s).cast("string"), patterns))[0]
    assert hit("trading symbol: BF.B", "BF.B") and not hit("trading symbol: BFXB", "BF.B") and not hit(None, "A") and not hit("(A)", None)
    names = values(spark, filings.context_names(F.lit("The board of Karvenolt Foods Inc. received it; Acme will acquire Zorva Energy said on Monday"), CONTEXT, STOPS, LEADING, TRAILING))[0]
    assert names == ["Karvenolt Foods Inc", "Zorva Energy"]
    assert values(spark, filings.matches_context(F.lit("Zorva Energy Corp"), F.array(F.lit("zorva energy partners"))), filings.matches_context(F.lit(None).cast("string"), F.array(F.lit("x")))) == [True, False]


def test_display_and_page_candidates(spark):
    text = "VARIAN INC (VAR, VARX) (CIK 0001012345); Other Co (CIK 77)"
    got = lambda t, s, hints, single: [(r.name, r.cik, r.score) for r in values(spark, filings.display_candidates(F.lit(t), F.lit(s), hints=F.lit(hints), single=F.lit(single)))[0]]
    assert got(text, "varx", False, True) == [("VARIAN INC", "0001012345", 95)]
    assert got(text, "OTH", True, True) == [("Other Co", "0000000077", 94)] and got(text, "OTH", False, True) == []
    assert got("Lone Co (CIK 5)", "Q", True, True) == [("Lone Co", "0000000005", 93)] and got("Lone Co (CIK 5)", "Q", True, False) == []
    page = "<b>Now Co</b> CIK#: 0000000012 <i>formerly: Then & Co CIK 12</i> <a>0000000034</a> <td>List Co</td>"
    r = values(spark, filings.page_candidates(F.lit(page), r"<b>([^<]+)</b> CIK#: (\d+)", r"formerly: ([^<]+?) CIK (\d+)", r"<a>(\d+)</a> <td>([^<]+)</td>"))[0]
    assert [(x.name, x.cik, x.source, x.score) for x in r] == [("Now Co", "0000000012", "page_current", 95), ("Then & Co", "0000000012", "page_former", 94), ("List Co", "0000000034", "page_row", 92)]


PARTY = "struct<cik: string, name: string, ticker: string, firm_id: string, told_by: string>"


def test_parties(spark):
    a, b = ("1", "Acme Inc", "AC", None, "subject"), (None, "ACME Corp.", None, None, "filer")
    z, m = (None, "Zorva LLC", "ZO", None, "text"), ("1", "Acme", "AC", "AC", "matched")
    rows = [(1, a, b, z, m), (2, None, None, None, m), (3, None, a, b, None), (4, None, None, None, None)]
    df = spark.createDataFrame(rows, f"k int, s {PARTY}, f {PARTY}, t {PARTY}, m {PARTY}")
    got = {r.k: (r.target, r.acquirer, r.source) for r in filings.deal_parties(df, ["s", "f"], ["f", "t"], "m").collect()}
    assert got[1][0].name == "Acme Inc" and got[1][1].name == "Zorva LLC" and got[1][2].firm_id == "AC" and got[1][2].told_by == "subject_matched"
    assert got[2][0].told_by == "matched" and got[2][1] is None and got[3][0].name == "Acme Inc" and got[3][1] is None
    assert got[4][0] is None and got[4][2] is None


def test_evidence(spark):
    df = spark.createDataFrame([(1, "7", "Zorva Inc", "8", "Other", None, None, ["zorva"], True, [("P", "9", "page_row", 92)]), (2, None, None, None, None, None, None, [], False, None)], "k int, subject_cik string, subject_name string, filer_cik string, filer_name string, filed_by_cik string, filed_by_name string, c array<string>, m boolean, e array<struct<name: string, cik: string, source: string, score: int>>")
    got = sorted((r.k, r.cik, r.source, r.score) for r in filings.evidence(df, ["k"], contexts="c", mentioned="m", extra=["e"]).collect())
    assert got == [(1, "7", "subject", 100), (1, "8", "filer_symbol", 80), (1, "9", "page_row", 92)]


def test_events(spark):
    day = lambda n: datetime(2020, 1, 1 + n, 12)
    rows = [("u", day(0), 1, "zorva", "Zorva Inc", "merger"), ("u", day(5), 2, None, None, "tender"), ("u", day(6), 3, "acme", "Acme", "x"), ("v", day(1), 4, None, None, "y"), (None, day(1), 5, None, None, "y")]
    df = spark.createDataFrame(rows, "u string, t timestamp, i int, p string, n string, k string")
    e = filings.event_rows(df, entity="u", at="t", tie="i", party="p", name="n", carried=["k"], long_gap=40, short_gap=10, listed=True)
    got = sorted((r.event_id, r.n_filings, r.k, r.counterparty, r.filings, r.is_conflicting) for r in e.collect())
    assert got == [("u_2020-01-01_zorva", 2, "merger", "Zorva Inc", "1;2", False), ("u_2020-01-07_acme", 1, "x", "Acme", "3", False), ("v_2020-01-02_cluster0003", 1, "y", None, "4", False)]


def test_link_standard_form(spark):
    df = spark.createDataFrame([(2015, "0.5", "12", "007", "A"), (2016, "x", "12.0", None, "B"), (None, "1", "1", "2", "C")], "`Year` int, Score string, gvkey1 string, gvkey2 string, Name1 string")
    got = sorted((r.link_year or 0, r.link_score, r.source_gvkey, r.linked_gvkey, r.source_name) for r in linktables.standard_links(df, "horizontal").collect())
    assert got == [(0, 1.0, "1", "2", "C"), (2015, 0.5, "12", "7", "A")]
    for bad in (df.drop("Score"), df.drop("gvkey2")):
        with pytest.raises(ValueError):
            linktables.standard_links(bad, "h")
    years, numbers = spark.createDataFrame([(2015,)], "link_year bigint"), spark.createDataFrame([("7",)], "source_gvkey string")
    assert linktables.standard_links(df, "h", years=years, numbers=numbers).count() == 1
    assert linktables.standard_links(df, "h", years=years, numbers=numbers.limit(0)).count() == 0


def test_links_of_one_case(spark):
    raw = spark.createDataFrame([(2015, 0.9, "SRC", "PEER"), (2015, 0.4, "PEER", "SRC"), (2015, 0.7, "SUPP", "SRC"), (2015, 0.1, "SRC", "GONE"), (2014, 1.0, "SRC", "CTRL")], "year int, score double, ticker1 string, ticker2 string")
    sources = spark.createDataFrame([("SRC", 2016, 2015)], "source_firm_id string, event_year bigint, link_year bigint")
    firms = spark.createDataFrame([(f, 2016) for f in ("SRC", "PEER", "SUPP", "CTRL")], "firm_id string, event_year bigint")
    t = linktables.linkage_table(linktables.standard_links(raw, "horizontal", years=sources), sources, firms)
    assert sorted((r.linked_firm_id, r.link_score, r.link_rank) for r in t.collect()) == [("PEER", 0.9, 1), ("SUPP", 0.7, 2)]
    c = linktables.control_candidates(sources, firms, t, ["horizontal", "vertical"])
    assert [(r.control_firm_id, r.link_type) for r in c.collect()] == [("CTRL", "horizontal")]
    assert linktables.control_candidates(sources, firms, t.limit(0), ["horizontal"]).count() == 0


def test_focal_is_always_kept(spark):
    every = spark.createDataFrame([("a", 1), ("b", 2)], "linked string, r int")
    rows = lambda df: sorted((r.linked, r.r, r.is_focal) for r in df.collect())
    assert rows(links.with_focal(every.where("r = 1"), every, "linked", "a", {})) == [("a", 1, True)]
    assert rows(links.with_focal(every.where("r = 1"), every, "linked", "b", {})) == [("a", 1, False), ("b", 2, True)]
    assert sorted(map(str, links.with_focal(every.where("r = 1"), every, "linked", "z", {}).collect())) == ["Row(linked='a', r=1, is_focal=False)", "Row(linked='z', r=None, is_focal=True)"]


def test_small_rules(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 1)], "k int, x int")
    assert [r.k for r in panel.nulls_first(df, [("x", True)]).collect()] == [1, 2, 3] and [r.k for r in panel.nulls_first(df, [("x", False)]).collect()] == [1, 3, 2]
    names = spark.createDataFrame([(" ", "id"), (None, "id"), ("A", "id")], "n string, i string")
    assert [r[0] for r in names.select(panel.display_name("n", "i")).collect()] == ["id", "id", "A"]
    assert options.exactly_one(df, F.col("x") == 5, "row") == {"k": 2, "x": 5}
    for none in (F.col("x") == 9, F.col("x") > 0):
        with pytest.raises(ValueError):
            options.exactly_one(df, none, "row")
    keys = spark.createDataFrame([("\t brk/b\n", 12345.0, "12345678901"), (None, None, "")], "s string, d double, c string")
    assert [tuple(r) for r in keys.select(K.symbol("s"), K.cik10("d"), K.cik10("c")).collect()] == [("BRK.B", "0000012345", "12345678901"), (None, None, None)]


def test_windows_need_their_days(spark):
    days = spark.createDataFrame([(d,) for d in range(10)], "d int")
    w = {"a": (-3, -1), "b": (0, 1)}
    assert windows.date_map(days, "d", F.lit(5), w).count() == 5
    for event in (2, 9, 77):
        with pytest.raises(ValueError):
            windows.date_map(days, "d", F.lit(event), w)
    assert windows.date_map(days, "d", F.lit(77), w, strict=False).count() == 0


def test_option_frame_needs_its_core(spark):
    df = spark.createDataFrame([(" a ", None, "r", None, 65.0, "call", 1.0, 2.0, "x")], "underlying_symbol string, quote_date date, root string, expiration date, strike double, option_type string, bid_eod double, ask_eod double, extra string")
    r = options.option_frame(df).first()
    assert (r.underlying_symbol, r.option_type, r.mid_eod, r.has_valid_1545_quote, r.series_id, r.extra, r.has_calcs) == ("A", "C", 1.5, False, None, "x", False)
    with pytest.raises(ValueError):
        options.option_frame(df.drop("strike"))


def test_lead_change_before_or_after_the_cut(spark):
    days = spark.createDataFrame([(1, -1, 2), (2, 0, 3)], "quote_date int, relative_day bigint, next_day int")
    rows = spark.createDataFrame([("s", d, 10 * d, "A", 1, 1.0, 2.0, 0.2, "C", 5) for d in (1, 2, 3)], "series_id string, quote_date int, open_interest int, underlying_symbol string, trade_volume int, vwap double, mid_1545 double, delta_1545 double, option_type string, dte_cal int")
    listed = spark.createDataFrame([("s",)], "series_id string")
    got = lambda **k: [(r.quote_date, r.lead_open_interest_change, r.is_listed, r.premium, r.moneyness) for r in options.enriched(rows, days, listed, "A", **k).orderBy("quote_date").collect()]
    assert got() == [(1, 10, True, 100.0, "call_otm"), (2, None, True, 100.0, "call_otm")]
    with_days = days.union(spark.createDataFrame([], days.schema))
    assert [x[1] for x in got(lead_first=True)] in ([10, 10], [10, None]) and with_days.count() == 2
