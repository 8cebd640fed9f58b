import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markup, quotes
from tidemark.functions import text_keys as K
from tidemark.operators import abnormal, calendar, clusters, entities, links, ordering, panel, quality, windows
from tidemark.plans.event_study import study


def test_clusters_against_one_pass_per_entity(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *(datetime(2020, 1, 1) + timedelta(days=rng.randint(0, 1500), hours=h) for h in range(9))]), i, rng.choice([None, "p", "q", "r"])) for i in range(500)]
    got = clusters.cluster_events(spark.createDataFrame(rows, "e string, t timestamp, i int, p string"), "e", "t", "i", "p", 40, 5)
    want = []
    for e in ("hot", "a"):
        mine = sorted((t, i, p) for x, t, i, p in rows if x == e and t is not None)
        ids = clusters.fold([((t.date() - date(1970, 1, 1)).days, p) for t, _, p in mine], 40, 5)
        for c in set(ids):
            sel = [m for m, k in zip(mine, ids, strict=True) if k == c]
            want.append((e, sel[0][0], sel[-1][0].date(), len(sel), ";".join(sorted({p for *_, p in sel if p})), sel[0][1]))
    # Numbered by entity and by the row that began the cluster.
    want = [(*x[:-1], i + 1) for i, x in enumerate(sorted(want, key=lambda x: (x[0], x[1], x[-1])))]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_fold_rules():
    assert clusters.fold([(0, "a"), (300, "a"), (310, "b"), (320, None), (700, None)], 365, 30) == [0, 0, 1, 1, 2]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_previous_across_partitions(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 5 + ["a", "b", None]), d, i) for i, d in enumerate(rng.choices(range(50), k=300))]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.i: r.p for r in ordering.with_previous(spark.createDataFrame(rows, "k string, d int, i int"), "k", ["d", "i"], "i", "p").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((d, i) for x, d, i in rows if x == k)
        want |= {i: (mine[n - 1][1] if n else None) for n, (_, i) in enumerate(mine)}
    assert got == want


def test_calendar(spark):
    assert date(2024, 3, 29) in calendar.holidays(2024) and date(2021, 12, 31) in calendar.trading_days(2021, 2022)
    cal = calendar.calendar(spark, 2024, 2024)
    at = [datetime(2024, 3, 15, 10), datetime(2024, 3, 15, 17, 1), datetime(2024, 3, 29, 9), datetime(2024, 4, 1, 16), None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(at)], "i int, t timestamp_ntz")
    got = {r.i: (r.trading_date, r.pre_event_end) for r in calendar.align(df, cal, F.col("t")).collect()}
    assert got == {0: (date(2024, 3, 15), date(2024, 3, 14)), 1: (date(2024, 3, 18), date(2024, 3, 15)), 2: (date(2024, 4, 1), date(2024, 3, 28)), 3: (date(2024, 4, 2), date(2024, 4, 1)), 4: (None, None)}


def test_abnormal(spark):
    import math
    from statistics import mean, stdev

    rows = [("k", d, v) for d, v in zip(range(-3, 1), (1, 3, 5, 7), strict=True)] + [(None, -1, 2), (None, 0, 2), ("one", 0, 1)]
    df = spark.createDataFrame(rows, "k string, d int, v bigint")
    how = (df, ["k"], "d", (-3, -1), [abnormal.Metric("v", "z", "log1p")])
    got = {(r.k, r.d): r for r in abnormal.abnormal(*how).collect()}
    same = {(r.k, r.d): r for r in abnormal.abnormal(*how, small_keys=True).collect()}
    assert {k: (r.z and round(r.z, 9), r.estimation_obs_count) for k, r in got.items()} == {k: (r.z and round(r.z, 9), r.estimation_obs_count) for k, r in same.items()}
    base = [math.log(x + 1) for x in (1, 3, 5)]
    assert got["k", 0].z == pytest.approx((math.log(8) - mean(base)) / stdev(base)) and got["k", 0].estimation_obs_count == 3
    assert got[None, 0].z is None and got[None, 0].estimation_obs_count == 1 and got["one", 0].estimation_obs_count is None
    with pytest.raises(ValueError):
        abnormal.Metric("v", "z", "sqrt").column()


def test_winners(spark):
    ev = [("q", 1, "a", 90), ("q", 1, "b", 90), ("q", 2, "a", 90), ("q", 2, "a", 80), ("z", 1, "a", 95), ("z", 1, "b", 80), ("t", 1, "a", 94), ("t", 1, "b", 94)]
    df = spark.createDataFrame([(*e, e[2].upper()) for e in ev], "q string, k int, c string, s int, n string")
    assert {r.q: (r.c, r.k) for r in entities.first_clear(df, "q", "k", "c", "s", "n", 3).collect()} == {"q": ("a", 2), "z": ("a", 1)}
    assert {r.q for r in entities.clear_winner(df, "q", "c", "s", "n").collect()} == {"q", "z"}


def test_texts(spark):
    df = spark.createDataFrame([("VARIAN INC (VAR) (CIK 0001012345); Foo Bar (CIK 77)", "FILER:\nx\n COMPANY NAME:  Acme \n</SEC-HEADER> COMPANY NAME: no", "say Acme Corp and Beta Inc and Acme Corp")], "d string, h string, t string")
    r = df.select(markup.display_names("d").alias("d"), markup.header_field("h", "FILER", "COMPANY NAME").alias("h"), markup.header_field("h", "SUBJECT COMPANY", "COMPANY NAME").alias("no"), markup.label_hits(F.lit(None).cast("string"), {"a": "b"}).alias("n")).first()
    assert [tuple(x) for x in r.d] == [("VARIAN INC", "VAR", "0001012345"), ("Foo Bar", None, "0000000077")]
    assert (r.h, r.no, r.n) == ("Acme", None, [])
    pairs = spark.createDataFrame([("Teledyne Tech Inc.", "TELEDYNE TECH"), ("Land", "Land Rover Co"), ("A B", "A B C"), (None, "x")], "a string, b string")
    assert [x[0] for x in pairs.select(markup.name_matches("a", "b", K.slug)).collect()] == [True, False, True, False]


def test_keys(spark):
    df = spark.createDataFrame([(" brk/b ", "CIK0000703500", "012345.0"), ("x-y", " 994129", "7"), (None, None, None), ("", "000", "n/a"), ("\t", "123456789012", "")], "s string, c string, g string")
    rows = [tuple(r) for r in df.select(K.symbol("s"), K.cik10("c"), K.gvkey("g")).collect()]
    assert rows[:3] == [("BRK.B", "0000703500", "12345"), ("X.Y", "0000994129", "7"), (None, None, None)]
    assert rows[3][1:] == (None, None) and rows[4][1:] == ("123456789012", None)  # padding never cuts


def test_quotes_and_keys_with_nulls(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 1.0, None), (None, 1.0, "b"), (0.0, 1.0, "c"), (1.0, 1.0, "d")], "b double, a double, k string")
    got = [tuple(r) for r in df.select(quotes.valid_quote("b", "a"), quotes.midpoint("b", "a"), quotes.composite_key("k", "b"), quotes.tier("b", [(0, "low"), (1, "mid")], "high")).collect()]
    assert got == [(True, 1.5, "a|1.0", "mid"), (False, None, None, "high"), (False, None, None, "high"), (False, None, "c|0.0", "low"), (True, 1.0, "d|1.0", "mid")]


def test_links(spark):
    one = spark.createDataFrame([("s", 2020, "h", "o")], "source string, year int, type string, linked string")
    firms = spark.createDataFrame([(2020, f) for f in ("s", "o", "x", "y", "y")], "year int, firm string")
    assert [tuple(r) for r in links.unlinked_counts(one.select("source", "year", "type"), firms, one).collect()] == [("s", 2020, "h", 2)]
    assert links.both_ways(one, {"source": "linked"}).count() == 2
    r = links.ranked(spark.createDataFrame([("g", "a", 1.0), ("g", "b", None), ("g", "c", 1.0), ("h", "a", None)], "g string, k string, s double"), ["g"], "s", "k")
    assert {(x.g, x.k): (x.link_rank, x.rank_percentile) for x in r.collect()} == {("g", "a"): (1, 1.0), ("g", "c"): (2, 0.5), ("g", "b"): (None, None), ("h", "a"): (None, 1.0)}


def test_require(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("c", 1), ("d", None), ("e", None)], "id string, x int")
    quality.require(df, {"none": "id is null"}, "id")
    with pytest.raises(ValueError, match="nulls: 4 rows, such as a, b, d, ..."):
        quality.require(df, {"fine": "id is null", "nulls": "x is null"}, "id")


def test_panel_edges(spark):
    df = spark.createDataFrame([(None, 1, None, None), (None, 2, 5.0, False), ("k", 1, None, True)], "k string, o int, v double, f boolean")
    got = {r.k: r for r in panel.collapse(df, ["k"], ["o"], first=["v"], flags=["f"], distinct=["v"], snapshots={"s": ["v", "f"]}).collect()}
    assert (got[None].v, got[None].f, got[None].v_n, got[None].s_n, got[None].s_inconsistent) == (5.0, False, 1, 2, True)
    assert (got["k"].v, got["k"].f, got["k"].v_n, got["k"].s_n) == (None, True, 0, 1)
    assert panel.union_aligned(df, df.limit(0), schema={"o": "bigint", "zz": "string"}).columns == ["o", "zz"]


def test_study(spark):
    days = [date(2024, 1, 1) + timedelta(d) for d in range(12)]
    rows = [(e, d, float(1 + (i * 7) % 5 + (9 if e == "a" and i == 9 else 0))) for e in ("a", "b") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "e string, d date, v double")
    s = study(df, entity=["e"], day=F.col("d"), event=F.lit(date(2024, 1, 11)), sums={"x": F.col("v")}, metrics=[abnormal.Metric("x", "z")], spans={"estimation": (-8, -3), "pre_event": (-2, -1), "announcement": (0, 1)})
    got = {r.e: r.z_pre_event for r in s.collect()}
    assert got["a"] > got["b"] + 2
    with pytest.raises(ValueError):  # a missing event day isn't passed over
        windows.date_map(df.select("d"), "d", F.lit(date(1999, 1, 1)))
