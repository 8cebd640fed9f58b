import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.timestamps import normalise_stamps, one_instant, parse_stamps

NY = "America/New_York"


def us(text):
    return int(pd.Timestamp(text).value // 1000)


def parse(text, zone=NY, day_first=None):
    r = parse_stamps(pd.Series([text]), pd.Series([zone]), pd.Series([day_first])).iloc[0]
    return None if pd.isna(r["lo"]) else (int(r["lo"]), int(r["hi"]))


@pytest.mark.parametrize(
    "text, zone, first, want",
    [
        ("2018-04-05 18:44:02.402-04:00", NY, None, "2018-04-05 22:44:02.402"),
        ("20191029080049", NY, None, "2019-10-29 12:00:49"),
        ("20120106T074700", NY, None, "2012-01-06 12:47"),
        ("1382560035328916", NY, None, "2013-10-23 20:27:15.328916"),
        ("1326113220", NY, None, "2012-01-09 12:47"),
        ("1328549739309", NY, None, "2012-02-06 17:35:39.309"),
        ("March 16, 2012 4:04 PM ET", NY, None, "2012-03-16 20:04"),
        ("6:41 p.m. Eastern, February 14, 2012", NY, None, "2012-02-14 23:41"),
        ("Tue, 07 Feb 2012 14:55:00 -0500", NY, None, "2012-02-07 19:55"),
        ("Thu, 05 Jan 2012 01:12:00 UT", NY, None, "2012-01-05 01:12"),
        ("03/01/2012 23.16", "Europe/London", True, "2012-01-03 23:16"),
        ("03/01/2012 23:16", "Europe/London", False, "2012-03-01 23:16"),
        ("18.1.12, 14:49:12 Uhr", "Europe/Berlin", None, "2012-01-18 13:49:12"),
        ("2012/01/10T06:39:00+0900", "Asia/Tokyo", None, "2012-01-09 21:39"),
        ("2012-03-09T01:07:31.284599123+05:30", NY, None, "2012-03-08 19:37:31.284599"),
        ("2016-02-29 12:00", "UTC", None, "2016-02-29 12:00"),
    ],
)
def test_notations(text, zone, first, want):
    assert parse(text, zone, first) == (us(want), us(want))


@pytest.mark.parametrize("text", [None, "", "  ", "TBD", "2014-06-10", "0000-00-00 00:00:00", "2013-13-08 09:00", "2015-02-29 10:00", "2012-03-11 02:15:00", "2012-01-01 25:00", "1:75 PM", "x" * 100_000, "2012-01-03 13:05 XYZ"])
def test_no_instant(text):
    assert parse(text) is None


@pytest.mark.parametrize("text, zone, want", [
    ("9999-12-31 23:59:59", NY, 253402300799 + 5 * 3600),
    ("0001-01-01 00:00", "Asia/Tokyo", -62135596800 - (9 * 3600 + 18 * 60 + 59)),
    ("0001-01-01 00:00", "UTC", -62135596800),
    ("9999-07-01 00:00:00", NY, 253386403200 + 4 * 3600),
])
def test_ends_of_the_calendar(text, zone, want):
    assert parse(text, zone) == (want * 1_000_000,) * 2


def test_overlap_has_two_instants():
    lo, hi = parse("2012-11-04 01:36:00")
    assert hi - lo == 3_600_000_000
    assert parse("2012-11-04 01:36:00 EDT") == (lo, lo)


def test_events(spark):
    rows = [
        ("a", "uk", None, "13/01/2012 10:00", None, 1),
        ("b", "uk", None, "02/01/2012 10:00", None, 1),  # the feed's other stamp tells the order
        ("c", "us", None, "2012-11-04 01:36:00", "2012-11-04T01:36:00-05:00", 1),
        ("d", "us", None, None, "2012-01-02 10:00:00", 1),
        ("e", "us", None, "TBD", None, 1),
        ("f", "us", None, "2012-01-02 10:00:00", None, 1),
        ("f", "us", None, "2012-01-02 10:00:00", None, 1),
        ("g", None, None, "2012-01-02 10:00:00", None, 1),
        ("h", "us", None, "2012-01-02 10:00:00", None, 1),
        ("h", "us", None, "2012-01-03 10:00:00", None, 1),
        (None, "us", None, "2012-01-02 10:00:00", None, 1),
    ]
    df = spark.createDataFrame(rows, "event_id string, feed string, feed_zone string, a string, l string, _feed int")
    z = {"a": ("a", F.coalesce("feed_zone", F.lit(NY))), "l": ("l", F.lit(NY))}
    got = {r[0]: r[1] for r in one_instant(normalise_stamps(df, z, keep=("event_id",)), "event_id", ("a", "l"), "us").collect()}
    assert got == {"a": us("2012-01-13 15:00"), "b": us("2012-01-02 15:00"), "c": us("2012-11-04 06:36"), "d": us("2012-01-02 15:00"), "f": us("2012-01-02 15:00"), "g": us("2012-01-02 15:00")}
    assert one_instant(normalise_stamps(df.limit(0), z, keep=("event_id",)), "event_id", ("a", "l"), "us").count() == 0
