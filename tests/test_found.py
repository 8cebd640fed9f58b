"""The queries of stamps and drifting files against readings of their own."""

import csv
import re
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from pathlib import Path
from zoneinfo import ZoneInfo

import pandas as pd
import pytest

import __spark_entry__ as E

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test data")
NAMED = {"EST": -5, "EDT": -4, "Z": 0, "UTC": 0, "UT": 0, "GMT": 0}


def instant(text, zone):
    """Microseconds of a stamp in a notation that the standard library knows; None for others, "none" where the wall clock isn't one instant."""
    t = text.strip()
    t = re.sub(r"(\.\d{6})\d+", r"\1", t)
    found = None
    if re.match(r"\d{4}-\d\d-\d\d[T ]\d\d:\d\d", t):
        try:
            found = datetime.fromisoformat(t)
        except ValueError:
            return None
    elif re.match(r"[A-Z][a-z]{2}, \d", t) and re.search(r"[+-]\d{4}$", t):
        found = parsedate_to_datetime(t)
    elif m := re.fullmatch(r"([A-Z][a-z]{2,8} \d{1,2}, \d{4} \d{1,2}:\d\d [AP]M) (E[SD]T)", t):
        try:
            found = datetime.strptime(m[1], "%b %d, %Y %I:%M %p" if len(m[1].split()[0]) == 3 else "%B %d, %Y %I:%M %p").replace(tzinfo=timezone(timedelta(hours=NAMED[m[2]])))
        except ValueError:
            return None
    if found is None:
        return None
    if found.tzinfo is None:
        here = [found.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1)]
        if here[0].utcoffset() != here[1].utcoffset():
            return "none"
        found = here[0]
    return round((found - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


def test_stamps(spark):
    e = pd.read_parquet(f"{FOLDER}/event_alignment.parquet")
    got = {r.event_id: r.announcement_us for r in E.queries()["p3_found"](spark, FOLDER).collect()}
    assert len(got) == len(set(got)) and set(got) <= set(e.event_id)
    known = 0
    for event, rows in e.groupby("event_id"):
        read = {instant(t, z if isinstance(z, str) else "America/New_York") if isinstance(t, str) else None for t, z in zip(rows.announcement_dt, rows.feed_zone, strict=True)}
        if len(read) == 1 and isinstance(us := read.pop(), int):
            known += 1
            assert got[event] == us, (event, rows.announcement_dt.tolist())
    assert known > 0.2 * e.event_id.nunique()


def test_changes_of_files(spark):
    lines = pd.read_parquet(f"{FOLDER}/panel_file_lines.parquet")
    heads = lines[(lines.line_no == 0) & lines.line_text.notna()].sort_values("line_text").drop_duplicates("file_id")
    split = lambda t: [x.lstrip("\ufeff") for x in max((next(csv.reader([t], delimiter=d)) for d in ",;|\t"), key=len)]
    names = {f: split(t) for f, t in zip(heads.file_id, heads.line_text, strict=True)}
    changes = {}
    for r in E.queries()["p6_found"](spark, FOLDER).collect():
        changes.setdefault(r.file_id, []).append(r.change_kind)
    pairs = same = 0
    for _, files in heads.sort_values(["file_date", "file_id"]).groupby("stream"):
        ids = files.file_id.tolist()
        assert ids[0] not in changes
        for before, now in zip(ids, ids[1:], strict=False):
            pairs += 1
            kinds = changes.get(now, [])
            if set(names[before]) == set(names[now]):
                same += 1
                assert not set(kinds) - {"retyped"}, (now, kinds)
            # Whatever is added or removed changes the number of columns; a new text without a new column is a rename.
            assert kinds.count("added") - kinds.count("removed") == len(names[now]) - len(names[before]), (now, kinds)
            assert kinds.count("added") + kinds.count("renamed") == len(set(names[now]) - set(names[before])), (now, kinds)
    assert pairs > 50 and same > 5
