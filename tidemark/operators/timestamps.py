"""Mixed timestamp notations to one instant per key.

All notations are one compiled alternation with named groups; each text is matched once,
its components are checked against the calendar, and instants are put together from
integer days. A wall clock is turned to UTC through its zone; one that falls in a
daylight-saving gap has no instant and one in an overlap has two.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import bounded, spread

#: Feeds whose orders are broadcast at most; of more they are joined.
MOST_FEEDS = 100_000
# Month names and the zone names that feeds print.
MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
FIXED_ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "jst": 540, "ist": 330, "hkt": 480,
}
NAMED_ZONES = {"et": "America/New_York", "eastern": "America/New_York", "ct": "America/Chicago", "central": "America/Chicago", "pt": "America/Los_Angeles", "pacific": "America/Los_Angeles"}

_Y, _YY, _MO, _D = r"(?P<y>\d{4})", r"(?P<yy>\d{2})", r"(?P<mo>\d{1,2})", r"(?P<d>\d{1,2})"
_NAME = r"(?P<mon>[A-Za-z]{3,9})\.?"
_CLOCK = r"(?P<h>\d{1,2})[:.](?P<mi>\d{2})(?:[:.](?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_TIME = rf"{_CLOCK}(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?:(?P<off>[+-]\d{2}:?\d{2})|(?P<z>[A-Za-z]{1,7})))?"
_SEP = r"(?:,?\s+|T)"
NOTATIONS = (
    r"(?P<epoch>\d{9,10}|\d{12,13}|\d{15,16}|\d{18,19})",
    r"(?P<y>\d{4})(?P<mo>\d{2})(?P<d>\d{2})T?(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})" + _ZONE,
    rf"{_Y}[-/.]{_MO}[-/.]{_D}{_SEP}{_TIME}{_ZONE}",
    rf"(?P<n1>\d{{1,2}})(?P<sep>[-/.])(?P<n2>\d{{1,2}})[-/.](?:{_Y}|{_YY}){_SEP}{_TIME}{_ZONE}",
    rf"(?:[A-Za-z]{{2,9}},?\s+)?{_D}\.?\s+{_NAME}\s+{_Y}{_SEP}{_TIME}{_ZONE}",
    rf"(?:[A-Za-z]{{2,9}},\s+)?{_NAME}\s+{_D},?\s+{_Y}{_SEP}{_TIME}{_ZONE}",
    rf"{_TIME}(?:\s+(?P<z>[A-Za-z]{{1,7}}))?,\s+{_NAME}\s+{_D},?\s+{_Y}",
)
STAMP = regex.compile("|".join(f"(?:{n})" for n in NOTATIONS))
GROUPS = ("epoch", "y", "yy", "mo", "mon", "d", "n1", "n2", "sep", "h", "mi", "s", "f", "ap", "off", "z")


def days_from_civil(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 of proleptic Gregorian dates, in integers only."""
    y = y - (m <= 2)
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + np.where(m > 2, -3, 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


@lru_cache(maxsize=1 << 16)
def _offsets(zone: str, y: int, m: int, d: int, h: int, mi: int) -> tuple[int, ...]:
    """UTC offsets in seconds at which this wall clock exists in ``zone``: none, one or two."""
    try:
        tz = ZoneInfo(zone)
    except (KeyError, ValueError, OSError):
        return ()
    # At the ends of the calendar offsets are taken from the same day of another 400-year cycle.
    y += 400 if y < 400 else -400 if y > 9600 else 0
    out = []
    for fold in (0, 1):
        local = datetime(y, m, d, h, mi, tzinfo=tz, fold=fold)
        off = local.utcoffset()
        back = (local - off).replace(tzinfo=ZoneInfo("UTC")).astimezone(tz)
        if back.replace(tzinfo=None) == local.replace(tzinfo=None):
            out.append(int(off.total_seconds()))
    return tuple(sorted(set(out), reverse=True))


def parse_stamps(text: pd.Series, zone: pd.Series, day_first: pd.Series) -> pd.DataFrame:
    """``lo`` and ``hi`` instants in microseconds for each text.

    ``zone`` is the zone of texts that name none, ``day_first`` the order of numeric dates
    (null where the feed never told). Both results are null where the text gives no
    instant; they differ where it gives two.
    """
    hits = [STAMP.fullmatch(t.strip()) if isinstance(t, str) else None for t in text]
    parts = {g: [None] * len(hits) for g in GROUPS}
    for i, m in enumerate(hits):
        if m:
            for g, v in m.groupdict().items():
                if v is not None:
                    parts[g][i] = v
    num = lambda g: pd.to_numeric(pd.Series(parts[g], dtype=object), errors="coerce").fillna(-1).to_numpy(np.int64)
    y, yy, mo, d, n1, n2, h, mi, s = (num(g) for g in ("y", "yy", "mo", "d", "n1", "n2", "h", "mi", "s"))
    y = np.where((y < 0) & (yy >= 0), np.where(yy < 70, 2000 + yy, 1900 + yy), y)
    mo = np.where([v is not None for v in parts["mon"]], [MONTHS.get((v or "")[:3].lower(), 0) for v in parts["mon"]], mo)
    # Numeric dates: the feed's order; where it never told, dots mean the day first and slashes the month.
    dot = np.array([v == "." for v in parts["sep"]])
    first = np.array([bool(v) if v is not None and v == v else bool(p) for v, p in zip(day_first, dot, strict=True)], dtype=bool)
    mo = np.where(n1 >= 0, np.where(first, n2, n1), mo)
    d = np.where(n1 >= 0, np.where(first, n1, n2), d)
    pm = np.array([v is not None and v in "Pp" for v in parts["ap"]])
    half = np.array([v is not None for v in parts["ap"]])
    fine = ~half | ((h >= 1) & (h <= 12))
    h = np.where(half, h % 12 + 12 * pm, h)
    s = np.where(s < 0, 0, s)
    f = np.array([int((v or "0").ljust(9, "0")) // 1000 for v in parts["f"]], dtype=np.int64)
    length = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 1, 12) - 1] + ((mo == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))
    fine &= (y >= 1) & (y <= 9999) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= length) & (h >= 0) & (h <= 23) & (mi >= 0) & (mi <= 59) & (s <= 59)
    wall = (days_from_civil(y, np.clip(mo, 1, 12), d) * 86_400 + h * 3600 + mi * 60 + s) * 1_000_000 + f
    lo, hi = [None] * len(hits), [None] * len(hits)
    for i, m in enumerate(hits):
        if m is None:
            continue
        if (e := parts["epoch"][i]) is not None:
            n = int(e)
            lo[i] = hi[i] = n * 1_000_000 if len(e) <= 10 else n * 1000 if len(e) <= 13 else n if len(e) <= 16 else n // 1000
            continue
        if not fine[i]:
            continue
        off, name = parts["off"][i], (parts["z"][i] or "").lower()
        if off is not None:
            hh, mm = int(off[1:3]), int(off[-2:])
            found: tuple[int, ...] = ((-1 if off[0] == "-" else 1) * (hh * 60 + mm) * 60,) if hh <= 15 and mm <= 59 else ()
        elif name in FIXED_ZONES:
            found = (FIXED_ZONES[name] * 60,)
        elif name and name not in NAMED_ZONES and name != "uhr":
            found = ()
        else:
            found = _offsets(NAMED_ZONES.get(name) or zone.iloc[i], int(y[i]), int(mo[i]), int(d[i]), int(h[i]), int(mi[i]))
        if found:
            lo[i], hi[i] = int(wall[i]) - found[0] * 1_000_000, int(wall[i]) - found[-1] * 1_000_000
    return pd.DataFrame({"lo": pd.array(lo, dtype="Int64"), "hi": pd.array(hi, dtype="Int64")})


def day_first(stamp: Column | str) -> Column:
    """Aggregate: whether numeric dates put the day first, by most of those that tell; null where none does or as many say either."""
    first = F.regexp_extract(stamp, r"^\s*(\d{1,2})[-/.]\d{1,2}[-/.]\d{2,4}\D", 1).try_cast("int")
    second = F.regexp_extract(stamp, r"^\s*\d{1,2}[-/.](\d{1,2})[-/.]\d{2,4}\D", 1).try_cast("int")
    day, month = F.count_if(first > 12), F.count_if(second > 12)
    return F.when(day != month, day > month)


def normalise_stamps(df: DataFrame, stamps: dict[str, tuple[str, Column]], feed: str = "feed", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``keep`` plus ``<name>_lo``/``<name>_hi`` microsecond instants for each stamp.

    ``stamps`` maps a name to (text column, zone of texts that name none). Null, blank and
    unreadable texts give null instants; a gap in the wall clock gives null, an overlap two
    different values, otherwise both are equal. Repeated rows stay. The order of day and
    month is counted per feed over all rows (one pre-aggregated pass, a row per feed, which
    goes to all tasks only if there are few feeds). Rows don't move but to make up for a
    table of fewer splits than cores.
    """
    rows = df.select(*keep, F.col(feed).alias("_feed"), *(F.col(c).cast("string").alias(f"_t_{n}") for n, (c, _) in stamps.items()), *(z.alias(f"_z_{n}") for n, (_, z) in stamps.items()))
    orders = rows.groupBy(F.col("_feed").alias("_of")).agg(*(day_first(f"_t_{n}").alias(f"_o_{n}") for n in stamps))
    rows = spread(rows).join(bounded(orders, MOST_FEEDS), F.col("_feed").eqNullSafe(F.col("_of")), "left").drop("_of")
    names = list(stamps)
    kept = [f for f in df.select(*keep).schema.fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}_{e}` bigint" for n in names for e in ("lo", "hi")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = b[list(keep)].copy()
            for n in names:
                got = parse_stamps(b[f"_t_{n}"], b[f"_z_{n}"], b[f"_o_{n}"])
                out[f"{n}_lo"], out[f"{n}_hi"] = got["lo"].to_numpy(), got["hi"].to_numpy()
            yield out

    return rows.mapInPandas(run, schema)


def one_instant(df: DataFrame, key: str, names: tuple[str, ...], out: str) -> DataFrame:
    """One row per key whose instant is determined: the first of ``names`` that gives exactly one.

    All rows of a key count (partial aggregation, so a key that fills a third of the table
    costs one row per task): a name decides if its unambiguous rows agree on one instant.
    """
    aggs = []
    for n in names:
        one = F.when(F.col(f"{n}_lo") == F.col(f"{n}_hi"), F.col(f"{n}_lo"))
        aggs += [F.min(one).alias(f"_a_{n}"), F.max(one).alias(f"_b_{n}")]
    pick = F.coalesce(*(F.when(F.col(f"_a_{n}") == F.col(f"_b_{n}"), F.col(f"_a_{n}")) for n in names))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs).select(key, pick.alias(out)).where(F.col(out).isNotNull())
