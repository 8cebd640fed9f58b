"""Quotes, prices and buckets as Column expressions. All are null-safe as their docstrings say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_quote(bid: Column | str, ask: Column | str) -> Column:
    """Both sides positive and not crossed (locked is fine); never null."""
    bid, ask = _c(bid), _c(ask)
    return F.coalesce((bid > 0) & (ask > 0) & (ask >= bid), F.lit(False))


def midpoint(bid: Column | str, ask: Column | str) -> Column:
    """The middle of a valid quote, else null."""
    return F.when(valid_quote(bid, ask), (_c(bid) + _c(ask)) / 2)


def relative_spread(bid: Column | str, ask: Column | str) -> Column:
    """Spread over midpoint of a valid quote, else null."""
    mid = midpoint(bid, ask)
    return F.when(mid > 0, (_c(ask) - _c(bid)) / mid)


def price_or(bid: Column | str, ask: Column | str, fallback: Column | str | None = None) -> Column:
    """The midpoint, else a positive fallback, else null."""
    mid = midpoint(bid, ask)
    return mid if fallback is None else F.coalesce(mid, F.when(_c(fallback) > 0, _c(fallback)))


def any_present(*columns: str) -> Column:
    """Whether any of the columns holds a value; false for no columns."""
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns], F.lit(False))


def short_code(c: Column | str, codes: dict[str, str]) -> Column:
    """Trimmed upper case text with its long forms replaced; others pass through."""
    t = F.upper(F.btrim(_c(c), F.lit(" \t\r\n")))
    return F.coalesce(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[t], t)


def composite_key(*parts: Column | str) -> Column:
    """Parts joined by ``|``; null if any part is (unlike ``concat_ws``, which would make up keys)."""
    out: list[Column] = []
    for p in parts:
        out += [F.lit("|"), _c(p).cast("string")]
    return F.concat(*out[1:])


def tier(c: Column | str, bounds: list[tuple[float, str]], beyond: str) -> Column:
    """The label of the first bound that isn't exceeded, ``beyond`` after the last and for null."""
    c = _c(c)
    out = F.when(c <= bounds[0][0], bounds[0][1])
    for b, label in bounds[1:]:
        out = out.when(c <= b, label)
    return out.otherwise(beyond)


def within(c: Column | str, ranges: list[tuple[Column, float, float, bool, str]], other: str) -> Column:
    """The label of the first (condition, low, high, closed, label) that holds, else ``other``."""
    c = _c(c)
    out: Column | None = None
    for cond, lo, hi, closed, label in ranges:
        hit = cond & (c.between(lo, hi) if closed else (c > lo) & (c < hi))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(other)


def log_plus_one(c: Column | str) -> Column:
    """``log(x + 1)`` of what isn't negative, else null."""
    c = _c(c).cast("double")
    return F.when(c >= 0, F.log(c + 1))
