"""Text taken out of filings: plain text, labels, excerpts, parties. Built-in expressions but for entities."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Comments and tags. A bracket that no name follows is text, one in a quoted value ends no
# tag; a tag of more values than the first form counts ends at its first bracket.
_TAG = r"""(?s)<!--.*?-->|<(?:!|[/?]?[A-Za-z])(?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=){0,500}+>|<(?:!|[/?]?[A-Za-z])[^>]*>"""
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")


@F.pandas_udf(StringType())
def _decoded(texts: pd.Series) -> pd.Series:
    """Every named or numbered entity once, so that ``&amp;lt;`` gives ``&lt;``."""
    return texts.map(lambda t: _ENTITY.sub(lambda m: html.unescape(m.group()), t), na_action="ignore")


def plain_text(c: Column | str, header_end: str | None = None) -> Column:
    """Markup without scripts, tags and entities, white space collapsed; only what follows ``header_end`` if given."""
    c = F.col(c) if isinstance(c, str) else c
    if header_end:
        at = F.locate(header_end, c)
        c = F.when(at > 0, F.substr(c, at + len(header_end))).otherwise(c)
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = _decoded(F.regexp_replace(c, _TAG, " "))
    return F.trim(F.regexp_replace(c, "[\\s\u00a0]+", " "))


def label_hits(c: Column | str, labels: dict[str, str]) -> Column:
    """The labels whose whole-word pattern occurs, in the labels' order; an empty array for null."""
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.array_compact(F.array(*(F.when(c.rlike(rf"(?i)\b(?:{p})\b"), F.lit(n)) for n, p in labels.items())))


def label_score(hits: Column, weights: dict[str, int]) -> Column:
    """The sum of the weights of the labels hit."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.aggregate(hits, F.lit(0), lambda a, x: a + F.coalesce(table[x], F.lit(0)))


def excerpt(c: Column | str, labels: dict[str, str], before: int = 120, after: int = 240) -> Column:
    """The surroundings of the first label in the labels' order that occurs; null if none does."""
    c = F.col(c) if isinstance(c, str) else c
    cuts = []
    for p in labels.values():
        # What stands before the first hit tells where it is.
        head = F.regexp_extract(c, rf"(?is)^(.*?)\b(?:{p})\b", 1)
        start = F.greatest(F.length(head) - before, F.lit(0))
        cuts.append(F.when(c.rlike(rf"(?i)\b(?:{p})\b"), F.substr(c, start + 1, F.length(head) - start + after)))
    return F.coalesce(*cuts)


def clean_capture(c: Column, stops: tuple[str, ...], most: int = 12) -> Column:
    """A captured name up to the first stop word, trimmed; null if empty or of more than ``most`` words."""
    cut = F.split(c, rf"(?i)\b(?:{'|'.join(stops)})\b", 2)[0]
    text = F.regexp_replace(F.regexp_replace(cut, r"[\s ]+", " "), r"^[\s,.;:-]+|[\s,.;:-]+$", "")
    return F.when((text != "") & (F.size(F.split(text, " ")) <= most), text)


def parties(c: Column | str, patterns: tuple[str, ...], stops: tuple[str, ...]) -> Column:
    """``struct(first, second)`` of the first pattern whose two captures are both usable; null if none is."""
    c = F.col(c) if isinstance(c, str) else c
    found = []
    for p in patterns:
        a, b = (clean_capture(F.nullif(F.regexp_extract(c, p, i), F.lit("")), stops) for i in (1, 2))
        found.append(F.when(a.isNotNull() & b.isNotNull(), F.struct(a.alias("first"), b.alias("second"))))
    return F.coalesce(*found)


def header_field(c: Column | str, section: str, field: str, end: str = "</SEC-HEADER>") -> Column:
    """The first ``field:`` line after the ``section:`` line and before ``end``; null if there is none."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.substring_index(c, end, 1)
    return F.nullif(F.trim(F.regexp_extract(head, rf"(?ms)^\s*{section}:.*?^\s*{field}:\s*([^\n]*)", 1)), F.lit(""))


def display_names(c: Column | str) -> Column:
    """``array<struct<name, ticker, cik>>`` of texts like ``VARIAN INC (VAR) (CIK 0001012345)``; parts that miss are null."""
    c = F.col(c) if isinstance(c, str) else c
    pattern = r"([^();|]+?)\s*(?:\(([A-Z][A-Z0-9.\-, ]*)\)\s*)?\(CIK\s+(\d{1,10})\)"
    part = lambda i: F.regexp_extract_all(c, F.lit(pattern), F.lit(i))
    zipped = F.arrays_zip(part(1).alias("name"), part(2).alias("ticker"), part(3).alias("cik"))
    return F.transform(zipped, lambda x: F.struct(F.nullif(F.trim(x["name"]), F.lit("")).alias("name"), F.nullif(x["ticker"], F.lit("")).alias("ticker"), F.lpad(x["cik"], 10, "0").alias("cik")))


def name_matches(name: Column | str, query: Column | str, slug) -> Column:
    """Same slug, or one of at least two words that the other starts with; false for a null."""
    a, b = slug(name), slug(query)
    starts = lambda x, y: (F.size(F.split(y, "_")) >= 2) & F.startswith(x, F.concat(y, F.lit("_")))
    return F.coalesce((a == b) | starts(a, b) | starts(b, a), F.lit(False))
