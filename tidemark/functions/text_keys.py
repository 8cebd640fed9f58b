"""Normalisers of identifiers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of all kinds that ends of texts are trimmed of.
SPACE = " \t\n\r\x0b\x0c\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def symbol(c: Column | str) -> Column:
    """Without white space at its ends, upper case, with ``/`` and ``-`` read as ``.``; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.upper(F.btrim(c, F.lit(SPACE))), "/-", "..")


def cik10(c: Column | str) -> Column:
    """The digits, with leading zeros up to ten characters and never cut; null where there is none.

    A number column that came as a double gives its whole part.
    """
    c = F.col(c) if isinstance(c, str) else c
    whole = F.regexp_replace(c.try_cast("decimal(38,0)").cast("string"), r"\D", "")
    digits = F.regexp_replace(F.regexp_replace(F.when(F.typeof(c).isin("double", "float"), whole).otherwise(c.cast("string")), r"\D", ""), r"^0+", "")
    return F.when(F.length(digits) > 10, digits).when(digits != "", F.lpad(digits, 10, "0"))


def gvkey(c: Column | str) -> Column:
    """Integer text without padding; null where the text is no integer."""
    c = F.col(c) if isinstance(c, str) else c
    digits = F.regexp_extract(F.trim(c.cast("string")), r"^\D*0*(\d+)(?:\.0*)?$", 1)
    return F.when(digits != "", digits)


# Legal and filler words that a slug leaves out.
SLUG_WORDS = ("inc", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "holdings", "group", "llc", "lp", "incorporated")


def slug(c: Column | str, words: int = 8, dropped: tuple[str, ...] = SLUG_WORDS) -> Column:
    """The first words of a name, lower case, joined by ``_``; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    parts = F.filter(F.split(F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")), " "), lambda w: (w != "") & ~w.isin(*dropped))
    return F.nullif(F.array_join(F.slice(parts, 1, words), "_"), F.lit(""))
