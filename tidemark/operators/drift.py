"""Delimited files whose columns drift: one consistent table and a report of every change."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.flooding import correspond
from tidemark.operators.ordering import with_previous
from tidemark.session import bounded, materialise, spread

DELIMITERS = ",;|\t"
BLANK = {"", "n/a", "na", "null"}
KIND = re.compile(
    r"(?P<compact>(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]))|(?P<integer>[+-]?\d+)"
    r"|(?P<decimal>[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<date>\d{4}-\d{2}-\d{2})|(?P<boolean>[Tt][Rr][Uu][Ee]|[Ff][Aa][Ll][Ss][Ee])"
)
#: Files whose delimiters go to all tasks at most; lines of more are joined with them.
MOST_FILES = 300_000


def delimiter_of(line: str) -> str:
    """The delimiter that occurs most outside quotes (the first of ``DELIMITERS`` among equals)."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(DELIMITERS, key=bare.count)


def cells(line: str, delimiter: str) -> list[str]:
    """The cells of one line, unquoted; never fails on a broken quote."""
    if '"' not in line:
        return line.split(delimiter)
    try:
        return next(csv.reader([line], delimiter=delimiter), [""])
    except csv.Error:
        return line.split(delimiter)


def kind_of(value: str) -> str | None:
    """integer, decimal, date, boolean or text; ``compact`` for an integer that reads as a date; null for a blank."""
    v = value.strip()
    if len(v) < 5 and v.lower() in BLANK:
        return None
    m = KIND.fullmatch(v)
    return m.lastgroup if m else "text"


def _headers(lines: DataFrame) -> DataFrame:
    """``file_id, stream, file_date, delimiter, header`` of each file (of several first lines the least text)."""
    first = lines.where((F.col("line_no") == 0) & F.col("line_text").isNotNull()).groupBy("file_id").agg(F.min("stream").alias("stream"), F.min("file_date").alias("file_date"), F.min("line_text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = b["text"].map(delimiter_of)
            yield b.drop(columns="text").assign(delimiter=d, header=[cells(t.lstrip("﻿"), x) for t, x in zip(b["text"], d, strict=True)])

    return first.mapInPandas(run, "file_id bigint, stream string, file_date date, delimiter string, header array<string>")


def _kinds(lines: DataFrame, heads: DataFrame) -> DataFrame:
    """``file_id, pos, kind, n``: how many cells of a column are of which kind, counted within tasks first."""
    known = heads.select("file_id", "delimiter", F.size("header").alias("width"))
    rows = spread(lines.where("line_no > 0 and line_text is not null").select("file_id", "line_text")).join(bounded(known, MOST_FILES), "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter = Counter()
            for f, t, d, w in zip(b["file_id"], b["line_text"], b["delimiter"], b["width"], strict=True):
                row = cells(t, d)
                if len(row) == w:
                    n.update((f, i, k) for i, k in enumerate(map(kind_of, row)) if k)
            yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["file_id", "pos", "kind", "n"])

    return rows.mapInPandas(run, "file_id bigint, pos int, kind string, n bigint").groupBy("file_id", "pos", "kind").agg(F.sum("n").alias("n"))


def file_columns(lines: DataFrame, canonical: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row per file: ``file_id, stream, file_date, delimiter, columns`` (name, header, kind, pos).

    A file is a header (line 0) and data lines; lines without a header are left out, lines
    with another number of cells don't count for types. The kind of a column is that of most
    of its non-blank cells (the first by name among equals), null where all are blank. Each
    distinct schema is matched by similarity flooding; a column that fits nothing keeps its
    own name. Null texts, lines without file and an empty table give nothing; columns of
    ``lines`` beyond the ones used are left out.
    """
    heads = materialise(_headers(lines))
    counts = _kinds(lines, heads)
    plain = counts.withColumn("base", F.when(F.col("kind") == "compact", "integer").otherwise(F.col("kind"))).groupBy("file_id", "pos", "base").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("kind") == "compact", F.col("n"))).alias("compact"))
    best = plain.groupBy("file_id", "pos").agg(F.min_by(F.struct("base", (F.coalesce("compact", F.lit(0)) * 2 > F.col("n")).alias("compact")), F.struct(-F.col("n"), "base")).alias("b"))
    found = best.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "b"))).alias("kinds"))
    files = heads.join(found.hint("merge"), "file_id", "left")
    at = lambda i: F.col("kinds")[i]
    files = files.withColumn("cols", F.transform("header", lambda h, i: F.struct(h.alias("header"), at(i)["base"].alias("kind"), at(i)["compact"].alias("compact")))).drop("kinds", "header")

    files = materialise(files)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for cols in b["cols"]:
                header = tuple(c["header"] for c in cols)
                got = correspond(header, tuple("date" if c["compact"] else c["kind"] for c in cols), canonical)
                out.append([{"name": n or h, "header": h, "kind": c["kind"], "pos": i} for i, (n, h, c) in enumerate(zip(got, header, cols, strict=True))])
            yield b.assign(columns=out)

    kind = files.schema["cols"].dataType.simpleString()
    schemas = files.select("cols").distinct().repartition(files.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, f"cols {kind}, columns array<struct<name:string,header:string,kind:string,pos:int>>")
    return files.join(schemas.hint("merge"), "cols").select("file_id", "stream", "file_date", "delimiter", "columns")


def changes(files: DataFrame) -> DataFrame:
    """``file_id, column_name, change_kind`` against the previous file of the stream by date and id.

    added, removed, renamed (another header text) and retyped (another kind, both known).
    The first file of a stream has no changes.
    """
    files = materialise(files)
    order = with_previous(files.select("stream", "file_date", "file_id"), "stream", ["file_date", "file_id"], "file_id", "before").where("before is not null")
    cols = files.select(F.col("file_id").alias("f"), F.explode("columns").alias("c")).select("f", F.col("c.name").alias("column_name"), F.col("c.header").alias("header"), F.col("c.kind").alias("kind"))
    cols = cols.groupBy("f", "column_name").agg(F.min("header").alias("header"), F.min("kind").alias("kind"))
    pairs = order.select("file_id", "before")
    cols = cols.hint("merge")
    now = pairs.join(cols, pairs["file_id"] == cols["f"]).select("file_id", "column_name", F.col("header").alias("h1"), F.col("kind").alias("k1"))
    old = pairs.join(cols, pairs["before"] == cols["f"]).select("file_id", "column_name", F.col("header").alias("h0"), F.col("kind").alias("k0"))
    both = now.join(old.hint("merge"), ["file_id", "column_name"], "full")
    what = F.array_compact(F.array(
        F.when(F.col("h0").isNull(), F.lit("added")),
        F.when(F.col("h1").isNull(), F.lit("removed")),
        F.when(F.col("h0") != F.col("h1"), F.lit("renamed")),
        F.when(F.col("k0") != F.col("k1"), F.lit("retyped")),
    ))
    return both.select("file_id", "column_name", F.explode(what).alias("change_kind"))


def _typed(c: Column, kind: str) -> Column:
    """A cell text cast leniently: currency marks dropped, both date forms, several spellings of a boolean."""
    number = F.regexp_replace(c, r"^[A-Z]{3}\s+", "")
    if kind == "integer":
        return F.round(number.try_cast("double")).cast("bigint")
    if kind == "decimal":
        return number.try_cast("double")
    if kind == "date":
        return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, r"\.0*$", ""), F.lit("yyyyMMdd")).cast("date"), c.try_cast("date"))
    if kind == "boolean":
        return F.when(F.lower(c).isin("true", "t", "y", "yes", "1"), True).when(F.lower(c).isin("false", "f", "n", "no", "0"), False)
    return c


def consistent_table(lines: DataFrame, files: DataFrame, canonical: tuple[tuple[str, str], ...]) -> DataFrame:
    """Every data line once, in canonical columns and types: ``line_id, file_id`` and the canonical columns.

    A blank, a missing column or a cell that can't be cast is null; cells beyond the header
    are left out. Repeated lines stay.
    """
    names = [n for n, _ in canonical]
    # Of two columns of one name the first counts.
    place = lambda n: F.coalesce(F.get(F.filter("columns", lambda c: c["name"] == n), F.lit(0))["pos"], F.lit(-1))
    pos = [place(n) for n in names]
    slots = files.select("file_id", "delimiter", F.array(*pos).alias("slots"))
    rows = spread(lines.where("line_no > 0 and line_text is not null").select("line_id", "file_id", "line_text")).join(bounded(slots, MOST_FILES), "file_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t, d, s in zip(b["line_text"], b["delimiter"], b["slots"], strict=True):
                row = cells(t, d)
                out.append([v if 0 <= i < len(row) and (v := row[i].strip()).lower() not in BLANK else None for i in s])
            yield pd.concat([b[["line_id", "file_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names, dtype=object)], axis=1)

    text = rows.mapInPandas(run, "line_id bigint, file_id bigint, " + ", ".join(f"{n} string" for n in names))
    return text.select("line_id", "file_id", *(_typed(F.col(n), k).alias(n) for n, k in canonical))
