"""Greedy clustering of dated rows of an entity into events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import with_number
from tidemark.session import materialise


class Fold:
    """Clusters of the rows of one entity, given in order; the newest cluster that fits takes a row.

    A row joins a cluster that knows its party within ``long_gap`` days of the cluster's
    last row, or within ``short_gap`` days if the row or the cluster has no party.
    """

    def __init__(self, long_gap: int, short_gap: int):
        self.long_gap, self.short_gap = long_gap, short_gap
        self.open: list[dict] = []
        self.made = 0

    def add(self, at, day: int, party: str | None) -> dict:
        """The cluster that takes the row."""
        for c in reversed(self.open):
            gap, parties = day - c["last"], c["parties"]
            if (party in parties and gap <= self.long_gap) if party is not None and parties else gap <= self.short_gap:
                break
        else:
            c = {"number": self.made, "first": at, "last": day, "n": 0, "parties": set()}
            self.made += 1
            self.open.append(c)
        c["last"] = max(c["last"], day)
        c["n"] += 1
        if party is not None:
            c["parties"].add(party)
        return c

    def closed(self, day: int | None) -> list[dict]:
        """Takes out the clusters that no row of ``day`` or later can join (all of them for none)."""
        reach = max(self.long_gap, self.short_gap)
        out = [c for c in self.open if day is None or day - c["last"] > reach]
        if out:
            self.open = [c for c in self.open if not (day is None or day - c["last"] > reach)]
        return out


def fold(rows: list[tuple], long_gap: int, short_gap: int) -> list[int]:
    """Cluster numbers of (day, party) rows in order."""
    f = Fold(long_gap, short_gap)
    return [f.add(None, day, party)["number"] for day, party in rows]


def _pieces(df: DataFrame, entity: str, at: str, tie: str, party: str, reach: int, carried: list[str] = ()) -> DataFrame:
    """``entity, piece, at, day, tie, party`` (and what is carried), an entity cut where nothing can reach across, each piece in order."""
    day = F.unix_date(F.col(at).cast("date"))
    rows = df.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(entity).alias("entity"), F.col(at).alias("at"), day.alias("day"), F.col(tie).alias("tie"), F.col(party).cast("string").alias("party"), *carried)
    w = Window.partitionBy("entity").orderBy("day")
    gap = F.coalesce(F.col("day") - F.lag("day").over(w) > reach, F.lit(True))
    days = rows.select("entity", "day").distinct().withColumn("piece", F.sum(gap.cast("int")).over(w))
    return rows.join(days.hint("merge"), ["entity", "day"]).repartition("entity", "piece").sortWithinPartitions("entity", "piece", "at", "tie")


def assign_clusters(df: DataFrame, entity: str, at: str, tie: str, party: str, long_gap: int = 365, short_gap: int = 30) -> DataFrame:
    """``df`` with each row's ``cluster`` (numbered within its entity) and ``event_index`` (over all, from 1).

    Both numbers follow entity, piece and the order in which clusters began. Rows without
    entity or time are left out.
    """
    pieces = _pieces(df, entity, at, tie, party, max(long_gap, short_gap), [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Fold(long_gap, short_gap), None
        for b in batches:
            got = []
            for e, p, d, who in zip(*(b.column(n).to_pylist() for n in ("entity", "piece", "day", "party")), strict=True):
                if (e, p) != now:
                    held, now = Fold(long_gap, short_gap), (e, p)
                held.closed(d)
                got.append(held.add(None, d, who)["number"])
            yield pa.RecordBatch.from_arrays([b.column("entity"), b.column("piece"), pa.array(got, pa.int64()), b.column("row")], ["entity", "piece", "number", "row"])

    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema.fields}
    rows = materialise(pieces.mapInArrow(run, f"entity {kinds['entity']}, piece bigint, number bigint, row {kinds['row']}"))
    numbers = with_number(rows.select("entity", "piece", "number").distinct(), ["entity", "piece", "number"], "event_index")
    first = numbers.groupBy("entity").agg(F.min("event_index").alias("_first"))
    numbers = numbers.join(first.hint("merge"), "entity").withColumn("cluster", F.col("event_index") - F.col("_first"))
    return rows.join(numbers.hint("merge"), ["entity", "piece", "number"]).select("row.*", "cluster", "event_index")


def cluster_events(df: DataFrame, entity: str, at: str, tie: str, party: str, long_gap: int = 365, short_gap: int = 30) -> DataFrame:
    """One row per cluster: ``entity, first_at, last_day, n_rows, parties, event_index``.

    Rows of an entity more than ``long_gap`` days after all before it can join nothing
    older, so an entity is cut there and the pieces are folded apart: where to cut is told
    by the distinct days of an entity, not by its rows. A piece is read in sorted order and
    only its open clusters are held; without a gap an entity is one piece, as its order
    decides. ``event_index`` numbers the clusters of all entities from 1, by entity, piece
    and the order in which they began. Null entities and times are left out.
    """
    pieces = _pieces(df, entity, at, tie, party, max(long_gap, short_gap))
    kind = pieces.schema["entity"].dataType.simpleString()
    stamp = pieces.schema["at"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, now = Fold(long_gap, short_gap), None
        for b in batches:
            out: list[tuple] = []

            def done(clusters: list[dict], out=out) -> None:
                out.extend((*now, c["number"], c["first"], c["last"], c["n"], ";".join(sorted(c["parties"]))) for c in clusters)

            for e, p, t, d, who in zip(b["entity"].tolist(), b["piece"].tolist(), b["at"].tolist(), b["day"].tolist(), b["party"].where(b["party"].notna(), None).tolist(), strict=True):
                if (e, p) != now:
                    done(held.closed(None))
                    held, now = Fold(long_gap, short_gap), (e, p)
                done(held.closed(d))
                held.add(t, d, who)
            yield pd.DataFrame(out, columns=COLUMNS)
        if now is not None:
            yield pd.DataFrame([(*now, c["number"], c["first"], c["last"], c["n"], ";".join(sorted(c["parties"]))) for c in held.closed(None)], columns=COLUMNS)

    found = pieces.mapInPandas(run, f"entity {kind}, piece bigint, number bigint, first_at {stamp}, last_day int, n_rows bigint, parties string")
    numbered = with_number(found, ["entity", "piece", "number"], "event_index")
    return numbered.select(F.col("entity").alias(entity), "first_at", F.date_from_unix_date("last_day").alias("last_day"), "n_rows", "parties", "event_index")


COLUMNS = ["entity", "piece", "number", "first_at", "last_day", "n_rows", "parties"]
