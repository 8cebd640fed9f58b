"""Per-key results at even load when a few keys hold most rows.

No row moves. Each input split encodes its keys by a dictionary of its own and adds its rows
into dense arrays by ``numpy.bincount``; only the arrays, a row for each key of a split, are
summed across splits, pre-aggregated. The load of a task follows the size of its split,
whatever keys it holds and however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import bounded, materialise

#: Keys whose wanted ranges go to all tasks at most; more are joined.
MOST_KEYS = 200_000
#: Keys of a split's dictionary, and of its value ranges, at which its arrays go out early.
FLUSH = 500_000
#: Ranges that the values of a key's middle range are cut into.
RANGES = 4096


def _ordered(values: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _unordered(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >> np.uint64(63), keys & np.uint64((1 << 63) - 1), ~keys).view(np.float64)


class _Split:
    """The dense arrays of one input split."""

    def __init__(self, sums: int, values: int):
        self.codes: dict[str | None, int] = {}
        self.n, self.sums = np.zeros(0), [np.zeros(0) for _ in range(sums)]
        self.ranges: list[list[np.ndarray]] = [[] for _ in range(values)]
        self.held = 0

    def add(self, b: pa.RecordBatch) -> None:
        words = pc.dictionary_encode(b.column(0), null_encoding="encode")
        code = np.array([self.codes.setdefault(w, len(self.codes)) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy(zero_copy_only=False)]
        m = len(self.codes)
        grown = lambda a: np.concatenate((a, np.zeros(m - len(a)))) if len(a) < m else a
        self.n = grown(self.n) + np.bincount(code, minlength=m)
        for i, a in enumerate(self.sums):
            self.sums[i] = grown(a) + np.bincount(code, pc.fill_null(b.column(1 + i), 0).to_numpy(zero_copy_only=False), m)
        for i, held in enumerate(self.ranges):
            x = b.column(1 + len(self.sums) + i).to_numpy(zero_copy_only=False)
            here = ~np.isnan(x)
            # A key's values by the top 16 bits of their order: sign, exponent and four bits more.
            at, n = np.unique((code[here] << 16) | (_ordered(x[here]) >> np.uint64(48)).astype(np.int64), return_counts=True)
            held.append(np.stack([at, n]))
            self.held += len(at)

    def rows(self) -> pa.RecordBatch:
        keys = np.array(list(self.codes), object)
        parts = [(keys, np.full(len(keys), -1), np.zeros(len(keys), np.int64), self.n.astype(np.int64), self.sums)]
        for i, held in enumerate(self.ranges):
            pairs = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            at, where = np.unique(pairs[0], return_inverse=True)
            n = np.bincount(where, pairs[1], len(at)).astype(np.int64)
            parts.append((keys[at >> 16], np.full(len(at), i), at & 0xFFFF, n, [np.zeros(len(at))] * len(self.sums)))
        flat = lambda i: np.concatenate([p[i] for p in parts])
        sums = [np.concatenate([p[4][i] for p in parts]).round().astype(np.int64) for i in range(len(self.sums))]
        arrays = [pa.array(flat(0), pa.string()), pa.array(flat(1), pa.int32()), pa.array(flat(2), pa.int32()), pa.array(flat(3), pa.int64()), *(pa.array(s, pa.int64()) for s in sums)]
        return pa.RecordBatch.from_arrays(arrays, ["key", "what", "at", "n", *(f"s{i}" for i in range(len(sums)))])


class Accumulators:
    """Dense per-key accumulators over ``df``.

    A null key is a key of its own. Null values and NaN don't count in sums and medians. An
    empty table gives no keys. Any number of keys is worked on in one and the same way.
    """

    def __init__(self, df: DataFrame, key: Column):
        self.df, self.key = df, key.cast("string")

    def _summed(self, sums: list[Column], values: list[Column]) -> DataFrame:
        """``key, what, at, n, s0..`` summed over all splits: what -1 for rows and sums, else the value whose range ``at`` is counted."""
        spread = self.df.select(self.key.alias("k"), *(c.cast("bigint").alias(f"v{i}") for i, c in enumerate(sums)), *(c.cast("double").alias(f"x{i}") for i, c in enumerate(values)))

        shape = len(sums), len(values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split = _Split(*shape)
            for b in batches:
                split.add(b)
                if max(len(split.codes), split.held) > FLUSH:
                    yield split.rows()
                    split = _Split(*shape)
            if split.codes:
                yield split.rows()

        names = [f"s{i}" for i in range(len(sums))]
        parts = spread.mapInArrow(run, "key string, what int, at int, n bigint" + "".join(f", {n} bigint" for n in names))
        return parts.groupBy("key", "what", "at").agg(F.sum("n").alias("n"), *(F.sum(n).alias(n) for n in names))

    def counts(self, sums: dict[str, Column] | None = None) -> DataFrame:
        """``key, n`` and the named sums of bigint columns, one row per key; one pass. Sums are exact below 2**53 a split."""
        sums = sums or {}
        return self._summed(list(sums.values()), []).select("key", "n", *(F.col(f"s{i}").alias(n) for i, n in enumerate(sums)))

    def counts_and_medians(self, sums: dict[str, Column], values: dict[str, Column]) -> DataFrame:
        """``counts`` with the exact median (mean of the middle two) of each named double column, null without values.

        Two passes over the rows: the first, that of the counts, also counts each key's
        values by range, which tells the ranges of the middle two; the second reduces the
        values in those to distinct ones with their counts. They are cut into ranges
        again, so that the last step sorts a ``RANGES``-th of a range of a key.
        """
        first = materialise(self._summed(list(sums.values()), list(values.values())))
        out = first.where("what = -1").select("key", "n", *(F.col(f"s{i}").alias(n) for i, n in enumerate(sums)))
        for i, (name, value) in enumerate(values.items()):
            counts = first.where(F.col("what") == i).select("key", "at", "n")
            m = self._middle(counts, value.cast("double")).withColumnsRenamed({"key": "_k", "median": name})
            out = out.join(m.hint("merge"), out["key"].eqNullSafe(m["_k"]), "left").drop("_k")
        return out

    def medians(self, value: Column, out: str = "median") -> DataFrame:
        """``key, out``: the exact median of a double column."""
        return self.counts_and_medians({}, {out: value}).drop("n")

    def _middle(self, counts: DataFrame, value: Column) -> DataFrame:
        """``key, median`` from the counts of the values' ranges."""
        known = F.struct(F.col("key").isNull().alias("none"), F.coalesce("key", F.lit("")).alias("key"))
        w = Window.partitionBy("k").orderBy("at")
        placed = counts.select(known.alias("k"), "at", "n").withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("k")))
        side = F.explode(F.array(F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2))).alias("rank")
        wanted = placed.select("k", "at", "n", "upto", side).where("rank >= upto - n and rank < upto").select("k", "at", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"))
        bounds = {i: (float(lo), float(hi)) for i, (lo, hi) in enumerate(_bounds())}

        def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at = b.column("at").to_numpy(zero_copy_only=False)
                lo, hi = (pa.array([bounds[int(i)][s] for i in at], pa.float64()) for s in (0, 1))
                yield pa.RecordBatch.from_arrays([*b.columns, lo, hi], [*b.schema.names, "lo", "hi"])

        kind = wanted.schema["k"].dataType.simpleString()
        ranges = wanted.select("k", "at", "rank").mapInArrow(limits, f"k {kind}, at int, rank bigint, lo double, hi double")
        ranges = materialise(ranges)
        places = bounded(ranges.select("k", "at", "lo", "hi").distinct(), 2 * MOST_KEYS)
        x = self.df.select(F.struct(self.key.isNull().alias("none"), F.coalesce(self.key, F.lit("")).alias("key")).alias("k"), (value + F.lit(0.0)).alias("x")).where("x is not null and not isnan(x)")
        inside = materialise(x.join(places, "k").where("x >= lo and x <= hi").groupBy("k", "at", "x").agg(F.count("*").alias("n")))
        # The same again within the range: first by parts of it, then by value.
        ends = inside.groupBy("k", "at").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        part = F.coalesce(F.least(F.floor((F.col("x") / 2 - F.col("a") / 2) / (F.nullif(F.col("b") / 2 - F.col("a") / 2, F.lit(0.0))) * RANGES), F.lit(RANGES - 1)), F.lit(0)).cast("int")
        cut = inside.join(ends.hint("merge"), ["k", "at"]).withColumn("part", part)
        found = _ranked(cut.groupBy("k", "at", "part").agg(F.sum("n").alias("n")), ranges.select("k", "at", "rank"), ["k", "at"], "part")
        one = _ranked(cut.join(found.select("k", "at", "part").distinct().hint("merge"), ["k", "at", "part"]).select("k", "at", "part", "x", "n"), found, ["k", "at", "part"], "x")
        # One row where both middle ranks are one: its value twice is the value.
        return one.groupBy("k").agg((F.sum("x") / F.count("*")).alias("median")).select(F.when(~F.col("k.none"), F.col("k.key")).alias("key"), "median")


def _bounds() -> np.ndarray:
    """The least and largest double of each range of the top 16 bits."""
    top = np.arange(1 << 16, dtype=np.uint64) << np.uint64(48)
    return np.stack([_unordered(top), _unordered(top | np.uint64((1 << 48) - 1))], 1)


def _ranked(counts: DataFrame, wanted: DataFrame, keys: list[str], by: str) -> DataFrame:
    """For each wanted rank (0 first) of the keys where it falls in ``by``, and the rank within that."""
    w = Window.partitionBy(*keys).orderBy(by)
    upto = counts.withColumn("_upto", F.sum("n").over(w))
    met = wanted.select(*keys, "rank").join(upto.hint("merge"), keys).where("rank >= _upto - n and rank < _upto")
    return met.select(*keys, by, (F.col("rank") - (F.col("_upto") - F.col("n"))).alias("rank"))
