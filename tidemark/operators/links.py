"""Scored yearly links between entities: standard form, both directions, best pairs, ranks, bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.panel import first_present


def both_ways(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Each link also with its sides swapped, in one pass over the rows."""
    swap = {**pairs, **{v: k for k, v in pairs.items()}}
    there = F.struct(*(F.col(c).alias(c) for c in df.columns))
    back = F.struct(*(F.col(swap.get(c, c)).alias(c) for c in df.columns))
    return df.select(F.explode(F.array(there, back)).alias("l")).select("l.*")


def best_pairs(df: DataFrame, keys: list[str], score: str, attributes: list[str], order: list[str]) -> DataFrame:
    """One row per pair: the highest score and the first attributes present, in the declared order."""
    at = F.struct(*order)
    return df.groupBy(*keys).agg(F.max(score).alias(score), *(first_present(a, at).alias(a) for a in attributes))


def ranked(df: DataFrame, group: list[str], score: str, tie: str) -> DataFrame:
    """``link_rank`` by descending score (ties by ``tie``, null for no score), the group's size and the rank's percentile."""
    w = Window.partitionBy(*group)
    rank = F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), tie))
    out = df.withColumn("link_rank", F.when(F.col(score).isNotNull(), rank).cast("bigint")).withColumn("link_count", F.count("*").over(w))
    n, r = F.col("link_count"), F.col("link_rank")
    return out.withColumn("rank_percentile", F.when(n == 1, F.lit(1.0)).otherwise(1 - (r - 1) / F.nullif(n - 1, F.lit(0))))


def related(df: DataFrame, k: int, top: Column, all_of: Column, forced: Column) -> DataFrame:
    """Of ranked links those in the top ``k`` of one type, all of another, and a forced one; each row once."""
    why = F.coalesce(F.when(forced, "forced"), F.when(all_of, "all"), F.when(top & (F.col("link_rank") <= k), "top"))
    return df.withColumn("kept_as", why).where(F.col("kept_as").isNotNull())


def with_focal(kept: DataFrame, every: DataFrame, linked: str, focal: str, made: dict[str, Column], flag: str = "is_focal") -> DataFrame:
    """Kept links with a flag for those to ``focal``, which is always among them: if none is kept its
    links of ``every``, and if there is none either a row of ``made`` (other columns null)."""
    near = every.where(F.col(linked) == focal)
    has = kept.where(F.col(linked) == focal).limit(1).count()
    extra = kept.limit(0) if has else near.select(*kept.columns)
    if not has and not near.limit(1).count():
        one = {**{c: F.lit(None) for c in kept.columns}, **made, linked: F.lit(focal)}
        extra = kept.sparkSession.range(1).select(*(one[f.name].cast(f.dataType).alias(f.name) for f in kept.schema.fields))
    return kept.unionByName(extra).withColumn(flag, F.coalesce(F.col(linked) == focal, F.lit(False)))


def without_linked(universe: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that aren't linked: a left anti join on all keys."""
    return universe.join(links.select(*keys).distinct(), keys, "left_anti")


def unlinked_counts(sources: DataFrame, firms: DataFrame, links: DataFrame) -> DataFrame:
    """How many firms of the year each (source, year, type) could be compared with: all but itself and its links.

    Counted as totals minus exceptions; the pairs themselves, every source with every firm,
    are never made.
    """
    total = firms.select("year", "firm").distinct().groupBy("year").agg(F.count("*").alias("firms"))
    f = firms.select("year", F.col("firm").alias("other")).distinct()
    out = links.select("source", "year", "type", F.col("linked").alias("other")).distinct()
    linked = out.where("other <> source").join(f, ["year", "other"]).groupBy("source", "year", "type").agg(F.count("*").alias("linked"))
    own = sources.join(f, (sources["year"] == f["year"]) & (sources["source"] == f["other"]), "left").select(sources["source"], sources["year"], sources["type"], F.when(F.col("other").isNotNull(), 1).otherwise(0).alias("own"))
    got = own.join(linked, ["source", "year", "type"], "left").join(total, "year")
    return got.select("source", "year", "type", (F.col("firms") - F.col("own") - F.coalesce("linked", F.lit(0))).alias("controls"))


def one_to_one(df: DataFrame, left: list[str], right: str) -> DataFrame:
    """Rows of the left keys that have exactly one distinct value on the right (null counts as one)."""
    n = df.groupBy(*left).agg((F.countDistinct(right) + F.max(F.col(right).isNull().cast("int"))).alias("_n")).where("_n = 1").drop("_n")
    return df.join(n, left, "left_semi")


def best_priority(df: DataFrame, keys: list[str], priority: Column) -> DataFrame:
    """Of each key the rows of the best (least) priority, ties included."""
    p = df.withColumn("_p", priority)
    best = p.groupBy(*keys).agg(F.min("_p").alias("_best"))
    return p.join(best, keys).where("_p = _best").drop("_p", "_best")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], spans: tuple[str, str, str, str]) -> DataFrame:
    """An equi-join whose rows' spans also overlap, both ends included; an open end is null."""
    a, b, x, y = (F.col(s) for s in spans)
    return left.join(right, keys).where((a <= F.coalesce(y, a)) & (F.coalesce(b, x) >= x))


def unpivot_roles(df: DataFrame, keep: list[str], roles: dict[str, dict[str, str]]) -> DataFrame:
    """Columns of several roles to rows: ``role`` and the common columns of each."""
    rows = F.array(*(F.struct(F.lit(r).alias("role"), *(F.col(c).alias(n) for n, c in cols.items())) for r, cols in roles.items()))
    return df.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.*")
