"""Entities by unambiguous keys, and the best candidate where it is clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K


def unique_lookup(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """``key`` and its values, for keys all of whose rows agree; null keys have none."""
    at = F.struct(*values)
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    return one.where(F.col("a").eqNullSafe(F.col("b"))).select(key, *(F.col(f"a.{v}").alias(v) for v in values))


def identify(df: DataFrame, lookups: list[tuple[str, DataFrame, str]], out: str) -> DataFrame:
    """``df`` with the identity of the first key a row has - a key that misses isn't made up for by the next.

    ``lookups`` are (column of ``df``, lookup with the same key column, value column).
    """
    got = df
    picks: Column | None = None
    for i, (column, table, value) in enumerate(lookups):
        side = table.select(F.col(column).alias(f"_k{i}"), F.col(value).alias(f"_v{i}"))
        got = got.join(side, F.col(column) == F.col(f"_k{i}"), "left")
        have = F.col(column).isNotNull()
        picks = F.when(have, F.col(f"_v{i}")) if picks is None else picks.when(have, F.col(f"_v{i}"))
    return got.select(*(df[c] for c in df.columns), picks.alias(out))


def clear_winner(evidence: DataFrame, query: str, candidate: str, score: str, name: str, strong: int = 90, lead: int = 10, near: int = 5) -> DataFrame:
    """The best candidate of each query by (score, strong hits, hits, name), unless the second is too close.

    Clear if the best leads by ``lead`` points, two strong hits, or twice the hits;
    otherwise ambiguous if the second is within ``near`` points and nearly as often hit.
    """
    c = evidence.groupBy(query, candidate).agg(F.max(score).alias("score"), F.count("*").alias("hits"), F.count_if(F.col(score) >= strong).alias("strong"), F.max_by(name, F.struct(score, name)).alias("name"))
    w = Window.partitionBy(query).orderBy(F.desc("score"), F.desc("strong"), F.desc("hits"), "name", candidate)
    two = c.withColumn("_rank", F.row_number().over(w)).where("_rank <= 2")
    pair = two.groupBy(query).agg(*(F.max_by(F.struct(candidate, "name", "score", "strong", "hits"), -F.abs(F.col("_rank") - r)).alias(n) for n, r in (("best", 1), ("second", 2))), F.count("*").alias("_n"))
    b, s = (lambda f: F.col(f"best.{f}")), (lambda f: F.col(f"second.{f}"))
    clear = (b("score") >= s("score") + lead) | (b("strong") >= s("strong") + 2) | (b("hits") >= F.greatest(F.lit(2), 2 * s("hits")))
    tied = (s("score") >= b("score") - near) & (s("strong") >= F.greatest(F.lit(0), b("strong") - 1)) & (s("hits") >= F.greatest(F.lit(1), F.floor(0.75 * b("hits"))))
    ambiguous = (F.col("_n") > 1) & ~clear & tied
    return pair.where(~ambiguous).select(query, b(candidate).alias(candidate), b("name").alias("name"), b("score").alias("score"), b("hits").alias("hits"))


def first_clear(evidence: DataFrame, query: str, step: str, candidate: str, score: str, name: str, steps: int) -> DataFrame:
    """The winner at the first step at which the evidence gathered so far has a clear one.

    Evidence of step ``i`` also counts at all later ones (at most ``steps``, a small number
    of searches), so all steps are judged in one pass instead of one after the other.
    """
    later = evidence.select(F.col(query).alias("q"), F.explode(F.sequence(F.col(step), F.lit(steps))).alias("k"), F.col(candidate).alias("c"), F.col(score).alias("s"), F.col(name).alias("n"))
    won = clear_winner(later.withColumn("qk", F.struct("q", "k")), "qk", "c", "s", "n")
    first = won.groupBy(F.col("qk.q").alias(query)).agg(F.min_by(F.struct(F.col("qk.k").alias(step), F.col("c").alias(candidate), "name", "score"), F.col("qk.k")).alias("w"))
    return first.select(query, "w.*")


def symbol_universe(df: DataFrame, symbol: str, day: str, first: str, last: str, only: list[str] | None = None) -> DataFrame:
    """``symbol``: the distinct symbols of rows from the first to the last day, or of them those asked for; both filters reach the scan."""
    rows = df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col(symbol).isNotNull())
    out = rows.select(K.symbol(symbol).alias("symbol"))
    return (out if only is None else out.where(F.col("symbol").isin(*only))).distinct()


def matched_and_not(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the rows of ``right`` of the same key (``matched``), and once with nulls where there is none."""
    out = left.join(right.withColumn("matched", F.lit(True)), key, "left")
    return out.withColumn("matched", F.coalesce("matched", F.lit(False)))
