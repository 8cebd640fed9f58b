"""Matching entities of two sources without a shared key, with a confidence for each match.

Candidates have names of which one may stand for the other (see ``blocking``), a code in
common, or a number of a third table. All distinct names and codes of a source take part,
each in a row of its own. Several matching functions vote on each candidate and a label
model weighs them (see ``labelmodel``). Parties that agree in all they tell are one until
the end, names are compared once each, and texts stay out of the joins of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text_keys as K
from tidemark.llm.blocking import candidates, like_words, name_words, vocabulary
from tidemark.llm.labelmodel import LabelModel
from tidemark.llm.names import BRACKETED, parse, stands_for
from tidemark.session import materialise

# Voters and how far each level speaks for a match before anything is learned.
VOTERS = {
    "name": {1: 0.02, 2: 0.55, 3: 0.85, 4: 0.97},
    "legal": {1: 0.2, 2: 0.6},
    "ticker": {1: 0.15, 2: 0.95, 3: 0.4},
    "symbol": {1: 0.15, 2: 0.95, 3: 0.4},
    "firm": {1: 0.1, 2: 0.97},
    "cik": {1: 0.15, 2: 0.97},
}


def counted_forms(rows: DataFrame, column: str) -> DataFrame:
    """``g, v, n, main``: every distinct value of each source, how often it has it, and whether no other is more frequent."""
    n = rows.where(F.col(column).isNotNull()).groupBy("g", F.col(column).alias("v")).agg(F.count("*").alias("n"))
    top = n.groupBy("g").agg(F.max("n").alias("top"))
    return n.join(top.hint("merge"), "g").select("g", "v", "n", (F.col("n") == F.col("top")).alias("main"))


def name_score(name: str, form: str) -> tuple[float, bool, int]:
    """How well one of two names stands for the other, whether wholly, and the vote of their legal forms."""
    mine, other = parse(name), parse(form)
    score, partial = max(stands_for(mine, other, False), stands_for(other, mine, False), key=lambda x: (x[0], not x[1]))
    return score, not partial, 0 if not mine.legal or not other.legal or score == 0.0 else 2 if mine.legal == other.legal else 1


def scored_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """``nid, vid, score, whole, legal`` of the names of either side (nid, name and vid, v) that may stand for each other."""
    mine, theirs = materialise(name_words(left, "nid", "name")), materialise(name_words(right, "vid", "v"))
    alike = like_words(vocabulary(mine), vocabulary(theirs))
    turned = alike.select(F.col("like").alias("word"), F.col("word").alias("like"))
    pairs = candidates(mine, theirs, alike, "nid", "vid", shaped=False).unionByName(candidates(theirs, mine, turned, "vid", "nid", shaped=False)).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            got = [name_score(a, b) for a, b in zip(x["name"], x["v"], strict=True)]
            yield pd.concat([x[["nid", "vid"]].reset_index(drop=True), pd.DataFrame(got, columns=["score", "whole", "legal"])], axis=1)

    texts = pairs.join(left.hint("merge"), "nid").join(right.hint("merge"), "vid")
    return texts.select("nid", "vid", "name", "v").mapInPandas(run, "nid bigint, vid bigint, score double, whole boolean, legal int")


def name_votes(scored: DataFrame, names: DataFrame) -> DataFrame:
    """``nid, g, name, legal``: votes of names on sources: 4 all words, 3 nearly, 2 partly, 1 not.

    ``names`` (g, vid, n) are the names of each source; the best one counts (of equal ones
    the more frequent, then the legal form that fits better).
    """
    best = scored.join(names.hint("merge"), "vid").groupBy("nid", "g").agg(F.max(F.struct("score", "whole", "n", "legal")).alias("b")).select("nid", "g", "b.*")
    level = F.when(F.col("score") == 0, 1).when(~F.col("whole") & (F.col("score") < 0.75), 2).when(~F.col("whole") | (F.col("score") < 0.9), 3).otherwise(4)
    return best.select("nid", "g", level.alias("name"), "legal")


CODED = {"ticker": "t", "symbol": "s", "firm": "f", "cik": "c"}


def votes_of(party: DataFrame, named: DataFrame, tickers: DataFrame, firms: DataFrame, numbers: DataFrame, sources: DataFrame) -> DataFrame:
    """``aid, g`` and the vote of each voter, for all pairs with a candidate name or a code in common.

    A code votes 2 for the same, 3 for one that the source has beside a more frequent one,
    1 for another one; any vote is 0 where a side has nothing to compare. ``party`` has
    (aid, nid, t, s, f, c), ``named`` the votes of names, the other tables (g, v, main), and
    ``sources`` all g. Each code is looked up among all codes of all sources by one join.
    """
    # Of a number or a firm the frequency says nothing; of the other codes it does.
    rows = lambda x, kind, main, firm: x.select("g", F.concat(F.lit(kind + ":"), "v").alias("code"), main.alias("main"), F.lit(firm).alias("firm"))
    yes = F.lit(True)
    theirs = rows(tickers, "x", F.col("main"), False).unionAll(rows(firms, "x", yes, True)).unionAll(rows(numbers, "c", yes, False))
    theirs = theirs.groupBy("g", "code").agg(F.max("main").alias("main"), F.bool_or("firm").alias("firm"))
    codes = F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(v).alias("voter"), F.concat(F.lit("c:" if c == "c" else "x:"), F.col(c)).alias("code"))) for v, c in CODED.items()))
    mine = party.select("aid", F.explode(F.array_compact(codes)).alias("m")).select("aid", "m.*")
    level = F.when(F.col("voter") == "firm", F.when(F.col("firm"), 2)).otherwise(F.when(F.col("main"), 2).otherwise(3))
    hits = mine.join(theirs.hint("merge"), "code").select("aid", "g", *(F.when(F.col("voter") == v, level).otherwise(F.lit(None)).alias(v) for v in CODED), F.lit(0).alias("name"), F.lit(0).alias("legal"))
    by_name = party.select("aid", "nid").join(named.hint("merge"), "nid").select("aid", "g", *(F.lit(None).cast("int").alias(v) for v in CODED), "name", "legal")
    both = hits.unionByName(by_name).groupBy("aid", "g").agg(*(F.max(v).alias(v) for v in (*CODED, "name", "legal")))
    has = lambda x, *kinds: x.select("g", *(F.lit(n in kinds).alias(n) for n in ("has_name", "has_x", "has_f", "has_c")))
    every = sources.select("g", "has_name", *(F.lit(False).alias(n) for n in ("has_x", "has_f", "has_c"))).unionAll(has(tickers, "has_x")).unionAll(has(firms, "has_x", "has_f")).unionAll(has(numbers, "has_c"))
    sources = every.groupBy("g").agg(*(F.bool_or(n).alias(n) for n in ("has_name", "has_x", "has_f", "has_c")))
    told = both.join(party.select("aid", "nid", *CODED.values()).hint("merge"), "aid").join(sources.hint("merge"), "g")
    of = {"ticker": "has_x", "symbol": "has_x", "firm": "has_f", "cik": "has_c"}
    votes = [F.coalesce(v, F.when(F.col(c).isNotNull() & F.col(of[v]), 1).otherwise(0)).alias(v) for v, c in CODED.items()]
    name = F.greatest("name", F.when(F.col("nid").isNotNull() & F.col("has_name"), 1).otherwise(0)).alias("name")
    return told.select("aid", "g", name, "legal", *votes).select("aid", "g", *VOTERS)


def link(left: DataFrame, right: DataFrame, bridge: DataFrame, *, least: float = 0.5) -> DataFrame:
    """``party_id, source_gvkey, confidence`` of each match with at least that posterior.

    ``left`` are parties (party_id, name, ticker, underlying_symbol, firm_id, cik), ``right``
    rows of sources (source_gvkey, source_name, source_ticker, source_firm_id). ``bridge``
    (gvkey, firm_id, cik) only lends firms and numbers to the sources. Nulls anywhere are silence; repeated rows count once a party; a party
    matches all gvkeys of its company. Without candidates the result is empty.
    """
    code = lambda c: K.symbol(F.nullif(F.regexp_extract(c, BRACKETED, 1), F.lit("")))
    party = left.select("party_id", "name", K.symbol("ticker").alias("t"), K.symbol("underlying_symbol").alias("s"), K.symbol("firm_id").alias("f"), K.cik10("cik").alias("c"))
    party = party.withColumn("t", F.coalesce("t", code("name"))).where("party_id is not null").distinct()
    told = ("name", "t", "s", "f", "c")
    alike = materialise(party.groupBy(*told).agg(F.count("*").alias("n")).withColumn("aid", F.monotonically_increasing_id()))
    rows = right.select(K.gvkey("source_gvkey").alias("g"), F.col("source_name").alias("name"), K.symbol("source_ticker").alias("t"), K.symbol("source_firm_id").alias("f"))
    rows = rows.where("g is not null").withColumn("t", F.coalesce("t", code("name")))
    b = bridge.select(K.gvkey("gvkey").alias("g"), K.symbol("firm_id").alias("f"), K.cik10("cik").alias("c"))
    # To a source's own codes the bridge adds the firm and number of its gvkey.
    sources = rows.groupBy("g").agg(F.bool_or(F.col("name").isNotNull()).alias("has_name"))
    firms = rows.select("g", "f").unionAll(b.select("g", "f").distinct())
    names, tickers, firms, numbers = (materialise(counted_forms(x.join(sources.select("g").hint("merge"), "g", "left_semi"), c)) for x, c in ((rows, "name"), (rows, "t"), (firms, "f"), (b, "c")))

    numbered = lambda df, c, out: materialise(df.select(c).where(f"{c} <> ''").distinct().withColumn(out, F.monotonically_increasing_id()))
    typed, forms = numbered(alike, "name", "nid"), numbered(names, "v", "vid")
    named = name_votes(scored_names(typed, forms), names.join(forms.hint("merge"), "v").select("g", "vid", "n"))
    parties = alike.join(typed.hint("merge"), "name", "left").drop("name")
    votes = materialise(votes_of(parties, named, tickers, firms, numbers, sources).join(alike.select("aid", "n").hint("merge"), "aid"))
    counted = votes.groupBy(*VOTERS).agg(F.sum("n").alias("n")).toPandas()  # at most the product of the levels
    kinds = left.schema["party_id"].dataType.simpleString()
    if not len(counted):
        return votes.select(F.col("aid").cast(kinds).alias("party_id"), F.col("g").alias("source_gvkey"), F.lit(0.0).alias("confidence"))
    patterns = counted[list(VOTERS)].to_numpy()
    model = LabelModel(list(VOTERS.values())).fit(patterns, counted["n"].to_numpy(np.float64))
    judged = counted[list(VOTERS)].assign(confidence=model.posterior(patterns))
    table = votes.sparkSession.createDataFrame(judged, ", ".join(f"{v} int" for v in VOTERS) + ", confidence double")
    matched = votes.join(F.broadcast(table), list(VOTERS)).where(F.col("confidence") >= least).select("aid", F.col("g").alias("source_gvkey"), "confidence")
    members = party.join(alike.hint("merge"), [party[c].eqNullSafe(alike[c]) for c in told]).select("party_id", "aid")
    return members.join(matched.hint("merge"), "aid").groupBy("party_id", "source_gvkey").agg(F.max("confidence").alias("confidence"))
