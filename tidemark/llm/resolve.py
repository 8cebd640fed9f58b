"""Spellings of names resolved to a list of registered names by merging and matching again.

Every listed name starts as a profile. Spellings that may stand for a form of a profile
(see ``blocking``) are compared with it; one that fits a single profile best is merged into
it. A profile takes over the words of what it merged - typing errors, short forms, initials
- as further forms of its name, and the codes that came with them; the new forms enter
blocking again, against the spellings still alone, until a round merges nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocking import candidates, like_words, name_words, vocabulary
from tidemark.llm.names import Name, likeness, parse, stands_for
from tidemark.session import materialise

#: Below this a spelling is doubtful: it is merged only if none of its codes says something else.
SURE = 0.66
#: How much a form that was taken over counts against the listed one.
LEARNED = 0.97


def richer(listed: Name, typed: Name, vouched: bool, clear: bool) -> set[str]:
    """Forms that a profile gains by a merged spelling: its words one by one and all together in the place of the listed ones.

    Another spelling of the first word, which names the company, is taken over only from a
    spelling that a code vouches for: errors upon errors end at other companies. Initials
    and other words of one or two letters are taken over only from a spelling that fits no
    other profile (``clear``): they say too little of whom they mean.
    """
    last = len(listed.tokens) - 1
    tokens, out = list(listed.tokens), set()
    for w in typed.tokens:
        if w in listed.tokens or (len(w) < 3 and not clear):
            continue
        best, i = max(((likeness(w, v, i < last), i) for i, v in enumerate(listed.tokens)), default=(0.0, 0))
        if best < (0.5 if len(w) >= 3 else 0.3) or (i == 0 and (not vouched or len(w) < 3)):
            continue
        tokens[i] = w
        out.add((*listed.tokens[:i], w, *listed.tokens[i + 1 :]))
    if len(out) > 1:
        out.add(tuple(tokens))
    return {" ".join([*t, listed.legal or ""]).strip() for t in out}


def _scored(pairs: DataFrame) -> DataFrame:
    """``nid, id, score, partial`` of candidate pairs (nid, name, id, form, learned), the best form of each profile; those that can't be are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [stands_for(parse(n), parse(f)) for n, f in zip(b["name"], b["form"], strict=True)]
            yield b[["nid", "id", "learned"]].assign(score=[s for s, _ in got], partial=[p for _, p in got])

    each = pairs.select("nid", "name", "id", "form", "learned").mapInPandas(run, "nid bigint, id string, learned boolean, score double, partial boolean").where("score > 0")
    score = F.when(F.col("learned"), F.col("score") * LEARNED).otherwise(F.col("score"))
    return each.select("nid", "id", score.alias("score"), "partial")


def _best_form(scores: DataFrame) -> DataFrame:
    return scores.groupBy("nid", "id").agg(F.max(F.struct("score", (~F.col("partial")).alias("whole"))).alias("b")).select("nid", "id", "b.*")


def _winners(scores: DataFrame, key: str, *carried: str) -> DataFrame:
    """``key, id`` (and what is carried) of the best score of each key, if it is one id's only."""
    level = scores.groupBy(key, F.round("score", 9).alias("score")).agg(F.min(F.struct("id", *carried)).alias("w"), F.max("id").alias("other"))
    top = level.groupBy(key).agg(F.max_by(F.struct("w", "other"), "score").alias("t"))
    return top.where("t.w.id = t.other").select(key, "t.w.*")


def resolve(records: DataFrame, listed: DataFrame) -> DataFrame:
    """``name, t, c, id``: each distinct (name, ticker, number) of ``records`` and whom it means.

    ``records`` has name, t (code) and c (number), ``listed`` id, name and t; any of the codes
    may be null. A null or blank name means nobody and neither does one that fits two
    profiles equally well; ties of score within a profile are one. Repeated rows are one.
    Rounds end when nothing merges: each one but the last leaves fewer spellings alone.
    """
    told = records.where("name is not null and trim(name) <> ''").select("name", "t", "c").distinct()
    names = materialise(told.select("name").distinct().withColumn("nid", F.monotonically_increasing_id()))
    records = materialise(told.join(names.hint("merge"), "name").select("nid", "t", "c").withColumn("rec", F.monotonically_increasing_id()))
    words = materialise(name_words(names, "nid", "name"))
    listed = listed.where("id is not null and name is not null").distinct()
    originals = materialise(listed.select("id", F.col("name").alias("form")).distinct())
    forms = originals.withColumn("learned", F.lit(False))
    codes = materialise(listed.select("id", "t").where("t is not null").distinct())
    known = originals
    alone, scores, done = records, None, None
    for turn in count():
        forms = materialise(forms.withColumn("f", F.monotonically_increasing_id()))
        listed_words = materialise(name_words(forms, "f", "form"))
        near = candidates(words, listed_words, like_words(vocabulary(words), vocabulary(listed_words)), "nid", "f")
        found = _scored(near.join(names.hint("merge"), "nid").join(forms.hint("merge"), "f"))
        scores = materialise(_best_form(found if scores is None else found.unionAll(scores.select("nid", "id", "score", (~F.col("whole")).alias("partial")))))
        # Codes of a spelling speak for a profile that has them and against one that has others.
        has = codes.select("id").distinct().withColumn("coded", F.lit(True))
        fits = alone.join(scores.hint("merge"), "nid").join(codes.withColumn("hit", F.lit(True)).hint("merge"), ["id", "t"], "left").join(has.hint("merge"), "id", "left")
        same = F.coalesce(F.col("c") == F.col("id"), F.lit(False)) | F.col("hit").isNotNull()
        other = F.coalesce(F.col("c") != F.col("id"), F.lit(False)) | (F.col("t").isNotNull() & F.col("coded").isNotNull() & F.col("hit").isNull())
        # A doubtful spelling of which the codes say something else is somebody else's.
        doubtful = (F.col("score") < SURE) & (other | (~F.col("whole") & (F.col("score") < 0.5))) & ~same
        fits = fits.where(~doubtful).select("rec", "nid", "t", "id", same.alias("same"), (F.col("score") + F.when(same, 0.2).otherwise(0.0)).alias("score"))
        merged = materialise(_winners(fits, "rec", "nid", "t", "same"))
        done = merged if done is None else done.unionAll(merged)
        if merged.isEmpty():
            break
        alone = materialise(alone.join(merged.select("rec").hint("merge"), "rec", "left_anti"))
        words = materialise(words.join(alone.select("nid").distinct().hint("merge"), "nid", "left_semi"))
        # What the merged spellings add to their profiles comes back as new forms and codes.
        clear = _winners(scores, "nid").withColumn("clear", F.lit(True))
        gained = merged.groupBy("nid", "id").agg(F.bool_or("same").alias("vouched")).join(clear.hint("merge"), ["nid", "id"], "left")
        spelled = gained.join(names.hint("merge"), "nid").join(originals.hint("merge"), "id")

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(k, f) for k, form, name, v, c in zip(b["id"], b["form"], b["name"], b["vouched"], b["clear"], strict=True) for f in richer(parse(form), parse(name), bool(v), c is True or c == 1)]
                yield pd.DataFrame(rows, columns=["id", "form"])

        new = spelled.select("id", "form", "name", "vouched", F.coalesce("clear", F.lit(False)).alias("clear")).mapInPandas(learn, "id string, form string").distinct()
        new = materialise(new.join(known.hint("merge"), ["id", "form"], "left_anti"))
        known = known.unionAll(new)
        codes = materialise(codes.unionAll(merged.select("id", "t").where("t is not null")).distinct())
        forms = new.withColumn("learned", F.lit(True))
    return records.join(done.select("rec", "id").hint("merge"), "rec").join(names.hint("merge"), "nid").select("name", "t", "c", "id")
