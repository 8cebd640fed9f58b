"""Variant spellings merged with each other where no list says who is meant.

Every spelling starts as an entity of its own. Spellings that stand for each other as a
whole are one; an entity takes over the words and initials of all its spellings as further
forms of its fullest one, and the new forms enter blocking again, until a round merges
nothing. Entities are kept by labels that travel along matches until all are equal, so none
is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.blocking import candidates, like_words, name_words, vocabulary
from tidemark.llm.names import parse, stands_for
from tidemark.llm.resolve import richer
from tidemark.session import materialise


def spread_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``nid, label`` with the least label of all that are joined by ``edges`` (a, b), directly or by way of others.

    In each round a node takes the least label of its neighbours and then that of its label,
    so that long chains take few rounds; rounds end when no label changes.
    """
    both = materialise(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        near = both.join(labels.select(F.col("nid").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("nid")).agg(F.min("label").alias("near"))
        least = labels.join(near.hint("merge"), "nid", "left").select("nid", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        at = labels.select(F.col("nid").alias("new"), F.col("label").alias("next"))
        jumped = materialise(least.join(at.hint("merge"), "new", "left").select("nid", "label", F.least("new", F.coalesce("next", "new")).alias("new")))
        labels = jumped.select("nid", F.col("new").alias("label"))
        if jumped.where("label <> new").isEmpty():
            return labels


def merge_variants(names: DataFrame, name: str = "name", *, least: float = 0.85) -> DataFrame:
    """``name, entity``: each distinct name and the spelling that stands for its entity, the first of its fullest ones.

    Two spellings are one if every word of either stands for a word of the other with at
    least that score; names that lack a word of another one stay apart from it, as they may
    be somebody else's. Null and blank names have no entity, and an empty table has none.
    """
    named = names.where(F.col(name).isNotNull() & (F.trim(name) != "")).select(F.col(name).alias("name")).distinct()
    named = materialise(named.withColumn("nid", F.monotonically_increasing_id()))
    words = materialise(name_words(named, "nid", "name"))
    labels = named.select("nid", F.col("nid").alias("label"))
    forms = known = named.select("nid", F.col("name").alias("form"))

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [stands_for(parse(n), parse(f)) for n, f in zip(b["name"], b["form"], strict=True)]
            yield b.loc[[s >= least and not partial for s, partial in got], ["a", "b"]]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, f) for k, full, n in zip(b["label"], b["full"], b["name"], strict=True) for f in richer(parse(full), parse(n), True, True)], columns=["nid", "form"])

    for _ in count():
        forms = materialise(forms.withColumn("f", F.monotonically_increasing_id()))
        heads = materialise(name_words(forms, "f", "form"))
        near = candidates(words, heads, like_words(vocabulary(words), vocabulary(heads)), "nid", "f")
        pairs = near.join(named.hint("merge"), "nid").join(forms.withColumnRenamed("nid", "b").hint("merge"), "f").where("nid <> b")
        edges = pairs.select(F.col("nid").alias("a"), "b", "name", "form").mapInPandas(same, "a bigint, b bigint")
        new = spread_labels(labels, edges)
        moved = new.join(labels.withColumnRenamed("label", "old").hint("merge"), "nid").where("label <> old").isEmpty()
        labels = new
        # The fullest spelling stands for an entity: most letters, then the first by name.
        told = materialise(labels.join(named.hint("merge"), "nid").select("nid", "label", "name"))
        full = told.groupBy("label").agg(F.min_by("name", F.struct(-F.length("name"), "name")).alias("full"))
        if moved:
            return told.join(full.hint("merge"), "label").select("name", F.col("full").alias("entity"))
        gained = told.join(full.hint("merge"), "label").where("name <> full").select("label", "full", "name").mapInPandas(learn, "nid bigint, form string").distinct()
        forms = materialise(gained.join(known.hint("merge"), ["nid", "form"], "left_anti"))
        known = known.unionAll(forms)
