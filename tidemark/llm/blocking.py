"""Candidate pairs of names: the first word of one has a like word in the other, and so has some further word.

Whatever ``stands_for`` accepts is a candidate: it asks for the listed name's first word
among the typed ones and for a listed word behind every typed one. Words are compared once
for all names they occur in - up to an edit by hashes of the word with a letter left out -
and names then meet by equal first words and the typed name's longest other word: by what
the comparison knows it to be like, or by its first letter, which short forms keep and
words with two errors, if it also has the letters of the other word or is two edits from
it. Every name blocks in the same way, whatever the size of the tables; a busy block is a
skewed partition of a sort-merge join, which Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.names import _SHORT, NICKNAMES, likeness, parse, seen_as
from tidemark.session import materialise

_P = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(place of the word, key, letter left out)``: a hash of each word (-1) and, from four letters on, of the word without each letter.

    Words within one edit or swap share a key, of letters at most one place apart where both
    leave one out. The hashes are sums of powers, so a word of
    ``n`` letters costs ``n`` steps however long it is.
    """
    words = [w or "\0" for w in words]
    if not words:
        return (np.zeros(0, np.int64),) * 3
    size = np.array([len(w) for w in words])
    code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    start = np.concatenate(([0], size.cumsum()[:-1]))
    power = np.concatenate((np.ones(1, np.uint64), np.full(size.max() - 1, _P))).cumprod(dtype=np.uint64)
    place = np.arange(len(code)) - start[owner]
    s = np.concatenate((np.zeros(1, np.uint64), ((code + np.uint64(1)) * power[place]).cumsum(dtype=np.uint64)))
    first, last = s[start], s[start + size]
    less = (s[:-1] - first[owner]) + (last[owner] - s[1:]) * _BACK
    long = (size >= 4)[owner]
    value = np.concatenate((last - first, less[long]))
    value ^= np.concatenate((size, (size - 1)[owner][long])).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.concatenate((np.arange(len(words)), owner[long])), value.view(np.int64), np.concatenate((np.full(len(words), -1), place[long]))


def name_words(df: DataFrame, key: str, name: str) -> DataFrame:
    """``key, word, second, others`` of each name; null names and those without a word have none.

    The first word, and the first two written together, come with all ``others`` (the words,
    neighbours written together, and "" for names of which no other word is there); the
    other rows (``others`` null) are all words of the name, each with the longest one beside it.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, n in zip(b["k"], b["n"], strict=True):
                t = parse(n).tokens
                for i in range(1, min(2, len(t)) + 1):
                    words = {*t[i:], *map("".join, zip(t[i:], t[i + 1 :], strict=False))}
                    rows.append((k, "".join(t[:i]), None, ["", *sorted(words)]))
                long = sorted(range(len(t)), key=lambda i: -len(t[i]))[:2]
                rows += [(k, w, t[long[long[0] == i]] if len(t) > 1 else None, None) for i, w in enumerate(t)]
            yield pd.DataFrame(rows, columns=["k", "word", "second", "others"])

    got = df.where(F.col(name).isNotNull()).select(F.col(key).alias("k"), F.col(name).alias("n"))
    return got.mapInPandas(run, f"k {kind}, word string, second string, others array<string>").withColumnRenamed("k", key)


def vocabulary(rows: DataFrame) -> DataFrame:
    """``word``: all words of ``name_words`` rows, and those written together."""
    return rows.select("word").unionAll(rows.select(F.explode("others").alias("word")).where("word <> ''")).distinct()


def _word_keys(words: DataFrame, out: str) -> DataFrame:
    """``out, key, place`` rows of words: with a letter left out, as its signs look, and by its nicknames."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spelled = [(w, x) for w in b["word"] for x in {w, seen_as(w), *("=" + f for f in _SHORT.get(w, ())), *(["=" + w] if w in NICKNAMES else [])}]
            at, keys, place = deletion_keys([x for _, x in spelled])
            yield pd.DataFrame({out: np.array([w for w, _ in spelled], object)[at], "key": keys, f"at_{out}": place})

    return words.mapInPandas(run, f"{out} string, key bigint, at_{out} int")


def like_words(words: DataFrame, listed: DataFrame) -> DataFrame:
    """``word, like``: the words of one ``vocabulary`` that can stand for one of the other's, whatever its place, and the reverse."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [max(likeness(w, f, True), likeness(f, w, True)) >= 0.5 for w, f in zip(b["word"], b["like"], strict=True)]
            yield b[np.array(ok, bool)] if len(b) else b

    apart = (F.col("at_word") < 0) | (F.col("at_like") < 0) | (F.abs(F.col("at_word") - F.col("at_like")) <= 1)
    # A word meets itself once, as a whole, not by each of its letters.
    apart &= (F.col("word") != F.col("like")) | (F.col("at_word") < 0)
    near = _word_keys(words, "word").join(_word_keys(listed, "like").hint("merge"), "key").where(apart).select("word", "like").distinct()
    return materialise(near.mapInPandas(run, "word string, like string"))


def candidates(typed: DataFrame, listed: DataFrame, alike: DataFrame, a: str, b: str, shaped: bool = True) -> DataFrame:
    """Distinct ``a, b`` whose names (both as ``name_words`` rows) may stand for each other, ``typed`` for ``listed``.

    ``alike`` are the ``like_words`` of both vocabularies. Where not ``shaped``, names that
    share a first word and a first letter are pairs whatever the shape of the other words:
    a model that learns from pairs needs those that don't match too.
    """
    words, heads = typed.where("others is null").drop("others"), listed.where("others is not null")
    right = heads.select(b, F.col("word").alias("first"), F.explode("others").alias("other"))
    # Of all like words only those that some listed name begins with.
    begins = heads.select(F.col("word").alias("first")).distinct()
    near = alike.withColumnRenamed("like", "first").join(begins.hint("merge"), "first", "left_semi")
    first = words.join(near.hint("merge"), "word").select(a, "first", "second")
    # No other word asks for none; one that is like another word, whatever the error, for that.
    known = alike.where("word <> like" if shaped else "substr(word, 1, 1) <> substr(like, 1, 1)").select(F.col("word").alias("second"), F.col("like").alias("other"))
    asked = first.where("second is null").select(a, "first", F.lit("").alias("other")).unionAll(first.join(known.hint("merge"), "second").select(a, "first", "other"))
    by_word = asked.join(right.hint("merge"), ["first", "other"]).select(a, b)
    # Short forms have the letters of the word but for one left in by error and a plural s.
    short = lambda x, y: (F.length(x) <= F.length(y)) & (F.length(F.call_function("translate", F.col(x), F.col(y), F.lit(""))) <= 2)
    fits = short("second", "other") | short("other", "second") | (F.levenshtein("second", "other", 2) >= 0)
    lettered = right.where("other <> ''").withColumn("c", F.substring("other", 1, 1))
    lettered = lettered if shaped else lettered.select(b, "first", "c").distinct()
    by_letter = first.where("second is not null").withColumn("c", F.substring("second", 1, 1)).join(lettered.hint("merge"), ["first", "c"])
    by_letter = (by_letter.where(fits) if shaped else by_letter).select(a, b)
    return by_word.unionAll(by_letter).distinct()
