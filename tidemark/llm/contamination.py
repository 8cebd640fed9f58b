"""Test passages in a corpus, whole or in part, a few words changed, dropped or put in.

A document leaks an item if it holds ``window`` consecutive words of it with at most
``changed`` of them changed or dropped and at most ``stray`` words put in between. With
``changed + stray`` errors, one of ``changed + stray + 1`` equal pieces of the window stays
whole: all pieces of all windows are looked up exactly, and around the hits the windows that
hold as many pieces as such a window must keep are verified by Myers' bit-parallel edit
distance, many windows side by side in numpy. Where the distance alone doesn't tell, an exact count of changed and stray words
follows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of all regions that are verified together, at most (a longer one goes alone).
CELLS = 4_000_000
_IN_NUMBER = re.compile(r"(?<=\d)[,.](?=\d)")
_DROPPED = re.compile(r"['’`´]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """The words of a text: case, punctuation and line breaks don't count, figures are words."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "'" in text or "’" in text:
        text = _DROPPED.sub("", text)
    return _WORD.findall(_IN_NUMBER.sub("", text))


class Passages:
    """The pieces and windows of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = 20, changed: int = 2, stray: int = 3):
        self.window, self.changed, self.stray = window, changed, stray
        self.piece = window // (changed + stray + 1)
        # Of all places of a piece in a window a changed word spoils as many as a piece has words, a stray one one less.
        self.kept = max(1, window - self.piece + 1 - changed * self.piece - stray * (self.piece - 1))
        texts = [(k, w) for k, t in items if len(w := words_of(t)) >= window]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.items = [np.array([self.vocabulary[w] for w in ws], np.int64) for _, ws in texts]
        self.item_ids = np.array([k for k, _ in texts], np.int64)
        self.base = len(self.vocabulary) + 1
        if self.base**self.piece >= 2**63:
            raise ValueError("too many distinct words for exact piece keys; use smaller blocks of items")
        keys, item, at = [], [], []
        for n, w in enumerate(self.items):
            k = self._pieces(w)
            keys.append(k)
            item.append(np.full(len(k), n))
            at.append(np.arange(len(k)))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.key_item = np.concatenate(item)[order] if len(order) else keys
        self.key_at = np.concatenate(at)[order] if len(order) else keys

    def _pieces(self, w: np.ndarray) -> np.ndarray:
        """A key for each run of ``piece`` words; -1 where a word is in no item."""
        n = len(w) - self.piece + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(self.piece):
            key = key * self.base + w[i : i + n]
            known &= w[i : i + n] > 0
        return np.where(known, key, -1)

    def regions(self, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """``(item, first window, last window, from, to)``: what to verify where in a document."""
        k = self._pieces(doc)
        lo = np.searchsorted(self.keys, k, "left")
        n = np.searchsorted(self.keys, k, "right") - lo
        n[k < 0] = 0
        hit = np.flatnonzero(n)
        if not len(hit):
            return []
        slot = np.repeat(lo[hit] - np.concatenate(([0], n[hit].cumsum()[:-1])), n[hit]) + np.arange(n[hit].sum())
        item, at, pos = self.key_item[slot], self.key_at[slot], np.repeat(hit, n[hit])
        order = np.lexsort((pos, item))
        item, at, pos = item[order], at[order], pos[order]
        reach = self.window + self.stray
        # Hits of an item within reach of each other are verified together.
        new = np.concatenate(([True], (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > reach)))
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate((start, [len(item)])))
        out = []
        for i, n in zip(start[size >= self.kept].tolist(), size[size >= self.kept].tolist(), strict=True):
            places = np.unique(at[i : i + n])
            if len(places) < self.kept:
                continue
            # A window that begins at s holds the pieces from s to s + window - piece.
            most = len(self.items[item[i]]) - self.window
            first = np.maximum(places[self.kept - 1 :] - (self.window - self.piece), 0)
            last = np.minimum(places[: len(first)], most)
            ok = first <= last
            if ok.any():
                begin, end = int(pos[i]), int(pos[i + n - 1])
                out.append((int(item[i]), int(first[ok].min()), int(last[ok].max()), max(0, begin + self.piece - reach), min(len(doc), end + reach)))
        return [r for r in out if r[4] - r[3] >= self.window - self.changed]

    def verify(self, jobs: list[tuple[np.ndarray, tuple[int, int, int, int, int]]]) -> np.ndarray:
        """For each (document, region) whether one of its windows is held there."""
        m, budget = self.window, self.changed + self.stray
        found = np.zeros(len(jobs), bool)
        regions = np.array([r for _, r in jobs])
        count = regions[:, 2] - regions[:, 1] + 1
        length = regions[:, 4] - regions[:, 3]
        longest = int(length.max())
        # The words of all windows of a job lie in one stretch; a lane is a window's place in it.
        words = np.concatenate([self.items[r[0]][r[1] : r[2] + m] for r in regions])
        owner = np.repeat(np.arange(len(jobs)), count + m - 1)
        offset = np.concatenate(([0], (count + m - 1).cumsum()[:-1]))
        job = np.repeat(np.arange(len(jobs)), count)
        lane = offset[job] + np.arange(len(job)) - np.concatenate(([0], count.cumsum()[:-1]))[job]
        text = np.full((longest, len(jobs)), -1, np.int64)
        for j, (doc, r) in enumerate(jobs):
            text[: r[4] - r[3], j] = doc[r[3] : r[4]]
        top, one = np.uint64(m - 1), np.uint64(1)
        pad = np.zeros(m, np.uint64)
        lanes = len(job)
        pv, mv = np.full(lanes, ~np.uint64(0)), np.zeros(lanes, np.uint64)
        score = np.full(lanes, m, np.int64)
        best = score.copy()
        for t in range(longest):
            # Bits of each window that the word equals, by doubling runs of 1, 2, 4 ... words.
            bits, width, done, eq = np.concatenate(((words == text[t][owner]).astype(np.uint64), pad)), 1, 0, np.zeros(lanes, np.uint64)
            while done < m:
                if m & width:
                    eq |= bits[lane + done] << np.uint64(done)
                    done += width
                if done < m:
                    bits[:-width] |= bits[width:] << np.uint64(width)
                    width *= 2
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
        sure = best <= self.changed
        found[job[sure]] = True
        for n in np.flatnonzero((best > self.changed) & (best <= budget)):
            if not found[job[n]]:
                doc, r = jobs[job[n]]
                found[job[n]] = self.held(words[lane[n] : lane[n] + m], doc[r[3] : r[4]])
        return found

    def held(self, pattern: np.ndarray, text: np.ndarray) -> bool:
        """Exactly: at most ``changed`` words changed or dropped with at most ``stray`` put in."""
        s, big = self.stray + 1, 99
        # cost[i][k]: least changed or dropped words of the first i, with k put in, ending here.
        cost = np.full((self.window + 1, s), big)
        cost[:, 0] = np.arange(self.window + 1)
        for w in text:
            new = np.full_like(cost, big)
            new[0, 0] = 0
            new[1:] = cost[:-1] + (pattern != w)[:, None]
            new[1:, 1:] = np.minimum(new[1:, 1:], cost[1:, :-1])
            for i in range(1, self.window + 1):
                new[i] = np.minimum(new[i], new[i - 1] + 1)
            cost = new
            if cost[-1].min() <= self.changed:
                return True
        return False

    def leaks(self, keys: list, texts: list[list[str]], lanes: int = 60_000) -> list[tuple[int, int]]:
        """``(document, item id)`` pairs of a batch of texts, given as their words."""
        jobs, whose, known = [], [], self.vocabulary.get
        for key, t in zip(keys, texts, strict=True):
            doc = np.array([known(w, 0) for w in t], np.int64)
            for r in self.regions(doc):
                jobs.append((doc, r))
                whose.append((key, int(self.item_ids[r[0]])))
        order = sorted(range(len(jobs)), key=lambda j: jobs[j][1][4] - jobs[j][1][3])
        out: set[tuple[int, int]] = set()
        i = 0
        while i < len(order):
            n, j = 0, i
            # Regions of like length go together: the longest sets the cost of all.
            while j < len(order) and (n == 0 or n < lanes):
                r = jobs[order[j]][1]
                if n and (r[4] - r[3]) * (j - i + 1) > CELLS:
                    break
                n += r[2] - r[1] + 1
                j += 1
            ok = self.verify([jobs[o] for o in order[i:j]])
            out.update(whose[o] for o, v in zip(order[i:j], ok, strict=True) if v)
            i = j
        return sorted(out)


@lru_cache(maxsize=16)
def _passages(number: int, block: Broadcast, window: int, changed: int, stray: int) -> Passages:
    """The passages of one block of items, kept by a worker for as long as few others are asked for."""
    del number
    return Passages(block.value, window, changed, stray)


def leaked_items(docs: DataFrame, items: DataFrame, *, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 20, changed: int = 2, stray: int = 3, block: int = 2000) -> DataFrame:
    """``doc_id, item_id`` once per document and item it holds a passage of.

    Items are sent to the tasks in blocks of at most ``block``, read one after another by the
    driver, which holds one block at a time; documents never move and are read once, however
    many blocks there are. Items with fewer than ``window`` words, documents with fewer than
    ``window - changed``, null and empty ones hold nothing. Repeated items count once each id.
    """
    kind = docs.schema[doc].dataType.simpleString()
    sc = docs.sparkSession.sparkContext
    rows = items.select(item, item_text).where(F.col(item_text).isNotNull()).distinct().toLocalIterator()
    blocks = []
    while some := [(r[0], r[1]) for r in islice(rows, block)]:
        blocks.append(sc.broadcast(some))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                keys, words = part.column(0).to_pylist(), [words_of(t) for t in part.column(1).to_pylist()]
                for n, items in enumerate(blocks):
                    if got := _passages(n, items, window, changed, stray).leaks(keys, words):
                        yield pa.RecordBatch.from_pandas(pd.DataFrame(got, columns=["doc_id", "item_id"]), preserve_index=False)

    return docs.where(F.col(text).isNotNull()).select(doc, text).mapInArrow(run, f"doc_id {kind}, item_id bigint").distinct()
