"""Encoding of a corpus with a public byte-level BPE, in numpy.

Texts are parted into words by the vocabulary's pattern; the distinct words of a batch that
the worker hasn't met are merged together: all their symbols lie in one flat array, and each
round looks up every neighbouring pair in the sorted pair keys by binary search, takes the
lowest rank of each word and merges it wherever it stands. A word leaves the array when no
pair of it is in the vocabulary.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words a worker keeps the ids of; beyond it the older half is forgotten.
CACHE_WORDS = 400_000
#: Bytes of one flat array of symbols.
CHUNK_BYTES = 4_000_000


def _byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE read from a tokenizer file: ids of words, by batched merge rounds."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        if spec.get("normalizer"):
            raise ValueError("tokenizers with a normalizer aren't read")
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.first = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.first[b] = vocab[c]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.base = max(vocab.values()) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        pre = spec["pre_tokenizer"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("only plain byte-level tokenizers are read")
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.known: dict[str, list[int]] = {}

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; a number beyond all ranks where it is in no merge."""
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.rank[at], len(self.keys))

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word, all words merged side by side."""
        none = len(self.keys)
        size = np.array([len(w) for w in words], np.int64)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        done_ids, done_owner = [], []
        rank = self._ranks(ids[:-1], ids[1:])
        rank[owner[:-1] != owner[1:]] = none
        while len(ids):
            # Symbols of one word are adjacent: the lowest rank of each word by one reduction.
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(np.concatenate((rank, [none])), start)
            word = np.concatenate(([0], (owner[1:] != owner[:-1]).cumsum()))
            live = (low < none)[word]
            if not live.all():
                done_ids.append(ids[~live])
                done_owner.append(owner[~live])
                keep = np.flatnonzero(live)
                if not len(keep):
                    break
                ids, owner, word = ids[keep], owner[keep], word[keep]
                rank = np.concatenate((rank, [none]))[keep][:-1]
            hit = np.flatnonzero((rank < none) & (rank == low[word[:-1]]))
            # Of overlapping pairs (aaa) every second one from the left of its run counts.
            run = np.concatenate(([True], np.diff(hit) != 1))
            origin = hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            hit = hit[(hit - origin) % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            at = np.cumsum(stay) - 1
            ids, owner = ids[stay], owner[stay]
            rank = rank[stay[:-1]] if stay[-1] else np.concatenate((rank, [none]))[stay][:-1]
            # Only pairs beside a merged symbol have changed.
            new = at[hit]
            touched = np.unique(np.concatenate((new, new - 1)))
            touched = touched[(touched >= 0) & (touched < len(ids) - 1)]
            got = self._ranks(ids[touched], ids[touched + 1])
            got[owner[touched] != owner[touched + 1]] = none
            rank[touched] = got
        flat, whose = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(whose, kind="stable")
        ends = np.bincount(whose, minlength=len(words)).cumsum()[:-1]
        return np.split(flat[order], ends)

    def learn(self, words: set[str]) -> None:
        """Puts the ids of unknown words into the cache."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            for w in [w for w in list(self.known)[: CACHE_WORDS // 2] if w not in words]:
                del self.known[w]
        i = 0
        while i < len(new):
            j, n = i, 0
            chunk = []
            while j < len(new) and (n == 0 or n < CHUNK_BYTES):
                chunk.append(new[j].encode("utf-8", "surrogatepass"))
                n += len(chunk[-1])
                j += 1
            for w, got in zip(new[i:j], self.merge(chunk), strict=True):
                self.known[w] = got.tolist()
            i = j

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty list for an empty or null one."""
        parts = [self.words(t) if t else [] for t in texts]
        self.learn({w for p in parts for w in p})
        known = self.known
        return [[i for w in p for i in known[w]] for p in parts]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", batch: int = 512) -> DataFrame:
    """``key, ids`` of each row of ``docs``, without special tokens; no shuffle.

    Null and empty texts have no ids (an empty list); blank ones have the ids of their
    white space. The strings of special tokens are ordinary text. ``path`` must be readable
    on every executor.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                ids = bpe.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")
