"""Similarity flooding between a file's header and a canonical schema.

Both are graphs: columns point to the words of their names, to the type of their values and
to what they are nested in (the part of a name before its last dot; else the schema itself).
Scores of column, word, type and parent pairs feed each other along these edges until they
settle; the best consistent one-to-one correspondences are then selected.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np

# Words that stand for others in column names. A word may stand for several.
WORDS = {
    "dt": ["date"], "px": ["price"], "und": ["underlying"], "impl": ["implied"], "qty": ["size"], "offer": ["ask"],
    "close": ["eod"], "closing": ["eod"], "vol": ["volume", "volatility"], "sym": ["symbol"], "exp": ["expiration"],
    "expiry": ["expiration"], "opt": ["option"], "wtd": ["weighted"], "avg": ["average"], "vw": ["volume", "weighted"],
    "vwap": ["volume", "weighted", "average", "price"], "oi": ["open", "interest"], "iv": ["implied", "volatility"],
    "int": ["interest"], "cp": ["option", "type"], "put": ["option"], "call": ["type"], "flag": ["is", "has"],
    "included": ["has"], "calc": ["calcs"], "adj": ["adjusted"], "trd": ["trade"], "cond": ["condition"],
}
EMPTY = {"to", "of", "the", "in", "is", "has", "flag"}
TYPES = ("integer", "decimal", "date", "boolean", "text")


def words(name: str) -> list[str]:
    """The words of a column name: case changes, digits and signs part them; a clock time is one word."""
    name = re.sub(r"(\d{1,2}):(\d{2})", r"\1\2", name)
    name = re.sub(r"([a-z])([A-Z])", r"\1 \2", name)
    return [w.lower() for w in re.findall(r"[A-Za-z]+|\d+", name)]


def _skeleton(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w[0] + re.sub(r"[aeiou]", "", w[1:]))


def _grams(w: str) -> set[str]:
    w = f"^{w}$"
    return {w[i : i + 2] for i in range(len(w) - 1)}


@lru_cache(maxsize=1 << 16)
def word_score(a: str, b: str) -> float:
    """How far two words can stand for each other, before flooding."""
    if a == b:
        return 1.0
    if a.isdigit() or b.isdigit():
        return 0.0
    if b in WORDS.get(a, ()) or a in WORDS.get(b, ()):
        return 0.95
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and long.startswith(short):
        return 0.8
    if len(short) >= 2 and _skeleton(a) == _skeleton(b):
        return 0.8
    x, y = _grams(a), _grams(b)
    dice = 2 * len(x & y) / (len(x) + len(y))
    return 0.6 * dice if dice > 0.4 else 0.0


@lru_cache(maxsize=1 << 16)
def _parts(name: str, known: frozenset[str]) -> tuple[str, ...]:
    """The words of a name, with glued ones parted where both halves are known and long forms spelled out."""
    out: list[str] = []
    for w in words(name):
        if w not in known and w not in WORDS:
            cut = next((i for i in range(2, len(w) - 1) if (w[:i] in known or w[:i] in WORDS) and (w[i:] in known or w[i:] in WORDS)), 0)
            out += [w[:cut], w[cut:]] if cut else [w]
        else:
            out.append(w)
    return tuple(x for w in out for x in (WORDS[w] if w in ("vwap", "oi", "iv", "cp", "vw") else [w]))


# Kinds of which values of one may be read as the other.
KINDRED = ({"integer", "decimal"}, {"integer", "boolean"}, {"text", "boolean"})
#: Rounds after which scores that still move are an error.
MOST_ROUNDS = 1000


def _points(items: list[tuple], nodes: list) -> np.ndarray:
    """Edges from columns (rows) to nodes."""
    out = np.zeros((len(items), len(nodes) + 1))
    out[np.arange(len(items))[:, None], _places(items, nodes)] = 1.0
    return out[:, :-1]


def _places(items: list[tuple], nodes: list) -> np.ndarray:
    """Of each column the places of its nodes, filled up with one beyond them all."""
    at = {n: i for i, n in enumerate(nodes)}
    out = np.full((len(items), max(map(len, items), default=1) or 1), len(nodes))
    for i, x in enumerate(items):
        out[i, : len(x)] = [at[n] for n in x]
    return out


def _parent(name: str) -> str:
    return name.rpartition(".")[0]


def _flooded(start: np.ndarray, left: np.ndarray, right: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores of node pairs, raised by how well the columns that point to them fit."""
    fed = left.T @ columns**3 @ right
    out = start * (1 + 0.3 * fed / max(fed.max(), 1e-9))
    return out / max(out.max(), 1e-9)


class _Canonical(NamedTuple):
    """The graph of the canonical schema: nodes and the edges to them."""

    known: frozenset[str]
    words: list[str]
    to_words: np.ndarray
    places: np.ndarray
    types: list[str]
    to_types: np.ndarray
    parents: list[str]
    to_parents: np.ndarray
    bare: np.ndarray


def _heavy(w: str) -> float:
    """Edges to words are lighter for words that say little."""
    return 0.25 if w in EMPTY else 0.6 if w in ("date", "price", "code", "type") else 1.0


@lru_cache(maxsize=1 << 16)
def _letters(name: str) -> str:
    return re.sub(r"[\W_]", "", name).lower()


def _bare(names: tuple[str, ...]) -> np.ndarray:
    return np.array([_letters(n) for n in names], object)


@lru_cache(maxsize=8)
def _graph_of(canonical: tuple[tuple[str, str], ...]) -> _Canonical:
    names = tuple(n for n, _ in canonical)
    known = frozenset(w for n in names for w in words(n))
    parts = [_parts(n, known) for n in names]
    nodes, types, parents = sorted({w for p in parts for w in p}), sorted({t for _, t in canonical}), sorted(set(map(_parent, names)))
    return _Canonical(
        known, nodes, _points(parts, nodes) * np.array([_heavy(w) for w in nodes]), _places(parts, nodes), types, _points([(t,) for _, t in canonical], types),
        parents, _points([(_parent(n),) for n in names], parents), _bare(names),
    )


@lru_cache(maxsize=1 << 15)
def correspond(header: tuple[str, ...], types: tuple[str | None, ...], canonical: tuple[tuple[str, str], ...], least: float = 0.25) -> tuple[str | None, ...]:
    """The canonical column of each header column, or null where none fits. ``canonical`` holds names and types."""
    c = _graph_of(canonical)
    left = [_parts(h, c.known) for h in header]
    lw, rw = sorted({w for p in left for w in p}), c.words
    if not lw or not rw:
        return tuple(None for _ in header)
    a, b = _points(left, lw) * np.array([_heavy(w) for w in lw]), c.to_words
    word0 = np.array([[word_score(x, y) for y in rw] for x in lw])
    lt = sorted({str(t) for t in types})
    ta, tb = _points([(str(t),) for t in types], lt), c.to_types
    type0 = np.array([[1.0 if x == y else 0.5 if x == "None" or {x, y} in KINDRED else 0.0 for y in c.types] for x in lt])
    lp = sorted({_parent(h) for h in header})
    pa, pb = _points([(_parent(h),) for h in header], lp), c.to_parents
    parent0 = np.array([[1.0 if x == y else 0.1 + 0.9 * max((word_score(v, w) for v in words(x) for w in words(y)), default=0.0) for y in c.parents] for x in lp])
    same = (_bare(header)[:, None] == c.bare).astype(float)
    mine, weight, edged = _places(left, lw), np.maximum(a.sum(1)[:, None] + b.sum(1)[None, :], 1e-9), np.zeros((len(lw) + 1, len(rw) + 1))
    word, kind, parent, cols = word0, type0, parent0, np.zeros_like(same)
    for _ in range(MOST_ROUNDS):
        # Each word of one name gives its best partner of the other; both directions count.
        edged[:-1, :-1] = word
        there, back = edged[:-1][:, c.places].max(2), edged.T[:-1][:, mine].max(2)
        score = (a @ there + (b @ back).T) / weight
        new = 0.8 * score + 0.12 * (ta @ kind @ tb.T) + 0.6 * same + 0.1 * (pa @ parent @ pb.T)
        new = 0.25 * cols + 0.75 * new / new.max()
        # Columns that fit strengthen the pairs of what they point to.
        word, kind, parent = _flooded(word0, a, b, new), _flooded(type0, ta, tb, new), _flooded(parent0, pa, pb, new)
        done = np.abs(new - cols).max() < 1e-4
        cols = new
        if done:
            break
    else:
        raise RuntimeError(f"scores don't settle in {MOST_ROUNDS} rounds: {header}")
    out: list[str | None] = [None] * len(header)
    rest = np.where(score > 0, cols, 0.0)
    while rest.size and rest.max() >= least:
        i, j = divmod(int(rest.argmax()), rest.shape[1])
        out[i] = canonical[j][0]
        rest[i, :] = 0
        rest[:, j] = 0
    return tuple(out)
