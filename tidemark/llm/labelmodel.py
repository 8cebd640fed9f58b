"""A generative model of several noisy votes on pairs: accuracies, correlations, posteriors.

Each voter says yes, no or nothing, in its own levels (small integers, 0 is silence). The
truth of a pair is drawn first, then each vote given the truth and the vote of at most one
other voter that it goes together with: a forest over the voters, the strongest one by
conditional mutual information given the truth. Expectation-maximisation learns all
chances from the counts of vote patterns, so its cost doesn't grow with the pairs. A vote
that only repeats another one has a chance near one whatever the truth and tells nothing
more.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class LabelModel:
    """``fit`` on pattern counts, then ``posterior`` of patterns.

    ``lean`` gives for each voter and level how far it speaks for a match (between 0 and 1).
    It starts the iteration and stays as pseudo-counts of ``trust`` of all pairs, which keep
    "match" the meaning of the class that is learned. ``tied`` is the least conditional mutual
    information, as a share of the smaller entropy, at which a voter depends on another, and
    ``repeats`` the share at which it does before any accuracy is known.
    """

    lean: list[dict[int, float]]
    rounds: int = 300
    trust: float = 0.02
    tied: float = 0.1
    repeats: float = 0.5
    prior: float = 0.5
    parent: list[int | None] = field(default_factory=list)
    alone: list[np.ndarray] = field(default_factory=list)
    given: list[np.ndarray | None] = field(default_factory=list)
    correlation: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def _maximise(self, votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> None:
        """Chances of each level given the truth (``alone``), and given the parent's level too (``given``)."""
        total, w = n.sum(), np.stack([n * (1 - q), n * q])
        self.prior = float(np.clip((n * q).sum() / total, 1e-4, 1 - 1e-4))
        extra = max(1.0, self.trust * total)
        self.alone, self.given = [], []
        for j, lean in enumerate(self.lean):
            c = np.full((2, max(lean) + 1), 1e-9)
            for v, p in lean.items():
                c[:, v] += np.array([1 - p, p]) * extra / len(lean)
            for y in (0, 1):
                c[y, 1:] += np.bincount(votes[:, j], w[y], c.shape[1])[1:]
            c[:, 0] = 0
            self.alone.append(c / c.sum(1, keepdims=True))
        for j, p in enumerate(self.parent):
            if p is None:
                self.given.append(None)
                continue
            wide, high = self.alone[j].shape[1], self.alone[p].shape[1]
            # A level of the parent that hardly occurs says as little as none.
            c = np.repeat(self.alone[j][:, None, :] * max(1.0, 0.1 * extra), high, 1)
            both = (votes[:, j] > 0) & (votes[:, p] > 0)
            for y in (0, 1):
                c[y] += np.bincount(votes[both, p] * wide + votes[both, j], w[y][both], high * wide).reshape(high, wide)
            self.given.append(c / c.sum(2, keepdims=True))

    def _log_odds(self, votes: np.ndarray) -> np.ndarray:
        out = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j in range(votes.shape[1]):
            v, p = votes[:, j], self.parent[j]
            chance = self.alone[j][:, v]
            if p is not None:
                chance = np.where(votes[:, p] > 0, self.given[j][:, votes[:, p], v], chance)
            out += np.where(v > 0, np.log(np.maximum(chance[1], 1e-12) / np.maximum(chance[0], 1e-12)), 0.0)
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._log_odds(np.atleast_2d(votes)), -50, 50)))

    def _expect(self, votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        for _ in range(self.rounds):
            self._maximise(votes, n, q)
            new = self.posterior(votes)
            if np.abs(new - q).max() < 1e-6:
                break
            q = new
        return q

    def _information(self, votes: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Of each two voters the information they share given the truth, as a share of the smaller entropy; 0 where they seldom speak together."""
        k = votes.shape[1]
        out = np.zeros((k, k))
        for a in range(k):
            for b in range(a + 1, k):
                both = (votes[:, a] > 0) & (votes[:, b] > 0)
                shared = least = 0.0
                for w in (n * (1 - q), n * q):
                    w = w * both
                    if w.sum() < 30:
                        continue
                    t = np.zeros((votes[:, a].max() + 1, votes[:, b].max() + 1))
                    np.add.at(t, (votes[:, a], votes[:, b]), w)
                    t /= w.sum()
                    pa, pb = t.sum(1), t.sum(0)
                    has = t > 0
                    shared += w.sum() * (t[has] * np.log(t[has] / np.outer(pa, pb)[has])).sum()
                    least += w.sum() * min(-(pa[pa > 0] * np.log(pa[pa > 0])).sum(), -(pb[pb > 0] * np.log(pb[pb > 0])).sum())
                out[a, b] = out[b, a] = shared / least if least > 1e-9 else 0.0
        return out

    def _forest(self) -> list[int | None]:
        """For each voter the earlier joined one it depends on: the strongest forest of ties."""
        k = len(self.correlation)
        parent: list[int | None] = [None] * k
        joined: set[int] = set()
        while len(joined) < k:
            ties = [(self.correlation[i, j], -j, i) for i in joined for j in range(k) if j not in joined]
            top = max(ties, default=(0.0, 0, 0))
            if top[0] > self.tied:
                parent[-top[1]] = top[2]
                joined.add(-top[1])
            else:
                joined.add(min(set(range(k)) - joined))
        return parent

    def fit(self, votes: np.ndarray, n: np.ndarray) -> LabelModel:
        k = votes.shape[1]
        self.parent, votes = [None] * k, votes.astype(np.int64)
        start = np.array([[np.log(p / (1 - p)) if v and (p := self.lean[j].get(int(v), 0.5)) else 0.0 for j, v in enumerate(row)] for row in votes])
        q = 1 / (1 + np.exp(-start.sum(1)))
        # Voters that all but repeat each other are told before they can outvote the rest;
        # weaker ties only once the others' chances are known.
        first = self._information(votes, n, q)
        self.correlation = np.where(first > self.repeats, first, 0.0)
        self.parent = self._forest()
        repeated = np.array([p is not None for p in self.parent])
        q = self._expect(votes, n, 1 / (1 + np.exp(-start[:, ~repeated].sum(1))))
        self.correlation = np.maximum(self.correlation, self._information(votes, n, q))
        self.parent = self._forest()
        self._expect(votes, n, q)
        return self
