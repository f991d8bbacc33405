"""A generative model of voters: their accuracies, and correlations along a tree.

The hidden label causes all votes; beyond that each voter may depend on one other voter, its
parent in the tree of largest mutual information given the label. Two voters that always fire
together then count once. Expectation maximisation runs over vote patterns with their counts, so
its size depends on the number of voters and not on the number of documents.
"""

from __future__ import annotations

import numpy as np


class LabelModel:
    """P(label = 1 | votes) for binary votes.

    Args:
        rounds: of expectation maximisation.
        smooth: added to every count.
    """

    def __init__(self, rounds: int = 20, smooth: float = 0.5) -> None:
        self.rounds, self.smooth = rounds, smooth
        self.prior = 0.5
        self.parent: list[int] = []
        self.fire = np.zeros(0)  # by voter, label, vote of the parent

    def fit(
        self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray, start: np.ndarray
    ) -> LabelModel:
        """Fit on patterns ``votes`` (n, voters) with ``counts`` of unlabelled rows, ``known``
        (n, 2) counts of rows with label 0 and 1, and ``start``, first posteriors."""
        posterior = start
        for step in range(self.rounds):
            if step % 5 == 0:
                self.parent = self._tree(votes, self._weights(counts, known, posterior))
            self._maximise(votes, counts, known, posterior)
            posterior = self.posterior(votes)
        return self

    @staticmethod
    def _weights(counts: np.ndarray, known: np.ndarray, posterior: np.ndarray) -> np.ndarray:
        # Rows of known label count as much as all others together, however few they are.
        share = max(1.0, counts.sum() / known.sum()) if known.sum() else 0.0
        return share * known + counts[:, None] * np.stack([1 - posterior, posterior], axis=1)

    def _maximise(self, votes, counts, known, posterior) -> None:
        w = self._weights(counts, known, posterior)
        total = w.sum(axis=0) + self.smooth
        self.prior = total[1] / total.sum()
        self.fire = np.zeros((votes.shape[1], 2, 2))
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                for a in (0, 1):
                    here = w[above == a, y]
                    fired = (here * votes[above == a, j]).sum()
                    base = (w[:, y] * votes[:, j]).sum() / max(w[:, y].sum(), 1e-9)
                    self.fire[j, y, a] = (fired + self.smooth * (base + 0.01)) / (
                        here.sum() + self.smooth * 1.02
                    )

    @staticmethod
    def _tree(votes: np.ndarray, w: np.ndarray) -> list[int]:
        """Parents in a spanning tree of largest conditional mutual information."""
        n = votes.shape[1]
        total = max(w.sum(), 1e-9)
        info = np.zeros((n, n))
        for y in (0, 1):
            mass = max(w[:, y].sum(), 1e-9)
            both = (votes * w[:, y : y + 1]).T @ votes / mass
            one = np.diag(both)
            for a in (0, 1):
                for b in (0, 1):
                    pa, pb = (one if a else 1 - one), (one if b else 1 - one)
                    joint = both if a and b else (
                        one[:, None] - both if a else one[None, :] - both if b
                        else 1 - one[:, None] - one[None, :] + both
                    )
                    ratio = np.maximum(joint, 1e-12) / np.maximum(pa[:, None] * pb[None, :], 1e-12)
                    info += mass / total * np.maximum(joint, 0) * np.log(ratio)
        parent, inside = [-1] * n, [0]
        while len(inside) < n:
            outside = [j for j in range(n) if j not in inside]
            part = info[np.ix_(outside, inside)]
            i, k = np.unravel_index(part.argmax(), part.shape)
            parent[outside[i]] = inside[k]
            inside.append(outside[i])
        return parent

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.full(len(votes), np.log(self.prior / (1 - self.prior)))
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            chance = [np.where(votes[:, j] == 1, f[above], 1 - f[above]) for f in self.fire[j]]
            odds += np.log(np.maximum(chance[1], 1e-9)) - np.log(np.maximum(chance[0], 1e-9))
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weights (last: constant) of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - soft)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w
