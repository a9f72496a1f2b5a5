"""Isolation forest: how few random splits set a row apart from the rest."""

from __future__ import annotations

import numpy as np


def expected_path(n: np.ndarray | int) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, "f8")
    harmonic = np.log(np.maximum(n - 1, 1)) + 0.5772156649
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees over random subsamples, each split at a random place of a random feature; kept as arrays, so that rows are scored at once."""

    def __init__(self, trees: int = 200, subsample: int = 256, seed: int = 7):
        self.trees, self.subsample, self.seed = trees, subsample, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        size = min(self.subsample, len(x))
        height = int(np.ceil(np.log2(max(size, 2))))
        nodes: list[list[float]] = []  # feature, threshold, left, right, path
        self.roots = []

        def grow(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([0, np.inf, me, me, depth + float(expected_path(len(rows)))])
            low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))
            open_ = np.flatnonzero(high > low)
            if depth < height and len(rows) > 1 and len(open_):
                f = rng.choice(open_)
                at = rng.uniform(low[f], high[f])
                below = rows[:, f] <= at
                left, right = grow(rows[below], depth + 1), grow(rows[~below], depth + 1)
                nodes[me] = [f, at, left, right, 0.0]
            return me

        for _ in range(self.trees):
            self.roots.append(grow(x[rng.choice(len(x), size, replace=False)], 0))
        table = np.array(nodes)
        self.feature, self.cut, self.left, self.right, self.path = table[:, 0].astype(int), table[:, 1], table[:, 2].astype(int), table[:, 3].astype(int), table[:, 4]
        self.height, self.norm = height, max(float(expected_path(size)), 1e-9)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 for rows that are set apart at once."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.height):
                at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / self.norm)
