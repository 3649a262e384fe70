"""A random forest in NumPy: bootstrap rows, random feature subsets, Gini splits on quantile cuts.

It is trained on a bounded sample on the driver and its arrays go to the tasks, where a batch of
rows walks all trees at once.
"""

from __future__ import annotations

import numpy as np


class RandomForest:
    def __init__(self, trees: int = 40, depth: int = 8, cuts: int = 16, min_rows: int = 4, seed: int = 7):
        self.n_trees, self.depth, self.cuts, self.min_rows, self.seed = trees, depth, cuts, min_rows, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        rng = np.random.default_rng(self.seed)
        n, f = x.shape
        take = max(1, int(round(np.sqrt(f))))
        size = 2 ** (self.depth + 1)
        self.feature = np.full((self.n_trees, size), -1, dtype=np.int32)
        self.cut, self.value = np.zeros((self.n_trees, size)), np.zeros((self.n_trees, size))
        for t in range(self.n_trees):
            rows = rng.integers(0, n, n)
            todo = [(1, rows)]
            while todo:
                node, idx = todo.pop()
                yy = y[idx]
                self.value[t, node] = yy.mean()
                if 2 * node + 1 >= size or len(idx) < 2 * self.min_rows or yy.min() == yy.max():
                    continue
                best = None
                for j in rng.choice(f, size=take, replace=False):
                    v = x[idx, j]
                    for c in np.unique(np.quantile(v, np.linspace(0, 1, self.cuts + 2)[1:-1])):
                        left = v <= c
                        k = int(left.sum())
                        if k < self.min_rows or len(idx) - k < self.min_rows:
                            continue
                        pl, pr = yy[left].mean(), yy[~left].mean()
                        gini = k * pl * (1 - pl) + (len(idx) - k) * pr * (1 - pr)
                        if best is None or gini < best[0]:
                            best = (gini, j, c, left)
                if best is None:
                    continue
                _, j, c, left = best
                self.feature[t, node], self.cut[t, node] = j, c
                todo += [(2 * node, idx[left]), (2 * node + 1, idx[~left])]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean probability of class 1 over the trees."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(self.n_trees):
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                j = self.feature[t, node]
                right = x[rows, np.maximum(j, 0)] > self.cut[t, node]
                node = np.where(j >= 0, 2 * node + right, node)
            total += self.value[t, node]
        return total / self.n_trees
