"""A generative label model over binary voters, and a linear classifier on its posterior labels (NumPy).

Both are fitted on the driver from a bounded sample of votes; nothing here touches Spark.
"""

from __future__ import annotations

import numpy as np


class LabelModel:
    """P(votes | class) as one tree of voters per model: every voter depends on the class (its accuracy) and
    on one other voter (its strongest correlation given the class); annotator votes depend on the class alone.

    Fitted by expectation and maximisation from first posteriors; the tree joins the pairs of the largest
    mutual information given the class.
    """

    def __init__(self, steps: int = 12, smooth: float = 1.0):
        self.steps, self.smooth = steps, smooth

    def fit(self, votes: np.ndarray, annotator: np.ndarray, first: np.ndarray) -> LabelModel:
        """``votes``: rows x voters of 0 and 1; ``annotator``: 0, 1 or -1 (did not vote); ``first``: P(class 1)."""
        v = votes.astype(np.float64)
        post = np.clip(first.astype(np.float64), 0.02, 0.98)
        for _ in range(self.steps):
            self._maximise(v, annotator, post)
            new = self.posterior(votes, annotator)
            moved = float(np.abs(new - post).max()) if len(post) else 0.0
            post = np.clip(new, 1e-4, 1 - 1e-4)
            if moved < 1e-3:
                break
        self._maximise(v, annotator, post)
        return self

    def _maximise(self, v: np.ndarray, annotator: np.ndarray, post: np.ndarray) -> None:
        m, s = v.shape[1], self.smooth
        weight = np.stack([1 - post, post])
        total = weight.sum(axis=1)
        self.prior = (total + s) / (total.sum() + 2 * s)
        both = np.stack([(v * w[:, None]).T @ v for w in weight])  # joint counts of votes per class
        ones = np.stack([np.diag(b) for b in both])
        #: accuracy[y, i]: the share of class y that voter i votes 1 for.
        self.accuracy = (ones + s) / (total[:, None] + 2 * s)
        self.parent = self._tree(both, ones, total)
        # given[y, i, a]: P(vote i = 1 | class y, parent's vote = a)
        self.given = np.empty((2, m, 2))
        for i, p in enumerate(self.parent):
            if p < 0:
                self.given[:, i, :] = self.accuracy[:, i, None]
            else:
                with1 = (both[:, i, p] + s * self.accuracy[:, i]) / (ones[:, p] + s)
                with0 = (ones[:, i] - both[:, i, p] + s * self.accuracy[:, i]) / (total - ones[:, p] + s)
                self.given[:, i, 0], self.given[:, i, 1] = with0, with1
        seen = annotator >= 0
        agree = np.array([(w[seen] * annotator[seen]).sum() for w in weight])
        #: annotation[y]: the share of class y that the annotator marks 1; a weak prior holds it right of chance.
        prior = np.array([0.1, 0.9])
        self.annotation = (agree + 10 * prior) / (np.array([w[seen].sum() for w in weight]) + 10)

    def _tree(self, both: np.ndarray, ones: np.ndarray, total: np.ndarray) -> np.ndarray:
        """The maximum spanning tree of the voters by mutual information given the class; parents, -1 at the root."""
        m = ones.shape[1]
        n = total.sum() + 1e-9
        info = np.zeros((m, m))
        for y in (0, 1):
            t = total[y] + 1e-9
            for a in (0, 1):
                for b in (0, 1):
                    i1, j1 = ones[y][:, None], ones[y][None, :]
                    pair = (both[y] if a and b else i1 - both[y] if a else j1 - both[y] if b else t - i1 - j1 + both[y])
                    pi, pj = (i1 if a else t - i1), (j1 if b else t - j1)
                    p = np.maximum(pair, 0) / n
                    with np.errstate(divide="ignore", invalid="ignore"):
                        info += np.where(p > 0, p * np.log(np.maximum(pair, 1e-12) * t / np.maximum(pi * pj, 1e-12)), 0.0)
        np.fill_diagonal(info, -1)
        #: correlation of every pair of voters given the class, in nats
        self.correlation = info
        parent = np.full(m, -1)
        best, to, left = np.full(m, -np.inf), np.full(m, -1), np.ones(m, dtype=bool)
        at = 0
        for _ in range(m - 1):
            left[at] = False
            closer = left & (info[at] > best)
            best[closer], to[closer] = info[at][closer], at
            at = int(np.argmax(np.where(left, best, -np.inf)))
            parent[at] = to[at]
        return parent

    def posterior(self, votes: np.ndarray, annotator: np.ndarray | None = None) -> np.ndarray:
        """P(class 1 | votes)."""
        v = votes.astype(np.int64)
        log = np.zeros((2, len(v)))
        for y in (0, 1):
            log[y] = np.log(self.prior[y])
            for i, p in enumerate(self.parent):
                one = self.given[y, i][v[:, p]] if p >= 0 else np.full(len(v), self.given[y, i, 0])
                log[y] += np.log(np.where(v[:, i] == 1, one, 1 - one))
            if annotator is not None:
                one = self.annotation[y]
                log[y] += np.where(annotator < 0, 0.0, np.log(np.where(annotator == 1, one, 1 - one)))
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


class LinearClassifier:
    """Logistic regression on sparse 0/1 rows with soft targets (full-batch Adam, L2)."""

    def __init__(self, l2: float = 2e-4, steps: int = 400, rate: float = 0.1):
        self.l2, self.steps, self.rate = l2, steps, rate

    def fit(self, row: np.ndarray, col: np.ndarray, target: np.ndarray, size: int) -> LinearClassifier:
        """``row, col``: places of the ones; ``target``: P(class 1) of every row."""
        w, m, v = (np.zeros(size + 1) for _ in range(3))
        n = max(len(target), 1)
        base = np.clip(target.mean() if len(target) else 0.0, 1e-3, 1 - 1e-3)
        w[size] = np.log(base / (1 - base))
        for step in range(1, self.steps + 1):
            z = np.bincount(row, w[col], minlength=len(target)) + w[size]
            miss = 1 / (1 + np.exp(-np.clip(z, -50, 50))) - target
            g = np.r_[np.bincount(col, miss[row], minlength=size), miss.sum()] / n
            g[:size] += self.l2 * w[:size]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= self.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
        self.weight, self.bias = w[:size], float(w[size])
        return self

    def predict(self, row: np.ndarray, col: np.ndarray, rows: int) -> np.ndarray:
        z = np.bincount(row, self.weight[col], minlength=rows) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))
