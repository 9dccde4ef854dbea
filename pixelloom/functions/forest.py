"""Small learners over the rows of one sample: a forest, a linear map, logistic outputs, a constant. They fit numpy arrays into lists of
numbers and predict from those; Spark deals the samples and keeps the numbers (see operators/trees.py).

A learner has fit(x, y, w, seed) -> list of arrays of doubles, and predict(params, x) -> one row of outputs per row. y: n x outputs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Constant:
    """The weighted mean."""

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int) -> list[np.ndarray]:
        return [np.average(y, axis=0, weights=w)]

    def predict(self, params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.repeat(params[0][None], len(x), axis=0)


@dataclass(frozen=True)
class Linear:
    """Weighted least squares with a bias and a little ridge."""

    ridge: float = 1e-9

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int) -> list[np.ndarray]:
        z = np.column_stack([x, np.ones(len(x))])
        gram = z.T @ (z * w[:, None])
        return [np.linalg.lstsq(gram + self.ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), z.T @ (y * w[:, None]), rcond=None)[0].ravel()]

    def predict(self, params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        coef = params[0].reshape(x.shape[1] + 1, -1)
        return x @ coef[:-1] + coef[-1]


@dataclass(frozen=True)
class Logistic:
    """Probabilities of the outputs (one-hot targets) by Newton steps on the penalised multinomial loss."""

    penalty: float = 1.0
    steps: int = 30

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int) -> list[np.ndarray]:
        mean, deviation = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)
        z = np.column_stack([(x - mean) / deviation, np.ones(len(x))])
        d, m = z.shape[1], y.shape[1]
        coef, keep = np.zeros((d, m)), np.append(np.full(d - 1, self.penalty), 1e-6)
        for _ in range(self.steps):
            p = _shares(z @ coef)
            slope = z.T @ ((p - y) * w[:, None]) + keep[:, None] * coef
            # the bound p (1 - p) <= 1/2 (I - 1/m) of the curvature makes every step a descent
            step = np.linalg.solve(0.5 * (z.T @ (z * w[:, None])) + np.diag(keep), slope)
            coef -= step
            if np.abs(step).max() < 1e-8:
                break
        return [mean, deviation, coef.ravel()]

    def predict(self, params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - params[0]) / params[1], np.ones(len(x))])
        return _shares(z @ params[2].reshape(z.shape[1], -1))


def _shares(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Forest:
    """Bootstrapped trees that lower the squared error of all outputs; with one-hot targets that is the Gini impurity. Features per split:
    all for a single output, else the root of their number."""

    trees: int = 10
    depth: int = 5
    least: int = 2
    balanced: bool = False

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, seed: int) -> list[np.ndarray]:
        if self.balanced:
            sizes = y.sum(axis=0)
            w = w * (len(y) / np.maximum(sizes, 1) / max(1, (sizes > 0).sum()))[y.argmax(axis=1)]
        rng, out = np.random.default_rng(seed), []
        some = x.shape[1] if y.shape[1] == 1 else max(1, int(np.sqrt(x.shape[1])))
        for _ in range(self.trees):
            rows = rng.integers(len(x), size=len(x)) if self.trees > 1 else np.arange(len(x))
            out.append(self._grow(x, y, w, rows, some, rng))
        feature, limit, left, value = (np.concatenate(c) for c in zip(*out, strict=True))
        base = np.cumsum([0, *(len(t[0]) for t in out[:-1])])
        shift = np.repeat(base, [len(t[0]) for t in out])
        return [feature, limit, np.where(left > 0, left + shift, 0).astype(float), value.ravel(), base.astype(float)]

    def _grow(self, x, y, w, rows, some, rng) -> tuple[np.ndarray, ...]:
        feature, limit, left, value, todo = [-1.0], [0.0], [0], [None], [(0, rows, 0)]
        while todo:
            at, own, depth = todo.pop(0)
            value[at] = np.average(y[own], axis=0, weights=w[own])
            if depth == self.depth or len(own) < 2 * self.least or not np.ptp(y[own], axis=0).any():
                continue
            tried = np.arange(x.shape[1]) if some == x.shape[1] else np.sort(rng.choice(x.shape[1], some, replace=False))
            found = self._best(x[own][:, tried], y[own], w[own])
            if found is None:
                continue
            feature[at], limit[at], left[at] = float(tried[found[0]]), found[1], len(feature)
            right = x[own, tried[found[0]]] > found[1]
            for side in (own[~right], own[right]):
                todo.append((len(feature), side, depth + 1))
                feature.append(-1.0)
                limit.append(0.0)
                left.append(0)
                value.append(None)
        return np.array(feature), np.array(limit), np.array(left, float), np.array(value)

    def _best(self, x, y, w) -> tuple[int, float] | None:
        """(feature, limit) of the largest gain."""
        order = np.argsort(x, axis=0, kind="stable")
        s = np.take_along_axis(x, order, axis=0)
        weight, total = w[order], (y * w[:, None])[order]  # n x d, n x d x outputs
        a, b = np.cumsum(weight, axis=0)[:-1], np.cumsum(total, axis=0)[:-1]
        gain = (b**2).sum(axis=2) / a + ((total.sum(axis=0) - b) ** 2).sum(axis=2) / np.maximum(w.sum() - a, 1e-300)
        n = np.arange(1, len(x))
        gain[(s[1:] <= s[:-1]) | ((n < self.least) | (len(x) - n < self.least))[:, None]] = -np.inf
        k, j = np.unravel_index(int(gain.argmax()), gain.shape)
        if not np.isfinite(gain[k, j]):
            return None
        middle = (s[k, j] + s[k + 1, j]) / 2
        return int(j), float(middle if middle < s[k + 1, j] else s[k, j])

    def predict(self, params: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, left = params[0].astype(int), params[2].astype(int)
        value = params[3].reshape(len(feature), -1)
        at = np.repeat(params[4].astype(int)[:, None], len(x), axis=1)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            right = x[np.arange(len(x))[None], np.maximum(feature[at], 0)] > params[1][at]
            at = np.where(inner, left[at] + right, at)
        return value[at].mean(axis=0)
