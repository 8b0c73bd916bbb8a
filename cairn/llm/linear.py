"""Linear scores over hashed text features with ordered thresholds, fitted on a
bounded sample: a cumulative-link model, logistic regression for two grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values: for short arrays faster than by hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


@dataclass(frozen=True)
class Rows:
    """Sparse rows: those of row i are ids[start[i]:start[i+1]]."""

    start: np.ndarray
    ids: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        start = np.cumsum([0, *(len(i) for i, _ in rows)])
        empty = np.empty(0)
        ids = np.concatenate([i for i, _ in rows]) if rows else empty.astype(np.int64)
        return cls(start, ids.astype(np.int64), np.concatenate([v for _, v in rows]).astype(np.float32) if rows else empty)

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.ids] * self.values)])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def transposed_dot(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.ids, weights=self.values * np.repeat(g, np.diff(self.start)), minlength=size)


def _thresholds(free: np.ndarray) -> np.ndarray:
    """The first as it is, then steps up of exp(.): always in order."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def _loss(x: np.ndarray, rows: Rows, grade: np.ndarray, share: np.ndarray, size: int, l2: float) -> tuple[float, np.ndarray]:
    w, free = x[:size], x[size:]
    cut = np.concatenate([[-np.inf], _thresholds(free), [np.inf]])
    s = rows.dot(w)
    low, high = sigmoid(s - cut[grade]), sigmoid(s - cut[grade + 1])
    p = np.maximum(low - high, 1e-12)
    d_low, d_high = low * (1 - low) / p * share, high * (1 - high) / p * share
    at = np.zeros(len(cut))
    np.add.at(at, grade, d_low)
    np.add.at(at, grade + 1, -d_high)
    by_cut = at[1:-1]
    steps = np.exp(free[1:])
    g_free = np.concatenate([[by_cut.sum()], [by_cut[k + 1 :].sum() * steps[k] for k in range(len(steps))]])
    g = np.concatenate([rows.transposed_dot(d_high - d_low, size) + l2 * w, g_free])
    return float(-(share * np.log(p)).sum() + l2 / 2 * (w @ w)), g


def _minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with a halving line search."""
    value, g = f(x)
    s_all: list[np.ndarray] = []
    y_all: list[np.ndarray] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in zip(reversed(s_all), reversed(y_all), strict=True):
            alphas.append((s @ q) / (s @ y))
            q -= alphas[-1] * y
        q *= (s_all[-1] @ y_all[-1]) / (y_all[-1] @ y_all[-1]) if s_all else 1 / max(1.0, np.abs(g).sum())
        for s, y, a in zip(s_all, y_all, reversed(alphas), strict=True):
            q += (a - (y @ q) / (s @ y)) * s
        step, slope = 1.0, g @ q
        while step > 1e-6:
            new = x - step * q
            v, h = f(new)
            if v <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        if (new - x) @ (h - g) > 1e-12:
            s_all, y_all = [*s_all, new - x][-memory:], [*y_all, h - g][-memory:]
        done = value - v < 1e-6 * max(1e-3, abs(value))
        x, value, g = new, v, h
        if done:
            break
    return x


def fit(rows: Rows, grade: np.ndarray, weight: np.ndarray, grades: int, size: int, l2: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(weights of `size` features, `grades` - 1 ordered thresholds). `weight`
    is what each row stands for."""
    used, inverse = np.unique(rows.ids, return_inverse=True)
    small = Rows(rows.start, inverse, rows.values)
    x = np.concatenate([np.zeros(len(used)), [0.0], np.zeros(grades - 2)])
    x = _minimise(lambda x: _loss(x, small, grade, weight / weight.sum(), len(used), l2), x, steps)
    w = np.zeros(size, np.float32)
    w[used] = x[: len(used)]
    return w, _thresholds(x[len(used) :])


def at_least(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k from 1, a column each."""
    return sigmoid(scores[:, None] - thresholds[None, :])
