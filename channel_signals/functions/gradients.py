"""Losses of many rows and their gradients, in plain numpy: this is what the tasks import.

Rows go through in blocks that stay in the cache. What a block holds for every row and feature of a
kernel has single precision, and for every unit of a perceptron if rows are many; sums have double.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial
from typing import NamedTuple

import numpy as np

from channel_signals.functions.descent import minimize

#: Rows of a block.
BLOCK = 1024
#: Rows of a fit from which units have single precision.
MANY_ROWS = 65_536

#: Numbers of some rows, given their features, labels and weights, and the sums of these over all rows.
Part = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
Total = Callable[[Part], np.ndarray]


def projection(columns: int, size: int, gamma: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """W and b of random Fourier features."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 * gamma), size=(columns, size))
    return w, rng.uniform(0.0, 2.0 * np.pi, size=size)


class Kernel(NamedTuple):
    """cos(x w + b), times the factor."""

    w: np.ndarray
    b: np.ndarray
    factor: float

    def blocks(self, x: np.ndarray):
        """(first row, values without the factor) of every block."""
        w = np.vstack([self.w, self.b]) / (2.0 * np.pi)
        rows = np.ones((BLOCK, len(w)))
        turns, whole, out = (np.empty((BLOCK, w.shape[1]), t) for t in (np.float64, np.float64, np.float32))
        for i in range(0, len(x), BLOCK):
            n = min(BLOCK, len(x) - i)
            rows[:n, :-1] = x[i:i + n]
            t = np.dot(rows[:n], w, out=turns[:n])
            # less whole turns, so that single precision is enough
            t -= np.rint(t, out=whole[:n])
            k = out[:n]
            k[:] = t
            k *= np.float32(2.0 * np.pi)
            yield i, np.cos(k, out=k)


def moments(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """Sums of the values and of their squares."""
    out = np.zeros((2, kernel.w.shape[1]))
    for _, k in kernel.blocks(x):
        out += k.sum(axis=0, dtype=float), np.square(k, dtype=float).sum(axis=0)
    return (out * [[kernel.factor], [kernel.factor ** 2]]).ravel()


def hinge(kernel: Kernel, x: np.ndarray, y: np.ndarray, weights: np.ndarray, shift: float) -> np.ndarray:
    """Sums over the rows: hinge loss, gradient by weight, gradient by shift."""
    sign = np.where(y > 0, 1.0, -1.0)
    u = (weights * kernel.factor).astype(np.float32)
    out = np.zeros(len(weights) + 2)
    for i, k in kernel.blocks(x):
        s = sign[i:i + BLOCK]
        short = 1.0 - s * ((k @ u).astype(float) + shift)
        far = short > 0
        pull = np.where(far, -s, 0.0)
        out[0] += short[far].sum()
        out[1:-1] += pull.astype(np.float32) @ k
        out[-1] += pull.sum()
    out[1:-1] *= kernel.factor
    return out


def perceptron(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: np.ndarray, hidden: int, kind=np.float32) -> np.ndarray:
    """Sums over the rows, each by its weight w: cross entropy of two classes, and its gradient, for one layer of sigmoid
    units; weights lie as in Spark's models, layer by layer, each unit's numbers by input, then constants."""
    d = x.shape[1]
    first = weights[:hidden * (d + 1)].reshape(d + 1, hidden)
    last = weights[hidden * (d + 1):].reshape(hidden + 1, 2)
    into = -first.astype(kind)
    out_of = (last[:, 1] - last[:, 0]).astype(kind)
    sign = np.where(y > 0, 1.0, -1.0)
    value, g_first, g_last = 0.0, np.zeros((d + 1, hidden)), np.zeros(hidden + 1)
    rows = np.ones((BLOCK, d + 1), kind)
    z, slope = np.empty((BLOCK, hidden), kind), np.empty((BLOCK, hidden), kind)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), BLOCK):
            n = min(BLOCK, len(x) - i)
            r, a, b, s = rows[:n], z[:n], slope[:n], sign[i:i + n]
            r[:, :d] = x[i:i + n]
            np.dot(r, into, out=a)
            np.exp(a, out=a)
            a += kind(1.0)
            np.reciprocal(a, out=a)
            margin = s * (a @ out_of[:hidden] + out_of[hidden]).astype(float)
            e = np.exp(-np.abs(margin))
            value += (np.log1p(e) - np.minimum(margin, 0.0)) @ w[i:i + n]
            pull = -s * w[i:i + n] * np.where(margin > 0, e, 1.0) / (1.0 + e)
            p = pull.astype(kind)
            g_last[:hidden] += p @ a
            g_last[hidden] += pull.sum()
            np.multiply(a, a, out=b)
            np.subtract(a, b, out=b)
            b *= p[:, None]
            g_first += r.T @ b
    g_first *= last[:hidden, 1] - last[:hidden, 0]
    return np.concatenate([[value], g_first.ravel(), np.stack([-g_last, g_last], axis=1).ravel()])


def fit_perceptron(total: Total, n: int, columns: int, start: np.ndarray, hidden: int, steps: int, tol: float) -> np.ndarray:
    """The weights where the mean cross entropy stops falling."""
    if len(start) != hidden * (columns + 1) + 2 * (hidden + 1):
        raise ValueError(f"{columns} features, not those of the first layer")

    kind = np.float32 if n > MANY_ROWS else np.float64
    weight = total(lambda x, y, w: w.sum(keepdims=True))[0]

    def objective(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sums = total(partial(perceptron, weights=weights, hidden=hidden, kind=kind)) / weight
        return sums[0], sums[1:]

    return minimize(objective, start, steps, tol)[0]


def fit_svm(total: Total, n: int, columns: int, size: int, gamma: float, seed: int, reg: float, steps: int, tol: float) -> np.ndarray:
    """Weights of the kernel's features, then the intercept; the penalty is on standardised features."""
    kernel = Kernel(*projection(columns, size, gamma, seed), math.sqrt(2.0 / size))
    sums, squares = total(lambda x, y, _: moments(kernel, x)).reshape(2, size)
    std = np.sqrt(np.maximum(squares - sums * sums / n, 0.0) / max(n - 1, 1))
    inverse = np.divide(1.0, std, out=np.zeros(size), where=std > 0)
    mean = sums / n * inverse

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        weights, shift = w[:size] * inverse, w[size] - w[:size] @ mean
        sums = total(lambda x, y, _: hinge(kernel, x, y, weights, shift)) / n
        by = sums[1:-1] * inverse - sums[-1] * mean + reg * w[:size]
        return sums[0] + reg / 2 * (w[:size] @ w[:size]), np.append(by, sums[-1])

    w = minimize(objective, np.zeros(size + 1), steps, tol, orthant=True)[0]
    return np.append(w[:size] * inverse, w[size] - w[:size] @ mean)
