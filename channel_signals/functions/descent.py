"""Minimising a smooth function by its gradient, in plain numpy: what the driver and the tasks import.

Steps are those of Breeze, which Spark's own classifiers call: ten steps are remembered, and a run
ends at a small gradient or when its last twenty values hardly differ.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import numpy as np

#: Steps that are remembered, and values that must hardly differ at the end.
MEMORY, VALUES = 10, 20

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


class SearchFailed(Exception):
    """No step along the direction is good enough."""


def _direction(grad: np.ndarray, history: deque) -> np.ndarray:
    """Against the gradient, bent by what the last steps have shown."""
    out, shares = grad.copy(), []
    for step, change in history:
        shares.append(step @ out / (step @ change))
        out -= shares[-1] * change
    if history:
        step, change = history[0]
        if not step @ change > 0:
            raise SearchFailed
        out *= (step @ change) / (change @ change)
    for (step, change), share in zip(reversed(history), reversed(shares)):
        out += (share - change @ out / (step @ change)) * step
    return -out


def _between(low: tuple, high: tuple) -> float:
    """Where the cubic through both ends is least, not too close to either."""
    (a, f_a, d_a), (b, f_b, d_b) = sorted((low, high))
    d1 = d_a + d_b - 3 * (f_a - f_b) / (a - b)
    d2 = math.sqrt(max(d1 * d1 - d_a * d_b, 0.0))
    below = d_b - d_a + 2 * d2
    t = b - (b - a) * (d_b + d2 - d1) / below if below else (a + b) / 2
    return min(max(t, a + 0.1 * (b - a)), a + 0.9 * (b - a))


def _wolfe(along: Callable[[float], tuple[float, float]], value: float, slope: float, t: float) -> float:
    """A step with enough decrease and a flat enough end (Nocedal and Wright, 3.5 and 3.6)."""
    if slope > 0:
        raise SearchFailed
    low = (0.0, value, slope)
    for i in range(10):
        c = (t, *along(t))
        if not math.isfinite(c[1]):
            t /= 2
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i):
            return _zoom(along, value, slope, low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return _zoom(along, value, slope, c, low)
        low, t = c, 1.5 * t
    raise SearchFailed


def _zoom(along, value: float, slope: float, low: tuple, high: tuple) -> float:
    for _ in range(10):
        t = _between(low, high)
        c = (t, *along(t))
        if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
            high = c
            continue
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise SearchFailed


def _backtracking(along: Callable[[float], tuple[float, float]], value: float, slope: float, t: float, shrink: float) -> float:
    """A step with enough decrease and a flat enough end, by factors; Breeze shrinks the first one unseen."""
    if slope > 1e-16:
        raise SearchFailed
    t *= shrink
    for _ in range(19):
        f, d = along(t)
        if f > value + 1e-4 * t * slope:
            t *= shrink
        elif d < 0.9 * slope:
            t *= 2.1
        elif d > -0.9 * slope:
            t *= shrink
        else:
            break
        if not 1e-10 <= t <= 1e10:
            raise SearchFailed
    return t


def minimize(objective: Objective, start: np.ndarray, steps: int, tol: float, orthant: bool = False) -> tuple[np.ndarray, list[float]]:
    """Where a run from `start` ends, and the values on its way.

    `orthant` is the variant for kinks that Spark's linear SVM takes: a step leaves out coordinates
    against their gradient, and those that would change sign stop at zero.
    """
    x = np.array(start, float)
    seen: dict[bytes, tuple[float, np.ndarray]] = {}

    def at(y: np.ndarray) -> tuple[float, np.ndarray]:
        # a search ends at a place where it has looked
        key = y.tobytes()
        if key not in seen:
            seen.clear()
            seen[key] = objective(y)
        return seen[key]

    value, grad = at(x)
    first, values, history, failed = value, [value], deque(maxlen=MEMORY), False
    while len(values) <= steps and np.linalg.norm(grad) > max(tol * abs(value), 1e-8):
        if len(values) > VALUES and max(values[-VALUES:]) - value <= tol * abs(first):
            break
        try:
            way = _direction(grad, history)
            if orthant:
                way = np.where(way * grad < 0, way, 0.0)
            side = np.where(x != 0, np.sign(x), -np.sign(grad))

            def end(t: float) -> np.ndarray:
                y = x + t * way
                return np.where(np.sign(y) == side, y, 0.0) if orthant else y

            def along(t: float) -> tuple[float, float]:
                f, g = at(end(t))
                return f, g @ way

            begin = len(values) == 1
            if orthant:
                t = _backtracking(along, value, grad @ way, 0.5 / np.linalg.norm(grad) if begin else 1.0, 0.1 if begin else 0.5)
            else:
                t = _wolfe(along, value, grad @ way, 1.0 / np.linalg.norm(way) if begin else 1.0)
                if t * np.linalg.norm(grad) < 1e-10:
                    raise SearchFailed
        except SearchFailed:
            # once more without what is remembered, then it is over
            if failed:
                break
            failed = True
            history.clear()
            continue
        y = end(t)
        f, g = at(y)
        history.appendleft((y - x, g - grad))
        x, value, grad, failed = y, f, g, False
        values.append(value)
    return x, values
