"""Classification trees over binned columns, in plain numpy: this is what the tasks import.

Every draw is a hash: how often a tree takes a row of its number, which columns a node tries of
the node's key, and that of the way down to it. So neither tasks nor batches change a tree.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Cuts that gain less are rounding.
LEAST_GAIN = 1e-12
#: Nodes whose histograms are held at once.
NODES_AT_ONCE = 256
#: Chances that a row is drawn at most 0, 1, 2 .. times, for a mean of once.
_DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 20)]))


class Shape(NamedTuple):
    """What all trees of a forest share: classes, columns a node tries, bins, depth."""

    classes: int
    tried: int
    bins: int
    depth: int


class Nodes(NamedTuple):
    """Nodes of a tree. Bins up to `cut` of `feature` go to the node `left`, others to the next one;
    a node of feature -1 has no cut. `weights` are the summed weights by class."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    weights: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root_key(seed: int, tree: int) -> int:
    return int(mix(mix(np.array([seed % (1 << 64)], np.uint64)) + np.uint64(tree))[0])


def child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the left and right children, side by side."""
    return mix(np.repeat(mix(keys), 2) + np.tile(np.array([1, 2], np.uint64), len(keys)))


def copies(ids: np.ndarray, key: int) -> np.ndarray:
    """How often the tree of this root key takes each row: a Poisson draw of mean one."""
    share = (mix(mix(ids.astype(np.uint64)) ^ np.uint64(key)) >> np.uint64(11)) * (1.0 / (1 << 53))
    return np.searchsorted(_DRAWN, share, side="right")


def tried_columns(keys: np.ndarray, columns: int, tried: int) -> np.ndarray:
    """The columns that each node tries."""
    draws = mix(keys[:, None] ^ mix(np.arange(columns, dtype=np.uint64) + np.uint64(7))[None])
    return np.argsort(draws, axis=1, kind="stable")[:, :tried]


def histograms(bins, slot, tried, label, weight, n: int, shape: Shape) -> np.ndarray:
    """Weights by node, tried column, class and bin; `tried` is given by row."""
    value = np.take_along_axis(bins, tried, axis=1)
    at = ((slot[:, None] * shape.tried + np.arange(shape.tried)) * shape.classes + label[:, None]) * shape.bins + value
    return np.bincount(at.ravel(), np.repeat(weight, shape.tried), n * shape.tried * shape.classes * shape.bins).reshape(
        n, shape.tried, shape.classes, shape.bins)


def best_cuts(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain of Gini impurity, which of the tried columns, last bin on the left) by node."""
    left = hist.cumsum(axis=3)
    # summed from the other side, so that nothing stays nothing
    right = np.zeros_like(left)
    right[..., :-1] = hist[..., :0:-1].cumsum(axis=3)[..., ::-1]
    w_left, w_right = left.sum(axis=2), right.sum(axis=2)
    whole = left[..., -1].max(axis=1)
    w = whole.sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        kept = (left * left).sum(axis=2) / w_left + (right * right).sum(axis=2) / w_right
    kept = np.where((w_left > 0) & (w_right > 0), kept, -np.inf).reshape(len(hist), -1)
    at = kept.argmax(axis=1)
    gain = (kept[np.arange(len(hist)), at] - (whole * whole).sum(axis=1) / w) / w
    return gain, at // hist.shape[3], at % hist.shape[3]


def walk(feature: np.ndarray, cut: np.ndarray, left: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """The node without a cut that each row comes to."""
    at = np.zeros(len(bins), np.int64)
    on = np.flatnonzero(feature[at] >= 0)
    while len(on):
        here = at[on]
        at[on] = left[here] + (bins[on, feature[here]] > cut[here])
        on = on[feature[at[on]] >= 0]
    return at


def grow(bins, label, weight, key: int, depth: int, shape: Shape) -> tuple[Nodes, np.ndarray]:
    """The nodes below one of this key and depth, level by level, and the gain by column.

    Children of equal decision without cuts of their own are taken back, as Spark's trees do.
    """
    weights = [np.bincount(label, weight, shape.classes)[None]]
    feature, cut, left, gains = [np.full(1, -1)], [np.zeros(1, int)], [np.zeros(1, int)], [np.zeros(1)]
    total, rows, slot = 1, np.arange(len(bins)), np.zeros(len(bins), np.int64)
    keys, index = np.array([key], np.uint64), np.zeros(1, int)  # open nodes, and their place in the level
    if np.count_nonzero(weights[0]) < 2:
        rows = rows[:0]
    while len(rows) and depth < shape.depth:
        tried = tried_columns(keys, bins.shape[1], shape.tried)
        found = []
        for a in range(0, len(keys), NODES_AT_ONCE):
            n = min(NODES_AT_ONCE, len(keys) - a)
            lo, hi = np.searchsorted(slot, [a, a + n])
            r, s = rows[lo:hi], slot[lo:hi]
            found.append(best_cuts(histograms(bins[r], s - a, tried[s], label[r], weight[r], n, shape)))
        gain, which, last = (np.concatenate(x) for x in zip(*found))
        cuts = np.flatnonzero(gain > LEAST_GAIN)
        if not len(cuts):
            break
        column, place = tried[cuts, which[cuts]], index[cuts]
        feature[-1][place], cut[-1][place], left[-1][place] = column, last[cuts], total + 2 * np.arange(len(cuts))
        gains[-1][place] = gain[cuts] * weights[-1][place].sum(axis=1)
        rank = np.full(len(keys), -1)
        rank[cuts] = np.arange(len(cuts))
        inside = rank[slot] >= 0
        rows, slot = rows[inside], rank[slot[inside]]
        slot = 2 * slot + (bins[rows, column[slot]] > last[cuts][slot])
        n = 2 * len(cuts)
        at = np.bincount(slot * shape.classes + label[rows], weight[rows], n * shape.classes).reshape(n, shape.classes)
        weights.append(at)
        feature.append(np.full(n, -1)), cut.append(np.zeros(n, int)), left.append(np.zeros(n, int)), gains.append(np.zeros(n))
        total, depth = total + n, depth + 1
        index = np.flatnonzero(np.count_nonzero(at, axis=1) > 1)
        keys = child_keys(keys[cuts])[index]
        rank = np.full(n, -1)
        rank[index] = np.arange(len(index))
        inside = np.flatnonzero(rank[slot] >= 0)
        inside = inside[np.argsort(rank[slot[inside]], kind="stable")]
        rows, slot = rows[inside], rank[slot[inside]]
    starts = np.cumsum([0] + [len(f) for f in feature])
    nodes = Nodes(*(np.concatenate(x) for x in (feature, cut, left, weights)))
    gain, decided = np.concatenate(gains), nodes.weights.argmax(axis=1)
    for a, b in zip(starts[-2::-1], starts[:0:-1]):
        at = a + np.flatnonzero(nodes.feature[a:b] >= 0)
        child = nodes.left[at]
        same = (nodes.feature[child] < 0) & (nodes.feature[child + 1] < 0) & (decided[child] == decided[child + 1])
        nodes.feature[at[same]] = -1
    if nodes.feature[0] < 0:
        nodes = Nodes(*(x[:1] for x in nodes))
    cutting = nodes.feature >= 0
    return nodes, np.bincount(nodes.feature[cutting], gain[:len(cutting)][cutting], bins.shape[1])
