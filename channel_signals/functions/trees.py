"""Random trees over one column, in plain numpy: this is what the tasks import."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np

EULER = 0.5772156649015329


def expected_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    if n <= 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def fraction(seed: int, tree: int, node: int) -> float:
    """A number in [0, 1) that only the seed, the tree and the node decide."""
    return int(hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()[:12], 16) / (1 << 48)


def tree_steps(values: np.ndarray, draw: Callable[[int], float], limit: int):
    """One random tree over sorted values, as breakpoints with the change of path length
    from each breakpoint on.

    Node i splits at the share draw(i) of its range and has the children 2i, for values up to
    the cut, and 2i + 1.
    """
    edges, paths = [], []
    # (node, first value, end, depth, where the node's range starts), leftmost node last
    stack = [(1, 0, len(values), 0, -np.inf)]
    while stack:
        node, lo, hi, depth, start = stack.pop()
        low, high = values[lo], values[hi - 1]
        if hi - lo <= 1 or depth >= limit or low == high:
            edges.append(start)
            paths.append(depth + expected_path(hi - lo))
            continue
        cut = low + (high - low) * draw(node)
        cut = cut if cut < high else low
        mid = lo + int(np.searchsorted(values[lo:hi], cut, side="right"))
        # values up to the cut go left, so the right side starts just above it
        stack.append((2 * node + 1, mid, hi, depth + 1, np.nextafter(cut, np.inf)))
        stack.append((2 * node, lo, mid, depth + 1, start))
    return edges, np.diff(paths, prepend=0.0)
