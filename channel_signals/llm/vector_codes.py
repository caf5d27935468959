"""Vectors as short codes: one codebook for each part, fitted by dual-tree Lloyd rounds.

Vectors become integers and are kept in blocks, each with a box tree over its parts at every
part position; the trees are built once and hold sums and counts. A round builds a box tree
over the entries of a codebook and walks both trees down together. Bounds on the distance
between a node of parts and a node of entries, and the exact margin by which one entry beats
another over a whole box, rule combinations out. A node left with one entry is assigned as a
whole, from its stored sums; parts in leaves left with several compare integer distances.
Everything is integer arithmetic, so results do not depend on how rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one block, and parts of one leaf of its trees.
BLOCK_ROWS, LEAF = 4096, 16
#: Components beyond this, after scaling, would overflow squared distances.
LARGEST = float(1 << 27)


class PartTree:
    """A balanced box tree over the parts of a block at one position.

    Leaves hold LEAF places in an order that halves each node along its widest side. Missing
    places repeat the last part and have no weight. `low`, `high`, `total` and `count` are
    lists over levels, the root first.
    """

    def __init__(self, points: np.ndarray):
        n, dim = points.shape
        depth = 0
        while LEAF << depth < n:
            depth += 1
        slots = LEAF << depth
        place = np.minimum(np.arange(slots), n - 1)
        weight = np.arange(slots) < n
        for level in range(depth):
            held = points[place].reshape(1 << level, -1, dim)
            side = (held.max(axis=1) - held.min(axis=1)).argmax(axis=1)
            key = np.take_along_axis(held, side[:, None, None], axis=2)[:, :, 0]
            order = np.argsort(key, axis=1, kind="stable") + (np.arange(1 << level) * (slots >> level))[:, None]
            place, weight = place[order.ravel()], weight[order.ravel()]
        self.place, self.weight, self.depth = place, weight, depth
        self.points = points[place]
        leaves = self.points.reshape(-1, LEAF, dim)
        low, high = [leaves.min(axis=1)], [leaves.max(axis=1)]
        total = [(leaves * weight.reshape(-1, LEAF, 1)).sum(axis=1)]
        count = [weight.reshape(-1, LEAF).sum(axis=1)]
        for _ in range(depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            total.append(total[-1][::2] + total[-1][1::2])
            count.append(count[-1][::2] + count[-1][1::2])
        self.low, self.high, self.total, self.count = (x[::-1] for x in (low, high, total, count))


class EntryTree:
    """A balanced box tree over the entries of one codebook; level 0 is the root."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        order = np.arange(len(entries))
        groups = [order]
        self.levels = [groups]
        while max(map(len, groups)) > 1:
            split = []
            for g in groups:
                if len(g) > 1:
                    side = np.ptp(entries[g], axis=0).argmax()
                    g = g[np.argsort(entries[g][:, side], kind="stable")]
                    split += [g[:len(g) // 2], g[len(g) // 2:]]
                else:
                    split.append(g)
            groups = split
            self.levels.append(groups)
        self.boxes = [(np.array([entries[g].min(axis=0) for g in gs]), np.array([entries[g].max(axis=0) for g in gs]))
                      for gs in self.levels]
        # which node of a level lies in which node of the level above
        self.inside = []
        for above, below in zip(self.levels, self.levels[1:]):
            owner = {int(e): i for i, g in enumerate(above) for e in g}
            self.inside.append(np.array([owner[int(g[0])] for g in below]))


def assigned(tree: PartTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of every place, sums, counts) of the nearest entries; ties go to the lower index.

    `codes` of whole nodes are spread over their places; sums and counts come from the nodes'
    stored ones, and from single parts in uncertain leaves.
    """
    book = EntryTree(entries)
    k, dim = entries.shape
    codes = np.zeros(len(tree.place), np.int64)
    sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
    squares = (entries ** 2).sum(axis=1)
    nodes = np.zeros(1, np.int64)
    level = 0
    open_ = np.ones((1, 1), bool)
    for depth in range(tree.depth + 1):
        low, high = tree.low[depth][nodes], tree.high[depth][nodes]
        while True:
            elow, ehigh = book.boxes[level]
            gap = np.maximum(0, np.maximum(elow - high[:, None], low[:, None] - ehigh))
            reach = np.maximum(ehigh - low[:, None], high[:, None] - elow)
            near, far = (gap ** 2).sum(axis=2), (reach ** 2).sum(axis=2)
            least = np.where(open_, far, np.iinfo(np.int64).max).min(axis=1)
            open_ = open_ & (near <= least[:, None])
            # entries are opened one level for each level of parts, all of them at the leaves
            if level == len(book.levels) - 1:
                break
            if depth < tree.depth and level >= depth + 1:
                break
            open_ = open_[:, book.inside[level]]
            level += 1
        if level == len(book.levels) - 1:
            leaf_of = np.array([int(g[0]) for g in book.levels[-1]])
            mask = np.zeros((len(nodes), k), bool)
            mask[:, leaf_of] = open_
            mask = _unbeaten(low, high, entries, squares, mask)
            whole = mask.sum(axis=1) == 1
            if whole.any():
                best = mask[whole].argmax(axis=1)
                np.add.at(sums, best, tree.total[depth][nodes[whole]])
                np.add.at(counts, best, tree.count[depth][nodes[whole]])
                span = len(tree.place) >> depth
                codes[(nodes[whole] * span)[:, None] + np.arange(span)] = best[:, None]
            nodes, mask = nodes[~whole], mask[~whole]
            open_ = mask[:, leaf_of]
        if depth < tree.depth:
            nodes = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes))
            open_ = np.repeat(open_, 2, axis=0)
    if len(nodes):
        at = (nodes * LEAF)[:, None] + np.arange(LEAF)
        points = tree.points[at]
        distance = ((points[:, :, None, :] - entries) ** 2).sum(axis=3)
        best = np.where(mask[:, None, :], distance, np.iinfo(np.int64).max).argmin(axis=2)
        codes[at] = best
        real = tree.weight[at]
        np.add.at(sums, best[real], points[real])
        counts += np.bincount(best[real], minlength=k)
    return codes, sums, counts


def _unbeaten(low, high, entries, squares, mask) -> np.ndarray:
    """`mask` without the entries that the one nearest to the box's middle beats at every
    point of the box; at equal distance the lower index wins."""
    middle = (low + high) // 2
    distance = np.where(mask, ((middle[:, None] - entries) ** 2).sum(axis=2), np.iinfo(np.int64).max)
    best = distance.argmin(axis=1)
    # |p - a|^2 - |p - b|^2 is linear in p: its largest value over a box is at a corner
    step = 2 * (entries[None] - entries[best][:, None])
    worst = np.maximum(step * low[:, None], step * high[:, None]).sum(axis=2) + squares[best][:, None] - squares
    lost = (worst < 0) | (worst == 0) & (np.arange(len(entries)) > best[:, None])
    lost[np.arange(len(best)), best] = False
    return mask & ~lost


#: Boxes hold components, which fit 32 bits.
_KIND = {"low": "<i4", "high": "<i4", "total": "<i8", "count": "<i8"}


def _pack(tree: PartTree) -> dict[str, bytes]:
    return {
        "place": tree.place.astype("<i4").tobytes(), "weight": tree.weight.tobytes(),
        "points": tree.points.astype("<i4").tobytes(),
        **{name: np.concatenate(getattr(tree, name)).astype(_KIND[name]).tobytes() for name in _KIND}}


def _unpack(row: dict, dim: int) -> PartTree:
    tree = PartTree.__new__(PartTree)
    tree.place = np.frombuffer(row["place"], "<i4").astype(np.int64)
    tree.weight = np.frombuffer(row["weight"], bool)
    tree.points = np.frombuffer(row["points"], "<i4").astype(np.int64).reshape(-1, dim)
    tree.depth = (len(tree.place) // LEAF).bit_length() - 1
    at = [(1 << d) - 1 for d in range(tree.depth + 2)]
    for name, kind in _KIND.items():
        flat = np.frombuffer(row[name], kind).astype(np.int64)
        flat = flat.reshape(-1, dim) if name != "count" else flat
        setattr(tree, name, [flat[a:b] for a, b in zip(at, at[1:])])
    return tree


_TREE = "struct<place:binary,weight:binary,points:binary,low:binary,high:binary,total:binary,count:binary>"
_TREE_ARROW = pa.struct([(n, pa.binary()) for n in ("place", "weight", "points", "low", "high", "total", "count")])


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row a kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Reads vec_id, embedding and label alone, so other columns never clash. Vectors that are
    null, empty or hold null or non-finite components are dropped, as are those that `parts`
    does not divide or whose length differs from that of the first by id (a null id comes last,
    equal ids by their components). Components must stay below 2**27 after scaling, else the
    job stops with an error. Fewer than `entries` vectors make shorter codebooks, none an empty
    table. Repeated rows each count. The driver holds the codebooks, nothing that grows.
    """
    x = F.col("embedding")
    fine = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.lit(float(SCALE)) * v.cast("double")).cast("long"))
    kept = vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), ints.alias("v"))
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    label = vectors.schema["label"].dataType
    if not start:
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = len(start[0]["v"])
    start = [r["v"] for r in start if len(r["v"]) == width]
    kept = kept.where(F.size("v") == width)
    if len(start) < entries:
        start = [r["v"] for r in kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
    dim = width // parts
    books = np.array(start, np.int64).reshape(len(start), parts, dim).transpose(1, 0, 2)
    blocks = materialize(_blocks(kept, parts, dim, label.simpleString()))
    for _ in range(rounds):
        books = _round(blocks, books)
    return _coded(blocks, books, label.simpleString())


def _blocks(kept: DataFrame, parts: int, dim: int, label: str) -> DataFrame:
    """Rows of (vec_ids, labels, trees): at most BLOCK_ROWS vectors with a tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                own = batch.slice(lo, BLOCK_ROWS)
                flat = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, parts, dim)
                if (np.abs(flat) >= LARGEST).any():
                    raise ValueError("a component is too large for exact squared distances")
                trees = [_pack(PartTree(flat[:, p])) for p in range(parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.column(i).to_pylist()], pa.list_(own.column(i).type)) for i in (0, 1)]
                    + [pa.array([trees], pa.list_(_TREE_ARROW))], names=["vec_ids", "labels", "trees"])

    return kept.mapInArrow(run, f"vec_ids array<long>, labels array<{label}>, trees array<{_TREE}>")


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floor of each entry's mean, unused ones unchanged."""
    parts, k, dim = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, dim), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, row in enumerate(trees.as_py()):
                    _, s, c = assigned(_unpack(row, dim), books[p])
                    sums[p] += s
                    counts[p] += c
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e], pa.int64()),
             pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["p", "e", "n", "s"])

    found = blocks.select("trees").mapInArrow(run, "p int, e int, n long, s array<long>").groupBy("p", "e").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("s")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dim)]).collect()
    out = books.copy()
    for r in found:
        out[r["p"], r["e"]] = [int(r[f"s{d}"]) // r["n"] for d in range(dim)]
    return out


def _coded(blocks: DataFrame, books: np.ndarray, label: str) -> DataFrame:
    """Codes and errors of all vectors under the final codebooks."""
    parts, _, dim = books.shape
    digest = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns):
                n = len(ids)
                codes, error = np.zeros((n, parts), np.int64), np.zeros(n, np.int64)
                for p, row in enumerate(trees.as_py()):
                    tree = _unpack(row, dim)
                    code, _, _ = assigned(tree, books[p])
                    real = tree.weight
                    at, code, points = tree.place[real], code[real], tree.points[real]
                    codes[at, p] = code
                    error[at] += ((points - books[p][code]) ** 2).sum(axis=1)
                text = [bytes(c).hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, labels.values, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    rows = materialize(blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long"))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
