"""A random forest of deep trees over a vector column, for tables of any number of rows.

Spark's own forest adds up statistics of every open node in every task, which grows with the
nodes times the tasks. Here only nodes of more than `taskRows` rows are cut from histograms that
tasks add up; the rows of smaller ones meet in one task, which grows all that is below. Trees stay
a table: what is below the first cuts is neither collected nor broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
    MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.constants import SEED
from channel_signals.functions import class_trees as T
from channel_signals.session import materialize

#: Rows that deal themselves out to all trees in one task.
DEALT_ROWS = 5_000
#: Rows, over all trees, that are grown in one task.
GROWN_ROWS = 2_000_000
#: Trees whose rows leave a task together, and large nodes counted at once.
TREES_AT_ONCE, LARGE_AT_ONCE = 32, 2_048
DEFAULTS = dict(numTrees=100, maxDepth=30, maxBins=128, taskRows=200_000, seed=SEED, featuresCol="features", labelCol="label", weightCol="")
NODES = "tree int, node int, feature binary, cut binary, left binary, weights binary, gains array<double>"


class _Params(Params):
    numTrees = Param(Params._dummy(), "numTrees", "trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "cuts on a way, at most", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a column, at most 256", TypeConverters.toInt)
    taskRows = Param(Params._dummy(), "taskRows", "rows of a node that may meet in one task", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "classes from 0 on", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "weight of a row, or empty", TypeConverters.toString)

    def _get(self, name):
        return self.getOrDefault(getattr(self, name))


class Top:
    """The first cuts of a tree, to nodes of at most `taskRows` rows or without a cut."""

    def __init__(self, key: int):
        self.feature, self.cut, self.left, self.keys, self.depth = [-1], [0], [0], [key], [0]

    def split(self, node: int, feature: int, cut: int) -> int:
        left = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, left
        self.feature += [-1, -1]
        self.cut += [0, 0]
        self.left += [0, 0]
        self.keys += [int(k) for k in T.child_keys(np.array([self.keys[node]], np.uint64))]
        self.depth += [self.depth[node] + 1] * 2
        return left

    def walk(self, bins: np.ndarray) -> np.ndarray:
        return T.walk(np.array(self.feature), np.array(self.cut), np.array(self.left), bins)


def _packed(nodes: T.Nodes) -> tuple[bytes, bytes, bytes, bytes]:
    kinds = (np.int16, np.uint8, np.int32, np.float64)
    return tuple(x.astype(k).tobytes() for x, k in zip(nodes, kinds))


def thresholds(df: DataFrame, values: str, columns: int, bins: int) -> list[np.ndarray]:
    """Upper ends of all bins but the last, by column: between all values where these are few, else quantiles of all rows."""
    probs = [i / bins for i in range(1, bins)]
    v = F.col(values)
    row = df.agg(*[f for i in range(columns) for f in (
        F.approx_count_distinct(v[i]).alias(f"n_{i}"), F.max(v[i]).alias(f"max_{i}"),
        F.percentile_approx(v[i], probs, 10_000).alias(f"q_{i}"))]).first()
    few = [i for i in range(columns) if row[f"n_{i}"] <= 2 * bins]
    seen: dict[int, list[float]] = {i: [] for i in few}
    if few:
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v[i].alias("x")) for i in few])).alias("c")
        for r in df.select(cells).select("c.i", "c.x").where("x is not null").distinct().collect():
            seen[r["i"]].append(r["x"])
    out = []
    for i in range(columns):
        if i in seen and len(seen[i]) <= bins:
            x = np.unique(seen[i])
            out.append((x[:-1] + x[1:]) / 2)
        else:
            out.append(np.array([q for q in sorted(set(row[f"q_{i}"])) if q < row[f"max_{i}"]]))
    return out


def _binned(cells: pa.Array, ends: list[np.ndarray]) -> np.ndarray:
    x = cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), len(ends))
    return np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(ends)], axis=1).astype(np.uint8)


def _matrix(cells: pa.Array, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.uint8).reshape(len(cells), columns)


class DeepForest(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Bootstrapped trees by Gini impurity; a node tries the square root of the columns.

    The bootstrap takes a row as often as a Poisson draw of mean one says.
    """

    @keyword_only
    def __init__(self, *, numTrees=100, maxDepth=30, maxBins=128, taskRows=200_000, seed=SEED,
                 featuresCol="features", labelCol="label", weightCol=""):
        super().__init__()
        self._setDefault(**DEFAULTS)
        self._set(**self._input_kwargs)

    def _rows(self, df: DataFrame) -> tuple[DataFrame, list[np.ndarray], int, T.Shape]:
        """(id, label, weight, bins): numbered by what they hold, so that partitions change nothing."""
        weight = F.col(self._get("weightCol")).cast("double") if self._get("weightCol") else F.lit(1.0)
        raw = df.select(F.col(self._get("labelCol")).cast("int").alias("label"), weight.alias("weight"),
                        vector_to_array(self._get("featuresCol")).alias("x"))
        size = raw.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.max("label").alias("k")).first()
        if not size["n"]:
            raise ValueError("no rows to fit")
        ends = thresholds(raw, "x", size["d"], self._get("maxBins"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    bins = pa.array([x.tobytes() for x in _binned(b.column(2), ends)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bins], names=["label", "weight", "bins"])

        cells = raw.mapInArrow(run, "label int, weight double, bins binary")
        dealt = cells.repartition(math.ceil(size["n"] / DEALT_ROWS), "bins", "label", "weight").sortWithinPartitions("bins", "label", "weight")
        rows = materialize(dealt.select(F.monotonically_increasing_id().alias("id"), "label", "weight", "bins"))
        shape = T.Shape(max(size["k"] + 1, 2), math.ceil(math.sqrt(size["d"])), max(len(e) for e in ends) + 1, self._get("maxDepth"))
        return rows, ends, size["n"], shape

    def _top(self, rows: DataFrame, columns: int, n: int, shape: T.Shape) -> tuple[list[Top], dict, dict]:
        """The first cuts of every tree; (tree, node) to column, gain and weights of a large node
        that is cut, and to the weights of one that is not."""
        tops = [Top(T.root_key(self._get("seed"), t)) for t in range(self._get("numTrees"))]
        cuts, leaves = {}, {}
        bound = self._get("taskRows")
        wanted = [(t, 0) for t in range(len(tops))] if n > bound else []
        while wanted:
            now, wanted = wanted[:LARGE_AT_ONCE], wanted[LARGE_AT_ONCE:]
            for slot, gain, feature, cut, whole, sides in _large_cuts(rows, tops, now, columns, shape):
                t, node = now[slot]
                if gain <= T.LEAST_GAIN or tops[t].depth[node] >= shape.depth:
                    leaves[t, node] = whole
                    continue
                left = tops[t].split(node, feature, cut)
                cuts[t, node] = feature, gain * sum(whole), whole
                wanted += [(t, left + side) for side in (0, 1) if sides[side] > bound]
        return tops, cuts, leaves

    def _fit(self, df: DataFrame) -> "DeepForestModel":
        rows, ends, n, shape = self._rows(df)
        columns = len(ends)
        tops, cuts, leaves = self._top(rows, columns, n, shape)
        done = set(leaves)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, label, weight = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                bins = _matrix(b.column(3), columns)
                for first in range(0, len(tops), TREES_AT_ONCE):
                    out = []
                    for t in range(first, min(first + TREES_AT_ONCE, len(tops))):
                        drawn = T.copies(ids, tops[t].keys[0])
                        taken = np.flatnonzero(drawn)
                        at = tops[t].walk(bins[taken])
                        for node in np.unique(at):
                            mine = taken[at == node]
                            if (t, int(node)) not in done:
                                out.append((t, int(node), int(ids[mine[0]]), bins[mine].tobytes(), label[mine].astype(np.int32).tobytes(),
                                            (weight[mine] * drawn[mine]).tobytes()))
                    if out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                            names=["tree", "node", "first", "bins", "label", "weight"])

        def finish(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("first")
            t, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
            bins, label, weight = (np.frombuffer(b"".join(pdf[c]), k) for c, k in (("bins", np.uint8), ("label", np.int32), ("weight", np.float64)))
            nodes, gains = T.grow(bins.reshape(-1, columns), label, weight, tops[t].keys[node], tops[t].depth[node], shape)
            return pd.DataFrame([(t, node, *_packed(nodes), gains)], columns=["tree", "node", "feature", "cut", "left", "weights", "gains"])

        # as many tasks as the work asks for, which the size of the packed rows does not show
        tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * len(tops) / GROWN_ROWS))
        dealt = rows.mapInArrow(deal, "tree int, node int, first long, bins binary, label binary, weight binary")
        grown = materialize(dealt.repartition(tasks, "tree", "node").groupBy("tree", "node").applyInPandas(finish, NODES))
        if cuts or leaves:
            grown = grown.unionByName(df.sparkSession.createDataFrame(_joined(tops, cuts, leaves, grown, columns), NODES))
        return self._copyValues(DeepForestModel(tops, ends, shape.classes, grown))


def _joined(tops: list[Top], cuts: dict, leaves: dict, grown: DataFrame, columns: int) -> list[tuple]:
    """Rows of the large nodes. Cuts between leaves of equal decision are taken back; a cut that
    stays has the row -1 - node, with its gain."""
    alone = grown.where(F.octet_length("feature") == 2).select("tree", "node", "weights")  # one number of two bytes
    decided = {(r["tree"], r["node"]): np.frombuffer(r["weights"], np.float64).argmax() for r in alone.collect()} if cuts else {}
    leaves = dict(leaves)
    decided |= {k: np.argmax(w) for k, w in leaves.items()}
    out = []
    for (t, node), (feature, gain, whole) in sorted(cuts.items(), reverse=True):
        sides = [(t, tops[t].left[node] + side) for side in (0, 1)]
        if all(s in decided for s in sides) and decided[sides[0]] == decided[sides[1]]:
            tops[t].feature[node] = -1
            leaves[t, node], decided[t, node] = whole, np.argmax(whole)
        else:
            gains = [0.0] * columns
            gains[feature] = gain
            out.append((t, -1 - node, None, None, None, None, gains))
    return out + [(t, node, *_packed(T.Nodes(np.full(1, -1), np.zeros(1), np.zeros(1), np.array(w))), [0.0] * columns)
                  for (t, node), w in leaves.items()]


def _large_cuts(rows: DataFrame, tops: list[Top], wanted: list[tuple[int, int]], columns: int, shape: T.Shape) -> list[tuple]:
    """(slot, gain, column, cut, weights by class, rows on both sides) of the wanted nodes."""
    slots: dict[int, list[tuple[int, int]]] = {}
    for slot, (t, node) in enumerate(wanted):
        slots.setdefault(t, []).append((node, slot))
    keys = np.array([tops[t].keys[node] for t, node in wanted], np.uint64)
    tried = T.tried_columns(keys, columns, shape.tried)
    ones = shape._replace(classes=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            ids, label, weight = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            bins = _matrix(b.column(3), columns)
            for t, nodes in slots.items():
                drawn = T.copies(ids, tops[t].keys[0])
                taken = np.flatnonzero(drawn)
                at = tops[t].walk(bins[taken])
                for node, slot in nodes:
                    mine = taken[at == node]
                    none, ways = np.zeros(len(mine), np.int64), np.broadcast_to(tried[slot], (len(mine), shape.tried))
                    w = T.histograms(bins[mine], none, ways, label[mine].astype(np.int64), weight[mine] * drawn[mine], 1, shape)[0]
                    n = T.histograms(bins[mine], none, ways, none, np.ones(len(mine)), 1, ones)[0]
                    both = np.concatenate([w, n], axis=1)
                    sums[slot] = sums[slot] + both if slot in sums else both
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slot", "hist"])

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        hist = sum(np.frombuffer(x, np.float64) for x in sorted(pdf["hist"])).reshape(shape.tried, shape.classes + 1, shape.bins)
        gain, which, cut = (x[0] for x in T.best_cuts(hist[None, :, :shape.classes]))
        n = hist[which, shape.classes]
        return pd.DataFrame([(slot, float(gain), int(tried[slot, which]), int(cut), hist[0, :shape.classes].sum(axis=1),
                              [float(n[:cut + 1].sum()), float(n[cut + 1:].sum())])], columns=["slot", "gain", "feature", "cut", "whole", "sides"])

    found = rows.mapInArrow(count, "slot int, hist binary").groupBy("slot").applyInPandas(
        best, "slot int, gain double, feature int, cut int, whole array<double>, sides array<double>")
    return sorted(map(tuple, found.collect()))


class DeepForestModel(Model, _Params, MLReadable, MLWritable):
    """`trees` holds the nodes below each first cut's end; `tops` are the first cuts."""

    def __init__(self, tops=(), ends=(), classes: int = 2, trees: DataFrame | None = None):
        super().__init__()
        self._setDefault(**DEFAULTS)
        self.tops, self.ends, self.classes, self.trees = list(tops), [np.array(e) for e in ends], classes, trees

    @property
    def featureImportances(self) -> DenseVector:
        """Gains by column: those of a tree add up to one, and so does their mean."""
        g = self.trees.select("tree", F.posexplode("gains").alias("i", "gain")).groupBy("tree", "i").agg(F.sum("gain").alias("gain"))
        shares = g.join(g.groupBy("tree").agg(F.sum("gain").alias("all")), "tree").where("all > 0").groupBy("i").agg(
            F.sum(F.col("gain") / F.col("all")).alias("share"))
        out = np.zeros(len(self.ends))
        for r in shares.collect():
            out[r["i"]] = r["share"]
        return DenseVector(out / out.sum() if out.sum() else out)

    def _transform(self, df: DataFrame) -> DataFrame:
        tops, ends, classes = self.tops, self.ends, self.classes
        shares = [f"_share_{k}" for k in range(classes)]
        rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                ids, bins = b.column(0).to_numpy(zero_copy_only=False), _binned(b.column(1), ends)
                for first in range(0, len(tops), TREES_AT_ONCE):
                    out = []
                    for t in range(first, min(first + TREES_AT_ONCE, len(tops))):
                        at = tops[t].walk(bins)
                        out += [(t, int(node), ids[at == node].tobytes(), bins[at == node].tobytes()) for node in np.unique(at)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["tree", "node", "ids", "bins"])

        def vote(mine: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            if not len(mine) or not len(nodes):
                return pd.DataFrame({"_row": np.zeros(0, np.int64)} | {c: np.zeros(0) for c in shares})
            feature, cut, left, weights = (np.frombuffer(nodes[c].iloc[0], k) for c, k in (
                ("feature", np.int16), ("cut", np.uint8), ("left", np.int32), ("weights", np.float64)))
            ids, bins = np.frombuffer(b"".join(mine["ids"]), np.int64), np.frombuffer(b"".join(mine["bins"]), np.uint8)
            at = weights.reshape(-1, classes)[T.walk(feature, cut, left, bins.reshape(len(ids), -1))]
            at = at / at.sum(axis=1, keepdims=True)
            return pd.DataFrame({"_row": ids} | {c: at[:, k] for k, c in enumerate(shares)})

        dealt = rows.select("_row", vector_to_array(self._get("featuresCol")).alias("x")).mapInArrow(
            deal, "tree int, node int, ids binary, bins binary")
        votes = dealt.groupBy("tree", "node").cogroup(self.trees.where("node >= 0").groupBy("tree", "node")).applyInPandas(
            vote, ", ".join(["_row long", *[f"{c} double" for c in shares]]))
        # rounded, so that the order of the trees does not decide ties
        mean = votes.groupBy("_row").agg(*[F.round(F.sum(c) / F.lit(float(len(tops))), 12).alias(c) for c in shares])
        most = F.greatest(*shares)
        decided = F.coalesce(*[F.when(F.col(c) == most, F.lit(float(k))) for k, c in enumerate(shares)])
        return rows.join(mean, "_row").withColumns({
            "probability": array_to_vector(F.array(*shares)), "prediction": decided}).drop("_row", *shares)

    def write(self):
        return _Writer(self)

    @classmethod
    def read(cls):
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: DeepForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        DefaultParamsWriter.saveMetadata(m, path, self.sparkSession, extraMetadata={"classes": m.classes})
        m.trees.write.parquet(f"{path}/trees")
        tops = [(i, t.feature, t.cut, t.left) for i, t in enumerate(m.tops)]
        self.sparkSession.createDataFrame(tops, "tree int, feature array<int>, cut array<int>, left array<int>").coalesce(
            1).write.parquet(f"{path}/tops")
        ends = [(i, [float(x) for x in e]) for i, e in enumerate(m.ends)]
        self.sparkSession.createDataFrame(ends, "i int, ends array<double>").coalesce(1).write.parquet(f"{path}/ends")


class _Reader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DeepForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        read = self.sparkSession.read.parquet
        tops = []
        for r in read(f"{path}/tops").orderBy("tree").collect():
            tops.append(Top(0))
            tops[-1].feature, tops[-1].cut, tops[-1].left = list(r["feature"]), list(r["cut"]), list(r["left"])
        ends = [r["ends"] for r in read(f"{path}/ends").orderBy("i").collect()]
        model = self.cls(tops, ends, metadata["classes"], read(f"{path}/trees"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
