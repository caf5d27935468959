"""Spark's perceptron and linear SVM, fitted in tasks.

Objectives, steps and fitted models are those of Spark's classifiers. What differs is where a step is
worked out: rows are packed once, a task adds up the gradient of its rows block by block, and
features of a kernel are made where they are needed, so they are never stored. A fit over few rows is
one task, which saves a job for every step.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.functions import gradients as G
from channel_signals.operators.kernel import RandomFourierFeatures

#: Rows that one task adds up.
TASK_ROWS = 65_536


def _arrays(x: bytes, y: bytes, w: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    labels = np.frombuffer(y, np.int32)
    return np.frombuffer(x, np.float64).reshape(len(labels), -1), labels, np.frombuffer(w, np.float64)


def block_weights(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of so many rows of a partition weigh alike, also the last one, which has less."""
    def weighted(t: pa.Table) -> list[pa.RecordBatch]:
        weight = block / min(t.num_rows or block, block)
        return t.append_column("w", pa.array(np.full(t.num_rows, weight))).to_batches()

    rest: list[pa.RecordBatch] = []
    for b in batches:
        seen = pa.Table.from_batches([*rest, b])
        full = seen.num_rows // block * block
        yield from weighted(seen.slice(0, full))
        rest = seen.slice(full).to_batches()
    if rest:
        yield from weighted(pa.Table.from_batches(rest))


def learn(df: DataFrame, features: str, label: str, fit: Callable[[G.Total, int, int], np.ndarray], block: int = 0) -> np.ndarray:
    """What `fit(total, n, columns)` returns: here, or in the task that holds all rows. Rows weigh
    alike, or blocks of so many do."""
    raw = df.select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
    n, columns = raw.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to fit")
    parts = math.ceil(n / TASK_ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1),
                 *(b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))) for b in batches if b.num_rows]
        if seen:
            x, y, w = (np.concatenate(c) for c in zip(*seen))
            # in the order of what they hold, so that sums do not depend on how rows came
            order = np.lexsort([*x.T, y, w])
            cells = x[order].astype(np.float64), y[order].astype(np.int32), w[order].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], names=["x", "y", "w"])

    weighed = raw.mapInArrow(lambda batches: block_weights(batches, block), "x array<double>, y int, w double") if block else (
        raw.withColumn("w", F.lit(1.0)))
    packed = weighed.repartition(parts).mapInArrow(pack, "x binary, y binary, w binary")
    if parts == 1:
        def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    found = fit(lambda part: part(*_arrays(*row)), n, columns)
                    yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["fitted"])

        return np.frombuffer(packed.mapInArrow(alone, "fitted binary").first()["fitted"])

    # an RDD, as a job over one is planned in a fraction of the time
    kept = packed.rdd.map(lambda r: tuple(map(bytes, r))).persist(StorageLevel.MEMORY_AND_DISK)

    def total(part: G.Part) -> np.ndarray:
        sums = kept.mapPartitions(lambda rows: [part(*_arrays(*row)) for row in rows])
        return np.sum(sums.collect(), axis=0)

    try:
        return fit(total, n, columns)
    finally:
        kept.unpersist()


class TaskPerceptron(MultilayerPerceptronClassifier):
    """One hidden layer and two classes: mean cross entropy by L-BFGS, from the weights that Spark
    draws. Blocks of a partition weigh alike, as they do there."""

    def _fit_java(self, df: DataFrame):
        layers = self.getLayers()
        if len(layers) != 3 or layers[2] != 2 or self.getSolver() != "l-bfgs" or self.isSet(self.initialWeights):
            raise ValueError("one hidden layer, two classes, L-BFGS from drawn weights")
        sc = df.sparkSession.sparkContext
        sizes = sc._gateway.new_array(sc._jvm.int, 3)
        for i, size in enumerate(layers):
            sizes[i] = size
        drawn = sc._jvm.org.apache.spark.ml.ann.FeedForwardTopology.multiLayerPerceptron(sizes, True).model(self.getSeed()).weights()
        start = np.array(list(drawn.toArray()))
        w = learn(df, self.getFeaturesCol(), self.getLabelCol(), partial(
            G.fit_perceptron, start=start, hidden=layers[1], steps=self.getMaxIter(), tol=self.getTol()), self.getBlockSize())
        return self._new_java_obj("org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel",
                                  self.uid, _py2java(sc, Vectors.dense(w)))


class KernelSVC(LinearSVC):
    """A linear SVM over the features that `kernel` adds, standardised, with an intercept. A fit reads
    what the kernel reads and makes its features in the tasks."""

    def __init__(self, kernel: RandomFourierFeatures, **params):
        super().__init__(featuresCol=kernel.getOrDefault(kernel.outputCol), **params)
        self.kernel = kernel

    def _fit_java(self, df: DataFrame):
        if self.isSet(self.weightCol) or not (self.getFitIntercept() and self.getStandardization()):
            raise ValueError("rows without weights, standardised, with an intercept")
        k = self.kernel
        w = learn(df, k.getOrDefault(k.inputCol), self.getLabelCol(), partial(
            G.fit_svm, size=k.getOrDefault(k.numFeatures), gamma=k.getOrDefault(k.gamma), seed=k.getOrDefault(k.seed),
            reg=self.getRegParam(), steps=self.getMaxIter(), tol=self.getTol()))
        return self._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", self.uid,
                                  _py2java(df.sparkSession.sparkContext, Vectors.dense(w[:-1])), float(w[-1]))
