"""The perceptron and the kernel SVM that are fitted in tasks, against Spark's own fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from channel_signals.functions import gradients as G
from channel_signals.functions.descent import minimize
from channel_signals.operators import gradient as O
from channel_signals.operators.kernel import RandomFourierFeatures
from channel_signals.plans import train as R

ROWS, COLUMNS = 512, 3


@pytest.fixture(scope="module")
def rows(spark):
    """The label is not linear in the features."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(ROWS, COLUMNS))
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=ROWS) > 0).astype(int)
    plain = spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, label int")
    return plain.coalesce(1).select(array_to_vector("x").alias("features"), "label").cache()


@pytest.fixture(scope="module")
def kernel():
    return RandomFourierFeatures(inputCol="features", outputCol="kernel", numFeatures=32, gamma=1.0 / COLUMNS, seed=3)


def test_descent_finds_the_valley():
    def rosenbrock(w):
        a, b = w
        return (1 - a) ** 2 + 100 * (b - a * a) ** 2, np.array([-2 * (1 - a) - 400 * a * (b - a * a), 200 * (b - a * a)])

    w, values = minimize(rosenbrock, np.array([-1.2, 1.0]), 200, 1e-12)
    assert np.allclose(w, 1.0, atol=1e-4) and values == sorted(values, reverse=True)
    assert len(minimize(rosenbrock, np.array([-1.2, 1.0]), 3, 1e-12)[1]) == 4


def test_gradients_are_those_of_the_losses(monkeypatch):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, COLUMNS)), (np.arange(50) % 3 == 0).astype(np.int32)
    kernel = G.Kernel(*G.projection(COLUMNS, 8, 0.5, 3), 0.5)
    w, u = rng.normal(size=4 * (COLUMNS + 1) + 10), rng.normal(size=8)

    def losses(w, u):
        z = 1 / (1 + np.exp(-(x @ w[:12].reshape(3, 4) + w[12:16])))
        out = z @ w[16:24].reshape(4, 2) + w[24:]
        margin = np.where(y > 0, 1, -1) * (0.5 * np.cos(x @ kernel.w + kernel.b) @ u + 0.1)
        return np.logaddexp(out[:, 0], out[:, 1]).sum() - out[np.arange(50), y].sum(), np.maximum(1 - margin, 0).sum()

    for block in (1024, 7):
        monkeypatch.setattr(G, "BLOCK", block)
        a, b = G.perceptron(x, y, np.ones(50), w, 4, np.float64), G.hinge(kernel, x, y, u, 0.1)
        assert (a[0], b[0]) == pytest.approx(losses(w, u), rel=1e-5)
        for i, e in enumerate(1e-6 * np.eye(len(w))):
            assert a[1 + i] == pytest.approx((losses(w + e, u)[0] - losses(w - e, u)[0]) / 2e-6, abs=1e-3)
        for i, e in enumerate(1e-6 * np.eye(8)):
            assert b[1 + i] == pytest.approx((losses(w, u + e)[1] - losses(w, u - e)[1]) / 2e-6, abs=1e-3)


@pytest.mark.parametrize("task_rows", [O.TASK_ROWS, 150])
def test_svm_is_that_of_spark(rows, kernel, task_rows, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", task_rows)
    wide = kernel.transform(rows).cache()
    mine = O.KernelSVC(kernel, maxIter=40, regParam=1.0 / ROWS).fit(wide)
    theirs = LinearSVC(featuresCol="kernel", maxIter=40, regParam=1.0 / ROWS).fit(wide)
    assert np.allclose(mine.coefficients.toArray(), theirs.coefficients.toArray(), rtol=0.02, atol=0.02)
    assert mine.intercept == pytest.approx(theirs.intercept, abs=0.02)
    right = mine.transform(wide).where("label = prediction").count()
    assert abs(right - theirs.transform(wide).where("label = prediction").count()) <= 5 and right > 0.8 * ROWS


@pytest.mark.parametrize("task_rows", [O.TASK_ROWS, 150])
def test_perceptron_is_that_of_spark(rows, task_rows, monkeypatch):
    monkeypatch.setattr(O, "TASK_ROWS", task_rows)
    params = dict(layers=[COLUMNS, 20, 2], maxIter=12, tol=1e-6, seed=7)
    mine, theirs = O.TaskPerceptron(**params).fit(rows), MultilayerPerceptronClassifier(**params).fit(rows)
    assert np.allclose(mine.weights.toArray(), theirs.weights.toArray(), atol=1e-6)
    got = [m.transform(rows).select("features", "prediction").collect() for m in (mine, theirs)]
    assert got[0] == got[1]


def test_partial_blocks_weigh_as_in_spark(rows):
    """The last 72 rows are a block like the 128 before."""
    params = dict(layers=[COLUMNS, 20, 2], maxIter=12, tol=1e-6, seed=7)
    some = rows.limit(200).coalesce(1).cache()
    mine, theirs = O.TaskPerceptron(**params).fit(some), MultilayerPerceptronClassifier(**params).fit(some)
    assert np.allclose(mine.weights.toArray(), theirs.weights.toArray(), atol=1e-6)


def test_a_fit_of_few_rows_is_few_jobs(spark, rows):
    """Spark's own fits are a job for every step."""
    columns = ["a", "b", "c"]
    sc = spark.sparkContext
    models = R.comparison_models(rows, columns)
    for name in ("SVM (RBF)", "MLP"):
        sc.setJobGroup(f"fit {name}", "")
        try:
            R.Pipeline(stages=models[name]).fit(rows)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        assert 0 < len(sc.statusTracker().getJobIdsForGroup(f"fit {name}")) < 12


def test_what_is_not_fitted_in_tasks_is_refused(rows, kernel):
    for layers in ([COLUMNS, 4, 4, 2], [COLUMNS, 4, 3], [COLUMNS + 1, 4, 2]):
        with pytest.raises(Exception):
            O.TaskPerceptron(layers=layers, maxIter=2).fit(rows)
    with pytest.raises(ValueError):
        O.KernelSVC(kernel, standardization=False).fit(rows)
