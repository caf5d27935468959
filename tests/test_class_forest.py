import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from channel_signals.functions import class_trees as T
from channel_signals.operators.class_forest import DeepForest, DeepForestModel
from channel_signals.plans import train as R

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def rows(spark):
    x = RNG.normal(size=(600, 6))
    y = ((x[:, 0] > 0) ^ (RNG.random(600) < 0.05)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), 1.0 + float(y[i]), *map(float, x[i])) for i in range(600)],
                               "id int, label int, weight double, " + ", ".join(f"f{j} double" for j in range(6)))
    return VectorAssembler(inputCols=[f"f{j}" for j in range(6)], outputCol="features").transform(df).cache()


def scores(model, df):
    return {r["id"]: (r["probability"].toArray().tolist(), r["prediction"]) for r in model.transform(df).collect()}


def test_a_tree_tells_apart_what_its_columns_tell():
    bins = RNG.integers(0, 16, size=(400, 4)).astype(np.uint8)
    _, same = np.unique(bins, axis=0, return_inverse=True)
    label = RNG.integers(0, 2, same.max() + 1)[same.ravel()]
    shape = T.Shape(2, 4, 16, 40)
    nodes, gains = T.grow(bins, label, np.ones(400), T.root_key(1, 0), 0, shape)
    at = T.walk(nodes.feature, nodes.cut, nodes.left, bins)
    assert (nodes.weights[at].argmax(axis=1) == label).all()
    p = label.mean()
    assert gains.sum() == pytest.approx(400 * 2 * p * (1 - p))  # nothing is left impure
    stump, _ = T.grow(bins, label, np.ones(400), T.root_key(1, 0), 0, shape._replace(depth=1))
    assert len(stump.feature) <= 3


def test_best_cut_is_that_of_brute_force():
    bins = RNG.integers(0, 9, size=(80, 3)).astype(np.uint8)
    label, weight = RNG.integers(0, 3, 80), RNG.random(80)

    def impure(mask):
        w = np.bincount(label[mask], weight[mask], 3)
        return w.sum() - (w * w).sum() / w.sum() if w.sum() else 0.0

    whole = np.ones(80, bool)
    want = max((impure(whole) - impure(bins[:, j] <= c) - impure(bins[:, j] > c)) / weight.sum()
               for j in range(3) for c in range(8))
    hist = T.histograms(bins, np.zeros(80, int), np.tile(np.arange(3), (80, 1)), label, weight, 1, T.Shape(3, 3, 9, 5))
    gain, which, cut = (x[0] for x in T.best_cuts(hist))
    assert gain == pytest.approx(want)
    assert (impure(whole) - impure(bins[:, which] <= cut) - impure(bins[:, which] > cut)) / weight.sum() == pytest.approx(want)


def test_rows_are_drawn_once_in_the_mean():
    n = T.copies(np.arange(200_000), T.root_key(3, 1))
    assert n.mean() == pytest.approx(1.0, abs=0.01) and (n == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_first_cuts_from_added_histograms_change_nothing(rows):
    """Nodes cut from histograms of all tasks are those that one task grows; neither do partitions count."""
    args = dict(numTrees=4, maxDepth=12, weightCol="weight")
    whole = DeepForest(**args).fit(rows)
    cut = DeepForest(**args, taskRows=60).fit(rows.repartition(5))
    assert {len(t.feature) for t in whole.tops} == {1} and min(len(t.feature) for t in cut.tops) > 4
    assert scores(whole, rows) == scores(cut, rows)
    assert cut.trees.where("node >= 0").count() > 16
    assert whole.featureImportances.toArray() == pytest.approx(cut.featureImportances.toArray())


def test_it_learns_as_spark_does(rows, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    ours = DeepForest(numTrees=40).fit(train)
    theirs = RandomForestClassifier(numTrees=40, maxDepth=30, maxBins=128, seed=1).fit(train)
    hits = [m.transform(test).where("label = prediction").count() for m in (ours, theirs)]
    assert hits[0] >= 125 and abs(hits[0] - hits[1]) <= 8
    a, b = ours.featureImportances.toArray(), theirs.featureImportances.toArray()
    assert a.sum() == pytest.approx(1.0) and a.argmax() == b.argmax() == 0 and np.abs(a - b).max() < 0.08
    ours.write().overwrite().save(str(tmp_path / "forest"))
    again = DeepForestModel.load(str(tmp_path / "forest"))
    assert scores(again, test) == scores(ours, test)


def test_one_class_and_large_equal_rows(spark, rows):
    alone = DeepForest(numTrees=3).fit(rows.where("label = 1"))
    assert {tuple(p) for p, _ in scores(alone, rows).values()} == {(0.0, 1.0)} and not alone.featureImportances.toArray().any()
    same = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(300).selectExpr("id", "cast(id % 3 = 0 as int) as label", "cast(id >= 200 as double) as x"))
    model = DeepForest(numTrees=5, taskRows=20).fit(same)
    assert len(scores(model, same)) == 300


def test_compared_and_exploratory_forests_keep_trees_and_depth(spark, rows):
    forest = R.comparison_models(rows, ["a"] * 6)["Random Forest"][0]
    assert isinstance(forest, DeepForest) and (forest._get("numTrees"), forest._get("maxDepth"), forest._get("maxBins")) == (100, 30, 128)
    flat = rows.drop("features", "weight")
    fitted, test = R.notebook_forest(flat, "id")
    model = fitted.model.stages[-1]
    assert isinstance(model, DeepForestModel) and model.trees.where("node >= 0").select("tree").distinct().count() == 300
    assert test.count() == 120 and test.where("p1 between 0 and 1").count() == 120
