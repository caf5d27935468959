import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from channel_signals.constants import ANOMALY_COLUMN, STATIC_FEATURES
from channel_signals.operators import prep as P
from channel_signals.operators.iforest import RANK_PRIME, IntervalForest, IntervalForestModel
from channel_signals.functions.trees import expected_path, fraction, tree_steps
from channel_signals.operators.kernel import RandomFourierFeatures
from channel_signals.operators.scaling import (
    MedianImputer, MedianImputerModel, PopulationScaler, PopulationScalerModel, fitted_rows,
)
from channel_signals.plans import train as R

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def intervals(spark):
    rows = [(f"c{i % 60}", i, float(RNG.normal(7, 1))) for i in range(900)]
    rows += [("odd", i, float(90 + 30 * i)) for i in range(5)]
    return spark.createDataFrame(rows, "channel_id string, seq long, days double").cache()


@pytest.fixture(scope="module")
def table(spark):
    """Two classes that differ in a few features, with sentinels and an empty column."""
    rows = []
    for i in range(160):
        y = i % 2
        x = RNG.normal(size=len(STATIC_FEATURES)) + 1.6 * y
        x[0] = -1.0 if i % 9 == 0 else abs(x[0])
        rows.append((f"c{i}", y, *map(float, x)))
    cols = ", ".join(f"{c} double" for c in STATIC_FEATURES)
    return spark.createDataFrame(rows, f"channel_id string, label int, {cols}").cache()


def brute_path(values, edges, deltas, x):
    return sum(d for e, d in zip(edges, deltas) if e <= x)


def test_tree_isolates_every_value():
    values = np.sort(RNG.normal(size=40))
    edges, deltas = tree_steps(values, lambda node: fraction(0, 0, node), 50)
    paths = [brute_path(values, edges, deltas, v) for v in values]
    assert len(edges) == 40 and min(paths) >= 1
    assert brute_path(values, edges, deltas, values[-1] + 100) == pytest.approx(paths[-1])


def test_tree_of_equal_values_is_one_leaf():
    edges, deltas = tree_steps(np.full(8, 3.0), lambda node: fraction(0, 0, node), 3)
    assert edges == [-np.inf] and deltas[0] == pytest.approx(expected_path(8))


def test_outliers_score_above_the_rest(intervals):
    model = IntervalForest().fit(intervals)
    scored = model.channel_scores(intervals)
    odd = scored.where("channel_id = 'odd'").first()[ANOMALY_COLUMN]
    rest = scored.where("channel_id <> 'odd'").selectExpr(f"percentile({ANOMALY_COLUMN}, 0.95)").first()[0]
    assert odd > rest
    flagged = model.transform(intervals).agg(F.avg((F.col(ANOMALY_COLUMN) > 0.5).cast("double"))).first()[0]
    assert flagged == pytest.approx(0.15, abs=0.02)


def test_forest_is_a_function_of_its_rows(intervals):
    """Neither partitions, nor order, nor the first guess of a tree's ranks change it."""
    a = IntervalForest(numTrees=20, sampleSize=64).fit(intervals)
    b = IntervalForest(numTrees=20, sampleSize=64).fit(intervals.orderBy(F.rand(3)).repartition(7))
    assert (a.splits, a.scores, a.offset) == (b.splits, b.scores, b.offset)
    other = IntervalForest(numTrees=20, sampleSize=64, seed=7).fit(intervals)
    assert other.splits != a.splits


def test_samples_are_the_lowest_ranks(intervals):
    forest = IntervalForest(numTrees=5, sampleSize=32, seed=3)
    values = forest._values(intervals)
    got = forest._sample(values, values.count())
    assert {r["n"] for r in got.groupBy("tree").agg(F.count("*").alias("n")).collect()} == {32}
    rows = [(r["value"], hashlib.md5(f"3:{r['row']}".encode()).hexdigest()) for r in values.collect()]
    for t in range(5):
        ranked = sorted(((int(h[:12], 16) + t * int(h[12:24], 16)) % RANK_PRIME, h, v) for v, h in rows)
        assert sorted(r["value"] for r in got.where(f"tree = {t}").collect()) == sorted(v for _, _, v in ranked[:32])


def test_array_and_long_forms_agree(spark, intervals):
    model = IntervalForest().fit(intervals)
    cells = intervals.groupBy("channel_id").agg(F.collect_list("days").alias("days")).union(
        spark.sql("SELECT 'none', CAST(array() AS array<double>)"))
    got = {r[0]: r[1] for r in model.transform(cells).select("channel_id", ANOMALY_COLUMN).collect()}
    want = {r[0]: r[1] for r in model.channel_scores(intervals).collect()}
    assert got.pop("none") == 0.5
    assert got == pytest.approx(want)


def test_forest_survives_saving(spark, intervals, tmp_path):
    model = IntervalForest(mode="raw", numTrees=10).fit(intervals)
    model.write().overwrite().save(str(tmp_path / "f"))
    again = IntervalForestModel.load(str(tmp_path / "f"))
    assert again.splits == model.splits and again.scores == model.scores
    assert sorted(map(tuple, again.channel_scores(intervals).collect())) == sorted(
        map(tuple, model.channel_scores(intervals).collect()))


def test_empty_and_tiny_inputs(spark, intervals):
    few = intervals.limit(5)
    channels = few.select("channel_id").distinct()
    raw = IntervalForest(mode="raw").fit(few).score_channels(channels, few)
    assert {r[ANOMALY_COLUMN] for r in raw.collect()} == {0.0}
    none = IntervalForest().fit(few.where("false")).score_channels(channels, few.where("false"))
    assert {r[ANOMALY_COLUMN] for r in none.collect()} == {0.5}


def test_split_and_folds(spark):
    df = spark.range(103).select(F.col("id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    split = P.stratified_split(df, "id").groupBy("label").agg(
        F.count_if("is_test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r["n"], r["t"]) for r in split} == {(26, 5), (77, 15)}
    folds = P.stratified_folds(df, "id")
    assert folds.select("id").distinct().count() == 103
    sizes = folds.groupBy("label", "fold").count().collect()
    for y in (0, 1):
        mine = [r["count"] for r in sizes if r["label"] == y]
        assert len(mine) == 5 and max(mine) - min(mine) <= 1


def test_sparse_column_is_dropped(spark):
    df = spark.sql("SELECT 0 AS label, CAST(NULL AS double) AS a, 1.0D AS b UNION ALL SELECT 1, 2.0D, NULL")
    assert P.drop_sparse(df, ["a", "b"], ["a", "b", "c"]) == ["b"]


def test_kernel_features_approximate_the_kernel(spark):
    from pyspark.ml.feature import VectorAssembler
    x = RNG.normal(size=(6, 3))
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"))
    z = np.array([r["kernel"].toArray() for r in RandomFourierFeatures(
        numFeatures=4000, gamma=0.3).transform(df).select("features", "kernel").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.1


def test_training_end_to_end(spark, table, intervals, tmp_path):
    columns = P.model_columns(table)
    result = R.train(table, columns, intervals, [R.random_forest(20, 5)], folds=3)
    row = result.metrics.first()
    assert row["cv_f1"] >= 0.85 and row["test_f1"] >= 0.8 and row["test_roc_auc"] >= 0.85
    assert result.cv.count() + result.test.count() == 160
    result.classifier.save(str(tmp_path / "m"))
    again = R.ChannelClassifier.load(str(tmp_path / "m"))
    assert again.columns == columns

    def scores(c):
        return sorted(map(tuple, c.predict(result.test.drop("p1", "prediction"), intervals).select("channel_id", "p1").collect()))
    assert scores(again) == scores(result.classifier)
    top = result.classifier.importances().collect()
    assert len(top) == len(columns) and top[0]["importance"] >= top[-1]["importance"]


def test_forest_sees_training_channels_only(spark, table, intervals):
    train = table.where("channel_id < 'c3'")
    names = P.model_columns(table)
    model = [R.random_forest(2, 2)]
    a = R.ChannelClassifier.fit(train, names, intervals, model)
    inside = F.col("channel_id") < "c3"
    changed = intervals.withColumn("days", F.when(inside, F.col("days")).otherwise(F.lit(999.0)))
    b = R.ChannelClassifier.fit(train, names, changed, model)
    assert (a.forest.splits, a.forest.scores, a.forest.offset) == (b.forest.splits, b.forest.scores, b.forest.offset)


def test_compare_models(spark, table):
    from pyspark.ml.classification import LogisticRegression
    models = {"a": [LogisticRegression(maxIter=20)],
              "b": R.comparison_models(table, STATIC_FEATURES)["SVM (RBF)"]}
    out = R.compare_models(table, STATIC_FEATURES, models=models, folds=2)
    got = out.collect()
    assert {r["Model"] for r in got} == {"a", "b"}
    assert all(r["F1"] > 0.8 and r["CV F1 Mean"] > 0.8 for r in got)
    assert R.best_model(out).first()["F1"] == max(r["F1"] for r in got)


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(i, None if i % 7 == 0 else float(x), float("nan") if i % 5 == 0 else float(x * x), 3.0, None)
            for i, x in enumerate(RNG.normal(size=101))]
    return spark.createDataFrame(rows, "id int, a double, b double, same double, none double")


def test_medians_and_population_deviation(gappy, tmp_path):
    names = ["a", "b", "same", "none"]
    got = {r["feature"]: r for r in fitted_rows(gappy, names).collect()}
    assert set(got) == {"a", "b", "same"}  # a column without a value has no median
    rows = gappy.toPandas()
    for c in got:
        median = np.nanmedian(rows[c].to_numpy(float))
        filled = rows[c].fillna(median)
        assert got[c]["median"] == pytest.approx(median) and got[c]["mean"] == pytest.approx(filled.mean())
        assert got[c]["std"] == pytest.approx(filled.std(ddof=0), abs=1e-12)
    imputer = MedianImputer(inputCols=names).fit(gappy)
    scaler = PopulationScaler(inputCols=imputer.outputs()).fit(imputer.transform(gappy))
    for model in (imputer, scaler):
        model.write().overwrite().save(str(tmp_path / type(model).__name__))
    again = PopulationScalerModel.load(str(tmp_path / "PopulationScalerModel"))
    first = MedianImputerModel.load(str(tmp_path / "MedianImputerModel"))
    a = scaler.transform(imputer.transform(gappy)).orderBy("id").select("features").collect()
    assert a == again.transform(first.transform(gappy)).orderBy("id").select("features").collect()
    x = np.array([r["features"].toArray() for r in a])
    assert np.allclose(x.mean(axis=0), 0) and np.allclose(x[:, :2].std(axis=0), 1) and (x[:, 2] == 0).all()


def test_folds_share_one_table_of_intervals(spark, table, intervals, monkeypatch):
    """One write, and the same predictions from threads as one after another."""
    written = []
    tag = R.tagged_intervals
    monkeypatch.setattr(R, "tagged_intervals", lambda *a: written.append(1) or tag(*a))
    columns, stages = P.model_columns(table), [R.random_forest(5, 3)]

    def rows(threads):
        out = R.cross_validate(table, columns, intervals, stages, folds=3, threads=threads)
        return sorted((r["channel_id"], r["fold"], r["p1"]) for r in out.collect())

    assert rows(3) == rows(1)
    assert len(written) == 2
    R.train(table, columns, intervals, stages, folds=3)
    assert len(written) == 3


def test_training_leaves_out_sparse_columns(spark, table):
    gone = table.withColumn("dash_density", F.when(F.col("label") == 1, F.col("dash_density")))
    columns = STATIC_FEATURES
    kept = R.train(gone, columns, None, [R.random_forest(3, 2)], folds=2, sparse=["dash_density", "title_length_std"])
    assert kept.classifier.columns == [c for c in columns if c != "dash_density"]
    whole = R.train(gone, columns, None, [R.random_forest(3, 2)], folds=2)
    assert whole.classifier.columns == columns


def test_leaderboard_comes_from_the_predictions(spark, table):
    pred = R.model_predictions(table, STATIC_FEATURES, folds=2, models={"a": [R.random_forest(3, 2)], "b": [R.random_forest(9, 4)]})
    rows = pred.collect()
    assert len(rows) == 2 * 160 and {r["fold"] for r in rows} == {None, 0, 1}
    for r in R.comparison(pred).collect():
        mine = [x for x in rows if x["Model"] == r["Model"] and x["fold"] is None]
        assert r["Accuracy"] == pytest.approx(np.mean([x["label"] == x["prediction"] for x in mine]), abs=1e-4)
