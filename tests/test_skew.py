import numpy as np
import pytest
from pyspark.sql import functions as F

from channel_signals.operators import metrics as M
from channel_signals.operators import profile as D
from channel_signals.operators.skew import exact_quantiles, hot_keys, prefix_sums

RNG = np.random.default_rng(5)


def test_hot_keys(tiny_tasks):
    df = tiny_tasks.createDataFrame([("a",)] * 5 + [("b",)] * 2 + [("c",)] * 3, "k string")
    assert sorted(r[0] for r in hot_keys(df, "k").collect()) == ["a", "c"]


def test_no_hot_keys(spark):
    assert hot_keys(spark.createDataFrame([("a",)], "k string"), "k") is None


def test_sliced_prefix_sums_and_null_groups(tiny_tasks):
    rows = [(g, float(v), int(w)) for g in ("x", None) for v, w in
            zip(RNG.permutation(40), RNG.integers(1, 9, 40))]
    df = tiny_tasks.createDataFrame(rows, "g string, v double, w long")
    out = prefix_sums(df, ["g"], "v", ["w"]).collect()
    assert len(out) == 80
    for g in ("x", None):
        mine = sorted((r["v"], r["w"], r["cum_w"], r["total_w"]) for r in out if r["g"] == g)
        assert [r[2] for r in mine] == list(np.cumsum([r[1] for r in mine]))
        assert {r[3] for r in mine} == {sum(r[1] for r in mine)}


@pytest.mark.parametrize("name", ["spark", "tiny_tasks"])
def test_quantiles_equal_numpy(request, name):
    session = request.getfixturevalue(name)
    data = {"a": RNG.normal(size=51), "b": np.repeat([1.0, 2.0], 20), "c": np.array([7.0])}
    df = session.createDataFrame(
        [(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")
    out = exact_quantiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}).collect()
    for r in out:
        assert r["q"] == pytest.approx(np.quantile(data[r["g"]], 0.25))
        assert r["m"] == pytest.approx(np.median(data[r["g"]]))


@pytest.mark.parametrize("name", ["spark", "tiny_tasks"])
def test_curves(request, name):
    session = request.getfixturevalue(name)
    y, p = RNG.integers(0, 2, 60), RNG.integers(0, 12, 60) / 12
    df = session.createDataFrame(
        [(int(a), float(b), int(b >= 0.5)) for a, b in zip(y, p)], "label int, p1 double, prediction int")
    pos, neg = p[y == 1], p[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert M.roc_auc(df).first()[0] == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        tp, n = np.sum(pos >= t), np.sum(p >= t)
        ap += (tp / len(pos) - last) * tp / n
        last = tp / len(pos)
    assert M.average_precision(df).first()[0] == pytest.approx(ap)
    curve = M.roc_curve(df).orderBy(F.desc("threshold")).collect()
    assert len(curve) == len(set(p)) + 1
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0.0, 0.0)
    assert (curve[-1]["fpr"], curve[-1]["tpr"]) == (1.0, 1.0)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.4, 0)], "label int, p1 double, prediction int")
    assert M.roc_auc(df).first()[0] is None
    assert M.binary_metrics(df).first()["f1"] == 0.0


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 2.0)], "label int, a double, b double")
    got = {(r[0], r[1]): r[2] for r in D.correlation_matrix(df, ["a", "b"]).collect()}
    assert got[("a", "b")] is None and got[("b", "b")] is None and got[("a", "a")] == 1.0


def test_constant_feature_has_one_bin(spark):
    df = spark.createDataFrame([(0, 3.0), (1, 3.0), (1, None)], "label int, a double")
    got = D.histogram(df, ["a"], 30).collect()
    assert sorted((r["label"], r["bin"], r["n"]) for r in got) == [(0, 0, 1), (1, 0, 1)]
