"""Classifier evaluation as tables. Positive class is 1.

Predictions are (label INT, prediction INT, p1 DOUBLE), with optional group columns
such as the fold. Curves are built from one row per distinct score, by prefix sums
that no single task has to hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.operators.skew import prefix_sums


def hard_decision(p1: Column) -> Column:
    return F.when(p1 >= 0.5, F.lit(1)).otherwise(F.lit(0))


def ratio(top: Column, bottom: Column) -> Column:
    """top/bottom, 0 when bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(pred: DataFrame, groups: list[str] = ()) -> DataFrame:
    y, p = F.col("label"), F.col("prediction")
    return pred.groupBy(*groups).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def binary_metrics(pred: DataFrame, groups: list[str] = ()) -> DataFrame:
    """tn, fp, fn, tp, accuracy, precision, recall, f1 per group."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(pred, groups).select(
        *groups, "tn", "fp", "fn", "tp",
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def classification_report(pred: DataFrame) -> DataFrame:
    """(row, precision, recall, f1, support): each class, accuracy, macro and weighted
    averages, in one pass over the predictions."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def line(name, hit, wrong, missed):
        return F.struct(
            F.lit(name).alias("row"), ratio(hit, hit + wrong).alias("precision"),
            ratio(hit, hit + missed).alias("recall"),
            ratio(2 * hit, 2 * hit + wrong + missed).alias("f1"),
            (hit + missed).alias("support"))

    per_class = confusion(pred).select(
        "*", line("0", tn, fn, fp).alias("c0"), line("1", tp, fp, fn).alias("c1"),
        (tn + fp + fn + tp).alias("n"))
    accuracy = ratio(tn + tp, F.col("n"))

    def mean(name, w0, w1):
        return F.struct(
            F.lit(name).alias("row"),
            *[(F.col(f"c0.{m}") * w0 + F.col(f"c1.{m}") * w1).alias(m)
              for m in ("precision", "recall", "f1")],
            F.col("n").alias("support"))

    half = F.lit(0.5)
    w0, w1 = (ratio(F.col(f"{c}.support"), F.col("n")) for c in ("c0", "c1"))
    rows = F.array(
        F.col("c0"), F.col("c1"),
        F.struct(F.lit("accuracy").alias("row"), accuracy.alias("precision"),
                 accuracy.alias("recall"), accuracy.alias("f1"), F.col("n").alias("support")),
        mean("macro avg", half, half), mean("weighted avg", w0, w1))
    return per_class.select(F.inline(rows))


def _by_score(pred: DataFrame, groups: list[str]) -> DataFrame:
    """Per distinct score, descending: positives and negatives at and above it."""
    counts = pred.where(F.col("p1").isNotNull()).groupBy(*groups, "p1").agg(
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    ).withColumn("_down", -F.col("p1"))
    return prefix_sums(counts, list(groups), "_down", ["pos", "neg"]).drop("_down")


def roc_curve(pred: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr): a point per distinct score, and (0, 0) at +infinity."""
    points = _by_score(pred, list(groups)).select(
        *groups, F.col("p1").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("total_pos")).alias("tpr"))
    origin = pred.groupBy(*groups).agg(F.lit(float("inf")).alias("threshold")).select(
        *groups, "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def roc_auc(pred: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs in order, ties one half; NULL for one class."""
    c = _by_score(pred, list(groups))
    won = F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") * 0.5)
    return c.groupBy(*groups).agg(
        F.sum(won).alias("_won"), F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n"),
    ).select(*groups, F.try_divide(
        F.col("_won"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"))


def precision_recall_curve(pred: DataFrame, groups: list[str] = ()) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    up = F.col("cum_pos")
    return _by_score(pred, list(groups)).select(
        *groups, F.col("p1").alias("threshold"),
        ratio(up, up + F.col("cum_neg")).alias("precision"),
        ratio(up, F.col("total_pos")).alias("recall"))


def average_precision(pred: DataFrame, groups: list[str] = ()) -> DataFrame:
    """Sum of precision times the step in recall, without interpolation."""
    up = F.col("cum_pos")
    step = ratio(F.col("pos"), F.col("total_pos")) * ratio(up, up + F.col("cum_neg"))
    return _by_score(pred, list(groups)).groupBy(*groups).agg(F.sum(step).alias("average_precision"))


def fold_metrics(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """Five metrics per fold."""
    return binary_metrics(pred, [fold]).join(roc_auc(pred, [fold]), fold).select(
        fold, "accuracy", "precision", "recall", "f1", "roc_auc")


def cv_summary(pred: DataFrame, fold: str = "fold") -> DataFrame:
    """Means over folds, population deviations of F1 and AUC."""
    return fold_metrics(pred, fold).agg(
        *[F.avg(m).alias(f"cv_{m}") for m in ("accuracy", "precision", "recall", "f1", "roc_auc")],
        F.stddev_pop("f1").alias("cv_f1_std"), F.stddev_pop("roc_auc").alias("cv_auc_std"))


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row tables side by side, without a join: stacked, then
    the single value of each column."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def health_flags(metrics: DataFrame) -> DataFrame:
    """Warnings on a row that has test_f1, cv_f1 and cv_f1_std."""
    return metrics.withColumns({
        "suspiciously_good": F.col("test_f1") > 0.98,
        "unstable_folds": F.col("cv_f1_std") > 0.1,
        "cv_test_gap": F.abs(F.col("cv_f1") - F.col("test_f1")) > 0.1,
    })


def error_type(label: Column, prediction: Column) -> Column:
    return (
        F.when((label == 0) & (prediction == 1), F.lit("False Positive"))
        .when((label == 1) & (prediction == 0), F.lit("False Negative"))
        .otherwise(F.lit("Correct"))
    )


def wrong_rows(pred: DataFrame) -> DataFrame:
    return pred.where(F.col("label") != F.col("prediction"))


def error_crosstab(pred: DataFrame, names: dict[int, str]) -> DataFrame:
    """Wrong rows counted by true name (rows) and predicted name (columns)."""
    def name(c: Column) -> Column:
        out = None
        for value, text in names.items():
            out = F.when(c == value, F.lit(text)) if out is None else out.when(c == value, F.lit(text))
        return out

    return (
        wrong_rows(pred)
        .select(name(F.col("label")).alias("true_name"), name(F.col("prediction")).alias("pred_name"))
        .groupBy("true_name").pivot("pred_name", list(names.values())).count()
        .na.fill(0)
    )


def error_profile(pred: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and column means by error type."""
    return pred.groupBy(
        error_type(F.col("label"), F.col("prediction")).alias("error_type")
    ).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])


def error_samples(pred: DataFrame, kind: str, key: str, n: int = 5) -> DataFrame:
    """The first n rows of one error type by key, for a look."""
    typed = pred.withColumn("error_type", error_type(F.col("label"), F.col("prediction")))
    return typed.where(F.col("error_type") == kind).orderBy(key).limit(n)
