"""Descriptive tables of a labelled feature table.

Statistics that combine (means, deviations) are columns of one wide aggregate, unpivoted
afterwards from a single row, so a row is never multiplied by the number of features;
correlations are matrix products per task. Order statistics go through sliced prefix sums.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.operators.skew import exact_quantiles
from channel_signals.session import materialize


def number(c: str | Column) -> Column:
    """DOUBLE with NaN as NULL."""
    d = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(d), d)


def _rows(df: DataFrame, structs: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*structs)))


def long_form(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value) without missing values."""
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), number(f).alias("value")) for f in features])
    return df.select(*keep, F.inline(cells)).where(F.col("value").isNotNull())


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share): rows per label and their percentage."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select(label, "n", (F.col("n") / total * 100.0).alias("share"))


def feature_summary(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, slop_mean, genuine_mean, direction): means of the values >= 0."""
    aggs = []
    for f in features:
        v = number(f)
        for name, y in (("slop", 1), ("genuine", 0)):
            aggs.append(F.avg(F.when((F.col(label) == y) & (v >= 0), v)).alias(f"{name}_{f}"))
    higher = [
        F.coalesce(F.col(f"slop_{f}") > F.col(f"genuine_{f}"), F.lit(False)) for f in features]
    return _rows(df.agg(*aggs), [
        F.struct(F.lit(f).alias("feature"), F.col(f"slop_{f}").alias("slop_mean"),
                 F.col(f"genuine_{f}").alias("genuine_mean"),
                 F.when(up, F.lit("↑slop")).otherwise(F.lit("↓slop")).alias("direction"))
        for f, up in zip(features, higher)])


def sign_profile(df: DataFrame, feature: str, label: str = "label") -> DataFrame:
    """Counts of negative, zero, positive and missing values by label."""
    v = number(feature)
    return df.groupBy(label).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(v < 0).alias("n_neg"),
        F.count_if(v == 0).alias("n_zero"), F.count_if(v > 0).alias("n_pos"),
        F.count_if(v.isNull()).alias("n_missing"))


def missing_timestamps(df: DataFrame, column: str = "time_interval_std") -> DataFrame:
    """Rows whose timing is undefined."""
    return df.agg(F.count_if(number(column) < 0).alias("n_missing_timestamps"))


def class_stats(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(label, feature, mean, median, std): exact median, sample deviation."""
    aggs = []
    for f in features:
        v = number(f)
        aggs += [F.avg(v).alias(f"m_{f}"), F.stddev_samp(v).alias(f"s_{f}")]
    wide = df.groupBy(label).agg(*aggs)
    means = wide.select(label, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"),
                 F.col(f"s_{f}").alias("std")) for f in features])))
    medians = exact_quantiles(
        long_form(df, features, [label]), [label, "feature"], "value", {"median": 0.5})
    return means.join(medians, [label, "feature"], "left").select(
        label, "feature", "mean", "median", "std")


def class_difference(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, genuine_mean, slop_mean, diff, verdict)."""
    aggs = []
    for f in features:
        v = number(f)
        aggs += [F.avg(F.when(F.col(label) == 1, v)).alias(f"slop_{f}"),
                 F.avg(F.when(F.col(label) == 0, v)).alias(f"genuine_{f}")]

    def row(f: str) -> Column:
        diff = F.col(f"slop_{f}") - F.col(f"genuine_{f}")
        return F.struct(
            F.lit(f).alias("feature"), F.col(f"genuine_{f}").alias("genuine_mean"),
            F.col(f"slop_{f}").alias("slop_mean"), diff.alias("diff"),
            F.when(diff > 0, F.lit("higher")).when(diff < 0, F.lit("lower"))
            .otherwise(F.lit("equal")).alias("verdict"))

    return _rows(df.agg(*aggs), [row(f) for f in features])


#: A variance below this share of the sum of squares is rounding.
FLAT = 1e-12


def _pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(feature_1, feature_2, correlation) over the rows where both are present;
    NULL when one of them is constant there.

    Values are taken from their column's smallest, then each task adds up its batches as
    products of matrices, and gives one row of sums for each pair, whatever its rows are.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    least = df.agg(*[F.min(number(c)).alias(c) for c in columns]).first()
    base = np.array([least[c] if least[c] is not None else 0.0 for c in columns])
    at = {c: i for i, c in enumerate(columns)}
    left = np.array([at[a] for a, _ in pairs], dtype=int)
    right = np.array([at[b] for _, b in pairs], dtype=int)

    def sums(batches):
        total = np.zeros((6, len(left)))
        for batch in batches:
            x = batch.to_numpy(dtype=float) - base
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(float)
            one, two, cross, n = x.T @ m, (x * x).T @ m, x.T @ x, m.T @ m
            total += np.stack([n[left, right], one[left, right], one[right, left],
                               two[left, right], two[right, left], cross[left, right]])
        yield pd.DataFrame(total.T, columns=["n", "sx", "sy", "sxx", "syy", "sxy"]).assign(pair=range(len(left)))

    added = df.select(*[number(c).alias(c) for c in columns]).mapInPandas(
        sums, "n double, sx double, sy double, sxx double, syy double, sxy double, pair int"
    ).groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])

    def variance(s: str, ss: str) -> Column:
        v = F.col(ss) - F.try_divide(F.col(s) * F.col(s), F.col("n"))
        return F.when(v > FLAT * F.col(ss), v)

    together = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), F.col("n"))
    names = F.array(*[F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2")) for a, b in pairs])
    return added.select(
        F.element_at(names, F.col("pair") + 1).alias("p"),
        (together / F.sqrt(variance("sx", "sxx") * variance("sy", "syy"))).alias("correlation"),
    ).select("p.feature_1", "p.feature_2", "correlation")


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, each pair once."""
    return _pair_correlations(df, list(combinations(columns, 2)))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature_1, feature_2, correlation) for the whole square matrix."""
    upper = correlation_pairs(df, columns)
    one = F.struct(F.col("feature_1"), F.col("feature_2"), F.col("correlation"))
    other = F.struct(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"),
                     F.col("correlation"))
    spread = df.agg(*[F.stddev_pop(number(c)).alias(c) for c in columns])
    diagonal = _rows(spread, [
        F.struct(F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"),
                 F.when(F.col(c) > 0, F.lit(1.0)).alias("correlation")) for c in columns])
    return upper.select(F.inline(F.array(one, other))).unionByName(diagonal)


def label_correlation(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(feature, correlation) with the label, the strongest first."""
    pairs = _pair_correlations(df, [(f, label) for f in features])
    return pairs.select(F.col("feature_1").alias("feature"), "correlation").orderBy(
        F.desc_nulls_last(F.abs("correlation")), "feature")


def high_correlation_pairs(
    df: DataFrame, features: list[str], threshold: float = 0.8,
) -> DataFrame:
    """Pairs with an absolute correlation of at least the threshold, strongest first."""
    return correlation_pairs(df, features).where(F.abs("correlation") >= threshold).orderBy(
        F.desc(F.abs("correlation")), "feature_1", "feature_2")


def _ranges(values: DataFrame) -> DataFrame:
    """(feature, lo, hi): one row per feature, so it is as small as the schema."""
    return values.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def histogram(
    df: DataFrame, features: list[str], bins: int = 30, by: str = "label",
) -> DataFrame:
    """(feature, by, bin, lo, hi, n): equal-width bins shared by the classes. The last
    bin is closed; a constant feature has one bin."""
    values = long_form(df, features, [by])
    placed = values.join(F.broadcast(_ranges(values)), "feature")
    width = (F.col("hi") - F.col("lo")) / float(bins)
    place = F.floor(F.try_divide(F.col("value") - F.col("lo"), width))
    # least() skips NULL, so the constant feature is told apart first
    index = F.when(place.isNull(), F.lit(0)).otherwise(F.least(place, F.lit(bins - 1))).cast("int")
    return (
        placed.withColumn("bin", index).groupBy("feature", by, "bin", "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("feature", by, "bin", (F.col("lo") + F.col("bin") * width).alias("lo"),
                (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), "n")
    )


def boxplot_stats(df: DataFrame, features: list[str], by: str = "label") -> DataFrame:
    """(feature, by, q1, median, q3, whisker_lo, whisker_hi, n_outliers)."""
    values = materialize(
        long_form(df, features, [by]).groupBy("feature", by, "value").agg(F.count(F.lit(1)).alias("n")))
    # one row per (feature, class)
    q = exact_quantiles(values, ["feature", by], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="n")
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col("value") >= low) & (F.col("value") <= high)
    return (
        values.join(F.broadcast(q), ["feature", by])
        .groupBy("feature", by, "q1", "median", "q3").agg(
            F.min(F.when(inside, F.col("value"))).alias("whisker_lo"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_hi"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("long").alias("n_outliers"))
    )


def kde(df: DataFrame, feature: str, points: int = 200, by: str = "label") -> DataFrame:
    """(by, i, x, density): Gaussian kernel density per class with Scott's bandwidth, on
    a grid over the range of all values. Equal values are counted first; each task adds its
    kernels up on the grid and sends a row for each class and point."""
    values = df.select(F.col(by), number(feature).alias("value")).where(F.col("value").isNotNull())
    counts = values.groupBy(by, "value").agg(F.count(F.lit(1)).alias("w"))
    per_class = values.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    everything = Window.partitionBy(F.lit(0))
    classes = per_class.select(
        by, "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        F.min("_lo").over(everything).alias("lo"), F.max("_hi").over(everything).alias("hi"))
    placed = counts.join(F.broadcast(classes), by).where(F.col("h") > 0)
    grid = np.arange(points) / (points - 1)

    def sums(batches):
        """Kernels of a task's values added up on the grid: a row a class and point."""
        total: dict = {}
        for batch in batches:
            for (key, h, lo, hi), own in batch.groupby(["k", "h", "lo", "hi"], dropna=False):
                x = lo + (hi - lo) * grid
                value, w = own["value"].to_numpy(), own["w"].to_numpy(float)
                for at in range(0, len(value), 4096):
                    z = (x - value[at:at + 4096, None]) / h
                    total[key] = total.get(key, 0.0) + w[at:at + 4096] @ np.exp(-0.5 * z * z)
        for key, k in total.items():
            yield pd.DataFrame({"k": key, "i": np.arange(points, dtype=np.int32), "s": k})

    # NULL, which may be a class too, travels as an empty text
    name = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))
    found = placed.select(name.alias("k"), "h", "lo", "hi", "value", "w").mapInPandas(
        sums, "k string, i int, s double").groupBy("k", "i").agg(F.sum("s").alias("_k"))
    step = (F.col("hi") - F.col("lo")) / float(points - 1)
    return found.join(F.broadcast(classes.withColumn("_name", name)), F.col("k") == F.col("_name")).select(
        by, "i", (F.col("lo") + F.col("i") * step).alias("x"),
        (F.col("_k") / (F.col("n") * F.col("h") * F.sqrt(2.0 * F.pi()))).alias("density"))
