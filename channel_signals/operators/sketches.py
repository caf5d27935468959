"""Quantiles that grow with their table: KLL sketches (Karnin, Lang & Liberty, 2016).

A sketch of a group is a few kilobytes whatever the group's size. Sketches of new rows are
merged into stored ones, so quantiles of a growing table never read its old rows again.
They stand beside the exact quantiles of `skew`, which read everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400


def rank_error(k: int = SKETCH_K) -> float:
    """Share of the rows by which the rank of a quantile is off at most, with 99 % confidence:
    the published fit for sketches of parameter k."""
    return 2.296 / k ** 0.9723


def quantile_sketches(df: DataFrame, groups: list[str], columns: list[str], k: int = SKETCH_K) -> DataFrame:
    """(groups, feature, n, low, high, sketch) of the present values of each column; combined
    in the tasks, so a group of any size sends a sketch a task."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(*groups, F.explode(cells).alias("cell")).select(*groups, "cell.feature", "cell.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*groups, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def merged_sketches(stored: DataFrame, new: DataFrame, groups: list[str], k: int = SKETCH_K) -> DataFrame:
    """Sketches of the rows of both; groups that one side lacks are kept."""
    return stored.unionByName(new.select(*stored.columns)).groupBy(*groups, "feature").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def _quantile(p: float) -> Column:
    """The ends are known exactly."""
    if p <= 0:
        return F.col("low")
    return F.col("high") if p >= 1 else F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))


def sketch_quantiles(sketches: DataFrame, groups: list[str], probs: dict[str, float]) -> DataFrame:
    """(groups, feature, n, one column for each entry of `probs`): values of the table whose
    rank is near the asked one."""
    return sketches.select(*groups, "feature", "n", *[_quantile(p).alias(name) for name, p in probs.items()])


def sketch_box(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Five numbers for a box plot, from sketches alone."""
    return sketch_quantiles(sketches, groups, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0})


def sketch_ranks(sketches: DataFrame, groups: list[str], values: dict[str, float]) -> DataFrame:
    """(groups, feature, n, one column for each entry of `values`): about the share of rows up
    to the value."""
    return sketches.select(*groups, "feature", "n", *[
        F.kll_sketch_get_rank_double("sketch", F.lit(float(v))).alias(name) for name, v in values.items()])
