"""Building blocks that keep any single key, value or group from filling one task.

* ``hot_keys`` measures which keys are too large for one task.
* ``slices`` cuts an ordered column into bounded ranges and stores the cut, so every
  consumer of the column sees the same one.
* ``prefix_sums`` and ``exact_quantiles`` are running totals and order statistics
  over groups of any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.session import (
    HOT_ROWS_CONF, HOT_ROWS_DEFAULT, SLICE_ROWS_CONF, SLICE_ROWS_DEFAULT,
    int_conf, materialize,
)


def hot_keys(df: DataFrame, key: str) -> DataFrame | None:
    """Keys with more rows than one task should hold, or None when there are none.

    All such keys: the table stays on the executors and is joined like any other.
    """
    floor = int_conf(df.sparkSession, HOT_ROWS_CONF, HOT_ROWS_DEFAULT)
    found = materialize(
        df.where(F.col(key).isNotNull()).groupBy(key).count()
        .where(F.col("count") > floor).select(key))
    return None if found.isEmpty() else found


#: Stands for hot keys that are still to be found.
FIND = object()


def split_hot(df: DataFrame, hot: DataFrame | None | object, key: str):
    """(ordinary rows, hot rows or None); NULL keys count as ordinary. `hot` is a table of keys,
    None where there are none, or FIND to count the rows of every key first."""
    if hot is FIND:
        hot = hot_keys(df, key)
    if hot is None:
        return df, None
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def slices(df: DataFrame, order: str, out: str = "_slice") -> tuple[DataFrame, int]:
    """Add a slice number that grows with `order`; slices hold about equal row counts.

    `df` should hold distinct order values per group (copies pre-aggregated) and be
    materialized, as it is read for its count first. Equal values share a slice. The
    ranges are those of Spark's range partitioning; the cut is stored with the rows.
    """
    per_slice = int_conf(df.sparkSession, SLICE_ROWS_CONF, SLICE_ROWS_DEFAULT)
    n = math.ceil(df.count() / per_slice)
    if n <= 1:
        return df.withColumn(out, F.lit(0)), 1
    return materialize(df.repartitionByRange(n, order).withColumn(out, F.spark_partition_id())), n


def prefix_sums(df: DataFrame, groups: list[str], order: str, measures: list[str]) -> DataFrame:
    """Add `cum_<m>` (running total up to and including the row, by `order` within
    the group) and `total_<m>` (group total) for each measure.

    `df` must hold one row per (groups, order): pre-aggregate copies first. Rows are
    cut into bounded slices; only slice totals, one row for so many, meet in one window.
    """
    compact = materialize(df)
    sliced, n = slices(compact, order)
    keys = [F.col(g) for g in groups] or [F.lit(0)]
    if n == 1:
        running = Window.partitionBy(*keys).orderBy(order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        whole = Window.partitionBy(*keys)
        for m in measures:
            sliced = sliced.withColumn(f"cum_{m}", F.sum(m).over(running))
            sliced = sliced.withColumn(f"total_{m}", F.sum(m).over(whole))
        return sliced.drop("_slice")
    sums = sliced.groupBy(*groups, "_slice").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = sums.select(
        *groups, "_slice",
        *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_b_{m}") for m in measures],
        *[F.sum(f"_s_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    joined = _null_safe_join(sliced, offsets, [*groups, "_slice"])
    running = Window.partitionBy(*groups, "_slice").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    for m in measures:
        joined = joined.withColumn(f"cum_{m}", F.col(f"_b_{m}") + F.sum(m).over(running))
    return joined.drop("_slice", *[f"_b_{m}" for m in measures])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        eq = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = eq if cond is None else cond & eq
    return left.join(renamed, cond).drop(*[f"_r_{k}" for k in keys])


def exact_quantiles(
    df: DataFrame, groups: list[str], value: str, probs: dict[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per entry of `probs`.

    Copies of a value are counted before anything is ordered, and the ordering is
    sliced, so neither a hot value nor a hot group reaches a single task.
    """
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = (
        df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*groups, value).agg(n.alias("_n"))
    )
    ranked = prefix_sums(counts, groups, value, ["_n"])

    def at(position: Column) -> Column:
        return F.min(F.when(F.col("cum__n") > position, F.col(value).cast("double")))

    aggs = [F.first("total__n").alias("_total")]
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("total__n") - 1)
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}")]
    picked = ranked.groupBy(*groups).agg(*aggs)
    out = []
    for name, p in probs.items():
        place = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return picked.select(*groups, *out)
