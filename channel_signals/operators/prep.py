"""Preparing a feature table for learning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from channel_signals.constants import (
    ANOMALY_COLUMN, FOLDS, LABEL_NAMES, SEED, SENTINEL_COLUMNS, STATIC_FEATURES, TEST_SHARE,
)

#: Rows of a label that share a hash prefix and are ranked in one task.
RANK_ROWS = 100_000


def sentinel_to_null(df: DataFrame, columns: list[str] = SENTINEL_COLUMNS) -> DataFrame:
    """-1 stands for missing in these columns."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(-1.0)) for c in present})


def numeric_columns(df: DataFrame, label: str = "label") -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name != label]


def encode_label(c: Column) -> Column:
    out = None
    for value, name in LABEL_NAMES.items():
        out = F.when(c == name, F.lit(value)) if out is None else out.when(c == name, F.lit(value))
    return out


def decode_label(c: Column) -> Column:
    out = None
    for value, name in LABEL_NAMES.items():
        out = F.when(c == value, F.lit(name)) if out is None else out.when(c == value, F.lit(name))
    return out


def encoded(df: DataFrame, label: str = "label") -> DataFrame:
    """The label as 0/1, whether it came as a name or as a number."""
    if dict(df.dtypes)[label] != "string":
        return df
    return df.withColumn(label, encode_label(F.col(label)))


def require_columns(df: DataFrame, columns: list[str] = STATIC_FEATURES) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")
    return df


def null_ratios(df: DataFrame, columns: list[str], label: str = "label", of: int = 0) -> DataFrame:
    """Share of missing values per column among one class, as one row."""
    def missing(c: str) -> Column:
        return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))

    return df.where(F.col(label) == of).agg(
        *[F.avg(missing(c).cast("double")).alias(c) for c in columns])


def drop_sparse(
    df: DataFrame, features: list[str], candidates: list[str], threshold: float = 0.9,
) -> list[str]:
    """`features` without the candidates that are mostly missing among genuine rows."""
    tested = [c for c in candidates if c in features and c in df.columns]
    if not tested:
        return list(features)
    row = null_ratios(df, tested).first()
    gone = {c for c in tested if row[c] is not None and row[c] > threshold}
    return [c for c in features if c not in gone]


def model_columns(df: DataFrame, drop_burst: bool = False) -> list[str]:
    """Model inputs in order: the static features, then the anomaly score. Any anomaly
    score already in the table is recomputed by the model."""
    require_columns(df)
    kept = [c for c in STATIC_FEATURES if not (drop_burst and c == "upload_burst_ratio")]
    return kept + [ANOMALY_COLUMN]


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    return counts.select(
        label, "n",
        (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add the balanced weight of each row's class; the weights are one row per class."""
    return df.join(F.broadcast(class_weights(df, label).drop("n")), label)


def stratified_rank(
    df: DataFrame, key: str, label: str = "label", seed: int = SEED,
) -> DataFrame:
    """Add `rank` (from 1, in a shuffled order that only the key and the seed decide) and
    `n_label`, both within the label. `key` must be unique.

    The hash prefix spreads each label over even groups of about RANK_ROWS rows: it has as
    many digits as the row count needs. Only the counts of the groups meet in one window.
    """
    digits = 1
    n = df.count()
    while n > RANK_ROWS * 16 ** digits:
        digits += 1
    hashed = df.withColumn(
        "_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ).withColumn("_p", F.substring("_h", 1, digits))
    along = Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = hashed.groupBy(label, "_p").agg(F.count(F.lit(1)).alias("_n")).select(
        label, "_p", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(label)).alias("n_label"))
    inside = Window.partitionBy(label, "_p").orderBy("_h", key)
    return (
        hashed.join(offsets, [label, "_p"])
        .withColumn("rank", F.col("_before") + F.row_number().over(inside))
        .drop("_h", "_p", "_before")
    )


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_share: float = TEST_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """Add `is_test`: the same share of every label, rounded per label."""
    ranked = stratified_rank(df, key, label, seed)
    cut = F.round(F.lit(test_share) * F.col("n_label"))
    return ranked.withColumn("is_test", F.col("rank") <= cut).drop("rank", "n_label")


def stratified_folds(
    df: DataFrame, key: str, label: str = "label", folds: int = FOLDS, seed: int = SEED,
) -> DataFrame:
    """Add `fold` in 0..folds-1, dealt evenly within each label."""
    ranked = stratified_rank(df, key, label, seed)
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")).drop(
        "rank", "n_label")
