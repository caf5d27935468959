"""Appending only what is new, by key."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.sources.tables import write_table


def known_ids(existing: DataFrame, key: str = "channel_id") -> DataFrame:
    """Non-NULL keys as strings."""
    return existing.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key))


def first_rows(df: DataFrame, key: str = "channel_id", order: list[str] | None = None) -> DataFrame:
    """One row per non-NULL key: the first by `order`, then by the other columns.

    Without an order the smallest row counts as the first, so every run keeps the same one.
    """
    order = list(order or [])
    rest = [c for c in df.columns if c != key and c not in order]
    lead = F.struct(*order, *rest) if order or rest else F.struct(key)
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(lead).alias("_r"))
    return kept.select(*[F.col(key) if c == key else F.col(f"_r.{c}") for c in df.columns])


def new_rows(existing: DataFrame, new: DataFrame, key: str = "channel_id",
             order: list[str] | None = None) -> DataFrame:
    """Rows of `new`, one per key (`first_rows`), whose key is not in `existing`. Rows
    without a key go."""
    fresh = first_rows(new, key, order)
    ids = known_ids(existing, key).withColumnRenamed(key, "_known")
    return fresh.join(ids, fresh[key].cast("string") == F.col("_known"), "left_anti")


def append_new(existing: DataFrame, new: DataFrame, key: str = "channel_id") -> DataFrame:
    """`existing` followed by the rows of `new` under keys it does not hold yet."""
    return existing.unionByName(new_rows(existing, new, key).select(*existing.columns))


def to_ingest(labels: DataFrame, existing: DataFrame, key: str = "channel_id") -> DataFrame:
    """Keys still to be ingested, in ascending order."""
    return new_rows(existing, labels, key).orderBy(key)


def incremental_ingest(new: DataFrame, path: str, key: str = "channel_id") -> None:
    """Append the unseen keys of `new` to the Parquet table at `path`.

    A rerun after an interruption adds only what is missing, as committed files count
    as known.
    """
    spark = new.sparkSession
    try:
        existing = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        existing = None
    fresh = (
        first_rows(new, key) if existing is None
        else new_rows(existing, new, key)
    )
    write_table(fresh, path, mode="append")
