"""A table of unique keys that grows by batches, without reading what it already holds.

Rows lie in hash buckets of their key, a folder each. Beside them lies, for every bucket, a
Bloom filter of its keys as sparse words of bits. A batch reads the filters of its buckets;
only keys that may be stored meet the stored keys, and only in their buckets. Filters are
written before rows, so they never miss a stored key: whatever is interrupted, a rerun adds
just what is missing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals.session import materialize
from channel_signals.sources.ingest import first_rows

BUCKETS = 64
#: Bits of a bucket's filter; eight for every key that the bucket is expected to hold.
FILTER_BITS = 1 << 23
ROWS_PER_FILE = 5_000_000
#: Bits that a key sets, all in one word.
BITS_PER_KEY = 4


@dataclass(frozen=True)
class KeyedTable:
    """`buckets` and `filter_bits` belong to the stored table: open it with the same ones."""

    path: str
    key: str = "channel_id"
    buckets: int = BUCKETS
    filter_bits: int = FILTER_BITS

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    @property
    def filters_path(self) -> str:
        return f"{self.path}/filters"

    def _hash(self, seed: int) -> Column:
        return F.xxhash64(F.lit(seed), F.col(self.key).cast("string"))

    def placed(self, df: DataFrame) -> DataFrame:
        """`df` with the bucket, the filter word and the bits of each key."""
        h = self._hash(2)
        bits = F.lit(0).cast("long")
        for i in range(BITS_PER_KEY):
            at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
            bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
        return df.select(
            "*", F.pmod(self._hash(0), F.lit(self.buckets)).cast("int").alias("bucket"),
            F.pmod(self._hash(1), F.lit(self.filter_bits // 64)).cast("int").alias("_word"), bits.alias("_bits"))

    def stored(self, spark: SparkSession) -> DataFrame | None:
        """All stored rows, with their bucket; None before the first batch."""
        return _read(spark, self.rows_path)

    def filters(self, spark: SparkSession, buckets: list[int]) -> DataFrame | None:
        """(bucket, _word, _set) of the given buckets, over all batches."""
        kept = _read(spark, self.filters_path)
        return None if kept is None else kept.where(F.col("bucket").isin(buckets)).groupBy("bucket", "_word").agg(
            F.bit_or("_bits").alias("_set"))

    def possible(self, placed: DataFrame) -> DataFrame:
        """`placed` with `_possible`: whether the key may be stored. Keys that are always are."""
        spark = placed.sparkSession
        touched = _buckets_of(placed)
        kept = self.filters(spark, touched)
        if kept is None:
            return placed.withColumn("_possible", F.lit(False))
        met = placed.join(kept, ["bucket", "_word"], "left")
        hit = F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits")
        return met.withColumn("_possible", F.coalesce(hit, F.lit(False))).drop("_set")

    def stored_keys(self, spark: SparkSession, buckets: list[int]) -> DataFrame | None:
        """Keys of the given buckets: no other folder and no other column is read."""
        rows = self.stored(spark)
        return None if rows is None else rows.where(F.col("bucket").isin(buckets)).select(
            "bucket", F.col(self.key).cast("string").alias("_known"))

    def new_rows(self, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
        """The first row of each key of `batch` (`first_rows`) that is not stored yet, placed."""
        spark = batch.sparkSession
        if taken := {"bucket", "_word", "_bits"} & {c.lower() for c in batch.columns}:
            raise ValueError(f"columns that the stored table needs itself: {sorted(taken)}")
        placed = materialize(self.possible(self.placed(first_rows(batch, self.key, order))))
        unsure = placed.where("_possible")
        hit = _buckets_of(unsure)
        kept = self.stored_keys(spark, hit) if hit else None
        if kept is None:
            return placed.drop("_possible")
        same = (unsure["bucket"] == kept["bucket"]) & (F.col(self.key).cast("string") == F.col("_known"))
        return placed.where("not _possible").unionByName(unsure.join(kept, same, "left_anti")).drop("_possible")

    def append(self, batch: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Store the keys of `batch` that are new; returns the rows that were added."""
        fresh = materialize(self.new_rows(batch, order))
        n = fresh.count()
        if not n:
            return fresh.drop("bucket", "_word", "_bits")
        words = fresh.groupBy("bucket", "_word").agg(F.bit_or("_bits").alias("_bits"))
        _append(words.repartition(self.buckets, "bucket"), self.filters_path)
        rows = fresh.drop("_word", "_bits")
        _append(self._filed(rows, n), self.rows_path)
        return rows.drop("bucket")

    def _filed(self, rows: DataFrame, n: int) -> DataFrame:
        """`rows` dealt out for writing: a file a bucket, however many tasks made the rows, and
        more of them where a bucket gets more than ROWS_PER_FILE."""
        files = 1 + n // (self.buckets * ROWS_PER_FILE)
        return rows.repartition(self.buckets * files, "bucket", F.pmod(self._hash(3), F.lit(files)))

    def compact(self, spark: SparkSession, target: str) -> "KeyedTable":
        """The table anew at `target`, a file a bucket, with filters of the stored keys alone."""
        out = KeyedTable(target, self.key, self.buckets, self.filter_bits)
        rows = self.stored(spark)
        words = self.placed(rows.select(self.key)).groupBy("bucket", "_word").agg(F.bit_or("_bits").alias("_bits"))
        _append(words.repartition(self.buckets, "bucket"), out.filters_path)
        _append(self._filed(rows, rows.count()), out.rows_path)
        return out


def _buckets_of(df: DataFrame) -> list[int]:
    """The distinct buckets; there are no more than the table has."""
    return sorted(r["bucket"] for r in df.select("bucket").distinct().collect())


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _append(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("bucket").parquet(path)
