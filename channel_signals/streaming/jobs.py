"""Continuous forms of ingest and scoring over landed files."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from channel_signals.plans.build import scoring_features
from channel_signals.plans.curate import classify, with_exclusion
from channel_signals.session import materialize
from channel_signals.sources.id_index import KeyedTable
from channel_signals.sources.ingest import first_rows, incremental_ingest
from channel_signals.sources.tables import write_table


def read_landed(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest_stream(stream: DataFrame, table: str | KeyedTable, checkpoint: str, key: str = "channel_id"):
    """Append channels not stored yet to the table at `table`. A replayed batch adds
    nothing, as its rows are known by then. A KeyedTable reads only the buckets of a batch's
    keys; a plain table has all its keys read for every batch."""
    def add(batch: DataFrame, _: int) -> None:
        if isinstance(table, KeyedTable):
            table.append(batch)
        else:
            incremental_ingest(batch, table, key)

    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(add).trigger(availableNow=True).start()
    )


class _FirstRow(StatefulProcessor):
    """Lets the first row of a key pass, and keeps it as the key's state."""

    def __init__(self, schema: StructType, key: str, order: list[str]):
        self.schema, self.key, self.order = schema, key, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        rest = StructType([f for f in self.schema if f.name != self.key])
        self.first = handle.getValueState("first", rest)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.first.exists():
            return
        names = [*self.order, *[c for c in self.schema.names if c != self.key and c not in self.order]]
        best = min(rows, key=lambda r: [(r[c] is not None, r[c]) if r[c] is not None else (False, 0) for c in names])
        self.first.update(tuple(best[c] for c in self.schema.names if c != self.key))
        yield best

    def close(self) -> None:
        pass


def first_seen_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "channel_id",
                      order: list[str] = ()):
    """The first row of every key, written once to the Parquet table at `out`.

    The first batch that brings a key decides; within it the first row by `order`, then by the
    other columns (null first). What was seen is keyed state in the checkpoint, so a restart
    goes on where the last commit ended, without a look at the table. Rows without a key go.
    The state store must be RocksDB (`keyed_state`).
    """
    schema = stream.schema
    named = stream.where(F.col(key).isNotNull())
    first = named.groupBy(key).transformWithState(
        statefulProcessor=_FirstRow(schema, key, list(order)), outputStructType=schema,
        outputMode="append", timeMode="none")
    return (
        first.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB: on disk, saved by changes."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield spark
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def score_stream(channels: DataFrame, uploads: DataFrame, titles: DataFrame,
                 intervals: DataFrame, classifier, as_of, out: str, checkpoint: str):
    """Score arriving channels with a fitted classifier: (channel_id, p1, decision).

    `uploads`, `titles` and `intervals` are landed tables, pruned to the channels of a
    batch before anything is computed. Each batch writes its own folder, so a replay
    replaces it.
    """
    def score(batch: DataFrame, batch_id: int) -> None:
        batch = first_rows(batch)
        ids = batch.select("channel_id")

        def theirs(table: DataFrame) -> DataFrame:
            return table.join(ids, "channel_id", "left_semi")

        features = scoring_features(batch, theirs(uploads), theirs(titles), as_of)
        scored = classifier.predict(features, theirs(intervals))
        decided = with_exclusion(scored, theirs(titles)).select(
            "channel_id", "p1", classify(F.col("p1"), F.col("excluded")).alias("decision"))
        write_table(decided, f"{out}/batch={batch_id}")

    return (
        channels.writeStream.option("checkpointLocation", checkpoint).foreachBatch(score)
        .trigger(availableNow=True).start()
    )


def daily_uploads_stream(uploads: DataFrame, out: str, checkpoint: str, late: str = "1 day"):
    """An extension of the cadence features: uploads per channel and day, with the first and
    last time.

    The watermark of a batch is the newest time of all batches before it, less `late`. Every
    batch writes its counts per channel and day, those of days that end before the watermark
    to a side table: these days were final. Nothing is dropped; `daily_uploads` reads days
    with what came late, and `merge_late` settles final days. A replayed batch rewrites its
    own folders.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _watermark(spark, out, batch_id, late)
        start = F.date_trunc("day", "published_at")
        days = materialize(
            batch.where(F.col("published_at").isNotNull()).groupBy("channel_id", start.alias("day")).agg(
                F.count(F.lit(1)).alias("n_uploads"), F.min("published_at").alias("first_at"),
                F.max("published_at").alias("last_at")))
        final = F.lit(False) if before is None else F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(before)
        write_table(days.where(~final), f"{out}/days/batch={batch_id}")
        write_table(days.where(final), f"{out}/late/batch={batch_id}")
        # the clock goes last: a batch counts for the next one's watermark once it is written
        write_table(days.agg(F.max("last_at").alias("newest")), f"{out}/clock/batch={batch_id}")

    return (
        uploads.select("channel_id", "published_at").writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(add).trigger(availableNow=True).start()
    )


def _watermark(spark: SparkSession, out: str, batch_id: int | None, late: str):
    """The time before which days are final for a batch, or after all (None); one row a batch is read."""
    try:
        clock = spark.read.schema("newest timestamp, batch int").parquet(f"{out}/clock")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if batch_id is not None:
        clock = clock.where(F.col("batch") < batch_id)
    return clock.agg((F.max("newest") - F.expr(f"INTERVAL {late}")).alias("at")).first()["at"]


def _written(spark: SparkSession, out: str) -> DataFrame:
    """Counts of all batches; `late` tells those of the side table."""
    def part(name: str, is_late: bool) -> DataFrame:
        return spark.read.parquet(f"{out}/{name}").drop("batch").withColumn("late", F.lit(is_late))

    return part("days", False).unionByName(part("late", True))


def daily_uploads(spark: SparkSession, out: str, late: str = "1 day") -> DataFrame:
    """(channel_id, day, n_uploads, first_at, last_at, n_late, final) over all batches so far."""
    now = _watermark(spark, out, None, late)
    return _written(spark, out).groupBy("channel_id", "day").agg(
        F.sum("n_uploads").alias("n_uploads"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"),
        F.sum(F.when(F.col("late"), F.col("n_uploads")).otherwise(0)).alias("n_late"),
    ).withColumn("final", F.col("day") + F.expr("INTERVAL 1 DAY") <= F.lit(now))


def merge_late(spark: SparkSession, out: str, target: str, late: str = "1 day") -> None:
    """Final days, side table included, as one table partitioned by day at `target`; days
    that are already there are replaced, the others stay."""
    days = daily_uploads(spark, out, late).where("final").drop("final").withColumn(
        "on_day", F.date_format("day", "yyyy-MM-dd"))
    days.repartition("on_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "on_day").parquet(target)
