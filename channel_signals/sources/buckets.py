"""Inputs stored in buckets of their channel, so that what is joined and grouped by channel
later needs no shuffle.

Buckets hold their rows sorted by channel and, for uploads and titles, by time or position.
Channels that are too large for one task are found once, while writing, and kept beside the
table; readers need not look for them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from channel_signals.operators.skew import hot_keys
from channel_signals.sources.tables import write_table

KEY = "channel_id"
ORDER = {"uploads": "published_at", "titles": "pos", "intervals": "seq"}


@dataclass(frozen=True)
class BucketedInputs:
    """Tables `<name>_channels`, `<name>_uploads`, `<name>_titles` and `<name>_intervals` under
    one folder, all in the same number of buckets; give it as many as tasks of a good size."""

    name: str
    path: str
    buckets: int = 200

    def write(self, **tables: DataFrame) -> None:
        """Write or replace the tables that are given by their kind, as in `uploads=...`."""
        for kind, df in tables.items():
            order = [KEY, *[c for c in (ORDER.get(kind),) if c in df.columns]]
            (df.repartition(self.buckets, KEY).write.mode("overwrite").format("parquet")
             .bucketBy(self.buckets, KEY).sortBy(*order).option("path", f"{self.path}/{kind}")
             .saveAsTable(f"{self.name}_{kind}"))
            if kind == "uploads":
                hot = hot_keys(self.read(df.sparkSession, kind), KEY)
                none = df.select(KEY).limit(0)
                write_table(none if hot is None else hot, f"{self.path}/hot_channels")

    def read(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.table(f"{self.name}_{kind}")

    def hot_channels(self, spark: SparkSession) -> DataFrame | None:
        """Channels whose uploads exceed one task, or None; read from what writing has found."""
        hot = spark.read.parquet(f"{self.path}/hot_channels")
        return None if hot.isEmpty() else hot
