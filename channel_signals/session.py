"""Session set-up and the few settings the library reads from it."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

#: Rows of one key a single task may take before the key counts as hot.
HOT_ROWS_CONF = "spark.channelSignals.hotKeyRows"
HOT_ROWS_DEFAULT = 1_000_000
#: Rows of one ordered slice that a single task sorts in a distributed prefix sum.
SLICE_ROWS_CONF = "spark.channelSignals.sliceRows"
SLICE_ROWS_DEFAULT = 1_000_000


def get_spark(app: str = "channel_signals", cores: str | None = None, **conf) -> SparkSession:
    """A session in UTC. Master, memory and partitions stay as they are submitted; `cores`
    asks for a local session of so many, with settings that fit one."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.scheduler.mode", "FAIR")
    )
    if cores:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def int_conf(spark: SparkSession, key: str, default: int) -> int:
    return int(spark.conf.get(key, str(default)))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A folder of our own is made only for local sessions that name none.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="channel_signals_")
    spark.sparkContext.setCheckpointDir(made)
    return made


def materialize(df: DataFrame) -> DataFrame:
    """Evaluate once into the shared checkpoint folder and cut the lineage there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)



def in_parallel(spark: SparkSession, jobs: Iterable[Callable[[], object]], threads: int = 8) -> list:
    """What the jobs return, in order. They run at once from as many threads, each in a pool
    of its own, so that a FAIR scheduler lets small jobs fill what large ones leave free."""
    jobs = list(jobs)
    sc = spark.sparkContext

    def run(i: int):
        sc.setLocalProperty("spark.scheduler.pool", f"parallel-{i % threads}")
        try:
            return jobs[i]()
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), range(len(jobs)), chunksize=1)
