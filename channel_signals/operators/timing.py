"""Upload cadence: gaps between uploads and the features built on them.

Input is the long table uploads(channel_id, published_at TIMESTAMP). Ordinary
channels take one shuffle on channel_id. A channel too large for one task is cut
along its time line, its segments are stitched by their end points, and copies of
an upload time are carried as a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.constants import BURST_SHARE, MAX_GAP_DAYS, MIN_TIMESTAMPS
from channel_signals.operators.skew import FIND, exact_quantiles, slices, split_hot
from channel_signals.session import materialize

MICROS_PER_DAY = 86_400_000_000
COPIES_PER_TASK = 100_000


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_DAY))


def _ordinary_gaps(uploads: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("channel_id").orderBy("published_at")
    whole = Window.partitionBy("channel_id")
    return uploads.select(
        "channel_id", "published_at",
        (F.row_number().over(by_time) - 1).cast("long").alias("seq"),
        days_between(F.col("published_at"), F.lag("published_at").over(by_time)).alias("days"),
        F.count(F.lit(1)).over(whole).alias("n_timestamps"),
    )


def _hot_runs(uploads: DataFrame) -> DataFrame:
    """One row per (channel, distinct time): copies, rank of the first copy, gap before it."""
    distinct = materialize(
        uploads.groupBy("channel_id", "published_at").agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_micros", F.unix_micros("published_at"))
    )
    cut, _ = slices(distinct, "_micros")
    along = Window.partitionBy("channel_id").orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        cut.groupBy("channel_id", "_slice")
        .agg(F.max("published_at").alias("_last"), F.sum("copies").alias("_n"))
        .select(
            F.col("channel_id").alias("_c"), F.col("_slice").alias("_s"),
            F.lag("_last").over(along).alias("_prev_last"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(Window.partitionBy("channel_id")).alias("n_timestamps"),
        )
    )
    inside = Window.partitionBy("channel_id", "_slice").orderBy("published_at")
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(
        segments, (F.col("channel_id") == F.col("_c")) & (F.col("_slice") == F.col("_s")))
    return joined.select(
        "channel_id", "published_at", "copies", "n_timestamps",
        (F.col("_offset") + F.coalesce(F.sum("copies").over(earlier), F.lit(0))).alias("seq"),
        days_between(
            F.col("published_at"),
            F.coalesce(F.lag("published_at").over(inside), F.col("_prev_last")),
        ).alias("days"),
    )


def _runs_to_gaps(runs: DataFrame) -> DataFrame:
    """One row per upload again; long runs of copies are dealt out over tasks first."""
    chunks = runs.withColumn(
        "_chunk",
        F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES_PER_TASK}"))),
    ).repartition("channel_id", "published_at", "_chunk")
    copy = F.explode(F.sequence(
        F.col("_chunk") * COPIES_PER_TASK,
        F.least(F.col("copies"), (F.col("_chunk") + 1) * COPIES_PER_TASK) - 1))
    return chunks.withColumn("_copy", copy).select(
        "channel_id", "published_at",
        (F.col("seq") + F.col("_copy")).alias("seq"),
        F.when(F.col("_copy") == 0, F.col("days")).otherwise(F.lit(0.0)).alias("days"),
        "n_timestamps",
    )


def gaps(uploads: DataFrame, hot=FIND) -> DataFrame:
    """(channel_id, published_at, seq, days, n_timestamps): every upload with the days
    since the one before it, NULL for the first. `hot` as in `split_hot`."""
    rows = uploads.select("channel_id", "published_at").where(F.col("published_at").isNotNull())
    ordinary, heavy = split_hot(rows, hot, "channel_id")
    out = _ordinary_gaps(ordinary)
    if heavy is not None:
        out = out.unionByName(_runs_to_gaps(_hot_runs(heavy)))
    return out


def intervals(uploads: DataFrame, min_timestamps: int = MIN_TIMESTAMPS, hot=FIND) -> DataFrame:
    """(channel_id, seq, days): gaps of at most a year, of channels with enough uploads."""
    return (
        gaps(uploads, hot)
        .where((F.col("n_timestamps") >= min_timestamps) & (F.col("days") <= MAX_GAP_DAYS))
        .select("channel_id", "seq", "days")
    )


def _finish(n: Column, kept: Column, std: Column, burst: Column) -> list[Column]:
    enough = n >= MIN_TIMESTAMPS
    return [
        F.when(enough & (kept >= 2), std).otherwise(F.lit(-1.0)).alias("time_interval_std"),
        F.when(enough & (kept >= 1), burst).otherwise(F.lit(0.0)).alias("upload_burst_ratio"),
    ]


def _ordinary_timing(uploads: DataFrame) -> DataFrame:
    by_time = Window.partitionBy("channel_id").orderBy("published_at")
    whole = Window.partitionBy("channel_id")
    gap = days_between(F.col("published_at"), F.lag("published_at").over(by_time))
    kept = uploads.select("channel_id", "published_at", gap.alias("_gap")).select(
        "channel_id", "published_at",
        F.when(F.col("_gap") <= MAX_GAP_DAYS, F.col("_gap")).alias("days"))
    centred = kept.withColumn("_median", F.median("days").over(whole))
    per_channel = centred.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("n_timestamps"),
        F.min("published_at").alias("first_at"),
        F.count("days").alias("n_intervals"),
        F.stddev_pop("days").alias("_std"),
        F.avg((F.col("days") < F.lit(BURST_SHARE) * F.col("_median")).cast("double")).alias("_burst"),
    )
    return per_channel.select(
        "channel_id", "n_timestamps", "first_at", "n_intervals",
        *_finish(F.col("n_timestamps"), F.col("n_intervals"), F.col("_std"), F.col("_burst")),
    )


def _hot_timing(uploads: DataFrame) -> DataFrame:
    runs = materialize(_hot_runs(uploads))
    heads = runs.groupBy("channel_id").agg(
        F.first("n_timestamps").alias("n_timestamps"), F.min("published_at").alias("first_at"))
    weighted = (
        runs.select("channel_id", F.explode(F.array(
            F.struct(F.col("days").alias("days"), F.lit(1).cast("long").alias("w")),
            F.struct(F.lit(0.0).alias("days"), (F.col("copies") - 1).alias("w")),
        )).alias("g"))
        .select("channel_id", "g.days", "g.w")
        .where((F.col("w") > 0) & (F.col("days") <= MAX_GAP_DAYS))
        .groupBy("channel_id", "days").agg(F.sum("w").alias("w"))
    )
    means = weighted.groupBy("channel_id").agg(
        (F.sum(F.col("days") * F.col("w")) / F.sum("w")).alias("_mean"))
    medians = exact_quantiles(weighted, ["channel_id"], "days", {"_median": 0.5}, weight="w")
    centre = means.join(medians, "channel_id")
    spread = (
        weighted.join(centre, "channel_id").groupBy("channel_id").agg(
            F.sum("w").alias("n_intervals"),
            F.sqrt(F.sum(F.col("w") * F.pow(F.col("days") - F.col("_mean"), 2)) / F.sum("w")).alias("_std"),
            (F.sum(F.when(F.col("days") < F.lit(BURST_SHARE) * F.col("_median"), F.col("w"))
                   .otherwise(F.lit(0))) / F.sum("w")).alias("_burst"))
    )
    return heads.join(spread, "channel_id", "left").select(
        "channel_id", "n_timestamps", "first_at",
        F.coalesce("n_intervals", F.lit(0).cast("long")).alias("n_intervals"),
        *_finish(F.col("n_timestamps"), F.coalesce("n_intervals", F.lit(0)),
                 F.col("_std"), F.col("_burst")),
    )


def timing_features(uploads: DataFrame, hot=FIND) -> DataFrame:
    """One row per channel that has uploads: n_timestamps, first_at, n_intervals,
    time_interval_std (-1 when undefined), upload_burst_ratio (0 when undefined). `hot` as in
    `split_hot`."""
    rows = uploads.select("channel_id", "published_at").where(F.col("published_at").isNotNull())
    ordinary, heavy = split_hot(rows, hot, "channel_id")
    out = _ordinary_timing(ordinary)
    if heavy is not None:
        out = out.unionByName(_hot_timing(heavy))
    return out


def channel_age_days(first_at: Column, as_of: Column) -> Column:
    """Days since the first upload, at least 1; -1 without uploads."""
    return F.when(first_at.isNull(), F.lit(-1.0)).otherwise(
        F.greatest(days_between(as_of, first_at), F.lit(1.0)))


def video_upload_frequency(
    age: Column, n_timestamps: Column, video_count: Column, n_videos_crawled: Column,
) -> Column:
    videos = (
        F.when(n_videos_crawled > 0, n_videos_crawled)
        .when(video_count > 0, video_count)
        .otherwise(n_timestamps)
    )
    return F.when(age <= 0, F.lit(-1.0)).otherwise(videos.cast("double") / age)
