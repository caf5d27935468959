"""The feature table: one row per channel, from channels, uploads and titles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals.constants import ALL_FEATURES, META_COLUMNS, STATIC_FEATURES
from channel_signals.functions.segment import Segmenter
from channel_signals.operators import engagement as E
from channel_signals.operators.similarity import compared_titles, similarity_of
from channel_signals.operators.skew import FIND
from channel_signals.operators.timing import (
    channel_age_days, timing_features, video_upload_frequency,
)
from channel_signals.operators.titles import (
    pick_vocabulary, temporal_clickbait, title_style, vocabulary,
)
from channel_signals.sources.buckets import BucketedInputs


def instant(as_of: str | datetime | Column) -> Column:
    """The reference time, always given by the caller: a run never reads the clock."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def _features(
    channels: DataFrame, uploads: DataFrame, titles: DataFrame, as_of, tokenizer: str,
    vietnamese: Column, hot=FIND, language: DataFrame | None = None, segment: Segmenter | None = None,
) -> DataFrame:
    style = title_style(titles)
    if language is not None:
        style = style.drop("is_vietnamese").join(language.select("channel_id", "is_vietnamese"), "channel_id", "left")
    joined = (
        channels
        .join(timing_features(uploads, hot), "channel_id", "left")
        .join(style, "channel_id", "left")
        .join(vocabulary(titles, tokenizer, segment), "channel_id", "left")
        .join(compared_titles(titles), "channel_id", "left")
    )
    zero = F.lit(0.0)
    timed = joined.withColumns({
        "_age": channel_age_days(F.col("first_at"), instant(as_of)),
        "_std": F.coalesce("time_interval_std", F.lit(-1.0)),
    })
    sub_v = E.velocity(F.col("subscriber_count"), F.col("_age"))
    view_v = E.velocity(F.col("view_count"), F.col("_age"))
    kept = [c for c in ("channel_id", "title", "label") if c in channels.columns]
    return timed.select(
        *kept,
        F.col("_std").alias("time_interval_std"),
        F.coalesce("upload_burst_ratio", zero).alias("upload_burst_ratio"),
        video_upload_frequency(
            F.col("_age"), F.col("n_timestamps"), F.col("video_count"), F.col("n_videos_crawled"),
        ).alias("video_upload_frequency"),
        E.view_per_video(F.col("view_count"), F.col("video_count")).alias("view_per_video"),
        F.coalesce("dash_density", zero).alias("dash_density"),
        F.coalesce("title_length_std", zero).alias("title_length_std"),
        F.coalesce("capitalization_ratio", zero).alias("capitalization_ratio"),
        temporal_clickbait(F.col("click_marker_share"), F.col("_std")).alias("temporal_clickbait_ratio"),
        *pick_vocabulary(vietnamese),
        similarity_of(F.col("compared")).alias("avg_title_similarity"),
        E.sub_to_view_ratio(F.col("subscriber_count"), F.col("view_count")).alias("sub_to_view_ratio"),
        sub_v.alias("subscriber_velocity"),
        E.velocity_ratio(sub_v, view_v).alias("sub_to_view_velocity_ratio"),
        F.coalesce("clickbait_phrase_ratio", zero).alias("clickbait_phrase_ratio"),
        *META_COLUMNS,
    )


def build_features(
    channels: DataFrame, uploads: DataFrame, titles: DataFrame, as_of,
    tokenizer: str = "words", extra: bool = False, hot=FIND,
    language: DataFrame | None = None, segment: Segmenter | None = None,
) -> DataFrame:
    """14 features and 4 counters per channel. Channels without uploads or titles stay.

    channels(channel_id, title, label, and the four counters); `as_of` is the instant
    ages are measured at; `extra` adds clickbait_phrase_ratio, which no model uses. Channels
    known to be too large for one task may be given as `hot` (`BucketedInputs.hot_channels`).
    `language`(channel_id, is_vietnamese) replaces the count of Vietnamese letters
    (`operators.bayes.is_vietnamese`), `segment` the tokens of Vietnamese titles.
    """
    out = _features(channels, uploads, titles, as_of, tokenizer,
                    F.coalesce("is_vietnamese", F.lit(False)), hot, language, segment)
    kept = [c for c in ("channel_id", "title", "label") if c in channels.columns]
    more = ["clickbait_phrase_ratio"] if extra else []
    return out.select(*kept, *ALL_FEATURES, *META_COLUMNS, *more)


def bucketed_features(spark: SparkSession, inputs: BucketedInputs, as_of, **kwargs) -> DataFrame:
    """`build_features` over tables in buckets of their channel: each is read in place, and
    nothing is shuffled but the uploads of channels that are too large for one task."""
    return build_features(*[inputs.read(spark, kind) for kind in ("channels", "uploads", "titles")], as_of,
                          hot=inputs.hot_channels(spark), **kwargs)


def scoring_features(channels: DataFrame, uploads: DataFrame, titles: DataFrame, as_of) -> DataFrame:
    """Features of channels about to be scored: the crawled number is the upload count."""
    return build_features(_with_upload_counts(channels, uploads), uploads, titles, as_of).drop(
        "sub_to_view_velocity_ratio")


def candidate_features(
    channels: DataFrame, uploads: DataFrame, titles: DataFrame, as_of,
) -> DataFrame:
    """Features of search candidates: Vietnamese by country, else whitespace tokens;
    the label is -1 and the counter of crawled videos is the number of uploads."""
    counted = _with_upload_counts(channels, uploads).withColumn("label", F.lit(-1))
    out = _features(counted, uploads, titles, as_of, "whitespace",
                    F.coalesce(F.col("country") == "VN", F.lit(False)))
    kept = [c for c in ("channel_id", "title") if c in channels.columns]
    return out.select(*kept, "label", *STATIC_FEATURES, *META_COLUMNS)


def _with_upload_counts(channels: DataFrame, uploads: DataFrame) -> DataFrame:
    n = uploads.where(F.col("published_at").isNotNull()).groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("_n_uploads"))
    return (
        channels.drop("n_videos_crawled").join(n, "channel_id", "left")
        .withColumn("n_videos_crawled", F.coalesce("_n_uploads", F.lit(0).cast("long")))
        .drop("_n_uploads")
    )
