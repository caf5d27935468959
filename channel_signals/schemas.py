"""Declared schemas of the tables the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from channel_signals.constants import ALL_FEATURES, META_COLUMNS

CHANNELS_RAW = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("channel_id", "title", "description", "published_at", "country")]
    + [T.StructField(c, T.LongType()) for c in
       ("subscriber_count", "video_count", "view_count")]
    + [T.StructField("uploads_playlist", T.StringType()),
       T.StructField("label", T.IntegerType()),
       T.StructField("raw_url", T.StringType()),
       T.StructField("n_videos_crawled", T.LongType()),
       T.StructField("video_timestamps", T.StringType()),
       T.StructField("video_titles", T.StringType())]
)

FEATURES = T.StructType(
    [T.StructField("channel_id", T.StringType()),
     T.StructField("title", T.StringType()),
     T.StructField("label", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ALL_FEATURES]
    + [T.StructField(c, T.LongType()) for c in META_COLUMNS]
)

INTERVAL_CELLS = T.StructType([
    T.StructField("channel_id", T.StringType()),
    T.StructField("intervals_json", T.StringType()),
])

ANOMALY_SCORES = T.StructType([
    T.StructField("channel_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("interval_anomaly_score", T.DoubleType()),
])

NEW_CHANNELS = T.StructType([
    T.StructField("channel_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("label", T.StringType()),
])

COMPARISON = T.StructType(
    [T.StructField("Model", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in
       ("Accuracy", "Precision", "Recall", "F1", "CV F1 Mean", "CV F1 Std")]
)
