"""The operators' inputs, derived from the given tables. Every view reads whole tables
and whole texts; modulo terms only decide how a row is dressed, never whether it counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals.operators.metrics import hard_decision
from channel_signals.operators.profile import number

AS_OF_ORDERS = "2002-01-01 00:00:00"
AS_OF_EVENTS = "2024-02-01 00:00:00"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of several syllables for the segmenter, as the documents use them.
WORDS_OF_SYLLABLES = ["of the", "in the", "de la", "in der", "one of the"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def uploads_ev(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("channel_id"), F.col("ts").cast("timestamp").alias("published_at"))


def uploads_ord(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("channel_id"),
        F.col("o_orderdate").cast("timestamp").alias("published_at"))


def channels_ord(spark, sf) -> DataFrame:
    """One channel per customer with counters from its orders."""
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("channel_id")).agg(
        F.floor(F.round(F.sum("o_totalprice"), 2)).alias("view_count"),
        F.count(F.lit(1)).alias("video_count"))
    k = F.col("channel_id")
    return (
        table(spark, sf, "customer").select(
            F.col("c_custkey").alias("channel_id"), F.col("c_name").alias("title"),
            (F.col("c_mktsegment") == "BUILDING").cast("int").alias("label"),
            F.floor("c_acctbal").alias("subscriber_count"))
        .join(sums, "channel_id", "left")
        .withColumn("n_videos_crawled", F.when(k % 7 == 0, F.lit(None)).when(
            k % 5 == 0, F.lit(0)).otherwise(F.col("video_count")).cast("long"))
    )


def documents(spark, sf) -> DataFrame:
    """Documents dealt out by id, as the table may be one row group: groupings by the id
    that follow need no other exchange."""
    return table(spark, sf, "documents").repartition("doc_id")


def doc_lines(spark, sf) -> DataFrame:
    """Every line of every document: doc_id, source, pos and the line."""
    return documents(spark, sf).select(
        "doc_id", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def _dressed(lines: DataFrame, key: str) -> DataFrame:
    d = F.col("doc_id") + F.col("i")
    line = F.col("line")

    def part(every: int, text) -> Column:
        return F.when(d % every == 0, text).otherwise(F.lit(""))

    t = F.when(d % 13 == 0, F.lit("***")).otherwise(F.concat(
        part(17, F.lit("The hidden truth ")),
        F.when(d % 7 == 0, F.translate(line, LOWER, UPPER)).otherwise(line),
        part(3, F.concat(F.lit(" — part "), F.col("doc_id").cast("string"))),
        part(5, F.lit("?")),
        part(11, F.lit(" -- – "))))
    return lines.select(
        F.col(key).alias("channel_id"), (F.col("doc_id") * 1000000 + F.col("i")).alias("pos"),
        t.alias("title"))


def titles_source(spark, sf) -> DataFrame:
    """Dressed lines as titles, a channel per source: 20 channels, each very large."""
    return _dressed(doc_lines(spark, sf), "source")


def titles_doc(spark, sf) -> DataFrame:
    """Dressed lines as titles, a channel per document."""
    return _dressed(doc_lines(spark, sf), "doc_id")


def titles_conv(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("channel_id"), F.col("turn").alias("pos"),
        F.col("text").alias("title"))


def numeric_labelled(spark, sf, more: list[str] = ()) -> DataFrame:
    """Line items with a sentinel and a gap in the first column."""
    line = F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.when(line == 1, F.lit(-1.0)).when(line == 2, F.lit(None)).otherwise(
            F.col("l_quantity")).alias("l_quantity"),
        *NUMERIC[1:], *more)


def numeric_clean(spark, sf, more: list[str] = ()) -> DataFrame:
    return numeric_labelled(spark, sf, more).withColumn(
        "l_quantity", F.nullif(number("l_quantity"), F.lit(-1.0)))


def predictions(spark, sf) -> DataFrame:
    p1 = ((F.col("doc_id") * 37) % 101) / 100.0
    return table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("label"), p1.alias("p1"),
        hard_decision(p1).alias("prediction"),
        (F.col("doc_id") % 5).alias("fold"))


def labelled_docs(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return docs.join(labels, "doc_id")


def seed_lines(spark, sf) -> DataFrame:
    """Seed lines of every kind, one per customer, in two files with two labels."""
    k = F.col("c_custkey")
    text = k.cast("string")
    kind = k % 8
    value = (
        F.when(kind == 0, F.concat(F.lit("https://www.youtube.com/@Handle"), text))
        .when(kind == 1, F.concat(F.lit("https://www.youtube.com/channel/UC"), F.lpad(text, 22, "x")))
        .when(kind == 2, F.concat(F.lit(" UC"), F.lpad(text, 22, "0")))
        .when(kind == 3, F.concat(F.lit("https://www.youtube.com/@T%C3%AAn"), text, F.lit("+a")))
        .when(kind == 4, F.concat(F.lit("https://www.youtube.com/@HANDLE"), (k - 4).cast("string")))
        .when(kind == 5, F.concat(F.lit("https://www.youtube.com/results?search_query="), text))
        .when(kind == 6, F.concat(F.lit("# note "), text))
        .otherwise(F.lit("   ")))
    return table(spark, sf, "customer").select(
        F.concat(F.lit("seeds_"), (k % 2).cast("string")).alias("source_file"),
        k.alias("line_no"), value.alias("value"), (k % 2).cast("int").alias("label"),
        "c_nationkey")


def candidates(spark, sf) -> DataFrame:
    """Two search hits per customer; counters in thousands."""
    k = F.col("channel_id")
    rows = channels_ord(spark, sf).withColumn(
        "query_order", F.explode(F.array(k % 12, (k * 7) % 12)))
    q = F.col("query_order")
    return rows.select(
        F.when(q == 0, F.lit("lofi hip hop radio to relax"))
        .when(q == 1, F.lit("sự thật kinh hoàng về"))
        .otherwise(F.concat(F.lit("query "), q.cast("string"))).alias("query"),
        F.when(q < 6, F.lit("slop")).otherwise(F.lit("genuine")).alias("target"),
        "query_order", k.alias("rank"), "channel_id",
        F.when(k % 9 == 0, F.concat(F.lit("Lofi Hip Hop "), "title")).otherwise(
            F.col("title")).alias("title"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("US")).alias("country"),
        F.col("subscriber_count"), (F.col("video_count")).alias("video_count"),
        F.col("view_count"), (((k * 53) % 100) / 100.0).alias("p"))


def titles_ord(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("channel_id"), k.alias("pos"),
        F.when(k % 40 == 0, F.lit("Deep Sleep mix")).otherwise(F.col("o_orderpriority")).alias("title"))


def json_channels(spark, sf) -> DataFrame:
    """A cell of timestamps per order: some malformed, some NULL, some with junk inside."""
    k = F.col("o_orderkey")

    def iso(c):
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")

    first, second = iso(F.col("o_orderdate")), iso(F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"))
    cell = (
        F.when(k % 50 == 0, F.lit("[oops"))
        .when(k % 51 == 0, F.lit(None))
        .when(k % 7 == 0, F.concat(F.lit('["2020-13-45","2020","'), first, F.lit('"]')))
        .otherwise(F.concat(F.lit('["'), second, F.lit('","'), first, F.lit('"]'))))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("channel_id"), cell.alias("video_timestamps"))


def json_titles(spark, sf) -> DataFrame:
    """A cell of titles per document: its lines."""
    return documents(spark, sf).select(
        F.col("doc_id").alias("channel_id"), F.to_json(F.split("text", "\n")).alias("video_titles"))


def ml_channels(spark, sf) -> DataFrame:
    """Labelled documents as channels: counters and uploads of the customer of the same
    number, lines as titles, the quality label."""
    return channels_ord(spark, sf).drop("label").join(ml_labels(spark, sf), "channel_id")


def ml_labels(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("channel_id"), F.col("quality").alias("label"))


def titles_plain_doc(spark, sf) -> DataFrame:
    return doc_lines(spark, sf).select(
        F.col("doc_id").alias("channel_id"), F.col("i").alias("pos"), F.col("line").alias("title"))
