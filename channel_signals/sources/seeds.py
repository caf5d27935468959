"""Seed lists: text files of channel references whose file names the label."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from channel_signals.constants import GENUINE, SLOP
from channel_signals.functions import refs
from channel_signals.functions.text import strip


def read_seed_lines(spark: SparkSession, labelled_paths: dict[str, int]) -> DataFrame:
    """(source_file, file_order, line_no, value, label) of text files.

    `line_no` only orders lines within a file: the byte position of the block, then
    the row within it. Files stay splittable, whatever their size.
    """
    parts = []
    for i, (path, label) in enumerate(labelled_paths.items()):
        parts.append(
            spark.read.text(path).select(
                F.col("_metadata.file_path").alias("source_file"),
                F.lit(i).alias("file_order"),
                F.struct(F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("row")).alias("line_no"),
                "value", F.lit(label).alias("label")))
    return reduce(DataFrame.unionByName, parts)


def parse_channel_refs(lines: DataFrame, col: str = "value") -> DataFrame:
    """Add ref_type ('handle' or 'id') and ref_value; unusable lines are dropped."""
    return (
        lines.withColumn("ref_type", refs.ref_type(F.col(col)))
        .withColumn("ref_value", refs.ref_value(F.col(col)))
        .where(F.col("ref_type").isNotNull())
    )


def parse_bare_ids(lines: DataFrame, col: str = "value") -> DataFrame:
    """Lines with a channel id, bare or in a URL, as ref_type 'id'."""
    return (
        lines.withColumn("ref_value", refs.channel_id(F.col(col)))
        .where(F.col("ref_value").isNotNull())
        .withColumn("ref_type", F.lit("id"))
    )


def parse_any_ref(lines: DataFrame, col: str = "value") -> DataFrame:
    """URL references first, bare ids where a line has none."""
    bare = refs.channel_id(F.col(col))
    return (
        lines
        .withColumn("ref_type", F.coalesce(
            refs.ref_type(F.col(col)), F.when(bare.isNotNull(), F.lit("id"))))
        .withColumn("ref_value", F.coalesce(refs.ref_value(F.col(col)), bare))
        .where(F.col("ref_type").isNotNull())
    )


def first_per_file(parsed: DataFrame) -> DataFrame:
    """One row per (file, reference without case), the first by line.

    A minimum that combines before the shuffle, so repeated references are cheap.
    """
    rest = [c for c in parsed.columns if c not in ("source_file", "line_no")]
    return (
        parsed.groupBy("source_file", "ref_type", F.lower("ref_value").alias("_key"))
        .agg(F.min(F.struct("line_no", *[c for c in rest if c != "ref_type"])).alias("_row"))
        .select("source_file", "ref_type", "_row.*")
    )


def read_seeds(
    spark: SparkSession, labelled_paths: dict[str, int], mode: str = "both",
) -> DataFrame:
    """Seeds with labels; mode 'url', 'id' or 'both' rules which lines count."""
    parse = {"url": parse_channel_refs, "id": parse_bare_ids, "both": parse_any_ref}[mode]
    lines = read_seed_lines(spark, labelled_paths)
    return first_per_file(parse(lines)).withColumn("raw_url", strip(F.col("value"))).drop("value")


def line_counts(lines: DataFrame) -> DataFrame:
    """Non-blank lines per file and label."""
    return lines.groupBy("source_file", "label").agg(
        F.count_if(strip(F.col("value")) != "").alias("n_lines"))


def limit_per_label(seeds: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n seeds of each label in input order."""
    w = Window.partitionBy("label").orderBy(*order)
    return seeds.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def union_labels(slop: DataFrame, genuine: DataFrame, key: str = "channel_id") -> DataFrame:
    """(key, label): the genuine label wins when a key is in both."""
    both = slop.select(key, F.lit(SLOP).alias("label"), F.lit(0).alias("_p")).unionByName(
        genuine.select(key, F.lit(GENUINE).alias("label"), F.lit(1).alias("_p")))
    return both.groupBy(key).agg(F.max_by("label", "_p").alias("label"))
