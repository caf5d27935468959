"""JSON array cells: timestamps, titles and intervals as the CSV tables hold them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.functions.text import strip

#: Upload positions that one cell of intervals covers.
CELL_VALUES = 100_000


def string_array(cell: Column) -> Column:
    """Elements of a JSON array of strings; NULL for NULL, malformed or non-array text."""
    return F.from_json(cell, "array<string>")


def instant(text: Column) -> Column:
    """ISO-8601 text as an instant (naive text is UTC), NULL when it is not one."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def parse_timestamps(cell: Column) -> Column:
    """Array of the valid instants of a cell, in order; empty when there are none."""
    parsed = F.transform(string_array(cell), instant)
    return F.coalesce(F.filter(parsed, lambda t: t.isNotNull()), F.array().cast("array<timestamp>"))


def parse_titles(cell: Column) -> Column:
    """Array of the stripped non-empty titles of a cell, in order."""
    cleaned = F.transform(string_array(cell), strip)
    return F.coalesce(
        F.filter(cleaned, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))


def flatten_titles(cell: Column) -> Column:
    """All titles of a cell joined by blanks."""
    return F.array_join(parse_titles(cell), " ")


def parse_intervals(cell: Column) -> Column:
    """Array of days of an intervals cell; empty for NULL (after a left join)."""
    return F.coalesce(F.from_json(cell, "array<double>"), F.array().cast("array<double>"))


def explode_uploads(df: DataFrame, cell: str = "video_timestamps") -> DataFrame:
    """uploads(channel_id, pos, published_at); bad elements are dropped, not counted."""
    return df.select("channel_id", F.posexplode(parse_timestamps(F.col(cell)))
                     .alias("pos", "published_at"))


def explode_titles(df: DataFrame, cell: str = "video_titles") -> DataFrame:
    """titles(channel_id, pos, title) of non-empty stripped titles."""
    return df.select("channel_id", F.posexplode(parse_titles(F.col(cell))).alias("pos", "title"))


def explode_intervals(df: DataFrame, cell: str = "intervals_json") -> DataFrame:
    """intervals(channel_id, seq, days) of interval cells.

    seq is unique in a channel and keeps the order: the parts of a channel follow each
    other, each with CELL_VALUES numbers of its own. Cells without `part` are whole.
    """
    part = F.col("part") if "part" in df.columns else F.lit(0).cast("long")
    rows = df.select("channel_id", part.alias("_part"),
                     F.posexplode(parse_intervals(F.col(cell))).alias("_i", "days"))
    return rows.select("channel_id", (F.col("_part") * CELL_VALUES + F.col("_i")).alias("seq"), "days")


def interval_cells(intervals: DataFrame) -> DataFrame:
    """(channel_id, part, intervals_json): days of a channel as JSON arrays in time order.

    A part covers CELL_VALUES upload positions, so no cell grows without bound; most
    channels have part 0 only.
    """
    cell = F.array_sort(F.collect_list(F.struct("seq", "days")))
    return (
        intervals.withColumn("part", F.expr(f"seq div {CELL_VALUES}"))
        .groupBy("channel_id", "part")
        .agg(F.to_json(F.transform(cell, lambda s: s["days"])).alias("intervals_json"))
    )
