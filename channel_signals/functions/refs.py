"""Column functions that read channel references out of seed lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from channel_signals.functions.text import strip

# --- fixed values: reference patterns ---
HANDLE = r"youtube\.com/@([\p{L}\p{N}_\-.]+)"
CHANNEL = r"youtube\.com/channel/(UC[\p{L}\p{N}_\-]+)"
BARE_ID = r"^(UC[\p{L}\p{N}_\-]{22})$"
ANY_CHANNEL = r"channel/(UC[\p{L}\p{N}_\-]+)"


def decode(line: Column) -> Column:
    """Percent-decoding that keeps `+`, and keeps the line when it is malformed."""
    clean = strip(line)
    return F.coalesce(F.try_url_decode(F.replace(clean, F.lit("+"), F.lit("%2B"))), clean)


def _usable(url: Column) -> Column:
    return (
        (url != "") & ~url.startswith("#")
        & ~url.contains("results?") & ~url.contains("search_query")
    )


def ref_type(line: Column) -> Column:
    url = decode(line)
    return F.when(
        _usable(url),
        F.when(url.rlike(HANDLE), F.lit("handle")).when(url.rlike(CHANNEL), F.lit("id")))


def ref_value(line: Column) -> Column:
    url = decode(line)
    return F.when(
        _usable(url),
        F.when(url.rlike(HANDLE), F.regexp_extract(url, HANDLE, 1))
        .when(url.rlike(CHANNEL), F.regexp_extract(url, CHANNEL, 1)))


def channel_id(line: Column) -> Column:
    """Channel id of a bare id line or a channel URL; handles give NULL."""
    clean = strip(line)
    return F.when(clean.rlike(BARE_ID), clean).when(
        clean.rlike(ANY_CHANNEL), F.regexp_extract(clean, ANY_CHANNEL, 1))
