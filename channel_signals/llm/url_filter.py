"""URL rules, and a list of canonical URLs behind a blocked Bloom filter. Columns only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import carried
from channel_signals.session import materialize

#: (verdict, rule) with the rule as host/path.
Rules = Sequence[tuple[str, str]]
#: Filter bits per listed URL, and the 64-bit words of a block.
BITS_PER_URL = 16
BLOCK_WORDS = 4
#: A filter of at most so many blocks (40 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading `www.` and path without `.html` or closing slashes; null without a host."""
    plain = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))
    return F.when(host != "", plain)


def rule_for(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host or its subdomain and path prefix fit."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _bits(key: Column) -> list[Column]:
    """Two bits in each word of a block."""
    h = F.xxhash64(F.lit(1), key)
    one = F.lit(1).cast("long")

    def bit(i: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))

    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(BLOCK_WORDS)]


def bloom(listed: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """The filter as rows (block, w0..w3), and its number of blocks, from the listed count."""
    blocks = max(1, -(-n * BITS_PER_URL // (64 * BLOCK_WORDS)))
    words = [f"w{i}" for i in range(BLOCK_WORDS)]
    rows = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"),
                         *[b.alias(w) for b, w in zip(_bits(F.col(key)), words)])
    return rows.groupBy("_block").agg(*[F.bit_or(w).alias(w) for w in words]), blocks


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: Rules) -> DataFrame:
    """`pages` with host, path, rule, verdict, possible and listed.

    A rule decides first. Otherwise a page is blocked where its canonical URL is one of
    `listed` (column `url`): the blocked Bloom filter passes possible hits, and only these
    meet the list in an exact hash join. Null, hostless and unlisted URLs are allowed;
    repeated pages or listed URLs change nothing; an empty list blocks nothing.
    Columns of `pages` under the new names are replaced.
    """
    new = ["host", "path", "rule", "verdict", "possible", "listed"]
    url = F.col("url").cast("string")
    parts = pages.select(carried(pages, new), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "_ruled": verdict, "_key": canonical(F.col("host"), F.col("path"))})
    known = materialize(listed.select(canonical(host_of(url), path_of(url)).alias("_key"))
                        .where("_key is not null").distinct())
    n = known.count()
    filter_, blocks = bloom(known, "_key", n)
    filter_ = F.broadcast(filter_) if blocks <= BROADCAST_BLOCKS else filter_
    words = [f"w{i}" for i in range(BLOCK_WORDS)]
    probed = parts.withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks))).join(filter_, "_block", "left")
    passes = F.lit(True)
    for w, bits in zip(words, _bits(F.col("_key"))):
        passes = passes & (F.col(w).bitwiseAND(bits) == bits)
    probed = probed.withColumn("possible", F.coalesce(passes & F.col("_key").isNotNull(), F.lit(False))).drop("_block", *words)
    hits = probed.where("possible").join(known.withColumn("listed", F.lit(True)), "_key", "left")
    rest = probed.where("not possible").withColumn("listed", F.lit(False))
    both = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).select(*rest.columns).unionByName(rest)
    final = F.coalesce("_ruled", F.when(F.col("listed"), "block").otherwise("allow"))
    return both.withColumn("verdict", final).select("row.*", *new)
