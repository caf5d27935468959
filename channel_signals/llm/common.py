"""Helpers shared by the corpus operators: byte-level text in numpy, exact ranks, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from channel_signals.session import materialize

#: Bytes of text handled at once inside a task; one longer text is handled alone.
CHUNK_BYTES = 1 << 20
#: Rows of one key that a window may rank in one task.
RANK_ROWS = 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(df: DataFrame, new: list[str]) -> Column:
    """The columns of `df` that stay beside the `new` ones, as one struct `row`, so that no
    name of a column meets a name used on the way. Names differ only where Spark's do."""
    gone = {n.lower() for n in new}
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]).alias("row")


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a string column; null is empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    else:
        column = column.cast(pa.binary())
    column = column.fill_null(b"")
    n = len(column)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + CHUNK_BYTES, side="right")) - 1)
        yield lo, hi, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd multiplier modulo 2**64 and of its inverse, grown as needed."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte range follows (`range_hash`)."""
    POWERS.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS.up[:len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    POWERS.need(len(prefix))
    h = (prefix[end] - prefix[start]) * POWERS.down[start]
    return mix(h + (end - start).astype(np.uint64) * _ODD)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of bytes other than space and tab to carriage return."""
    solid = ~_SPACE[data]
    n = len(data)
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = solid
    before &= ~fresh
    start = np.flatnonzero(solid & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = solid
    after &= ~fresh
    end = np.flatnonzero(solid & ~after[1:]) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of every row of a chunk.

    A row of fewer words has one shingle, all its words; one without words has none.
    """
    start, end, row = words_of(data, offsets)
    h = range_hash(prefix_hash(data), start, end)
    first = np.searchsorted(row, np.arange(len(offsets)))
    grams = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width):
        grams = grams * _ODD + h[j:len(h) - width + 1 + j] if len(grams) else grams
    grams = mix(grams)
    out = []
    for i in range(len(offsets) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= width:
            out.append(np.unique(grams[lo:hi - width + 1]))
        elif hi > lo:
            short = np.full(1, hi - lo, np.uint64)
            for x in h[lo:hi]:
                short = short * _ODD + x
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sampled(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """About `rows` rows (all, where there are no more), by a hash of the keys; reruns agree."""
    n = df.count()
    share = min(1.0, rows / max(n, 1))
    return df if share == 1.0 else df.where(
        F.pmod(F.xxhash64(F.lit(77), *keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def ranked(df: DataFrame, keys: list[str], tie: list[Column], largest: int, name: str) -> DataFrame:
    """`df` with a number from 0 within each key, in a seeded order.

    `largest` is the row count of the largest key: keys are cut into parts of about
    RANK_ROWS rows by a hash, parts are counted, and rows are numbered within their part.
    """
    parts = max(1, -(-int(largest) // RANK_ROWS))
    df = df.withColumn("_part", F.pmod(F.xxhash64(F.lit(5), *tie), F.lit(parts)))
    inside = Window.partitionBy(*keys, "_part").orderBy(F.xxhash64(F.lit(9), *tie), *tie)
    out = df.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
    if parts == 1:
        return out.withColumn(name, F.col("_in")).drop("_in", "_part")
    sizes = df.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_size").over(ahead), F.lit(0)).alias("_ahead"))
    return (out.join(starts, [*keys, "_part"])
            .withColumn(name, F.col("_in") + F.col("_ahead")).drop("_in", "_part", "_ahead"))


def with_neighbours(df: DataFrame, key: Column, build: dict[str, Column], wrap: bool = False) -> DataFrame:
    """`df` in the order of `key` with next_<name>, and without `wrap` also prev_<name>, of every
    column of `build`; null at the ends, or with `wrap` the first follows the last.

    The key's range is cut where Spark's range partitioning of the bare keys cuts it. Rows go
    once to their range, and copies of a range's outer rows to the ranges beside it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumn("_k", key)
    ends = (df.select("_k").repartitionByRange(parts, "_k").withColumn("_p", F.spark_partition_id())
            .groupBy("_p").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi")).orderBy("lo").collect())
    if not ends:
        for name, column in build.items():
            df = df.withColumn(name, column)
            for side in ("next",) if wrap else ("prev", "next"):
                df = df.withColumn(f"{side}_{name}", F.col(name))
        return df.drop("_k")

    def fixed(rows) -> Column:
        return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in r.asDict().items()]) for r in rows])

    first, last = fixed([r["lo"] for r in ends]), fixed([r["hi"] for r in ends])
    at = F.col("_k")
    part = F.size(F.filter(first, lambda b: b <= at)) - 1
    before = F.when((part == 0) & F.lit(wrap), len(ends) - 1).otherwise(part - 1)
    copies = df.where(F.array_contains(first, at)).withColumn("_b", before).withColumn("_side", F.lit(1))
    if not wrap:
        copies = copies.unionByName(df.where(F.array_contains(last, at)).withColumn("_b", part + 1).withColumn("_side", F.lit(-1)))
    # of rows that tie at a range's end the smallest is the neighbour, on every run
    copies = copies.groupBy("_b", "_side").agg(F.min(F.struct(*df.columns)).alias("_r")).select("_b", "_side", "_r.*")
    rows = df.withColumn("_b", part).withColumn("_side", F.lit(0)).unionByName(copies).repartition("_b")
    for name, column in build.items():
        rows = rows.withColumn(name, column)
    order = Window.partitionBy("_b").orderBy("_side", "_k")
    rows = rows.select("*", *[F.lead(n).over(order).alias(f"next_{n}") for n in build],
                       *[F.lag(n).over(order).alias(f"prev_{n}") for n in build if not wrap])
    return rows.where("_side = 0").drop("_k", "_b", "_side")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the graph with edges (a, b): root is the smallest node of its component.

    Large-star and small-star steps alternate until nothing changes. Every step is a
    map-side-combined minimum per node joined back to the edges, and is checkpointed.
    """
    edges = materialize(edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stamp = None
    while True:
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == stamp:
            break
        stamp = seen
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = materialize(small.select("e.a", "e.b").where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of `n` nodes, given links a[i]-b[i]."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not (root[root] == root).all():
            root = root[root]
    return root


def grouped(batches: Iterator, keys: list[str], limit: int | None = None) -> Iterator:
    """Pandas frames of one key each out of batches sorted by the keys."""
    import pandas as pd

    kept: list = []
    last = None
    for frame in batches:
        if not len(frame):
            continue
        new = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new), len(frame)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            part = frame.iloc[lo:hi]
            key = tuple(part[k].iloc[0] for k in keys)
            if kept and key != last:
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(part)
            last = key
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]
