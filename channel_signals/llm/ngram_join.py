"""Jaccard join of word n-grams: banded MinHash, Bayesian pruning, exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import components, grouped, local_roots, mix, shingle_sets, text_chunks
from channel_signals.session import materialize

WORDS = 5
THRESHOLD = 0.8
HASHES, BAND_ROWS, BANDS = 96, 4, 24
#: A pair goes on while P(similarity >= threshold | matches so far) is at least this.
TOLERANCE = 1e-6
STEP = 32
#: Signatures, and texts, of one bucket that a task compares with as many others.
SIGNATURE_BLOCK, TEXT_BLOCK = 1024, 256
_PRIMES = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_SHIFTS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
SKETCH = "doc_id long, text_key long, text_class long, n_shingles long, signature binary, bands array<long>"


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """Fewest of n matches at which the posterior, from a uniform prior, is within tolerance."""
    for m in range(n + 1):
        p = sum(comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))
        if p >= tolerance:
            return m
    return n + 1


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text_class, n_shingles, signature, bands) of every document.

    text_key is a hash of the text, text_class is one of the set of shingles: equal sets are one class. The
    signature keeps 8 bits of each MinHash value, the bands hash whole values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, sizes, signatures, bands = [], [], [], []
            for _, _, data, offsets in text_chunks(batch.column(2)):
                sets = shingle_sets(data, offsets, WORDS)
                full = np.array([len(s) > 0 for s in sets])
                sizes += [len(s) for s in sets]
                least = np.zeros((len(sets), HASHES), np.uint64)
                if full.any():
                    flat = np.concatenate([s for s in sets if len(s)])
                    begin = np.cumsum([0, *(len(s) for s in sets if len(s))])[:-1]
                    for j in range(HASHES):
                        least[full, j] = np.minimum.reduceat(flat * _PRIMES[j] + _SHIFTS[j], begin)
                least = mix(least)
                for s, row, ok in zip(sets, least, full):
                    if not ok:
                        classes.append(None)
                        signatures.append(None)
                        bands.append(None)
                        continue
                    total = mix(np.array([s.sum() + np.uint64(len(s))], np.uint64) ^ np.bitwise_xor.reduce(mix(s)))
                    classes.append(int(total.view(np.int64)[0]))
                    signatures.append((row & np.uint64(255)).astype(np.uint8).tobytes())
                    band = np.zeros(BANDS, np.uint64)
                    for r in range(BAND_ROWS):
                        band = mix(band + row[r:BANDS * BAND_ROWS:BAND_ROWS])
                    bands.append((band ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(signatures, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "text_class", "n_shingles", "signature", "bands"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text).mapInArrow(run, SKETCH)


def _blocks(df: DataFrame, size: str, node: str, block: int) -> DataFrame:
    """Rows once for each pair (i, j) of blocks of their group that they take part in."""
    m = F.ceil(F.col(size) / block).cast("int")
    mine = F.pmod(F.xxhash64(F.lit(3), node), m).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), m - 1), lambda o: F.struct(
        F.least(o, mine).alias("i"), F.greatest(o, mine).alias("j")))
    return df.withColumn("_mine", mine).withColumn("_p", F.explode(pairs)).select(
        *df.columns, "_mine", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j"))


def _survivors(sig: np.ndarray, left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of a row of `left` and one of `right` once, where the matches stay plausible
    step by step; `left` and `right` are the same rows or have none in common."""
    found = [_plausible(sig, left[lo:lo + 128], right[lo:] if left is right else right, left is right, least)
             for lo in range(0, len(left), 128)]
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _plausible(sig, left, right, same: bool, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    a = np.repeat(left, len(right))
    b = np.tile(right, len(left))
    if same:
        once = a < b
        a, b = a[once], b[once]
    hits = np.zeros(len(a), np.int32)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        hits += (sig[a, part] == sig[b, part]).sum(axis=1, dtype=np.int32)
        on = hits >= need
        a, b, hits = a[on], b[on], hits[on]
    return a, b


def _sides(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    i, j = group["_i"].iloc[0], group["_j"].iloc[0]
    if i == j:
        every = np.arange(len(group))
        return every, every
    mine = group["_mine"].to_numpy()
    return np.flatnonzero(mine == i), np.flatnonzero(mine == j)


def _least(threshold: float, tolerance: float) -> list[int]:
    return [least_matches(n, threshold, tolerance) for n in range(STEP, HASHES + 1, STEP)]


def candidates(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b) that connect the classes between which a pair survives the pruning.

    Classes that share a band meet in one bucket; buckets of one are dropped, larger ones
    are compared block by block. Only a spanning star of each block's links leaves a task.
    """
    least = _least(threshold, tolerance)
    rows = classes.select("text_class", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = rows.join(sizes, "bucket").join(classes.select("text_class", "signature"), "text_class")
    rows = _blocks(rows, "size", "text_class", SIGNATURE_BLOCK).drop("size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(frames, ["bucket", "_i", "_j"]):
            sig = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
            left, right = _sides(group)
            a, b = _survivors(sig, left, right, least)
            if len(a):
                ids = group["text_class"].to_numpy()
                root = local_roots(len(ids), a, b)
                other = np.flatnonzero(root != np.arange(len(ids)))
                yield pd.DataFrame({"a": ids[other], "b": ids[root[other]]})

    keys = ["bucket", "_i", "_j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, "a long, b long")


def verified(texts: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Links counted and connected: rows (node, links, a, b) from blocks of a candidate group.

    `texts` has text_class, root, size, weight and text. Every pair of a group is taken
    once, pruned again by signature, and what is left is decided by exact intersections.
    """
    least = _least(threshold, tolerance)
    rows = _blocks(texts, "size", "text_class", TEXT_BLOCK).drop("size")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(frames, ["root", "_i", "_j"]):
            group = group.drop_duplicates("text_class")
            sets: list[np.ndarray] = []
            for _, _, data, offsets in text_chunks(pa.array(group["text"], pa.string())):
                sets += shingle_sets(data, offsets, WORDS)
            sig = np.frombuffer(b"".join(group["signature"]), np.uint8).reshape(len(group), -1)
            left, right = _sides(group)
            a, b = _survivors(sig, left, right, least)
            if not len(a):
                continue
            size = np.array([len(s) for s in sets])
            shared = _intersections(sets, a, b)
            on = shared >= threshold * (size[a] + size[b] - shared) - 1e-9
            a, b = a[on], b[on]
            if not len(a):
                continue
            weight = group["weight"].to_numpy()
            links = np.bincount(a, weight[b], len(group)) + np.bincount(b, weight[a], len(group))
            root = local_roots(len(group), a, b)
            ids = group["text_class"].to_numpy()
            some = np.flatnonzero(links > 0)
            yield pd.DataFrame({"node": ids[some], "links": links[some].astype(np.int64), "hook": ids[root[some]]})

    keys = ["root", "_i", "_j"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInPandas(run, "node long, links long, hook long")


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs; many pairs go through a 0/1 matrix in slices."""
    if len(a) < 64:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a, b)])
    used = np.unique(np.concatenate([a, b]))
    flat = np.concatenate([sets[u] for u in used])
    rows = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    on = count[column] > 1
    rows, column = rows[on], column[on]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    total = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        s, e = np.searchsorted(column, [lo, lo + 4096])
        part = np.zeros((len(used), 4096), np.float32)
        part[rows[s:e], column[s:e] - lo] = 1
        total += part @ part.T
    return total[np.searchsorted(used, a), np.searchsorted(used, b)].astype(np.int64)


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept), one row per row of `docs`.

    Documents link where the Jaccard similarity of their sets of five-word shingles is
    `threshold` or more. class_id is the smallest id among documents of an equal set,
    n_links the number of other documents linked directly, copies included, component_id
    the smallest id reachable by links, and kept is doc_id = component_id. Copies are one
    class and are never paired. Texts of fewer than five words are one shingle; null,
    empty and wordless texts link with nothing. Rows without an id link like others but
    are never class_id; a component of only such rows has null, and they are kept. Rows that
    share an id are counted each and are kept or not together. Other columns are not read.
    """
    rows = materialize(sketches(docs))
    light = rows.select("doc_id", "text_class")
    classes = materialize(rows.where("text_class is not null").groupBy("text_class").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("weight"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("pick"),
        F.first("signature").alias("signature"), F.first("bands").alias("bands")))
    roots = components(candidates(classes, threshold, tolerance))
    sizes = roots.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    members = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(sizes, "root")
    members = members.withColumnRenamed("node", "text_class").join(
        classes.select("text_class", "pick", "weight", "signature"), "text_class")
    members = materialize(members)
    # one text per class, that of its smallest id
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.alias("text"))
    found = members.join(texts, F.col("pick.doc_id").eqNullSafe(F.col("_id")) & (F.col("pick.text_key") == F.col("_key")))
    found = found.select("text_class", "root", "size", "weight", "signature", "text")
    links = materialize(verified(found, threshold, tolerance))
    counted = links.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "text_class")
    groups = components(links.select(F.col("node").alias("a"), F.col("hook").alias("b")))
    out = classes.select("text_class", "class_id", "weight").join(counted, "text_class", "left").join(
        groups.withColumnRenamed("node", "text_class"), "text_class", "left")
    out = out.withColumn("root", F.coalesce("root", "text_class"))
    least = out.groupBy("root").agg(F.min("class_id").alias("component_id"))
    out = out.join(least, "root").select(
        "text_class", "class_id", "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    done = light.where("text_class is not null").join(out, "text_class")
    alone = light.where("text_class is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    both = done.select(*alone.columns).unionByName(alone)
    return both.select("doc_id", "class_id", "n_links", "component_id",
                       F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
