"""Exact cosine range join: pivot cells, replicated boundaries, independent cells."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import components, grouped, local_roots
from channel_signals.session import materialize

COSINE = 0.98
#: Pivots grow with the square root of the vectors: one for each so many, four at least.
ROOTS_PER_PIVOT, MOST_PIVOTS = 16, 1024
#: Vectors of a cell that a task compares with as many others.
BLOCK = 2048
SLACK = 1e-9


def units(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of equal size, and which rows have one."""
    width = int(sizes.max(initial=0))
    ok = sizes == width
    out = np.zeros((len(sizes), width))
    if width:
        out[ok] = flat[np.repeat(ok, sizes)].reshape(-1, width)
    with np.errstate(all="ignore"):
        norm = np.sqrt((out * out).sum(axis=1))
        ok &= np.isfinite(norm) & (norm > 0)
        out[ok] /= norm[ok, None]
    out[~ok] = 0
    return out, ok


def vectors_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values in double, with null as not a number; sizes) of an array column."""
    sizes = np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    flat = column.flatten()
    return flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float), sizes


def pivots_of(rows: DataFrame, n: int) -> np.ndarray:
    """Unit vectors of the smallest hashes: a number that grows with the root of n, to a bound."""
    wanted = min(MOST_PIVOTS, max(4, round(sqrt(n) / ROOTS_PER_PIVOT)))
    got = rows.select("vector").orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id").limit(wanted).toPandas()
    if not len(got):
        return np.zeros((0, 0))
    return np.unique(np.stack([np.frombuffer(v, "<f8") for v in got["vector"]]), axis=0)


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that can link, the unit vector in doubles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, sizes = vectors_of(batch.column(2))
            width = np.unique(sizes)
            begin = np.concatenate([[0], np.cumsum(sizes)])
            for w in width[width > 0]:
                rows = np.flatnonzero(sizes == w)
                values = flat[(begin[rows][:, None] + np.arange(w)).ravel()]
                unit, ok = units(values, np.full(len(rows), w))
                keep = pa.array(rows[ok])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(keep), batch.column(1).take(keep), pa.array([u.tobytes() for u in unit[ok]], pa.binary())],
                    names=["vec_id", "label", "vector"])

    return df.where("vec_id is not null and label is not null and embedding is not null").select(
        "vec_id", "label", F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, label long, vector binary")


def cells(rows: DataFrame, pivots: np.ndarray, cosine: float) -> DataFrame:
    """(label, cell, home, vec_id, vector): each vector in the cell of its nearest pivot, and in
    every cell that a vector within range of it may call home.

    u is at home with pivot q and v with p, at most r apart; then, from the triangle inequality on the
    bisector of p and q, (cos(v, p) - cos(v, q)) / |p - q| <= r. Only such cells get a copy of v.
    """
    reach = sqrt(2 - 2 * cosine) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        width = pivots.shape[1] * 8
        for batch in batches:
            raw = batch.column(2).to_pylist()
            fits = np.array([len(v) == width for v in raw], bool)
            cell, row = [], []
            if fits.any():
                some = np.flatnonzero(fits)
                near = np.stack([np.frombuffer(raw[i], "<f8") for i in some]) @ pivots.T
                best = near.argmax(axis=1)
                at, to = np.nonzero(near[np.arange(len(some)), best][:, None] - near <= reach * apart[best] + SLACK)
                row, cell, home = some[at], to, best[at] == to
            if (~fits).any():  # other dimensions meet in a cell of their own
                rest = np.flatnonzero(~fits)
                row, cell, home = (np.concatenate(x) for x in zip(
                    (row, cell, home) if fits.any() else (rest[:0], rest[:0], np.zeros(0, bool)),
                    (rest, np.array([-len(raw[i]) for i in rest]), np.ones(len(rest), bool))))
            if len(row):
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).take(pick), pa.array(cell.astype(np.int32)), pa.array(home),
                     batch.column(0).take(pick), batch.column(2).take(pick)],
                    names=["label", "cell", "home", "vec_id", "vector"])

    return rows.mapInArrow(run, "label long, cell int, home boolean, vec_id long, vector binary")


def links(placed: DataFrame, cosine: float) -> DataFrame:
    """(vec_id, n, hook): links of a cell's own vectors, and stars that connect what is linked.

    A cell's own vectors are compared with everything in the cell, in pairs of blocks.
    """
    sizes = placed.groupBy("label", "cell").agg(
        F.ceil(F.count_if("home") / BLOCK).cast("int").alias("_m"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_r"))
    rows = placed.join(sizes, ["label", "cell"])
    own, other = (F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.col(n)).cast("int") for n in ("_m", "_r"))
    left = rows.where("home").select("label", "cell", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("_r") - 1)).alias("j"),
                                     F.lit(True).alias("left"), "vec_id", "vector")
    right = rows.where("_m > 0").select("label", "cell", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("i"), other.alias("j"),
                                        F.lit(False).alias("left"), "vec_id", "vector")
    keys = ["label", "cell", "i", "j"]
    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(frames, keys):
            side = group["left"].to_numpy()
            if side.all() or not side.any():
                continue
            ids, vector = group["vec_id"].to_numpy(), np.stack([np.frombuffer(v, "<f8") for v in group["vector"]])
            ia, ib = np.flatnonzero(side), np.flatnonzero(~side)
            known, node = np.unique(ids, return_inverse=True)
            count, ends_a, ends_b = np.zeros(len(ia), np.int64), [], []
            for lo in range(0, len(ia), 256):
                some = ia[lo:lo + 256]
                on = (vector[some] @ vector[ib].T >= cosine) & (ids[some][:, None] != ids[ib][None, :])
                a, b = np.nonzero(on)
                count[lo:lo + 256] = np.bincount(a, minlength=len(some))
                ends_a.append(node[some[a]])
                ends_b.append(node[ib[b]])
            a, b = np.concatenate(ends_a), np.concatenate(ends_b)
            if not len(a):
                continue
            top = local_roots(len(known), a, b)
            hook = pd.Series(known[top], index=known)
            has = np.flatnonzero(count)
            yield pd.DataFrame({"vec_id": ids[ia[has]], "n": count[has], "hook": hook[ids[ia[has]]].to_numpy()})
            copies = np.setdiff1d(np.unique(b), np.unique(a))
            yield pd.DataFrame({"vec_id": known[copies], "n": 0, "hook": known[top[copies]]})

    return both.mapInPandas(run, "vec_id long, n long, hook long")


def metric_join(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vec_id.

    Vectors link where labels are equal and not null and their cosine, in doubles, is at least
    `cosine`. A vector that is null, empty, zero, or holds a null or non-finite number links with
    nothing, as does one without a label; vectors of unequal dimension do not link. Rows that
    share a vec_id are one vector, the first by label and values; rows without an id are one row,
    null, linked with nothing and kept. An empty table gives an empty one. Other columns are not read.
    """
    one = df.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<float>") if dict(df.dtypes)["embedding"] == "array<float>" else F.col("embedding").cast("array<double>"))
    one = one.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    rows = materialize(usable(one))
    found = links(cells(rows, pivots_of(rows, rows.count()), cosine), cosine)
    found = materialize(found)
    counted = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("hook").alias("b"))).withColumnRenamed("node", "vec_id")
    every = df.select(F.col("vec_id").cast("long")).distinct()
    out = every.join(counted, "vec_id", "left").join(roots, "vec_id", "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
