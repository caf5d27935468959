"""Mixing sources to target weights by counting lengths and fitting a subset sum."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import carried, ranked
from channel_signals.session import materialize

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Words that the dynamic programme fits exactly; larger remainders shrink greedily first.
EXACT_WORDS = 4096
SEED = 17


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_REPEATS) -> list[float]:
    """Shares of the summed sizes by weight, none above `most` times its own size.

    What a capped source can't take is shared among the others by weight, until none is above.
    """
    total, target = float(sum(s for _, s in sizes)), [0.0] * len(sizes)
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    open_, left = set(range(len(sizes))), total
    while open_:
        whole = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] / whole > most * sizes[i][1]]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / whole
            break
        for i in over:
            target[i] = float(most * sizes[i][1])
            open_.discard(i)
        left = total - sum(target)
    return target


def subset_sum(lengths: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Length -> number used, within the counts, for the largest sum not above `budget`.

    Bounded knapsack over bit sets: each length is split into powers of two of its count,
    the sums reachable after every part are kept, and the parts are read back from the end.
    """
    full = (1 << (budget + 1)) - 1
    reach, states, parts = 1, [], []
    for length, count in zip(lengths, counts):
        left, k = min(count, budget // length if length else 0), 1
        while left > 0:
            k = min(k, left)
            states.append(reach)
            parts.append((length, k))
            reach |= (reach << (length * k)) & full
            left, k = left - k, k * 2
    at, used = reach.bit_length() - 1, {}
    for before, (length, k) in zip(reversed(states), reversed(parts)):
        if not (before >> at) & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> tuple[int, np.ndarray]:
    """(whole repeats of every document, further documents by length) for `budget` words."""
    size = int((lengths * counts).sum())
    if not size or budget <= 0:
        return 0, np.zeros(len(lengths), np.int64)
    times, rest = divmod(budget, size)
    if times >= MOST_REPEATS:
        return MOST_REPEATS, np.zeros(len(lengths), np.int64)
    extra = np.array([int(c) * rest // size for c in counts], np.int64)
    rest -= int((lengths * extra).sum())
    order = list(range(len(lengths)))
    random.Random(seed).shuffle(order)
    for margin in (EXACT_WORDS // 2, 0):
        for i in order:
            if lengths[i] and rest > EXACT_WORDS:
                k = min(int(counts[i] - extra[i]), max(0, rest - margin) // int(lengths[i]))
                extra[i] += k
                rest -= k * int(lengths[i])
    if rest > EXACT_WORDS:
        for i in sorted(order, key=lambda i: -lengths[i]):
            if lengths[i]:
                k = min(int(counts[i] - extra[i]), rest // int(lengths[i]))
                extra[i] += k
                rest -= k * int(lengths[i])
    fine = [i for i in range(len(lengths)) if 0 < lengths[i] <= rest and counts[i] > extra[i]]
    at = {int(lengths[i]): i for i in fine}
    bound = min(rest, EXACT_WORDS)
    for length, k in subset_sum([int(lengths[i]) for i in fine],
                                [int(counts[i] - extra[i]) for i in fine], bound).items():
        extra[at[length]] += k
    return int(times), extra


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = SEED) -> DataFrame:
    """`docs` with size, source_size, target, copies and taken (words taken, repeats counted).

    Documents are counted by source and exact length; each source's counts are fitted to its
    target in a task of its own; then documents are chosen by a seeded rank in their length.
    Null text has size 0, null is a source of its own and comes last, rows without an id
    rank like others, repeated rows are documents of their own, an empty table stays empty.
    The table of sources and their sizes is the mix's configuration and goes to the driver.
    Columns of `docs` under the new names are replaced.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    base = docs.select(
        carried(docs, new), "doc_id", n_words(F.col("text").cast("string")).alias("size"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_s"), F.col("source").isNull().alias("_n"))
    lengths = materialize(base.groupBy("_s", "_n", "size").agg(F.count(F.lit(1)).alias("n")))
    sizes = lengths.groupBy("_s", "_n").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.max("n").alias("most")).collect()
    sizes = sorted(sizes, key=lambda r: (r["_n"], r["_s"]))
    goal = targets([(r["_s"], r["total"]) for r in sizes], weights)
    spark = docs.sparkSession
    goals = spark.createDataFrame(
        [(r["_s"], r["_n"], int(r["total"]), float(t)) for r, t in zip(sizes, goal)],
        "_s string, _n boolean, source_size long, target double")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        times, extra = fit_counts(group["size"].to_numpy(), group["n"].to_numpy(), round(float(group["target"].iloc[0])), seed)
        return group.assign(times=times, extra=extra)

    # the sources' table is as small as the list collected above
    plans = lengths.join(F.broadcast(goals), ["_s", "_n"]).groupBy("_s", "_n").applyInPandas(
        plan, "_s string, _n boolean, size long, n long, source_size long, target double, times long, extra long")
    out = ranked(base, ["_s", "_n", "size"], [F.col("doc_id")], max((r["most"] for r in sizes), default=0), "_rank")
    out = out.join(plans.drop("n"), ["_s", "_n", "size"])
    copies = F.col("times") + (F.col("_rank") < F.col("extra")).cast("long")
    return out.withColumn("copies", copies).select(
        "row.*", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
