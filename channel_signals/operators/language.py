"""Language identification by character n-gram profiles (Cavnar & Trenkle, 1994)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GRAM = 3
PROFILE_SIZE = 300
#: Characters that are counted at once, and rows that leave together.
PART_CHARS, PART_ROWS = 2_000_000, 100_000


def gram_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, n): the n-grams of 1..MAX_GRAM characters of the lower-cased letters and
    blanks of each row. Rows of a batch that share their key are counted together, so a gram
    leaves a batch once for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).dictionary_encode("encode")
            own = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for owner, gram, n in _counted(own, batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [keys.dictionary.take(pa.array(owner)), gram, pa.array(n)], names=[key, "gram", "n"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, _letters(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, gram string, n long")


def _letters(text: str) -> Column:
    return F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}]+", " ")


def _counted(own: np.ndarray, texts: pa.Array, whole: bool = False) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Owner, gram and count, sorted by both; `own` numbers the owners of the texts. Parts are
    of PART_ROWS, or of `whole` owners."""
    texts = pc.fill_null(texts, "")
    order = np.argsort(own, kind="stable")
    sizes = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False)[order])
    edges = np.flatnonzero(np.diff(own[order], prepend=-1))
    lo = 0
    while lo < len(order):
        # owners up to PART_CHARS together, one at least
        ends = np.append(edges[edges > lo], len(order))
        before = sizes[lo - 1] if lo else 0
        hi = int(ends[max(np.searchsorted(sizes[ends - 1], before + PART_CHARS, side="right") - 1, 0)])
        yield from _count_part(own[order[lo:hi]], texts.take(pa.array(order[lo:hi])), whole)
        lo = hi


def _count_part(own: np.ndarray, texts: pa.Array, whole: bool) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(chars):
        return
    # characters are numbered from 1 as they rank, 0 is no character
    used = np.flatnonzero(np.bincount(chars))
    rank = np.zeros(int(used[-1]) + 1, np.int64)
    rank[used] = np.arange(1, len(used) + 1)
    base, code, text = len(used) + 1, rank[chars], np.repeat(np.arange(len(size)), size)
    owners, owner = np.unique(own, return_inverse=True)
    span = base ** MAX_GRAM
    if len(owners) > 1 and len(owners) * span >= 1 << 63:
        # `own` is sorted: whole owners on both sides
        cut = int(np.searchsorted(own, owners[len(owners) // 2]))
        for part in (slice(0, cut), slice(cut, None)):
            yield from _count_part(own[part], texts.take(pa.array(np.arange(len(own))[part])), whole)
        return
    place = owner[text] * span
    found = []
    for n in range(1, MAX_GRAM + 1):
        k = max(len(code) - n + 1, 0)
        inside = text[:k] == text[n - 1:]
        gram = sum(code[i:i + k] * base ** (MAX_GRAM - 1 - i) for i in range(n))
        found.append((place[:k] + gram)[inside if n > 1 else chars != ord(" ")])
    key, count = np.unique(np.concatenate(found), return_counts=True)
    grams, which = np.unique(key % span, return_inverse=True)
    digits = [grams // base ** (MAX_GRAM - 1 - i) % base for i in range(MAX_GRAM)]
    letters = [""] + [chr(c) for c in used]
    spelled = pa.array(["".join(letters[d] for d in x) for x in zip(*(d.tolist() for d in digits))], pa.string())
    owner = owners[key // span]
    step = max(len(key) if whole else PART_ROWS, 1)
    for lo in range(0, len(key), step):
        part = slice(lo, lo + step)
        yield owner[part], spelled.take(pa.array(which[part])), count[part]


def _profile(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, gram, rank): the most frequent n-grams; counts combine before the shuffle
    and the ranking keeps only `size` rows per key and task."""
    counts = gram_counts(df, key, text).groupBy(key, "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
        .select(key, "gram", "rank")
    )


def _ranked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Like `_profile`, for keys of few rows: those of a key come to one task side by side, and
    no more than `size` grams a key leave it."""

    def top(owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the kept rows and their ranks; rows are sorted by owner, then by gram."""
        order = np.lexsort((-n, owner))
        _, first, many = np.unique(owner, return_index=True, return_counts=True)
        rank = np.arange(1, len(order) + 1) - np.repeat(first, many)
        return order[rank <= size], rank[rank <= size]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: pa.Array, grams: pa.Array, ranks: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([keys, grams, pa.array(ranks, pa.int32())], names=[key, "gram", "rank"])

        def closed() -> Iterator[pa.RecordBatch]:
            best = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:size]
            if best:
                yield out(pa.concat_arrays([last] * len(best)), pa.array([g for g, _ in best], pa.string()), np.arange(1, len(best) + 1))

        # the last key of a batch may go on in the next one
        last, sums = None, Counter()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode("encode")
            own = keys.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            names, texts = keys.dictionary, batch.column(1)
            ends = {own[-1]}
            if last is not None and names.slice(own[0], 1).equals(last):
                ends.add(own[0])
            elif last is not None:
                yield from closed()
                last, sums = None, Counter()
            for at in sorted(ends):
                mine = np.flatnonzero(own == at)
                if last is not None and at != own[0]:
                    yield from closed()
                    last, sums = None, Counter()
                last = names.slice(at, 1)
                for _, grams, n in _counted(own[mine], texts.take(pa.array(mine))):
                    sums.update(dict(zip(grams.to_pylist(), n.tolist())))
            rest = np.flatnonzero(~np.isin(own, list(ends)))
            for owner, grams, n in _counted(own[rest], texts.take(pa.array(rest)), whole=True):
                places, ranks = top(owner, n)
                yield out(names.take(pa.array(owner[places])), grams.take(pa.array(places)), ranks)
        if last is not None:
            yield from closed()

    kind = df.schema[key].dataType.simpleString()
    beside = df.select(key, _letters(text).alias("t")).repartition(key).sortWithinPartitions(key)
    return beside.mapInArrow(run, f"`{key}` {kind}, gram string, rank int")


def language_profiles(df: DataFrame, lang: str = "lang", text: str = "text",
                      size: int = PROFILE_SIZE) -> DataFrame:
    """(lang, gram, rank) from labelled text."""
    return _profile(df, lang, text, size)


def identify(df: DataFrame, profiles: DataFrame, key: str, text: str = "text",
             lang: str = "lang", size: int = PROFILE_SIZE) -> DataFrame:
    """(key, language): the profile with the least out-of-place distance. Texts without
    letters do not appear.

    `profiles` holds `size` rows per language, so it is broadcast. A gram that no profile
    knows costs every language the same and is left out of the comparison.
    """
    ranks = _ranked(df, key, text, size).withColumnRenamed("rank", "_r")
    known = profiles.groupBy("gram").agg(
        F.collect_list(F.struct(F.col(lang).alias("l"), F.col("rank").alias("p"))).alias("_known"))
    gain = F.lit(size) - F.abs(F.col("_r") - F.col("k.p"))
    # distance = sum over grams of |r - p|, or `size` where the profile lacks the gram:
    # minimizing it is maximizing the sum of size - |r - p| over the shared grams
    scored = (
        ranks.join(F.broadcast(known), "gram", "left")
        .select(key, F.col("_r"), F.explode_outer("_known").alias("k"))
        .groupBy(key, F.col("k.l").alias("language")).agg(F.sum(gain).alias("score"))
    )
    best = F.max(F.when(F.col("language").isNotNull(), F.struct(
        F.col("score"), F.col("language"))))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.language").alias("language"))
