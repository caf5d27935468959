"""Mean pairwise cosine similarity of a channel's first titles, without forming pairs.

With unit TF-IDF vectors u_i, the sum over ordered pairs of u_i . u_j is the sum over
terms of (sum_i u_it)^2 minus the sum of the u_it^2. Everything after the choice of
the first titles stays on the channel_id partitioning, so there is one shuffle, and
it carries at most `window` titles per channel and map task. Terms are counted in the
tasks, from the titles of a channel side by side; no row is a term.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.constants import SIMILARITY_TERMS, SIMILARITY_TITLES
from channel_signals.functions import text as X
from channel_signals.operators.titles import clean


def first_titles(titles: DataFrame, n: int) -> DataFrame:
    """The first n titles of each channel by position."""
    order = Window.partitionBy("channel_id").orderBy("pos")
    return (
        titles.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")
    )


def avg_title_similarity(
    titles: DataFrame, window: int = SIMILARITY_TITLES, max_terms: int = SIMILARITY_TERMS,
) -> DataFrame:
    """(channel_id, avg_title_similarity), 0 below two titles or without any term.

    A channel is one row of its at most `window` titles, so its terms never become rows:
    they are counted, capped and weighed a batch of channels at a time.
    """
    return compared_titles(titles, window).select("channel_id", similarity_of(F.col("compared"), max_terms).alias("avg_title_similarity"))


def compared_titles(titles: DataFrame, window: int = SIMILARITY_TITLES) -> DataFrame:
    """(channel_id, compared): a channel's first titles that are not empty, in order."""
    order = Window.partitionBy("channel_id").orderBy("pos")
    top = clean(titles).withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= window)
    return top.groupBy("channel_id").agg(F.sort_array(F.collect_list(F.struct("_i", "title"))).alias("compared"))


def similarity_of(compared: Column, max_terms: int = SIMILARITY_TERMS) -> Column:
    """The similarity of the titles that `compared_titles` gives, 0 for none. A join after it
    would shuffle, as Spark forgets the partitioning behind a Python function."""
    @F.arrow_udf("double")
    def similarity(words: pa.Array) -> pa.Array:
        return pa.array(mean_similarities(words, max_terms), pa.float64())

    return similarity(F.transform(compared, lambda t: X.term_tokens(t["title"])))


def mean_similarities(words: pa.Array, max_terms: int) -> np.ndarray:
    """The mean similarity of each row of `words`, a list of titles that are lists of tokens."""
    n_rows = len(words)
    size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    titles = words.flatten()  # without those of null rows
    row = np.repeat(np.arange(n_rows), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    length = pc.list_value_length(titles).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = titles.flatten().dictionary_encode()
    if not len(coded):
        return np.zeros(n_rows)
    # by name, so that sums go in one order whatever the batch holds
    rank = np.argsort(pc.sort_indices(coded.dictionary).to_numpy())
    a = rank[coded.indices.to_numpy(zero_copy_only=False)]
    # a term is a token, or a token and the next one of its title plus one
    base, most = len(coded.dictionary) + 1, int(size.max())
    if n_rows > 1 and n_rows * base * base * most >= 1 << 63:
        half = n_rows // 2
        return np.concatenate([mean_similarities(x, max_terms) for x in (words.slice(0, half), words.slice(half))])
    at = np.repeat(np.arange(len(titles)), length)
    paired = np.flatnonzero(at[1:] == at[:-1])
    term = np.concatenate([a * base, a[paired] * base + a[paired + 1] + 1])
    at = np.concatenate([at, at[paired]])
    key, count = np.unique((row[at] * (base * base) + term) * most + place[at], return_counts=True)
    place, key = key % most, key // most
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
    row, term = key[first] // (base * base), key[first] % (base * base)
    total, df = np.add.reduceat(count, first), np.bincount(group)
    kept = np.ones(len(first), bool)
    for r in np.flatnonzero(np.bincount(row) > max_terms):
        mine = np.flatnonzero(row == r)
        # whole counts decide, only the terms of the last count go by name: a blank sorts below
        # all characters of a token, so terms rise as their numbers do
        last = -np.partition(-total[mine], max_terms - 1)[max_terms - 1]
        over, tied = mine[total[mine] > last], mine[total[mine] == last]
        kept[mine] = False
        kept[over] = True
        kept[tied[:max_terms - len(over)]] = True
    keep = kept[group]
    group, place, count = group[keep], place[keep], count[keep]
    idf = np.log((1.0 + size[row]) / (1.0 + df)) + 1.0
    weight, title = count * idf[group], row[group] * most + place
    norm = np.sqrt(np.bincount(title, weight * weight, n_rows * most))
    unit = weight / norm[title]
    s = np.bincount(group, unit, len(first))
    pairs = np.bincount(row, s * s - np.bincount(group, unit * unit, len(first)), n_rows)
    return np.where(size >= 2, pairs / np.maximum(size * (size - 1.0), 1.0), 0.0)
