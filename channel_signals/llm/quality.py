"""Quality by weak labels: labelling functions, expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import carried, mix, prefix_hash, range_hash, sampled, text_chunks, words_of

#: Documents, drawn by hash, on whose posterior labels the scorer is fitted.
FIT_ROWS = 5000
#: Buckets of the hashed features.
BUCKETS = 2048
KEEP_AT = 0.5
#: Votes: "g" good, "b" bad, "-" no opinion. One letter for each labeller, in this order.
LABELLERS = ("symbol_bytes", "symbol_endings", "capitals", "capital_words", "bangs", "bars",
             "repeated_word", "distinct_words", "repeated_lines", "plain_words")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"%$&#*|<>{}~^\\")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_CLASS = np.full(256, 3, np.uint64)
_CLASS[97:123] = _CLASS[128:] = 0
_CLASS[65:91], _CLASS[48:58] = 1, 2


def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


class _Chunk:
    """Words of a chunk of texts with their hashes, and where each row's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1
        self.start, self.end, self.row = words_of(data, offsets)
        self.hash = range_hash(prefix_hash(data), self.start, self.end)
        self.cuts = np.searchsorted(self.row, np.arange(self.n + 1))
        self.same = np.zeros(len(self.hash), bool)
        self.same[1:] = (self.hash[1:] == self.hash[:-1]) & (self.row[1:] == self.row[:-1])

    def distinct(self, values: np.ndarray, rows: np.ndarray) -> np.ndarray:
        key = np.unique((rows.astype(np.uint64) << np.uint64(40)) | (values >> np.uint64(24)))
        return np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=self.n)

    def votes(self) -> list[str]:
        data, offsets = self.data, self.offsets
        words = np.maximum(np.diff(self.cuts), 1)
        bytes_ = np.maximum(np.diff(offsets), 1)
        upper = _UPPER[data]
        letters = np.maximum(_sums(_LETTER[data], offsets), 1)
        last = data[self.end - 1] if len(self.end) else np.zeros(0, np.uint8)
        ends_symbol = _SYMBOL[last]
        bang = (last == 33) & (self.end - self.start >= 2) if len(self.end) else np.zeros(0, bool)
        if len(self.end):
            bang &= data[np.maximum(self.end - 2, 0)] == 33
        bar = (last == 124) & (self.end - self.start == 1) if len(self.end) else np.zeros(0, bool)
        ups = np.zeros(len(data) + 1, np.int64)
        np.cumsum(upper, out=ups[1:])
        shout = (ups[self.end] - ups[self.start] >= 2) if len(self.end) else np.zeros(0, bool)
        plain = ~(ends_symbol | bang | shout | self.same)
        line_end = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets[1:]]))
        line_start = np.concatenate([[0], line_end[:-1]])
        line_row = np.searchsorted(offsets, line_start, side="right") - 1
        line_row = np.minimum(line_row, self.n - 1)
        head = prefix_hash(data)
        skip = (line_start < len(data)) & (data[np.minimum(line_start, max(len(data) - 1, 0))] == 10) if len(data) else np.zeros(len(line_start), bool)
        lines = np.maximum(np.bincount(line_row, minlength=self.n), 1)
        line_kinds = self.distinct(range_hash(head, np.minimum(line_start + skip, line_end), line_end), line_row)

        def share(flags: np.ndarray) -> np.ndarray:
            return _sums(flags, self.cuts) / words

        symbols = _sums(_SYMBOL[data], offsets) / bytes_
        caps = _sums(upper, offsets) / letters
        kinds = self.distinct(self.hash, self.row) / words
        n_words = np.diff(self.cuts)
        few = n_words < 20
        rules = [
            (symbols > 0.03, symbols < 0.01),
            (share(ends_symbol) > 0.2, share(ends_symbol) < 0.05),
            (caps > 0.5, caps < 0.2),
            (share(shout) > 0.5, share(shout) < 0.2),
            (share(bang) > 0.2, share(bang) < 0.05),
            (share(bar) > 0.1, share(bar) < 0.03),
            (share(self.same) > 0.3, share(self.same) < 0.1),
            ((kinds < 0.3) & (n_words < 3000) & ~few, kinds > 0.5),
            ((line_kinds / lines < 0.5) & (lines >= 4), line_kinds / lines > 0.8),
            ((share(plain) < 0.5) & ~few, share(plain) > 0.8),
        ]
        code = np.full((self.n, len(rules)), ord("-"), np.uint8)
        for j, (bad, good) in enumerate(rules):
            code[good, j] = ord("g")
            code[bad, j] = ord("b")
        code[n_words == 0] = ord("-")
        return [row.tobytes().decode() for row in code]

    def features(self) -> np.ndarray:
        """Three hashed features a word: shape and ending, shape of the pair, repetition."""
        if not len(self.start):
            return np.zeros((3, 0), np.int64)
        tail = np.zeros(len(self.end), np.uint64)
        for back in (1, 2, 3):
            at = np.maximum(self.end - back, self.start)
            tail = tail * np.uint64(256) + self.data[at].astype(np.uint64)
        shape = np.zeros(len(self.end), np.uint64)
        for at in (self.start, np.minimum(self.start + 1, self.end - 1), np.maximum(self.end - 2, self.start), self.end - 1):
            shape = shape * np.uint64(4) + _CLASS[self.data[at]]
        shape = shape * np.uint64(2) + self.same.astype(np.uint64)
        before = np.concatenate([shape[:1], shape[:-1]])
        before[self.cuts[:-1][self.cuts[:-1] < len(before)]] = 0
        keys = (tail * np.uint64(3), (shape * np.uint64(512) + before) * np.uint64(3) + np.uint64(1), shape * np.uint64(3) + np.uint64(2))
        return np.stack([(mix(k) % np.uint64(BUCKETS)).astype(np.int64) for k in keys])


def voted(docs: DataFrame) -> DataFrame:
    """(votes) of each document: one letter for each labeller; wordless texts get none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[str] = []
            for _, _, data, offsets in text_chunks(batch.column(0)):
                out += _Chunk(data, offsets).votes()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["votes"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "votes string")


@dataclass
class LabelModel:
    """P(good), and for each labeller the logs of P(vote | class), over "b", "-", "g"."""

    prior: float
    log_vote: np.ndarray

    def posterior(self, votes: list[str]) -> np.ndarray:
        code = _codes(votes)
        both = np.log([1 - self.prior, self.prior])[None, :] + sum(
            self.log_vote[j][:, code[:, j]].T for j in range(code.shape[1]))
        p = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
        return np.where((code == 1).all(axis=1), self.prior, p)


def _codes(votes: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(votes).encode(), np.uint8).reshape(len(votes), -1)
    return np.select([raw == ord("b"), raw == ord("g")], [0, 2], 1)


def expectation_maximisation(votes: list[str], counts: list[int], rounds: int = 100) -> LabelModel:
    """Class share and vote rates of every labeller, from the counts of vote patterns.

    A pattern with a bad vote begins as mostly bad. Rates are smoothed by one vote, and
    kept so that no labeller is better informed by a wrong vote than by a right one.
    """
    code, weight = _codes(votes), np.array(counts, float)
    good = np.where((code == 0).any(axis=1), 0.1, 0.9)
    model = LabelModel(0.5, np.zeros((code.shape[1], 2, 3)))
    for _ in range(rounds):
        before = good
        share = np.stack([weight * (1 - good), weight * good])
        prior = float(np.clip(share[1].sum() / max(weight.sum(), 1), 0.01, 0.99))
        rates = np.empty((code.shape[1], 2, 3))
        for j in range(code.shape[1]):
            for c in (0, 1):
                rates[j, c] = np.bincount(code[:, j], share[c], 3) + 1
            rates[j] /= rates[j].sum(axis=1, keepdims=True)
        model = LabelModel(prior, np.log(rates))
        good = model.posterior(votes)
        if np.abs(good - before).max() < 1e-9:
            break
    return model


def label_model(docs: DataFrame) -> LabelModel:
    """Fitted on the vote patterns of all documents; there are at most 3 ** labellers of them."""
    rows = voted(docs).groupBy("votes").count().orderBy("votes").collect()
    if not rows:
        return LabelModel(0.5, np.log(np.full((len(LABELLERS), 2, 3), 1 / 3)))
    return expectation_maximisation([r["votes"] for r in rows], [r["count"] for r in rows])


def fit_scorer(docs: DataFrame, model: LabelModel, rows: int = FIT_ROWS, steps: int = 300) -> np.ndarray:
    """Weights of the buckets and the bias, by logistic regression on posterior labels.

    The labelled rows are a sample by hash of about `rows` documents; both classes weigh alike.
    """
    sample = sampled(docs.select("doc_id", F.col("text").cast("string")), rows, "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, share, good = [], [], []
            for _, _, data, offsets in text_chunks(batch.column(0)):
                chunk = _Chunk(data, offsets)
                good += model.posterior(chunk.votes()).tolist() if chunk.n else []
                f = chunk.features()
                for lo, hi in zip(chunk.cuts[:-1], chunk.cuts[1:]):
                    i, n = np.unique(f[:, lo:hi], return_counts=True)
                    at.append(i.astype("<i2").tobytes())
                    share.append((n / max(hi - lo, 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.binary()), pa.array(share, pa.binary()), pa.array(good, pa.float64())],
                names=["at", "share", "good"])

    got = sample.mapInArrow(run, "at binary, share binary, good double").toPandas()
    weight = np.zeros(BUCKETS + 1)
    if not len(got):
        return weight
    at = [np.frombuffer(x, "<i2").astype(np.int64) for x in got["at"]]
    cols = np.concatenate(at)
    rows_ = np.repeat(np.arange(len(at)), [len(a) for a in at])
    value = np.concatenate([np.frombuffer(x, "<f4") for x in got["share"]]).astype(float)
    good = got["good"].to_numpy()
    balance = np.where(good >= 0.5, 0.5 / max((good >= 0.5).sum(), 1), 0.5 / max((good < 0.5).sum(), 1))
    first = np.zeros(BUCKETS + 1)
    second = np.zeros(BUCKETS + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows_, value * weight[cols], len(at)) + weight[-1]
        error = (1 / (1 + np.exp(-z)) - good) * balance
        slope = np.append(np.bincount(cols, value * error[rows_], BUCKETS), error.sum()) + 1e-5 * weight
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        weight -= 0.3 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    return weight


def quality(docs: DataFrame, fit_rows: int = FIT_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """`docs` with votes, posterior (of the label model), score (of the scorer) and kept.

    kept is score >= keep_at; the score is what the linear scorer gives the whole text.
    Null, empty and wordless texts have no votes, the prior as posterior, score 0 and are
    not kept. Equal texts score alike; rows without an id or repeated are scored as any other; an empty table
    gives an empty one. Columns of `docs` under the new names are replaced.
    """
    new = ["votes", "posterior", "score", "kept"]
    model = label_model(docs)
    weight = fit_scorer(docs, model, fit_rows)

    @F.pandas_udf("votes string, posterior double, score double")
    def judge(text):
        import pandas as pd

        votes: list[str] = []
        scores: list[np.ndarray] = []
        for _, _, data, offsets in text_chunks(pa.array(text, pa.string(), from_pandas=True)):
            chunk = _Chunk(data, offsets)
            votes += chunk.votes()
            n = np.diff(chunk.cuts)
            each = np.zeros(len(chunk.start) + 1)
            np.cumsum(weight[chunk.features()].sum(axis=0), out=each[1:])
            z = (each[chunk.cuts[1:]] - each[chunk.cuts[:-1]]) / np.maximum(n, 1) + weight[-1]
            scores.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(z, -500, 500))), 0.0))
        return pd.DataFrame({"votes": votes, "posterior": model.posterior(votes) if votes else [],
                             "score": np.concatenate(scores) if scores else []})

    return docs.select(carried(docs, new), judge(F.col("text").cast("string")).alias("judged")).select(
        "row.*", "judged.votes", "judged.posterior", "judged.score", (F.col("judged.score") >= keep_at).alias("kept"))
