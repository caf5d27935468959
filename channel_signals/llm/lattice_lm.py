"""Log probabilities of documents under a subword lattice, beside a smoothed word model.

The pieces and their first weights come from an existing vocabulary. A word, led by its
space, is a lattice: its probability is the sum over all segmentations into pieces, by a
forward recursion in log space. Expectation-maximisation over the distinct training words,
weighted with their counts, re-estimates the pieces; the vocabulary's own weights stay as
pseudo-counts. No piece crosses white space, so a document's marginal is the product over its
words and one end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import mix, prefix_hash, range_hash, text_chunks, words_of
from channel_signals.session import materialize

ROUNDS = 2
#: Pseudo-counts, in pieces, that the vocabulary's own weights are worth.
PRIOR = 20_000.0
#: Words of at least this share of all training tokens are looked up in the tasks: there are
#: at most 1 / FREQUENT of them, of 1 / FREQUENT mean token lengths in bytes together.
FREQUENT = 1 / 250_000
#: Lattice cells (words x positions x piece lengths) that are held at once.
CELLS = 1 << 20
#: Posteriors are counted in steps of this size, so that sums don't depend on their order.
STEP = 1 << 16
#: The end of a document among words, which are never empty.
END = b""
LN10 = np.log(10.0)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 17
#: Masks that keep the first so many bytes of a little-endian word.
_HEADS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def read_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """(pieces, weights that add up to one) of a sentencepiece vocabulary that can occur in
    lower-cased words; a leading space marks the start of a word.

    Scores of a unigram vocabulary are log probabilities. Whole-number scores are ranks, the
    order of merges, and weigh 1/rank. Single bytes are pieces too and close every gap; those
    that the vocabulary doesn't weigh get the least weight.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        piece, score = model.id_to_piece(i), model.get_score(i)
        raw = piece.replace("▁", " ").encode()
        if "▁" not in piece[1:] and not any(65 <= b <= 90 for b in raw):
            found[raw] = score
    pieces = sorted(found)
    scores = np.array([found[p] for p in pieces])
    if len(scores) and (scores == np.floor(scores)).all():
        weights = 1.0 / (2.0 - scores)
    else:
        weights = np.exp(scores)
    rest = [bytes([b]) for b in range(256) if bytes([b]) not in found and not (65 <= b <= 90 or 9 <= b <= 13)]
    pieces += rest
    weights = np.concatenate([weights, np.full(len(rest), weights.min(initial=1.0))])
    return pieces, weights / weights.sum()


class Lattice:
    """Forward and backward recursions over words with given piece log probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray):
        self.logp = np.append(logp, -np.inf)
        self.none = len(pieces)
        self.longest = max(map(len, pieces))
        self.by_length = {}
        for size in sorted({len(p) for p in pieces}):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == size])
            raw = np.frombuffer(b"".join(pieces[i] for i in ids), np.uint8).reshape(len(ids), size)
            h = np.zeros(len(raw), np.uint64)
            for j in range(size):
                h = h * _BASE + raw[:, j] + np.uint64(1)
            order = np.argsort(h)
            # most windows are no piece: a table over a few bits of the hash says so at once
            seen = np.zeros(1 << _BITS, bool)
            seen[self._few(h)] = True
            self.by_length[size] = h[order], ids[order], raw[order], seen

    @staticmethod
    def _few(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - _BITS)

    def edges(self, text: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """ids[t - lo - 1, size - 1, word]: the piece of `size` bytes that ends at position t
        in (lo, hi] of each column of `text`; `none` where there is none."""
        most = min(self.longest, hi)
        ids = np.full((hi - lo, most, text.shape[1]), self.none, np.int32)
        window = np.zeros((hi - lo, text.shape[1]), np.uint64)
        power = np.uint64(1)
        with np.errstate(over="ignore"):
            for size in range(1, most + 1):
                # windows that end at positions from `first` on have begun inside the text
                first = max(lo, size - 1)
                window = window[first - lo - (hi - lo - len(window)):] if first >= lo else window
                window = window + (text[first + 1 - size:hi + 1 - size] + np.uint64(1)) * power
                power = power * _BASE
                if size not in self.by_length:
                    continue
                h, own, raw, seen = self.by_length[size]
                t, word = np.nonzero(seen[self._few(window)])
                found = window[t, word]
                k = np.minimum(np.searchsorted(h, found), len(h) - 1)
                same = h[k] == found
                t, word, k = t[same] + first, word[same], k[same]
                # equal hashes are compared byte by byte
                same = np.ones(len(k), bool)
                for j in range(size):
                    same &= text[t + 1 - size + j, word] == raw[k, j]
                ids[t[same] - lo, size - 1, word[same]] = own[k[same]]
        return ids

    def forward(self, text: np.ndarray) -> np.ndarray:
        """alpha[t, word]: log probability of the first t bytes over all segmentations."""
        width, n = text.shape
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for lo, hi in self._blocks(n, width):
            self._forward(alpha, self.edges(text, lo, hi), lo)
        return alpha

    def _forward(self, alpha: np.ndarray, ids: np.ndarray, lo: int) -> None:
        weight = self.logp[ids]
        for i in range(len(ids)):
            size = min(lo + i + 1, ids.shape[1])
            alpha[lo + i + 1] = _log_sum(alpha[lo + i + 1 - size:lo + i + 1][::-1] + weight[i, :size])

    def counts(self, text: np.ndarray, length: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in words that occur `times` times, in STEPs."""
        width, n = text.shape
        blocks = self._blocks(n, width)
        alpha = np.full((width + 1, n), -np.inf)
        alpha[0] = 0.0
        for lo, hi in blocks:
            ids = self.edges(text, lo, hi)
            self._forward(alpha, ids, lo)
        whole = alpha[length, np.arange(n)]
        beta = np.full((width + 1, n), -np.inf)
        beta[length, np.arange(n)] = 0.0
        out = np.zeros(self.none, np.int64)
        for lo, hi in reversed(blocks):
            if len(blocks) > 1:
                ids = self.edges(text, lo, hi)
            weight = self.logp[ids]
            for t in range(hi, lo, -1):
                size = min(t, ids.shape[1])
                beta[t - size:t] = np.logaddexp(beta[t - size:t], (weight[t - lo - 1, :size] + beta[t])[::-1])
            t, k, word = np.nonzero(ids != self.none)
            own = ids[t, k, word]
            start, stop = lo + t - k, lo + t + 1
            post = np.exp(alpha[start, word] + self.logp[own] + beta[stop, word] - whole[word])
            np.add.at(out, own, np.rint(post * STEP).astype(np.int64) * times[word])
        return out

    def _blocks(self, n: int, width: int) -> list[tuple[int, int]]:
        step = max(1, CELLS // (n * min(self.longest, width)))
        return [(lo, min(width, lo + step)) for lo in range(0, width, step)]


def _log_sum(ways: np.ndarray) -> np.ndarray:
    top = ways.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(ways - safe).sum(axis=0))


def _padded(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the column, zero-padded bytes by position and word, lengths) of words of
    about one length, each led by a space; the end, which is no word, is left out."""
    for lo, _, data, at in text_chunks(column):
        size = np.diff(at)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        done = 0
        while done < len(order):
            width = int(size[order[done]]) * 5 // 4 + 2
            most = max(1, CELLS // (16 * width))
            end = min(done + most, int(np.searchsorted(size[order], width - 1, side="right")))
            own = order[done:end]
            length = size[own]
            text = np.zeros((int(length.max()) + 1, len(own)), np.uint8)
            text[0] = 32
            row = np.repeat(np.arange(len(own)), length)
            place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
            text[place + 1, row] = data[at[own][row] + place]
            yield lo + own, text, length + 1
            done = end


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words that stand for every byte range: its first eight bytes, and its length or,
    where it is longer, a hash of all of it. Short ranges are told apart exactly."""
    size = end - start
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    head = np.lib.stride_tricks.sliding_window_view(padded, 8)[start].reshape(-1, 8).view("<u8").ravel()
    head = head & _HEADS[np.minimum(size, 8)]
    rest = size.astype(np.uint64)
    long = np.flatnonzero(size > 8)
    if len(long):
        rest[long] = range_hash(prefix_hash(data), start[long], end[long]) | np.uint64(1 << 63)
    return head, rest


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of runs in it) that bring equal rows of the keys together. Rows whose
    mixed keys collide may fall into several runs, but never share one."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        mixed = mix(mixed * _BASE + k.astype(np.uint64))
    order = np.argsort(mixed)
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for k in keys:
        own = k[order]
        fresh[1:] |= own[1:] != own[:-1]
    return order, np.flatnonzero(fresh)


def _binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte ranges as one Arrow column, copied in one go."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [
        None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[take])])


def _prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, text): the split by the id's decimal digits; no id counts as none."""
    doc = F.col("doc_id").cast("long")
    digits = F.coalesce(doc.cast("string"), F.lit(""))
    return docs.select(doc.alias("doc_id"), (F.crc32(digits.cast("binary")) % 10 == 0).alias("held_out"),
                       F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): every distinct word of all documents and the end, with its training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            train = ~np.array(batch.column(0).to_pylist(), bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array([END], pa.binary()), pa.array([int(train.sum())], pa.int64())], names=["word", "n"])
            for lo, hi, data, offsets in text_chunks(batch.column(1)):
                data = _lowered(data)
                start, end, row = words_of(data, offsets)
                if not len(start):
                    continue
                order, first = _groups([*_hashes(data, start, end)])
                n = np.add.reduceat(train[lo + row[order]].astype(np.int64), first)
                own = order[first]
                yield pa.RecordBatch.from_arrays(
                    [_binary(data, start[own], end[own]), pa.array(n)], names=["word", "n"])

    seen = docs.select("held_out", "text").mapInArrow(run, "word binary, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n"))


def fit_pieces(words: DataFrame, pieces: list[bytes], weights: np.ndarray, rounds: int = ROUNDS,
               prior: float = PRIOR) -> tuple[np.ndarray, float]:
    """(log probabilities of the pieces, of the end) by expectation-maximisation over the
    training counts of `words`. The driver sees one number a piece in each round."""
    sc = words.sparkSession.sparkContext
    known = words.where("n > 0")
    ends = known.where(F.col("word") == F.lit(END)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = known.where(F.col("word") != F.lit(END))
    own = prior * weights
    shares, end = own / (prior + 1.0), 1.0 / (prior + 1.0)
    for _ in range(rounds):
        model = sc.broadcast((pieces, np.log(shares)))

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*model.value)
            total = np.zeros(lattice.none, np.int64)
            for batch in frames:
                times = batch.column(1).to_numpy()
                for own, text, length in _padded(batch.column(0)):
                    total += lattice.counts(text, length, times[own])
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

        uses = known.mapInArrow(run, "piece long, uses long").groupBy("piece").agg(
            F.sum(F.col("uses").cast("decimal(38,0)")).alias("uses")).collect()
        count = np.zeros(len(pieces))
        for r in uses:
            count[r["piece"]] = float(r["uses"]) / STEP
        whole = count.sum() + ends + prior + 1.0
        shares, end = (count + own) / whole, (ends + 1.0) / whole
        model.unpersist()
    return np.log(shares), float(np.log(end))


def lattice_scores(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32 of the decimal id leaves 0 modulo 10 are held out, all others teach
    both models. Null text is empty and has the end alone; a null id is read as no digits; rows
    that repeat count each time and score alike; without training documents every token has the
    vocabulary's own weights. Only `doc_id` and `text` are read, so other columns never clash.

    Frequent words are few by their definition and are looked up where the text is read; the
    others meet their word's row in one shuffle, each with at most a FREQUENT share of all
    tokens. A text of any length is read whole; a word of any length is one lattice, whose
    edges are held block by block. Rows are told apart by their place, so `docs` should be a stored
    table or a checkpoint, which a lost task reads again in the same order.
    """
    docs = _prepared(docs)
    sc = docs.sparkSession.sparkContext
    words = materialize(word_counts(docs))
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    pieces, weights = read_vocabulary(vocabulary)
    logp, end_logp = fit_pieces(words, pieces, weights, rounds)
    model = sc.broadcast((pieces, logp))
    rest = total + 0.1 * (kinds + 1)

    def weigh(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*model.value)
        for batch in frames:
            score = np.full(batch.num_rows, end_logp)
            for own, text, length in _padded(batch.column(0)):
                score[own] = lattice.forward(text)[length, np.arange(len(own))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score / LN10)], names=["word", "n", "lattice"])

    frequent = F.col("n") >= F.lit(max(1.0, total * FREQUENT))
    columns = "word binary, n long, lattice double"
    common = words.where(frequent & (F.col("word") != F.lit(END))).mapInArrow(weigh, columns).collect()
    table = sc.broadcast(_lookup(common, rest))
    ends = words.where(F.col("word") == F.lit(END)).first()
    end_n = ends["n"] if ends else 0
    end = (int(end_n > 0), float(np.log10((end_n + 0.1) / rest)), end_logp / LN10)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for lo, hi, data, offsets in text_chunks(batch.column(3)):
                yield _looked_up(batch.slice(lo, hi - lo), _lowered(data), offsets, table.value, end)

    # one row a document carries what its frequent words gave, beside its first rare word;
    # documents without one get a key that no word equals
    parts = "id long, word binary, n long, head struct<doc_id:long,held_out:boolean,n_tokens:long,known:long,base:double,lattice:double>"
    seen = docs.select(F.monotonically_increasing_id().alias("id"), "doc_id", "held_out", "text").mapInArrow(run, parts)
    rare = words.where(~frequent).mapInArrow(weigh, columns).select("word", F.col("n").alias("c"), "lattice")
    base = F.log10((F.col("c") + 0.1) / F.lit(rest))
    met = seen.join(rare, "word", "left").groupBy("id").agg(
        F.max("head").alias("h"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.coalesce(F.sum(F.col("n") * base), F.lit(0.0)).alias("base"),
        F.coalesce(F.sum(F.col("n") * F.col("lattice")), F.lit(0.0)).alias("lattice"))
    return met.select(
        "h.doc_id", "h.held_out", "h.n_tokens", (F.col("h.known") + F.col("known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("h.base") + F.col("base")).alias("base_score"),
        (F.col("h.lattice") + F.col("lattice")).alias("score"))


def _lookup(rows: list, rest: float) -> tuple[np.ndarray, ...]:
    """Mixed key, both words of `_hashes`, base and lattice log10 of the frequent words."""
    data = np.frombuffer(b"".join(bytes(r["word"]) for r in rows), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r["word"]) for r in rows])]).astype(np.int64)
    head, tail = _hashes(data, at[:-1], at[1:])
    n = np.array([r["n"] for r in rows], float)
    lattice = np.array([r["lattice"] for r in rows], float)
    key = mix(head * _BASE + tail)
    order = np.argsort(key)
    return key[order], head[order], tail[order], np.log10((n + 0.1) / rest)[order], lattice[order]


def _looked_up(batch: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, table: tuple, end: tuple) -> pa.RecordBatch:
    """Rows (id, word, n, head) of some documents."""
    rows = batch.num_rows
    start, stop, row = words_of(data, offsets)
    one, two = _hashes(data, start, stop)
    n_tokens = np.bincount(row, minlength=rows) + 1
    known = np.full(rows, end[0])
    base, lattice = np.full(rows, end[1]), np.full(rows, end[2])
    left = np.ones(len(start), bool)
    if len(table[0]) and len(start):
        k = np.minimum(np.searchsorted(table[0], mix(one * _BASE + two)), len(table[0]) - 1)
        left = (table[1][k] != one) | (table[2][k] != two)
        hit, k = row[~left], k[~left]
        known = known + np.bincount(hit, minlength=rows)
        base += np.bincount(hit, table[3][k], rows)
        lattice += np.bincount(hit, table[4][k], rows)
    start, stop, row = start[left], stop[left], row[left]
    order, first = _groups([one[left], two[left], row])
    n = np.diff(np.append(first, len(order)))
    own = order[first]
    start, stop, row = start[own], stop[own], row[own]
    lead = np.full(rows, -1)
    lead[row[::-1]] = np.arange(len(row))[::-1]
    heads = np.zeros(len(row), bool)
    heads[lead[lead >= 0]] = True
    alone = np.flatnonzero(lead < 0)
    ids = np.array(batch.column(0))
    keys = b"".join(b" %020d" % i for i in ids[alone])
    at = len(data) + 21 * np.arange(len(alone))
    data = np.concatenate([data, np.frombuffer(keys, np.uint8)])
    of = np.concatenate([row, alone]).astype(np.int64)
    with_head = np.concatenate([heads, np.ones(len(alone), bool)])
    head = pa.StructArray.from_arrays(
        [batch.column(1).take(pa.array(of)), batch.column(2).take(pa.array(of)),
         *[pa.array(x[of]) for x in (n_tokens, known.astype(np.int64), base, lattice)]],
        names=["doc_id", "held_out", "n_tokens", "known", "base", "lattice"], mask=pa.array(~with_head))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[of]), _binary(data, np.concatenate([start, at]), np.concatenate([stop, at + 21])),
         pa.array(np.concatenate([n, np.zeros(len(alone), np.int64)])), head],
        names=["id", "word", "n", "head"])

