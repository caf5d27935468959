"""Removing repeated passages: merged Burrows-Wheeler transforms of the places that may repeat.

1. Anchors. A string of LENGTH bytes holds LENGTH - GRAM + 1 grams; wherever it occurs, its gram
   of least hash is the same and stands at the same offset. Such grams are the anchors of a text.
   A string can repeat only where its anchor's gram repeats, so all other places drop out.
2. Contexts. What surrounds an anchor within reach of a string is its context. Equal contexts
   repeat whole. The others of a gram go on, one of each.
3. Merge. Each context is a shard whose transform lists, column by column from the right, the
   symbol before its suffix. The interleave of all shards of a gram is refined one symbol at a
   time, by a stable partition of the interleave by the symbols it reads; no suffixes are sorted
   again. The common prefix of neighbours is one more than the least between them before the
   step, and suffixes with a neighbour of LENGTH common bytes form the repeated intervals.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import mix, prefix_hash, range_hash, text_chunks
from channel_signals.session import materialize

LENGTH = 200
GRAM = 80
#: Contexts merged at once, and those of one gram above which their strings are counted instead.
MERGE_ROWS, MERGE_MOST = 16_384, 65_536
#: What is known of an anchor: its context repeats; alone; repeats and stands for its equals.
WHOLE, ALONE, CHOSEN = 0, 1, 2


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    k, out = 1, x
    while k * 2 <= width:
        out = best(out[:-k], out[k:])
        k *= 2
    n = len(x) - width + 1
    return best(out[:n], out[width - k:width - k + n]) if k < width else out


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in a chunk of the grams that are least in some string, and the grams' hashes."""
    window = length - gram + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(len(data) - gram + 1)
    h = range_hash(prefix_hash(data), at, at + gram) | np.uint64(1)
    least = _slide(h, window, np.minimum)
    for end in offsets[1:-1]:  # strings do not cross documents
        least[max(0, end - length + 1):end] = 0
    edge = np.zeros(window - 1, np.uint64)
    is_least = _slide(np.concatenate([edge, least, edge]), window, np.maximum) == h
    found = np.flatnonzero(is_least)
    return found, h[found]


def contexts(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(lo, pos - (length - gram)), np.minimum(hi, pos + length)


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, c, th, pos, more): gram hash, context hash, text and place; equal texts of a batch once.

    Contexts that a text holds several times, as a repeated word does, are one row: `more` has
    their other places as 32-bit integers, else it is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            texts = batch.column(1).take(pa.array(first))
            for lo, _, data, offsets in text_chunks(texts):
                pos, h = anchors_of(data, offsets, length, gram)
                if not len(pos):
                    continue
                row = np.searchsorted(offsets, pos, side="right") - 1
                start, end = contexts(pos, offsets[row], offsets[row + 1], length, gram)
                c = range_hash(prefix_hash(data), start, end) ^ mix((pos - start + 1).astype(np.uint64))
                place = (pos - offsets[row]).astype("<i4")
                same = mix(h ^ mix(c ^ mix(row.astype(np.uint64))))
                order = np.argsort(same, kind="stable")
                begin = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
                end = np.append(begin[1:], len(order))
                one = order[begin]
                more = [None] * len(one)
                for i in np.flatnonzero(end - begin > 1):
                    more[i] = place[order[begin[i] + 1:end[i]]].tobytes()
                yield pa.RecordBatch.from_arrays([
                    pa.array(h[one].view(np.int64)), pa.array(c[one].view(np.int64)), pa.array(keys[lo + row[one]]),
                    pa.array(place[one]), pa.array(more, pa.binary())], names=["h", "c", "th", "pos", "more"])

    return docs.select("th", "text").mapInArrow(run, "h long, c long, th long, pos int, more binary")


def judged(rows: DataFrame) -> DataFrame:
    """(th, code) of the anchors whose gram occurs again; code is 4 * pos + what is known."""

    def flush(h, c, th, pos, many):
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        group, run_ = np.cumsum(new_h) - 1, np.cumsum(new_c) - 1
        same = np.bincount(run_, 1 + many).astype(np.int64)[run_]
        kinds = np.bincount(group[new_c])[group]
        code = np.where(same > 1, WHOLE, ALONE)
        code[(same > 1) & new_c & (kinds > 1)] = CHOSEN
        # representatives serve only those that are alone in their context
        lonely = np.bincount(group, same == 1)[group] > 0
        code[(code == CHOSEN) & ~lonely] = WHOLE
        keep = (same > 1) | (kinds > 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(th[keep]), pa.array(pos[keep].astype(np.int64) * 4 + code[keep])], names=["th", "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            more = batch.column(4)
            many = more.is_valid().to_numpy(zero_copy_only=False)
            held.append([batch.column(i).to_numpy() for i in range(4)] + [many])
            if many.any():  # these repeat, whatever else is known of the gram
                at = np.flatnonzero(many)
                places = [np.frombuffer(more[int(i)].as_py(), "<i4").astype(np.int64) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(held[-1][2][at], [len(p) for p in places])),
                     pa.array(np.concatenate(places) * 4 + WHOLE)], names=["th", "code"])
            h = held[-1][0]
            cut = int(np.searchsorted(h, h[-1])) if h[0] <= h[-1] else 0
            if cut or (len(held) > 1 and held[-2][0][-1] != h[0]):
                parts = [np.concatenate([x[i] for x in held[:-1]] + [held[-1][i][:cut]]) for i in range(5)]
                if len(parts[0]):
                    yield flush(*parts)
                held = [[x[cut:] for x in held[-1]]]
        if held:
            yield flush(*[np.concatenate([x[i] for x in held]) for i in range(5)])

    return rows.repartition("h").sortWithinPartitions("h", "c").mapInArrow(run, "th long, code long")


def context_rows(docs: DataFrame, known: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, th, pos, want, before, bytes) of the anchors that are alone or chosen, once per text."""
    todo = known.select("th", F.filter("codes", lambda c: c % 4 != WHOLE).alias("codes")).where(F.size("codes") > 0)
    joined = docs.select("th", "text").join(todo, "th")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            out = []
            for th, text, codes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if th in done:
                    continue
                done = {th} if len(done) > 1000 else done | {th}
                raw = text.as_py().encode()
                code = np.array(codes.values)
                pos = code >> 2
                data = np.frombuffer(raw, np.uint8)
                h = range_hash(prefix_hash(data), pos, pos + gram).view(np.int64)
                start, end = contexts(pos, 0, len(raw), length, gram)
                out += [(g, th, p, k, p - s, raw[s:e]) for g, p, k, s, e in zip(
                    h.tolist(), pos.tolist(), (code % 4 == ALONE).tolist(), start.tolist(), end.tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()))],
                    names=["h", "th", "pos", "want", "before", "bytes"])

    return joined.mapInArrow(run, "h long, th long, pos long, want boolean, before int, bytes binary")


def merged(group: np.ndarray, before: np.ndarray, texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last column (a string's start; the anchor is at length - gram) that repeats, -1 if none.

    `group` is sorted; only contexts of one group meet. Ends of documents match nothing.
    """
    ahead = length - gram
    n, width = len(texts), ahead + length
    symbol = np.full((width, n), 256, np.int64)
    for i, (b, t) in enumerate(zip(before, texts)):
        symbol[ahead - b:ahead - b + len(t), i] = np.frombuffer(t, np.uint8)
    base = group * 512
    order = np.arange(n)
    common = np.zeros(n + 1, np.int32)
    first, last = np.full(n, -1), np.full(n, -1)
    for column in range(width - 1, -1, -1):
        read = base + symbol[column][order]  # what each shard's transform gives, in interleave order
        step = np.argsort(read, kind="stable")
        read = read[step]
        same = np.flatnonzero((read[1:] == read[:-1]) & (read[1:] & 511 != 256))
        grown = np.zeros(n + 1, np.int32)
        if len(same):
            between = np.stack([step[same] + 1, step[same + 1] + 1], axis=1).ravel()
            grown[same + 1] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[step], grown
        if column <= ahead:
            long_ = common >= length
            hit = order[long_[:-1] | long_[1:]]
            first[hit] = column
            last[hit[last[hit] < 0]] = column
    return first, last


def edges(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(th, start, end) of the stretch around an anchor that repeated strings cover."""
    ahead = length - gram

    def some(parts: list[tuple]) -> pa.RecordBatch:
        h, th, pos, want, before = (np.concatenate([p[i] for p in parts]) for i in range(5))
        texts = [t for p in parts for t in p[5]]
        group = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
        first, last = merged(group, before, texts, length, gram)
        on = (first >= 0) & want
        return pa.RecordBatch.from_arrays(
            [pa.array(th[on]), pa.array(pos[on] - ahead + first[on]), pa.array(pos[on] - ahead + last[on] + length)],
            names=["th", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1), len(h)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if size + hi - lo > MERGE_ROWS and held and held[-1][0][-1] != h[lo]:
                    yield some(held)
                    held, size = [], 0
                held.append((h[lo:hi], part.column(1).to_numpy(), part.column(2).to_numpy(), part.column(3).to_numpy(zero_copy_only=False),
                             part.column(4).to_numpy(), part.column(5).to_pylist()))
                size += hi - lo
        if held:
            yield some(held)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "th long, start long, end long")


def counted_edges(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """What `edges` gives, by counting the hash of every string around the anchors with its column:
    for grams of so many contexts that no task should hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, th, pos, want, before, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                n = min(before, len(raw) - length) + 1
                if n <= 0:
                    continue
                at = np.arange(n)
                w = range_hash(prefix_hash(np.frombuffer(raw, np.uint8)), at, at + length)
                w = (w ^ mix((before - at).astype(np.uint64))).view(np.int64)
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, h)), pa.array(w), pa.array(np.full(k, th)), pa.array(pos - before + at),
                                                  pa.array(np.full(k, want))], names=["h", "w", "th", "start", "want"])

    strings = rows.mapInArrow(run, "h long, w long, th long, start long, want boolean")
    twice = strings.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return strings.where("want").join(twice, ["h", "w"]).select("th", "start", (F.col("start") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row per row of `docs`.

    Every byte of the UTF-8 text that lies in a string of `length` bytes which starts at another
    place too, in any document or the same, is removed; overlapping occurrences count, strings do
    not cross documents and are judged on the input. n_spans counts the maximal removed runs;
    `kept` holds the other bytes joined (null where that cuts a character). Null text is empty; texts shorter
    than `length` stay whole; of repeated rows each is a document, so long ones go whole; rows without an id are
    documents like others; an empty table gives an empty one. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    long_ = docs.where(F.octet_length("text") >= length)
    copies = long_.groupBy("th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("th")
    known = judged(anchor_rows(long_, length, gram)).groupBy("th").agg(F.collect_set("code").alias("codes"))
    known = materialize(known)
    rows = context_rows(docs, known, length, gram)
    rows = materialize(rows)
    crowded = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MERGE_MOST).select("h")
    crowded = materialize(crowded)
    few = rows.join(crowded, "h", "left_anti")
    found = edges(few, length, gram).unionByName(counted_edges(rows.join(crowded, "h", "left_semi"), length, gram))
    found = found.groupBy("th").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    nothing = F.lit(None)
    facts = (copies.select("th", F.lit(True).alias("copy"), nothing.cast("array<long>").alias("codes"), nothing.cast("array<struct<start:long,end:long>>").alias("spans"))
             .unionByName(known.select("th", F.lit(False).alias("copy"), F.filter("codes", lambda c: c % 4 != ALONE).alias("codes"), nothing.cast("array<struct<start:long,end:long>>").alias("spans")))
             .unionByName(found.select("th", F.lit(False).alias("copy"), nothing.cast("array<long>").alias("codes"), "spans")))
    facts = facts.groupBy("th").agg(F.max("copy").alias("copy"), F.max("codes").alias("codes"), F.max("spans").alias("spans"))
    both = docs.join(facts, "th", "left").select("doc_id", "text", "copy", "codes", "spans")
    ahead = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, value, copy, codes, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                raw = value.as_py().encode()
                n = len(raw)
                start, end = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if copy and n >= length:
                    start, end = np.array([0]), np.array([n])
                else:
                    if codes.is_valid:
                        pos = np.array(codes.values) >> 2
                        start, end = contexts(pos, 0, n, length, gram)
                        on = end - start >= length
                        start, end = start[on], end[on]
                    if spans.is_valid:
                        start = np.concatenate([start, np.array(spans.values.field("start"))])
                        end = np.concatenate([end, np.array(spans.values.field("end"))])
                change = np.zeros(n + 1, np.int32)
                np.add.at(change, start, 1)
                np.add.at(change, end, -1)
                gone = np.cumsum(change[:n]) > 0
                runs = int((gone[1:] & ~gone[:-1]).sum() + (gone[:1].sum()))
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc, n, int(gone.sum()), runs, sha256(kept).hexdigest(), kept))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    out = both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
    return out.withColumn("kept", F.try_validate_utf8(F.col("kept_bytes").cast("string"))).drop("kept_bytes")
