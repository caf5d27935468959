"""Best-fit packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import heapq
import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from channel_signals.session import materialize, shared_dir

CAPACITY = 1024
END_ID = 2
#: Runs of white space of this length go to the general encoder, whose memory they don't exhaust.
_LONG_SPACE = re.compile(r"\s{500}")
#: The pre-token pattern of byte-level vocabularies (a fixed value).
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Encoder:
    """Ids of texts as little-endian 32-bit bytes, as `tokenizers` gives them.

    Where the file is a plain byte-level vocabulary whose merges are numbered in their order,
    `tiktoken` merges by the same ranks in a quarter of the time; special tokens are ordinary
    text to both. Any other file, and texts with very long white space, go to `tokenizers`.
    Nothing is remembered from text to text.
    """

    def __init__(self, path: str):
        self.path = path
        self.ranks = _merge_ranks(path)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.ranks is None or _LONG_SPACE.search(text):
            return self.raw(text)
        return array("I", self.ranks.encode_ordinary(text)).tobytes()


def _merge_ranks(path: str):
    """The vocabulary at `path` for tiktoken, or None where ranks can't stand for it."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type", "BPE") == "BPE" and not spec.get("normalizer") and before.get("type") == "ByteLevel"
             and before.get("use_regex", True) and not before.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
    if not plain or sys.byteorder != "little" or array("I").itemsize != 4:
        return None
    # printable bytes stand for themselves, the others follow from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown}
    back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    added = {t["content"] for t in spec.get("added_tokens", ())}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
    if any(c not in back for t in vocabulary for c in t) or merged != sorted(x for x in merged if x is not None):
        return None
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, special_tokens={}, mergeable_ranks={
        bytes(back[c] for c in t): i for t, i in vocabulary.items()})


@lru_cache(1)
def _encoder(path: str) -> _Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of at most `capacity` ids of a document, its end id included.

    The remainder comes first: every later piece is full. Null text has the end id alone.
    The tokenizer file must be readable at `tokenizer_path` on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            encoder = _encoder(tokenizer_path)
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n = len(ids) // 4
                at, size = 0, n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    out.append((doc, piece, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, size = at + size, capacity
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])
        pa.default_memory_pool().release_unused()  # the worker lives on without the texts

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


#: Documents and gaps that one task sweeps in a round.
RANGE_ROWS = 50_000
#: Columns of a piece that only travel along.
_PIECE = ["doc_id", "piece", "start", "ids_crc32"]
_PLACED, _DOC, _GAP, _SMALL = range(4)
#: Kinds from here on are rows of counts: of a kind of the range, with its least and largest size.
_COUNT = 10
_SWEPT = ("part int, kind int, rank long, size long, sequence_id long, used long, "
          "doc_id long, piece int, start long, ids_crc32 long")


def _sweep(rows: Iterator[tuple]) -> Iterator[tuple]:
    """One task's share of a round: (is_doc, size, sequence, used, payload) from the largest size
    down, gaps before documents of the same size.

    Every document takes the successor of its length among the gaps seen so far, which is the
    last one on a stack. What is left of that gap comes back in its place of the order, while
    that lies in this task's range. Yields (kind, rank, size, sequence, used, payload): placed
    documents, documents without a gap by falling size, free gaps by rising size, and gaps
    smaller than the range.
    """
    stack: list[tuple[int, int, int]] = []
    later: list[tuple[int, int, int]] = []
    missed, size = 0, 0
    for is_doc, size, sequence, used, payload in rows:
        while later and -later[0][0] >= size:
            left, seq, at = heapq.heappop(later)
            stack.append((-left, seq, at))
        if not is_doc:
            stack.append((size, sequence, used))
        elif stack:
            gap, seq, at = stack.pop()
            yield _PLACED, 0, size, seq, at, payload
            left = gap - size
            if left >= size:
                stack.append((left, seq, at + size))
            elif left:
                heapq.heappush(later, (-left, seq, at + size))
        else:
            yield _DOC, missed, size, None, None, payload
            missed += 1
    # what fits the smallest size of the range fits all documents of later ranges
    rank = 0
    for gap, seq, at in sorted(stack + [(-g, s, a) for g, s, a in later]):
        if gap >= size:
            yield _GAP, rank, gap, seq, at, (None,) * 4
            rank += 1
        else:
            yield _SMALL, 0, gap, seq, at, (None,) * 4


def _swept(docs: DataFrame, gaps: DataFrame, parts: int) -> DataFrame:
    """Documents and gaps, range-sorted by falling size and swept by the task of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(),
                 pa.int64(), pa.int32(), pa.int64(), pa.int64())
        names = ["part", "kind", "rank", "size", "sequence_id", "used", *_PIECE]

        def rows():
            for batch in batches:
                c = [x.to_pylist() for x in batch.columns]
                for is_doc, size, seq, used, *payload in zip(*c):
                    yield is_doc, size, seq, used, payload

        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), kinds)], names=names)

        held, seen = [], {}
        for kind, rank, size, seq, used, payload in _sweep(rows()):
            held.append((part, kind, rank, size, seq, used, *payload))
            n, low, high = seen.get(kind, (0, size, size))
            seen[kind] = n + 1, min(low, size), max(high, size)
            if len(held) == 10_000:
                yield out(held)
                held = []
        yield out(held + [(part, _COUNT + kind, n, low, None, high, *[None] * 4) for kind, (n, low, high) in seen.items()]
                  ) if held or seen else out([(part, _COUNT, 0, 0, None, 0, *[None] * 4)])

    none = [F.lit(None).cast(t).alias(n) for n, t in zip(_PIECE, ("long", "int", "long", "long"))]
    both = docs.select(F.lit(True).alias("is_doc"), "size", F.lit(None).cast("long").alias("sequence_id"),
                       F.lit(None).cast("long").alias("used"), *_PIECE).unionByName(
        gaps.select(F.lit(False).alias("is_doc"), "size", "sequence_id", "used", *none))
    # ties are broken by the whole row, so that a size that most rows have is dealt out too
    order = [F.desc("size"), F.asc("is_doc"), F.asc("sequence_id"), *[F.asc(c) for c in _PIECE]]
    return both.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, _SWEPT)


def _segments(found: list) -> list[tuple[int, int, int, int, int, int]]:
    """Which free gaps serve documents that found none in their own range, from counts by range:
    (part, from, to, gap part, first gap rank, documents a gap). Ranges come by falling size, so
    every free gap fits every such document of a later range; the smallest gaps go first, and a
    gap takes as many documents of a range as surely fit."""
    docs = {r["part"]: r for r in found if r["kind"] == _DOC}
    free = {r["part"]: r for r in found if r["kind"] == _GAP}
    stack: list[list[int]] = []
    out = []
    for part in sorted({*docs, *free}):
        done, n = 0, docs[part]["n"] if part in docs else 0
        while done < n and stack:
            gap_part, first, count, least = stack[-1]
            high = docs[part]["high"]
            each = least // high
            take = min(count, -(-(n - done) // each)) if each else 0
            if take:
                upto = min(n, done + take * each)
                out.append((part, done, upto, gap_part, first, each))
                spare = take * each - (upto - done)
                done = upto
                stack[-1][1] += take
                stack[-1][2] -= take
            if not stack[-1][2] or not each:
                stack.pop()  # a gap that was begun and holds no more waits for the next round
            if take and spare:
                # the last gap has surely room for more of smaller ranges
                stack.append([gap_part, first + take - 1, 1, least - (each - spare) * high])
        if part in free:
            stack.append([part, 0, free[part]["n"], free[part]["low"]])
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with `sequence_id` and `offset`: gapless from 0 in every sequence.

    Bulk-synchronous best fit. Pieces above half the capacity open a sequence each. Then, round
    by round, the remaining pieces and the gaps are range-sorted by size, and every range is
    swept from the top: a piece takes the smallest gap that holds it (`_sweep`). Pieces that
    find none in their range get the free gaps of larger ranges by rank (`_segments`), the gaps
    are updated, and the next round begins. Sequences are opened when the gaps can't hold what
    remains, never more than the remaining tokens fill. The driver sees counts by range.
    Equal pieces are interchangeable; a null id sorts first; an empty table gives an empty one.
    """
    spark = cut.sparkSession
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(cut.withColumnRenamed("length", "size").withColumn("_row", F.monotonically_increasing_id()))
    # placements are a table in the shared folder that every round adds to
    table = f"{shared_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    alone = F.col("size") * 2 > capacity
    cut.where(alone).select(*_PIECE, "size", F.col("_row").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).write.parquet(table)
    gaps = cut.where(alone & (F.col("size") < capacity)).select(
        (F.lit(capacity) - F.col("size")).alias("size"), F.col("_row").alias("sequence_id"), F.col("size").alias("used"))
    docs = cut.where(~alone).select(*_PIECE, "size")
    opened = 1 << 60
    while True:
        # sizes are at most `capacity`, so their counts are a small table
        sizes = docs.select("size", F.lit(True).alias("doc")).unionByName(gaps.select("size", F.lit(False).alias("doc"))).groupBy(
            "size", "doc").agg(F.count(F.lit(1)).alias("n")).collect()
        left = {r["size"]: r["n"] for r in sizes if r["doc"]}
        free = {r["size"]: r["n"] for r in sizes if not r["doc"] and left and r["size"] >= min(left)}
        if not left:
            break
        n, high = sum(left.values()), max(free, default=0)
        # neither all the room nor the largest gap holds so much
        new = max(0, -(-_words(left, free) // capacity), -(-sum(k * c for k, c in left.items() if k > high) // capacity))
        gaps = _few(gaps.where(F.col("size") >= min(left)), sum(free.values()))
        docs = _few(docs, n)
        parts = max(1, min(most, -(-(n + sum(free.values()) + new) // RANGE_ROWS)))
        while True:
            fresh = spark.range(opened, opened + new, 1, 1 + new // RANGE_ROWS).select(
                F.lit(capacity).cast("long").alias("size"), F.col("id").alias("sequence_id"), F.lit(0).cast("long").alias("used"))
            swept = materialize(_swept(docs, gaps.unionByName(fresh), parts))
            found = swept.where((F.col("kind") >= _COUNT) & (F.col("rank") > 0)).select(
                "part", (F.col("kind") - _COUNT).alias("kind"), F.col("rank").alias("n"), F.col("size").alias("low"),
                F.col("used").alias("high")).collect()
            segments = _segments(found)
            hits = sum(r["n"] for r in found if r["kind"] == _PLACED)
            if segments or hits:
                break
            new = max(1, new)  # nothing fits any more, though there is room in all
        opened += new
        served, updated = _served(swept, segments)
        done = swept.where(F.col("kind") == _PLACED).select(*_PIECE, "size", "sequence_id", F.col("used").alias("offset")).unionByName(served)
        _few(done, hits + sum(hi - lo for _, lo, hi, *_ in segments)).write.mode("append").parquet(table)
        gaps = updated.unionByName(swept.where(F.col("kind") == _SMALL).select("size", "sequence_id", "used"))
        docs = _unserved(swept, segments)
    return spark.read.parquet(table).select(
        "doc_id", "piece", "start", F.col("size").alias("length"), "ids_crc32", "sequence_id", "offset")


def _words(left: dict[int, int], free: dict[int, int]) -> int:
    """What remains, less the room there is."""
    return sum(k * c for k, c in left.items()) - sum(k * c for k, c in free.items())


def _few(df: DataFrame, rows: int) -> DataFrame:
    """`df` in as many partitions as its rows ask for, and not in those it comes from."""
    return df.coalesce(1 + rows // RANGE_ROWS)


def _segment_table(spark, segments: list[tuple]) -> DataFrame:
    """A few segments a range, in an order of their own."""
    return F.broadcast(spark.createDataFrame(segments, "part int, lo long, hi long, gap_part int, first long, each long"))


def _served(swept: DataFrame, segments: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """Documents placed in free gaps of larger ranges, and all free gaps as they are then."""
    free = swept.where(F.col("kind") == _GAP).select(
        F.col("part").alias("gap_part"), F.col("rank").alias("gap_rank"), F.col("size").alias("gap"), "sequence_id", "used")
    docs = swept.where(F.col("kind") == _DOC).select("part", "rank", "size", *_PIECE)
    inside = (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    asked = docs.join(_segment_table(swept.sparkSession, segments), "part").where(inside).withColumn(
        "gap_rank", F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each")).cast("long"))
    # a gap is a group of at most `capacity` documents
    order = Window.partitionBy("gap_part", "gap_rank").orderBy("part", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("gap_part", "gap_rank")
    met = materialize(free.join(asked, ["gap_part", "gap_rank"], "left").select(
        "gap", "sequence_id", "used", "size", *_PIECE, F.col("rank").isNotNull().alias("taken"),
        F.coalesce(F.sum("size").over(order), F.lit(0)).alias("before"),
        F.coalesce(F.sum("size").over(whole), F.lit(0)).alias("filled")))
    served = met.where("taken").select(*_PIECE, "size", "sequence_id", (F.col("used") + F.col("before")).alias("offset"))
    updated = met.where("before = 0").select(
        (F.col("gap") - F.col("filled")).alias("size"), "sequence_id", (F.col("used") + F.col("filled")).alias("used"))
    return served, updated.where("size > 0")


def _unserved(swept: DataFrame, segments: list[tuple]) -> DataFrame:
    """Documents that still have no place."""
    docs = swept.where(F.col("kind") == _DOC)
    upto = {}
    for part, _, hi, *_ in segments:
        upto[part] = max(hi, upto.get(part, 0))
    if upto:
        table = swept.sparkSession.createDataFrame(list(upto.items()), "part int, upto long")
        docs = docs.join(F.broadcast(table), "part", "left").where(F.col("rank") >= F.coalesce("upto", F.lit(0)))
    return docs.select(*_PIECE, "size")
