"""The trie of conversation prefixes, built by cutting sequences at half depth.

A prefix is named by a chained digest of its turns, so equal prefixes have equal names
without a shuffle. A piece of the trie of height h holds the distinct sequences below one
root, with the number and the smallest of the conversations behind each. Cutting them at half
depth gives an upper trie of the cut prefixes and, below every cut prefix, a lower forest; the
pieces of all roots and depths are cut in one job, so a trie of depth d takes log2(d) rounds.
At height one a sequence is a node. Totals of subtrees go the other way: at each cut the
totals of a lower forest are grafted onto the path of its cut prefix in the upper trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.session import materialize

#: Remainders of the hash that sets how many turns of the first conversation of a block lead.
HEADS, BLOCK = 9, 5
ROOT = ""
#: Conversation ids that are joined to one string before the strings of a node are hashed.
JOINED = 4096
NAME_CHARS = 32


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation with its digest and byte length of every turn.

    Turns are ordered by `turn`, null first, equal ones by their digest; null role or text is
    empty. The first h turns come from the conversation that leads the block of five (fewer
    where it has fewer, none where it is absent), the rest is the conversation's own from turn h
    on; h is the crc32 of the decimal id modulo nine. Rows without a conv_id belong to none.
    A conversation is held as one row of digests, 48 bytes a turn, never with its texts.
    """
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _name(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.where(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % BLOCK).alias("lead"), F.col("turn").cast("long").alias("turn"),
        digest.alias("d"), F.octet_length(text).cast("long").alias("b"))
    # one exchange serves the grouping and both sides of the join
    own = rows.repartition("lead").groupBy("lead", "conv_id").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("turn", "d", "b"))), lambda t: F.struct(t.d.alias("d"), t.b.alias("b"))).alias("turns"))
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    heads = own.where("conv_id = lead").select("lead", F.slice("turns", 1, HEADS - 1).alias("head"))
    none = F.slice("turns", 1, 0)
    return own.join(heads, "lead", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
        F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")).alias("turns"))


def _name(of: Column) -> Column:
    return F.substring(F.sha2(of, 256), 1, NAME_CHARS)


def _named(convs: DataFrame) -> DataFrame:
    """(conv_id, names, bytes): the names of all prefixes of a conversation, from depth one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = []
            for digests in batch.column(1).to_pylist():
                name, own = ROOT, []
                for d in digests:
                    name = hashlib.sha256((name + d).encode()).hexdigest()[:NAME_CHARS]
                    own.append(name)
                names.append(own)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.list_(pa.string())), batch.column(2)],
                names=["conv_id", "names", "bytes"])

    flat = convs.select("conv_id", F.col("turns.d").alias("names"), F.col("turns.b").alias("bytes"))
    return flat.mapInArrow(run, "conv_id long, names array<string>, bytes array<long>")


def _distinct(pieces: DataFrame) -> DataFrame:
    """Sequences of each root that end in the same name are one; copies are added up."""
    return pieces.groupBy("lo", "root", F.element_at("names", -1).alias("end")).agg(
        F.first("names").alias("names"), F.first("bytes").alias("bytes"),
        F.sum("n").alias("n"), F.min("first").alias("first")).drop("end")


def _cut(pieces: DataFrame, half: int) -> DataFrame:
    """Upper and lower parts of the sequences, cut after `half` turns."""
    upper = F.struct(F.col("lo"), F.col("root"), F.slice("names", 1, half).alias("names"),
                     F.slice("bytes", 1, half).alias("bytes"))
    lower = F.struct((F.col("lo") + half).alias("lo"), F.col("names")[half - 1].alias("root"),
                     F.expr(f"slice(names, {half + 1}, greatest(size(names) - {half}, 0))").alias("names"),
                     F.expr(f"slice(bytes, {half + 1}, greatest(size(bytes) - {half}, 0))").alias("bytes"))
    both = F.when(F.size("names") > half, F.array(upper, lower)).otherwise(F.array(upper))
    return pieces.select(F.explode(both).alias("p"), "n", "first").select("p.*", "n", "first")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row a node of the trie of the rebuilt conversations (`rebuilt`): conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Only conv_id, turn, role and text are read, so other columns never clash. An empty table
    has no node; turnless conversations are members of the root alone. Copies of conversations
    become one sequence before the first cut, and all sums and minima combine before they are
    shuffled, so no node, however common, gathers its members in one task. The ids that end at
    a node are sorted and joined in parallel; only the strings are hashed one after another,
    as the digest demands.
    """
    convs = materialize(_named(rebuilt(turns)))
    n_convs, least, deepest = convs.agg(
        F.count(F.lit(1)), F.min("conv_id"), F.coalesce(F.max(F.size("names")), F.lit(0))).first()
    height = 1
    while height < deepest:
        height *= 2
    whole = convs.where(F.size("names") > 0).select(
        F.lit(0).alias("lo"), F.lit(ROOT).alias("root"), "names", "bytes", F.lit(1).cast("long").alias("n"),
        F.col("conv_id").alias("first"))
    levels = {height: materialize(_distinct(whole))}
    half = height // 2
    while half:
        levels[half] = materialize(_distinct(_cut(levels[2 * half], half)))
        half //= 2
    nodes = levels[1].select(
        F.col("names")[0].alias("name"), F.col("root").alias("parent"), (F.col("lo") + 1).alias("depth"),
        "n", "first", F.col("bytes")[0].alias("bytes"))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("children"))
    nodes = materialize(nodes.join(children, "name", "left").fillna(0, ["children"]))
    totals = _grafted(nodes, levels, height).groupBy("name").agg(
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    nodes = nodes.join(totals, "name")

    top = nodes.where("depth = 1").agg(
        F.count(F.lit(1)).alias("children"), F.coalesce(F.sum("leaves"), F.lit(1)).cast("long").alias("leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).cast("long").alias("saved")).select(
        F.lit(ROOT).alias("name"), F.lit(least).cast("long").alias("first"), F.lit(0).alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"), F.lit(n_convs).cast("long").alias("n"),
        "children", "leaves", "saved").where(F.lit(n_convs > 0))
    over = nodes.select(F.col("name").alias("parent"), F.col("first").alias("parent_first"))
    # the children of the root need no join: its smallest member is known
    below = nodes.where("depth > 1").join(over, "parent").withColumnRenamed("parent_first", "parent_conv_id")
    first = nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(least).cast("long"))
    columns = ["name", "first", "depth", "parent_conv_id", "n", "children", "leaves", "saved"]
    every = top.unionByName(first.select(*columns)).unionByName(below.select(*columns))
    empty = hashlib.sha256(b"").hexdigest()
    return every.join(_ends(convs), "name", "left").select(
        F.col("first").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id",
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def _grafted(nodes: DataFrame, levels: dict[int, DataFrame], height: int) -> DataFrame:
    """(name, parent, depth, leaves, saved): what each node adds to its own total and, from
    every lower forest, to the totals of the nodes above its cut. Sums by name are the totals."""
    parts = nodes.select(
        "name", "parent", "depth", (F.col("children") == 0).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    half = 1
    while half < height:
        # cut prefixes end where the depth is an odd multiple of half
        forests = parts.where((F.col("depth") - 1) % (2 * half) == half).groupBy(F.col("parent").alias("cut")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        paths = levels[half].where((F.size("names") == half) & (F.col("lo") % (2 * half) == 0)).select(
            "lo", "root", "names", F.element_at("names", -1).alias("cut"))
        up = paths.join(forests, "cut").select(
            F.posexplode("names").alias("i", "name"), "lo", "root", "names", "leaves", "saved").select(
            "name", F.when(F.col("i") == 0, F.col("root")).otherwise(F.get("names", F.col("i") - 1)).alias("parent"),
            (F.col("lo") + F.col("i") + 1).alias("depth"), "leaves", "saved")
        up = up.groupBy("name", "parent", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        parts = parts.unionByName(materialize(up))
        half *= 2
    return parts


def _ends(convs: DataFrame) -> DataFrame:
    """(name, ends_sha256) of the nodes at which conversations end."""
    ends = convs.select(F.coalesce(F.get("names", F.size("names") - 1), F.lit(ROOT)).alias("name"), "conv_id")
    parts = int(convs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of one node, in order, as strings of at most JOINED of them."""
        last, held = None, []

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))],
                names=["name", "first", "ids"])

        for batch in batches:
            rows = []
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (name != last or len(held) == JOINED):
                    rows.append((last, held[0], ",".join(map(str, held))))
                    held = []
                last = name
                held.append(conv)
            if rows:
                yield out(rows)
        if held:
            yield out([(last, held[0], ",".join(map(str, held)))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if name != last:
                    if state:
                        done.append((last, state.hexdigest()))
                    last, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], names=["name", "ends_sha256"])

    joined = ends.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(
        join, "name string, first long, ids string")
    return joined.repartition(parts, "name").sortWithinPartitions("name", "first").mapInArrow(
        digest, "name string, ends_sha256 string")
