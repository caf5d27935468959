"""Merkle fingerprints over the paragraphs and sections of a text. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import with_neighbours

#: A paragraph ends after a mark and a space; a section is a line.
PARAGRAPH_END = r"(?<=[.!?,|] )"
#: Hex digits of a paragraph's digest that the fingerprint keeps.
LEAF_DIGITS = 10


def paragraphs(text: Column) -> Column:
    """array<array<string>>: digests of the paragraphs of every section."""
    return F.transform(F.split(text, "\n"), lambda s: F.transform(F.split(s, PARAGRAPH_END), lambda p: F.md5(p)))


def sections(leaves: Column) -> Column:
    """array<string>: a digest for every section, over its paragraphs."""
    return F.transform(leaves, lambda s: F.md5(F.concat_ws(",", s)))


def root(nodes: Column) -> Column:
    return F.sha2(F.concat_ws("/", nodes), 256)


def fingerprint(top: Column, leaves: Column) -> Column:
    """Root, then sections by `/` and in them paragraphs by `,`."""
    short = F.transform(leaves, lambda s: F.concat_ws(",", F.transform(s, lambda p: F.substring(p, 1, LEAF_DIGITS))))
    return F.concat(top, F.lit(":"), F.concat_ws("/", short))


def likeness(root_a: Column, a: Column, root_b: Column, b: Column) -> Column:
    """1 for equal roots, else the shared share of distinct paragraphs."""
    a, b = F.array_distinct(F.flatten(a)), F.array_distinct(F.flatten(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(root_a == root_b, 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def first_difference(a: Column, b: Column) -> Column:
    """Number from 1 of the first section that differs, 0 where none does."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.array_position(same, False), F.lit(0)).cast("long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    first_edit), a row per row of `docs`.

    Equal texts have equal roots, and so equal fingerprints; where roots differ, the sections
    whose digests differ hold the edits. The edited text is the text whose last
    floor(n_chars / 2) code points are replaced by the first as many, or all, of the next
    document's: by descending doc_id, rows that share an id by a hash of their text, rows
    without an id last, and after the last the first. Null text is empty; a document alone is
    its own next. near_edited and near_next are the shared shares of distinct paragraphs, 1 for
    equal texts; first_edit is the first section that the edit changes. Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce(F.bitwise_not(F.col("doc_id")), F.lit(0).cast("long")).alias("d"), F.xxhash64("text").alias("h"))
    rows = with_neighbours(base, key, {"text": F.col("text"), "leaves": paragraphs(F.col("text"))}, wrap=True)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_leaves", paragraphs(F.col("edited")))
    for name in ("", "edited_", "next_"):
        rows = rows.withColumn(f"{name}nodes", sections(F.col(f"{name}leaves"))).withColumn(f"{name}root", root(F.col(f"{name}nodes")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("root"), F.col("leaves")).alias("fingerprint"),
        fingerprint(F.col("edited_root"), F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("root"), F.col("leaves"), F.col("edited_root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("root"), F.col("leaves"), F.col("next_root"), F.col("next_leaves")).alias("near_next"),
        first_difference(F.col("nodes"), F.col("edited_nodes")).alias("first_edit"))
