"""The corpus pipeline: quality, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a
DataFrame, which is written as Parquet and read again as the next stage's `docs`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals.llm.common import table
from channel_signals.llm.mixing import mix
from channel_signals.llm.ngram_join import ngram_join
from channel_signals.llm.packing import pack, pieces
from channel_signals.llm.quality import quality
from channel_signals.llm.queries import tokenizer_path
from channel_signals.llm.secrets import find_secrets
from channel_signals.session import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Bytes of a batch that goes to a Python worker: texts are long, and stages follow on another.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches for Python are bounded by bytes from now on, not by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    small_batches(spark)
    return quality(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates, the one of the smallest id.

    Rows that share an id stay or go together; rows without an id are always kept.
    """
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    gone = ngram_join(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark and n_chars counted anew where text changed."""
    small_batches(spark)
    found = find_secrets(docs.select(*COLUMNS))
    changed = F.col("spans") != ""
    return found.select(
        "doc_id", F.col("clean_text").alias("text"), "lang", "source",
        F.when(changed, F.length("clean_text").cast("long")).otherwise(F.col("n_chars").cast("long")).alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    small_batches(spark)
    taken = mix(docs.select(*COLUMNS)).where("copies > 0")
    repeat = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return taken.withColumn("_copy", repeat).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in the packed sequences."""
    small_batches(spark)
    return pack(pieces(docs.select("doc_id", "text"), tokenizer_path()))


STAGES = [
    ("quality", keep_quality), ("near_duplicates", drop_near_copies), ("secrets", redact_secrets),
    ("mixing", mix_sources), ("packing", pack_sequences),
]
#: No SQL says a fitted classifier, inferred automata, a subset sum or best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/corpus_pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
