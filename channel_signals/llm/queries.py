"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from channel_signals.llm.common import table
from channel_signals.llm.html_main import main_text
from channel_signals.llm.lattice_lm import lattice_scores
from channel_signals.llm.merkle import fingerprints
from channel_signals.llm.metric_join import metric_join
from channel_signals.llm.mixing import mix
from channel_signals.llm.ngram_join import ngram_join
from channel_signals.llm.packing import pack, pieces
from channel_signals.llm.prefix_trie import prefix_trie
from channel_signals.llm.quality import quality
from channel_signals.llm.repeats import remove_repeats
from channel_signals.llm.secrets import find_secrets
from channel_signals.llm.url_filter import url_verdicts
from channel_signals.llm.vector_codes import vector_codes

# The host and path rules.
URL_RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
    ("block", "net/es/"), ("block", "net/fr/"),
)
#: Every page whose id divides by this is a listed URL.
LISTED_EVERY = 20


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "votes", "posterior", "score", "kept")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("page_id") % LISTED_EVERY == 0)
    return url_verdicts(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"), clean=False).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar")


def op6_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join(table(spark, sf_dir, "embeddings"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op11_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_quality, op3_url_filter, op4_html, op5_secrets, op6_metric_join,
    op7_merkle, op8_mixing, op9_packing, op10_ngram_join, op11_lattice_lm, op12_prefix_trie,
    op13_vector_codes)}

SQL = {
    "op3_url_filter": """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '(\\.html)?/*$', '') END AS k
  FROM parts),
listed AS (SELECT DISTINCT k FROM keyed WHERE page_id % 20 = 0 AND k IS NOT NULL),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed.k IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       listed.k IS NOT NULL AS listed
FROM ruled LEFT JOIN listed ON ruled.k = listed.k
""",
}
