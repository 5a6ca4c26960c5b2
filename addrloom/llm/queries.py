"""Queries opN_<name> over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, huffman, jaccard_join, langid, licenses, mixing, packing, quality_classifier, quality_rules, warc
from .common import dataset

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(dataset(spark, sf_dir, "documents"), tokenizer_path(), 2048)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(dataset(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(dataset(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(dataset(spark, sf_dir, "pages"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(dataset(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    own = F.col("_mix")
    return mixed.select("doc_id", own["size"].alias("size"), own.source_size.alias("source_size"), own.target.alias("target"), (own.copies * own["size"]).cast("long").alias("taken"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dataset(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, dataset(spark, sf_dir, "labels")))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.dedup(dataset(spark, sf_dir, "embeddings"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(dataset(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(dataset(spark, sf_dir, "documents"), dataset(spark, sf_dir, "labels"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(dataset(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_license_scan, op3_language_id, op4_warc, op5_source_mixing, op6_quality_rules,
    op7_embedding_dedup, op8_token_output, op9_quality_classifier, op10_ngram_jaccard_join,
)}

SQL = {
    "op2_license_scan": licenses.sql(),
    "op4_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id, url) AS k,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages
), b AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', (strpos('0123456789abcdef', substr(h, i, 1)) - 1) * 4 + 1, 4)), '') AS bits FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT
    + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to
FROM b
""",
    "op5_source_mixing": mixing.SQL,
}
