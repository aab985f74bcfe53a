"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import (
    clustering, decontaminate, hard_negatives, licenses, line_dedup, mixing, near_dedup, oracles, phrase_dedup, quality, suffix_dedup,
    tokens, top_products, warc,
)
from barloom.llm.common import table
from barloom.sources.stage import stage_root


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = suffix_dedup.removed_length().alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{stage_root(spark)}/barloom/warc-{uuid.uuid4().hex}"
    return warc.round_trip(table(spark, sf_dir, "pages"), path)


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup.remove_phrases(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, model)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # one query's files; the others do without

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.remove_lines(table(spark, sf_dir, "documents"), words=line_dedup.WORDS)
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.encode("kept", "UTF-8")).alias("kept_md5"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source and language are directories."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit(""), F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    doc_id = F.element_at(F.split("path", "/"), -1).cast("long")
    return found.select(doc_id.alias("doc_id"), "own_license", "cosine", "license", "inherited_from", "n_words")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the id is divisible by 7 the label is the next one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


_ALL = (op1_suffix_dedup, op2_warc, op3_phrase_dedup, op4_near_dedup, op5_quality_rules, op6_token_counts, op7_decontamination, op8_mixing, op9_line_dedup, op10_license_scan, op11_centroid_clustering, op12_top_products, op13_hard_negatives)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "op1_suffix_dedup": oracles.BYTES,
    "op3_phrase_dedup": oracles.WORDS,
    "op4_near_dedup": oracles.NEAR,
    "op9_line_dedup": oracles.LINES,
    "op11_centroid_clustering": oracles.clusters(),
    "op12_top_products": oracles.PRODUCTS,
    "op13_hard_negatives": oracles.NEGATIVES,
    "op7_decontamination": decontaminate.ORACLE,
    "op10_license_scan": licenses.oracle(),
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY sha1(h)) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((('0x' || substr(s, ((i // 4) * 5 + 1)::BIGINT, 5))::BIGINT) >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1, 1)), 'string_agg', '')
       AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url
FROM d JOIN (SELECT page_id, url FROM pages) USING (page_id)
""",
}
