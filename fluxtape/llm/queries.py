"""The queries of this subpackage, by name, and their SQL where SQL can say it."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, line_rules, merkle, mixing, ppm, quality, sharding, simhash, suffix_dedup, token_counts, topk, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op3_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weak_label_quality(_table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mixed(_table(spark, sf_dir, "documents")).where("drawn_")
    return drawn.select("doc.doc_id", F.col("source_").alias("source"), F.col("lang_").alias("lang"), F.col("topic_").alias("topic"), F.col("tokens_").alias("tokens"), F.round("p_", 6).alias("p"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = toxicity.toxicity(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return done.select("doc.doc_id", "held_out", "score", "predicted")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return done.select("doc.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_frequency_rules(_table(spark, sf_dir, "documents"), texts=False)


def op9_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.language_scores(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(_table(spark, sf_dir, "documents"), shards=40)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(_table(spark, sf_dir, "documents"), sentinels=("<P>", "<S>", "<M>"), seed="7", rate=100, spm=50)
    chars = [F.length(c).cast("bigint").alias(f"{c}_chars") for c in ("prefix", "middle")]
    return made.select("doc.doc_id", "n", "form", *chars, *(F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return merkle.manifest(_table(spark, sf_dir, "documents"), presented={"text": F.when(drawn, lowered).otherwise(F.col("text"))})


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_exact_top_k, op3_weak_label_quality, op4_source_mixing, op5_toxicity, op6_suffix_array_dedup, op7_byte_bpe, op8_line_frequency_rules, op9_ppm_scoring, op10_sharding, op11_fill_in_middle, op12_token_counts, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_top_k": OP2_SQL.strip(), "op4_source_mixing": mixing.oracle_sql(), "op8_line_frequency_rules": line_rules.SQL, "op11_fill_in_middle": fill_in_middle.SQL.strip(), "op13_merkle_manifest": merkle.SQL}
