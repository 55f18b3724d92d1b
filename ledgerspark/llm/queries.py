"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_bpe_codec, op2_hpylm, op3_media, op4_simhash, op5_topk, op6_secrets, op7_packing, op8_toxicity, op9_token_counts, op10_token_files, op11_chats, op12_repair, op13_negatives
from .common import crc_bucket, scratch

OP5_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies."""
    return importlib.import_module("public_tokenizers").path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_codec_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_bpe_codec.round_trip_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op2_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_hpylm.score(table(spark, sf_dir, "documents"), folds=5, held=1)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_media.media_features(op3_media.to_media(table(spark, sf_dir, "documents")))


def op4_simhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_secrets.report(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = op8_toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = op8_toxicity.score(docs, model)
    return scored.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)


def op9_token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op10_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch(spark, "token-files")
    op10_token_files.write_token_files(table(spark, sf_dir, "documents"), target, tokenizer_file("byte_bpe_50k.json"), end_id=2)
    return op10_token_files.read_token_files(spark, target)


def op11_chat_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_chats.report(table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_repair.report(op12_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return op13_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importlib.import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {
        "pipeline": pipeline,
        "op1_bpe_codec": op1_bpe_codec_query,
        "op2_pitman_yor_scores": op2_pitman_yor_scores,
        "op3_media_columns": op3_media_columns,
        "op4_simhash_near_dups": op4_simhash_near_dups,
        "op5_exact_topk": op5_exact_topk,
        "op6_secret_scan": op6_secret_scan,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_weak_toxicity": op8_weak_toxicity,
        "op9_token_counts": op9_token_counts_query,
        "op10_rans_token_files": op10_rans_token_files,
        "op11_chat_formats": op11_chat_formats,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_topk": OP5_SQL,
        "op6_secret_scan": op6_secrets.oracle(),
        "op11_chat_formats": op11_chats.oracle(),
        "op13_hard_negatives": op13_negatives.ORACLE_SQL,
    }
