"""A training-data pipeline over ``documents``: toxic texts go, near copies go, secrets are masked, the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the
columns of ``documents``.  Cases are those of the operators that the stages call.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import op4_simhash, op6_secrets, op7_packing, op8_toxicity
from ledgerspark.llm.common import saved
from ledgerspark.llm.queries import tokenizer_file


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weakly supervised classifier scores 0.7 or more."""
    model = op8_toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op8_toxicity.drop_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return op4_simhash.drop_near_copies(docs, shingle=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; the character count follows."""
    clean = op6_secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of 4096 tokens."""
    return op7_packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: SQL cannot express the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
