"""Scoring an extraction against the golden tables with plain equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import hash52
from ..functions.money import CENTS


def perturbed(golden: DataFrame) -> DataFrame:
    """A stand-in extraction: one total in ten is a cent off, one invoice in fifty is missing."""
    i = F.col("invoice_index")
    off = F.when(hash52("cent", i) % 10 == 0, F.lit("0.01").cast(CENTS)).otherwise(F.lit(0).cast(CENTS))
    return golden.where(hash52("missing", i) % 50 != 0).withColumn("grand_total", (F.col("grand_total") + off).cast(CENTS))


def exact_join(golden: DataFrame, extracted: DataFrame, key: str = "invoice_id", field: str = "grand_total") -> DataFrame:
    """Golden and extracted value of every invoice that both have; a cent's difference is no match."""
    g, e = golden.select(key, F.col(field).alias("golden")), extracted.select(key, F.col(field).alias("extracted"))
    return g.join(e, key).withColumn("matches", F.col("golden") == F.col("extracted"))


def field_accuracy(golden: DataFrame, extracted: DataFrame, fields: list[str], by: str, key: str = "invoice_id") -> DataFrame:
    """Share of golden invoices with a matching field, by a slice; absent ones count as misses."""
    e = extracted.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    joined = golden.select(key, by, *fields).join(e, key, "left")
    hits = [F.count(F.when(F.col(f).eqNullSafe(F.col(f"_{f}")), 1)).alias(f"{f}_hits") for f in fields]
    return joined.groupBy(by).agg(F.count("*").alias("invoices"), *hits)


def row_scores(golden: DataFrame, extracted: DataFrame, keys: list[str], value: str) -> DataFrame:
    """True positives, false positives and false negatives of line rows, from one full outer join."""
    g = golden.select(*keys, F.col(value).alias("_g"), F.lit(True).alias("_in_g"))
    e = extracted.select(*keys, F.col(value).alias("_e"), F.lit(True).alias("_in_e"))
    both = g.join(e, keys, "full_outer")
    same = F.coalesce(F.col("_g") == F.col("_e"), F.lit(False))
    return both.agg(
        F.count(F.when(same, 1)).alias("true_positives"),
        F.count(F.when(F.col("_in_e") & ~same, 1)).alias("false_positives"),
        F.count(F.when(F.col("_in_g") & ~same, 1)).alias("false_negatives"),
    )
