"""Text gates: findings per rule, rejection reports, normalised duplicates, first-wins de-duplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import findings_of_stripped, lowered, normalised, promotional, stripped


def gate_findings(items: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each finding: (key, rule)."""
    # not a plain explode: Spark would test first whether there is anything to explode, which works all rules out once more,
    # and what they share again for each of them
    return _rules(items, key, text).select(key, F.explode_outer("rules").alias("rule")).where("rule is not null")


def _rules(items: DataFrame, key: str, text: str) -> DataFrame:
    # what several rules read is a column of its own, so that they don't work it out several times
    ready = items.select(key, stripped(F.coalesce(F.col(text), F.lit(""))).alias("text")).withColumn("low", lowered(F.col("text")))
    ready = ready.withColumn("marketing", promotional(F.col("text"), F.col("low")))
    return ready.select(key, findings_of_stripped(F.col("text"), F.col("low"), F.col("marketing")).alias("rules"))


def by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule").agg(F.count("*").alias("findings"))


def rejection(items: DataFrame, key: str, text: str) -> DataFrame:
    """Items, rejected items, and their rate to four decimals; nothing rejected of nothing is 0."""
    bad = (F.size("rules") > 0).cast("int")
    counts = _rules(items, key, text).select(bad.alias("bad")).agg(F.count("*").alias("items"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("rejected"))
    rate = F.when(F.col("items") == 0, F.lit(0)).otherwise(F.col("rejected") * 10000 / F.col("items"))
    return counts.withColumn("rate_bp", F.round(rate, 0).cast("long"))


def within_ceiling(items: DataFrame, key: str, text: str, ceiling: float = 0.02) -> bool:
    """Whether the rejection rate allows publishing."""
    row = rejection(items, key, text).first()
    return row.items == 0 or row.rejected / row.items <= ceiling


def digest(text: Column) -> Column:
    """What stands for a text as a key: 32 bytes, however long it is."""
    return F.unhex(F.sha2(text, 256))


def duplicate_groups(items: DataFrame, key: str, text: str) -> DataFrame:
    """Groups of items that are equal once normalised: least key and size (no group is gathered)."""
    groups = items.select(key, digest(normalised(F.col(text))).alias("norm")).groupBy("norm")
    return groups.agg(F.min(key).alias("first_id"), F.count("*").alias("n")).where("n > 1").select("first_id", "n")


def duplicate_totals(items: DataFrame, key: str, text: str) -> DataFrame:
    return duplicate_groups(items, key, text).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("items"))


def first_wins(items: DataFrame, within: list[str], name: Column, order: list[str]) -> DataFrame:
    """The first item of each name inside a group."""
    w = Window.partitionBy(*within, digest(name.cast("string"))).orderBy(*order)
    return items.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
