"""Weighted routing: companies by weight, providers by mix, fall-backs around quarantined ones, distinct draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import cumulative, hash52, weighted_draw

MIX = [("batch", 40), ("fast", 40), ("local", 20)]


def by_weight(rows: DataFrame, key: Column, choices: DataFrame, name: str, weight: str, draw: str) -> DataFrame:
    """Give each row a choice in proportion to integer weights."""
    ranges = cumulative(choices, name, weight)
    total = ranges.agg(F.max("hi")).first()[0]
    if not total:
        raise ValueError("weights must add up to more than nothing")
    return weighted_draw(rows, hash52(draw, key), ranges, int(total))


def route(rows: DataFrame, key: Column, quarantined: tuple[str, ...] = ()) -> DataFrame:
    """A provider for each row by the mix; rows of quarantined ones draw again, independently, among the rest."""
    spark: SparkSession = rows.sparkSession
    mix = spark.createDataFrame(MIX, "provider string, weight long")
    routed = by_weight(rows, key, mix, "provider", "weight", "route").drop("weight")
    if not quarantined:
        return routed.withColumn("fallback", F.lit(False))
    healthy = mix.where(~F.col("provider").isin(*quarantined))
    lost = routed.where(F.col("provider").isin(*quarantined)).drop("provider")
    moved = by_weight(lost, key, healthy, "provider", "weight", "fallback").drop("weight").withColumn("fallback", F.lit(True))
    return routed.where(~F.col("provider").isin(*quarantined)).withColumn("fallback", F.lit(False)).unionByName(moved)


def distinct_then_reshuffle(slots: DataFrame, pool: int, group: str, slot: str) -> DataFrame:
    """Draw from a pool of n without repeats until it is used up, then shuffle anew: adds ``choice`` (0 to n-1).

    ``slot`` counts from 0; pass p of a group is its p-th shuffle of the pool, ordered by a hash.
    """
    passes = slots.withColumn("pass", F.expr(f"{slot} div {pool}")).withColumn("place", F.col(slot) % pool)
    wanted = passes.select(group, "pass").distinct()
    ranked = wanted.withColumn("choice", F.explode(F.sequence(F.lit(0), F.lit(pool - 1))))
    w = Window.partitionBy(group, "pass").orderBy(hash52("shuffle", F.col(group), F.col("pass"), F.col("choice")), "choice")
    ranked = ranked.withColumn("place", F.row_number().over(w) - 1)
    return passes.join(ranked, [group, "pass", "place"]).select(group, slot, "choice")
