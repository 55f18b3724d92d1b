"""Runs, units, manifests: planning, progress, gaps and integrity as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = ["pending", "running", "done", "failed"]


def plan_units(spark: SparkSession, total: int, unit_size: int, run_id: str = "run") -> DataFrame:
    """Contiguous index ranges; the last one takes the remainder."""
    if total <= 0 or unit_size <= 0:
        raise ValueError("total and unit size must be positive")
    units = spark.range(-(-total // unit_size)).withColumnRenamed("id", "unit_index")
    start = F.col("unit_index") * unit_size
    return units.select(F.lit(run_id).alias("run_id"), "unit_index", start.alias("start_index"), F.least(F.lit(unit_size), F.lit(total) - start).cast("long").alias("n"))


def apportion(shares: DataFrame, total: int, key: str, share: str) -> DataFrame:
    """Whole counts from shares in percent: each rounded, the remainder to the last slice."""
    rounded = F.round(F.col(share).cast("decimal(9,3)") * total / 100, 0).cast("long")
    w = Window.orderBy(key)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = shares.withColumn("n", rounded).withColumn("before", before)
    last = F.lead(key).over(w).isNull()
    return out.withColumn("n", F.when(last, F.lit(total) - F.col("before")).otherwise(F.col("n"))).drop("before")


def progress(units: DataFrame) -> DataFrame:
    """Units by state, states without units as zero."""
    states = units.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return states.join(units.groupBy("state").agg(F.count("*").alias("units")), "state", "left").select("state", F.coalesce("units", F.lit(0)).alias("units"))


def claimable(units: DataFrame, n: int = 1) -> DataFrame:
    """The next pending units by index."""
    return units.where("state = 'pending'").orderBy("unit_index").limit(n)


def expired(units: DataFrame, now: Column) -> DataFrame:
    return units.where((F.col("state") == "running") & (F.col("lease_until") <= now))


def step(units: DataFrame, event: str, now: Column, lease_seconds: int = 900) -> DataFrame:
    """The units' next state under an event: claim, complete, fail, reset or reclaim, where it applies."""
    state, lease = F.col("state"), F.col("lease_until")
    empty = F.lit(None).cast("timestamp")
    rules = {
        "claim": (state == "pending", "running", now + F.make_interval(secs=F.lit(lease_seconds)), 1),
        "complete": (state == "running", "done", empty, 0),
        "fail": (state == "running", "failed", empty, 0),
        "reset": (state == "failed", "pending", empty, 0),
        "reclaim": ((state == "running") & (lease <= now), "pending", empty, 0),
    }
    when, to, until, tries = rules[event]
    return units.withColumns({"state": F.when(when, F.lit(to)).otherwise(state), "lease_until": F.when(when, until).otherwise(lease), "attempts": F.col("attempts") + F.when(when, F.lit(tries)).otherwise(F.lit(0))})


def manifest_parts(items: DataFrame, unit: Column, key: str, content: str) -> DataFrame:
    """One part for each unit: documents, bytes, and a digest of the sorted document digests."""
    entry = items.select(unit.alias("unit_index"), F.col(key).alias("k"), F.sha2(F.col(content), 256).alias("sha"), F.octet_length(content).alias("size"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sha"))), lambda x: x["sha"]), ","), 256)
    return entry.groupBy("unit_index").agg(F.count("*").alias("documents"), F.sum("size").cast("long").alias("bytes"), digest.alias("part_sha"))


def gaps(parts: DataFrame, units: DataFrame) -> DataFrame:
    """Planned units without a part."""
    return units.select("unit_index").join(parts.select("unit_index"), "unit_index", "left_anti")


def verify(entries: DataFrame, blobs: DataFrame, key: str, content: str) -> DataFrame:
    """Problems of a manifest: blobs that are missing or whose digest differs."""
    found = blobs.select(F.col(key), F.sha2(F.col(content), 256).alias("actual"))
    joined = entries.join(found, key, "left")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("sha"), "altered")
    return joined.select(key, problem.alias("problem")).where("problem is not null")
