"""Usage telemetry: call costs, spend roll-up, budget prefix, failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import PRICES, to_nano, token_cost


def prices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(PRICES, "model string, p_in string, p_out string, p_cached string")
    return rows.select("model", *(F.col(c).cast("decimal(8,4)").alias(c) for c in ("p_in", "p_out", "p_cached")))


def calls(events: DataFrame) -> DataFrame:
    """Events as model calls: tokens from the payload and the user, errors as failed calls without tokens."""
    spark = events.sparkSession
    model = F.element_at(F.array(*map(F.lit, ["deepseek-v4-flash", "qwen3.5-flash", "claude-haiku-4-5", "local"])), (F.col("user_id") % 4 + 1).cast("int"))
    failed = F.col("event_type") == "error"
    tokens = F.when(failed, F.lit(0)).otherwise(F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)))
    raw = events.select(
        "event_id", "ts", model.alias("model"), F.when(failed, "error").otherwise("ok").alias("status"), tokens.alias("input_tokens"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.col("user_id")).alias("output_tokens"), F.floor(tokens / 2).cast("long").alias("cached_input_tokens"), (F.col("event_type") == "view").alias("is_batch"),
    )
    rated = raw.join(F.broadcast(prices(spark)), "model", "left")  # a fixed handful of rows
    cost = token_cost(F.col("input_tokens"), F.col("output_tokens"), F.col("cached_input_tokens"), (F.col("p_in"), F.col("p_out"), F.col("p_cached")), F.col("is_batch"))
    return rated.withColumn("cost_usd", cost).withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")).drop("p_in", "p_out", "p_cached")


def spend(usage: DataFrame) -> DataFrame:
    """Integer nano-dollars by model, with a '*' row for all: one pass, partial sums before the shuffle."""
    nano = usage.select("model", to_nano(F.col("cost_usd")).alias("nano"), "total_tokens")
    return nano.rollup("model").agg(F.sum("nano").alias("nano"), F.sum("total_tokens").alias("tokens"), F.count("*").alias("calls")).withColumn("model", F.coalesce("model", F.lit("*")))


#: Calls whose numbers fall in one bucket of a running total.
BUCKET = 65_536


def _bucketed(usage: DataFrame, by: str, order: str) -> DataFrame:
    return usage.withColumn("_bucket", F.expr(f"`{order}` div {BUCKET}"))


def budget_prefix(usage: DataFrame, limit: Column, by: str = "model", order: str = "event_id") -> DataFrame:
    """The calls, in order, that fit a budget for each group: spent before plus own cost within the limit.

    Running sums are taken inside buckets of the order; buckets, a small table, are summed up before them.
    """
    calls = _bucketed(usage, by, order)
    sums = calls.groupBy(by, "_bucket").agg(F.sum("cost_usd").alias("_sum"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = calls.join(starts, [by, "_bucket"]).withColumn("spent", (F.col("_before") + F.sum("cost_usd").over(within)).cast("decimal(28,12)"))
    return running.where(F.col("spent") <= limit).select(*usage.columns, "spent")


def _joined(a: Column, b: Column) -> Column:
    """Two neighbouring stretches of calls as one: size, failures it begins and ends with, and the longest run and number of
    runs that touch neither end.  A stretch of failures alone begins and ends with all of them."""
    full_a, full_b, middle = a["lead"] == a["size"], b["lead"] == b["size"], a["trail"] + b["lead"]
    inner = ~full_a & ~full_b & (middle > 0)
    return F.struct(
        (a["size"] + b["size"]).alias("size"),
        F.when(full_a, a["size"] + b["lead"]).otherwise(a["lead"]).alias("lead"),
        F.when(full_b, a["trail"] + b["size"]).otherwise(b["trail"]).alias("trail"),
        F.greatest(a["longest"], b["longest"], F.when(inner, middle).otherwise(F.lit(0).cast("long"))).alias("longest"),
        (a["runs"] + b["runs"] + F.when(inner, 1).otherwise(0)).alias("runs"),
    )


def failure_streaks(usage: DataFrame, by: str = "model", order: str = "event_id") -> DataFrame:
    """The longest run of consecutive failures of each group.

    A bucket of the order is folded into one stretch, buckets of stretches into longer ones, and the few that are left into
    the group's: no group of calls is gathered, and each level is one pass.
    """
    zero = F.lit(0).cast("long")
    none = F.struct(*(zero.alias(n) for n in ("size", "lead", "trail", "longest", "runs")))
    failed = F.when(F.col("status") == "error", 1).otherwise(0).cast("long")
    rows = usage.select(F.col(by), F.col(order).cast("long").alias("_place"), F.struct(F.lit(1).cast("long").alias("size"), failed.alias("lead"), failed.alias("trail"), zero.alias("longest"), zero.alias("runs")).alias("_part"))
    for level in (BUCKET, BUCKET, None):
        place = F.expr(f"_place div {level}") if level else F.lit(0).cast("long")
        parts = rows.groupBy(by, place.alias("_above")).agg(F.array_sort(F.collect_list(F.struct("_place", "_part"))).alias("_parts"))
        rows = parts.select(by, F.col("_above").alias("_place"), F.aggregate("_parts", none, lambda a, x: _joined(a, x["_part"])).alias("_part"))
    full, whole = F.col("_part.lead") == F.col("_part.size"), F.col("_part.size")
    longest = F.when(full, whole).otherwise(F.greatest("_part.longest", "_part.lead", "_part.trail"))
    edges = F.when(F.col("_part.lead") > 0, 1).otherwise(0) + F.when(F.col("_part.trail") > 0, 1).otherwise(0)
    runs = F.when(full, F.least(whole, F.lit(1))).otherwise(F.col("_part.runs") + edges).cast("long")
    return rows.select(by, longest.alias("longest_streak"), runs.alias("streaks")).where("streaks > 0")


def running_max(usage: DataFrame, by: str = "model", order: str = "event_id") -> DataFrame:
    """The greatest number of output tokens so far, from buckets as in the running sums."""
    calls = _bucketed(usage, by, order)
    tops = calls.groupBy(by, "_bucket").agg(F.max("output_tokens").alias("_top"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = tops.select(by, "_bucket", F.max("_top").over(before).alias("_before"))
    within = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return calls.join(starts, [by, "_bucket"]).withColumn("observed_max", F.greatest("_before", F.max("output_tokens").over(within))).select(*usage.columns, "observed_max")
