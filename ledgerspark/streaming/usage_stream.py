"""Usage telemetry as a stream: idempotent replays, watermarked windows, streaks with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import delete, exists, scratch


def rollup(events: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls and value by window and type; replayed events count once inside the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    once = stamped.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else stamped.dropDuplicates(["event_id"])
    window = F.window("ts", every)
    return once.groupBy(window, "event_type").agg(F.count("*").alias("calls"), F.sum(F.round(F.col("value") * 100, 0).cast("long")).alias("cents")).select(F.col("window.start").alias("day"), "event_type", "calls", "cents")


def breaker(calls: DataFrame, limit: int = 10) -> DataFrame:
    """Providers whose failures in a row reach a limit, with state kept between batches."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        tripped = False
        for frame in frames:
            for status in frame.sort_values("event_id")["status"]:
                streak = streak + 1 if status == "error" else 0
                tripped = tripped or streak >= limit
        state.update((streak,))
        if tripped:
            yield pd.DataFrame({"model": [key[0]], "streak": [streak]})

    return calls.groupBy("model").applyInPandasWithState(update, "model string, streak long", "streak long", "append", GroupStateTimeout.NoTimeout)


def write_usage(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream of usage rows; a batch that is replayed replaces its own rows."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def put_units(rows: DataFrame, path: str) -> None:
    """Merge usage rows (run_id, unit_index, attempt, call_index, ...) into a table that is partitioned by run and unit.

    A later attempt at a unit replaces the unit's rows, a call that comes again replaces itself, and other calls of the
    same attempt are added, whatever batches they come in.  Rows without a unit belong to the run's catalogue; a null
    attempt is the first.  Only the partitions that the rows touch are read and written.
    """
    spark = rows.sparkSession
    unit = F.when(F.col("unit_index").isNull(), "catalogue").otherwise(F.format_string("unit-%06d", "unit_index"))
    fresh = rows.withColumn("attempt", F.coalesce(F.col("attempt").cast("long"), F.lit(1).cast("long"))).withColumn("unit", unit).withColumn("_fresh", F.lit(True))
    both = fresh
    if exists(spark, path):
        touched = F.broadcast(fresh.select("run_id", "unit").distinct())  # at most as many as the batch has units
        held = spark.read.schema(fresh.drop("_fresh").schema).parquet(path).join(touched, ["run_id", "unit"], "left_semi")
        both = fresh.unionByName(held.withColumn("_fresh", F.lit(False)))
    of_unit = Window.partitionBy("run_id", "unit")
    latest = both.withColumn("_latest", F.max("attempt").over(of_unit)).where(F.col("attempt") == F.col("_latest"))
    again = Window.partitionBy("run_id", "unit", "call_index").orderBy(F.desc("_fresh"))
    one = latest.withColumn("_nth", F.row_number().over(again)).where("_nth = 1").drop("_nth", "_latest", "_fresh")
    aside = scratch(spark, "usage")  # what is replaced is read meanwhile
    one.write.parquet(aside)
    spark.read.schema(one.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "unit").parquet(path)
    delete(spark, aside)


def write_unit_usage(stream: DataFrame, path: str, checkpoint: str):
    """Keep a usage table by run and unit from a stream; batches may be replayed or cut anywhere."""
    return stream.writeStream.foreachBatch(lambda batch, _: put_units(batch, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
