"""Counter-based draws: every value is a pure function of (run, index, name), so any layout gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = "run"


def stable_seed(run_id: str, index: Column) -> Column:
    """Unsigned 64-bit seed of (run, index): the first eight bytes of SHA-256, as decimal(20,0)."""
    digest = F.sha2(F.concat(F.lit(run_id), F.lit("\0"), index.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def hash52(name: str, *keys: Column, run_id: str = RUN) -> Column:
    """52-bit integer of (run, keys, draw name)."""
    text = F.concat_ws("/", F.lit(run_id), *(k.cast("string") for k in keys), F.lit(name))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def below(name: str, percent: int, *keys: Column) -> Column:
    """True for about ``percent`` of a hundred draws."""
    return hash52(name, *keys) % 100 < percent


def pick(name: str, options: list, *keys: Column) -> Column:
    """One of a few literal options, evenly."""
    return F.element_at(F.array(*map(F.lit, options)), (hash52(name, *keys) % len(options) + 1).cast("int"))


#: Key ranges that weights are summed up in, each by itself.
RANGES = 256


def cumulative(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Integer weights as half-open ranges in the order of the key: adds ``lo``, ``hi`` and ``total``.

    Rows are cut into at most ``RANGES`` key ranges at bounds that are settled first; each range sums up its own rows, and
    only the ranges' sums meet in one task.
    """
    share = min(1.0, 65_536 / max(1, weights.count()))
    marks = [r[0] for r in weights.sample(share, seed=1).select(key).distinct().orderBy(key).collect()]
    bounds = sorted({marks[i * len(marks) // RANGES] for i in range(1, RANGES)}) if len(marks) > RANGES else []
    if not bounds:  # few keys: one range
        whole = Window.partitionBy(F.lit(1))
        upto = whole.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        out = weights.withColumn("hi", F.sum(weight).over(upto)).withColumn("total", F.sum(weight).over(whole))
        return out.withColumn("lo", F.col("hi") - F.col(weight)).select(*weights.columns, "hi", "lo", "total")
    # the number of bounds at or below the key
    cut = weights.withColumn("_part", F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(key))))
    sums = cut.groupBy("_part").agg(F.sum(weight).alias("_sum"))
    order = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_start"), F.sum("_sum").over(Window.partitionBy(F.lit(1))).alias("total"))
    running = F.sum(weight).over(Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    # one row a range, so the broadcast is bounded by their number
    out = cut.join(F.broadcast(starts), "_part").withColumn("hi", F.col("_start") + running)
    return out.withColumn("lo", F.col("hi") - F.col(weight)).select(*weights.columns, "hi", "lo", "total")


def weighted_draw(rows: DataFrame, draw: Column, ranges: DataFrame, total: int, buckets: int | None = None) -> DataFrame:
    """Join each row to the range its draw falls in.

    Ranges are exploded into the integer buckets they touch, as many buckets as ranges if none are given, which turns the
    range join into an equi-join with a residual predicate: there are at most twice as many entries as ranges, and a row
    meets two of them on average.
    """
    width = max(1, -(-total // (buckets or max(1, ranges.count()))))
    point = rows.withColumn("_point", F.pmod(draw, F.lit(total))).withColumn("_bucket", F.expr(f"_point div {width}"))
    spread = ranges.where("hi > lo").withColumn("_bucket", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    hit = point.join(spread, "_bucket").where((F.col("_point") >= F.col("lo")) & (F.col("_point") < F.col("hi")))
    return hit.drop("_bucket", "_point", "lo", "hi", "total")
