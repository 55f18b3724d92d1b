"""Weighted draws in constant time: every choice has a slot of equal size, shared with at most one other choice.

The table is exact in whole numbers: of n choices with total weight W, a slot is W wide, and choice i fills n * weight(i)
of all the slots.  A draw takes a slot and a point in it, so a row meets one entry however many choices there are and
however uneven their weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .draws import hash52

#: Choices that are gathered to make a table, at most; beyond it use :func:`.draws.weighted_draw`.
MOST = 1 << 16


def alias_table(weights: list[int]) -> list[tuple[int, int]]:
    """(points that stay with the slot's own choice, the other choice) of every slot."""
    if not weights or min(weights) < 0 or not sum(weights):
        raise ValueError("weights must not be negative and must add up to more than nothing")
    n, total = len(weights), sum(weights)
    left = [n * w for w in weights]
    small = [i for i in reversed(range(n)) if left[i] < total]
    large = [i for i in reversed(range(n)) if left[i] >= total]
    out = [(total, i) for i in range(n)]
    while small:
        i, j = small.pop(), large[-1]
        out[i] = (left[i], j)
        left[j] -= total - left[i]
        if left[j] < total:
            small.append(large.pop())
    return out


def drawn(rows: DataFrame, draw: str, key: Column, choices: DataFrame, name: str, weight: str, run_id: str = "run") -> DataFrame:
    """Give each row a choice in proportion to whole weights: adds the column ``name``.

    The choices, ``MOST`` of them at most, are put in the order of their names.
    """
    known = choices.select(name, F.col(weight).cast("long").alias("w")).orderBy(name).limit(MOST + 1).collect()
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} choices")
    table = alias_table([r.w for r in known])
    total = sum(r.w for r in known)
    kind = choices.schema[name].dataType.simpleString()
    entries = [(i, keep, known[i][0], known[other][0]) for i, (keep, other) in enumerate(table)]
    slots = rows.sparkSession.createDataFrame(entries, f"_slot long, _keep long, _own {kind}, _other {kind}")
    at = rows.withColumn("_draw", hash52(draw, key, run_id=run_id)).withColumn("_slot", F.col("_draw") % len(known)).withColumn("_point", F.expr(f"_draw div {len(known)}") % total)
    hit = at.join(F.broadcast(slots), "_slot")
    return hit.withColumn(name, F.when(F.col("_point") < F.col("_keep"), F.col("_own")).otherwise(F.col("_other"))).drop("_draw", "_slot", "_point", "_keep", "_own", "_other")
