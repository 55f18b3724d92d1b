"""Usage by run and unit, and budgets, as streams that are cut and replayed."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.streaming import budget, usage_stream

USAGE = "run_id string, unit_index long, attempt long, call_index long, model string, cost_nano long"


def drop(folder, name, rows, columns):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(columns, r, strict=True))) for r in rows))


def test_units_are_replaced_by_their_key(spark, tmp_path):
    names = [c.split()[0] for c in USAGE.split(", ")]
    path, where = str(tmp_path / "usage"), tmp_path / "in"

    def run():
        usage_stream.write_unit_usage(spark.readStream.schema(USAGE).json(str(where)), path, str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.run_id, r.unit, r.attempt, r.call_index, r.cost_nano) for r in spark.read.parquet(path).collect())

    drop(where, "a", [("r1", 1, 1, n, "m", n) for n in range(3)] + [("r1", 2, 1, 0, "m", 7), ("r2", 1, 1, 0, "m", 9), ("r1", None, None, 0, "m", 5)], names)
    first = run()
    assert len(first) == 6 and ("r1", "catalogue", 1, 0, 5) in first
    # the same rows again, in another batch
    drop(where, "b", [("r1", 1, 1, n, "m", n) for n in range(3)], names)
    assert run() == first
    # further calls of a unit's attempt are added; a later attempt replaces the unit; other runs stay
    drop(where, "c", [("r1", 2, 1, 1, "m", 8), ("r1", 1, 2, 0, "m", 100), ("r1", None, None, 1, "m", 6)], names)
    third = run()
    assert third == sorted([("r1", "unit-000001", 2, 0, 100), ("r1", "unit-000002", 1, 0, 7), ("r1", "unit-000002", 1, 1, 8), ("r2", "unit-000001", 1, 0, 9), ("r1", "catalogue", 1, 0, 5), ("r1", "catalogue", 1, 1, 6)])
    # an attempt that is over does not come back
    drop(where, "d", [("r1", 1, 1, 5, "m", 1)], names)
    assert run() == third


CALLS = "run_id string, worker string, call long, ts timestamp, estimate_nano long, cost_nano long"


@pytest.mark.parametrize("flush_every,refresh,workers", [(1, 0.0, 4), (5, 30.0, 4), (20, 5.0, 3)])
def test_overshoot_is_bounded(spark, tmp_path, flush_every, refresh, workers):
    rng = random.Random(flush_every)
    names, where, limit = [c.split()[0] for c in CALLS.split(", ")], tmp_path / "in", 20_000
    rows = []
    for run in ("r1", "r2"):
        for n in range(240):
            cost = rng.randint(50, 300)
            rows.append((run, f"w{rng.randrange(workers)}", n, f"2026-01-01T00:{n // 60:02d}:{n % 60:02d}", 300, cost))
    for k in range(4):
        drop(where, f"{k}", rows[k * 120 : (k + 1) * 120], names)
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", budget.PROVIDER)
    try:
        calls = spark.readStream.schema(CALLS).option("maxFilesPerTrigger", 1).json(str(where))
        decided = budget.admitted(calls, limit, flush_every, refresh, late="1 hour")
        decided.writeStream.format("memory").queryName(f"decided_{flush_every}").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    cost = {(r[0], r[2]): r[5] for r in rows}
    got = spark.table(f"decided_{flush_every}").collect()
    assert len(got) == 480
    for run in ("r1", "r2"):
        spent = sum(cost[run, r.call] for r in got if r.run_id == run and r.admitted)
        assert limit - 300 <= spent + 300 and spent <= limit + budget.overshoot(workers, flush_every, 300)
    assert any(not r.admitted for r in got)
    if flush_every == 1:
        assert all(r.seen_nano <= limit for r in got)
