"""A run's budget over many workers as a stream: calls are admitted on a view of the spend that is stale within bounds.

Every worker of a run keeps what it has spent to itself until ``flush_every`` calls have been made or ``refresh_seconds`` have
gone by, and only then adds it to the run's total and looks at that total anew.  So what it doesn't know of is at most
``flush_every`` calls of every other worker, and the admitted calls cost at most ``overshoot`` more than the limit.  With
``flush_every=1`` and ``refresh_seconds=0`` nothing is overspent.

State is kept by run: the total, and for each worker what is pending and what it has seen; a timer adds what a silent
worker has pending.  A run's calls are taken in the order of their time within a batch, so they pass through one task, as
does the counter they stand for.  Amounts are whole billionths.

Cases: null costs and estimates are 0; a call that is not admitted spends nothing; null times count as the earliest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DECISIONS = "run_id string, worker string, call long, admitted boolean, seen_nano long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def overshoot(workers: int, flush_every: int, dearest: int, error: int = 0) -> int:
    """What the admitted calls may cost beyond the limit: unseen calls of the other workers at the dearest call's cost, and by
    how much one call may cost more than estimated, for each worker."""
    return max(0, workers - 1) * flush_every * dearest + workers * error


class Guard(StatefulProcessor):
    """Admission of one run's calls."""

    def __init__(self, limit: int, flush_every: int, refresh_seconds: float):
        self.limit, self.flush_every, self.refresh = limit, max(1, flush_every), max(0.0, refresh_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "nano long")
        self.workers = handle.getMapState("workers", "worker string", "pending long, calls long, seen long, at double")

    def _shared(self) -> int:
        return self.total.get()[0] if self.total.exists() else 0

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["at", "worker", "call"], kind="stable")
        shared, held, out = self._shared(), {}, []
        for r in frame.itertuples(index=False):
            if r.worker not in held:
                held[r.worker] = list(self.workers.getValue((r.worker,))) if self.workers.containsKey((r.worker,)) else [0, 0, 0, float("-inf")]
            w = held[r.worker]

            def flush(w: list = w, at: float = r.at) -> None:
                nonlocal shared
                shared += w[0]
                w[:] = [0, 0, shared, at]

            if r.at - w[3] >= self.refresh:
                flush()
            if w[2] + w[0] + r.estimate > self.limit:
                flush()  # the last word is the run's
            admitted = w[2] + w[0] + r.estimate <= self.limit
            if admitted:
                w[0], w[1] = w[0] + r.cost, w[1] + 1
                if w[1] >= self.flush_every:
                    flush()
            out.append((key[0], r.worker, r.call, admitted, w[2] + w[0]))
        for worker, w in held.items():
            self.workers.updateValue((worker,), tuple(w))
        self.total.update((shared,))
        if any(w[0] for w in held.values()):
            self.handle.registerTimer(int((float(frame["at"].max()) + self.refresh) * 1000) + 1)
        yield pd.DataFrame(out, columns=["run_id", "worker", "call", "admitted", "seen_nano"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Add what workers have pending to the run's total."""
        shared = self._shared()
        for worker, (pending, _, _, at) in [(k[0], v) for k, v in self.workers.iterator()]:
            if pending:
                shared += pending
                self.workers.updateValue((worker,), (0, 0, shared, at))
        self.total.update((shared,))
        return iter(())

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, limit_nano: int, flush_every: int = 20, refresh_seconds: float = 5.0, late: str = "10 seconds") -> DataFrame:
    """Decisions on a stream of calls (run_id, worker, call, ts, estimate_nano, cost_nano), in append mode.

    The session needs the RocksDB state store (``PROVIDER``).
    """
    spent = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    rows = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    ready = rows.select("run_id", "worker", F.col("call").cast("long").alias("call"), "ts", F.coalesce(F.unix_micros("ts") / 1e6, F.lit(0.0)).alias("at"), spent("estimate_nano").alias("estimate"), spent("cost_nano").alias("cost"))
    return ready.groupBy("run_id").transformWithStateInPandas(statefulProcessor=Guard(limit_nano, flush_every, refresh_seconds), outputStructType=DECISIONS, outputMode="Append", timeMode="EventTime")
