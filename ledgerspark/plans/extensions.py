"""Extension points: packs that yield tables, sinks by scheme, providers that answer items; and a registry for them."""

from __future__ import annotations

import importlib.metadata
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import findings_of_stripped, stripped
from ..operators import catalogue, gates
from .engine import Engine, RunSpec


class Pack(Protocol):
    """A document type: its name, its tables, and how a run of it is made."""

    name: str
    tables: tuple[str, ...]

    def generate(self, spark: SparkSession, spec: RunSpec) -> dict[str, DataFrame]: ...


class InvoicePack:
    name, tables = "invoice", ("invoices", "line_items", "tax_buckets")

    def generate(self, spark: SparkSession, spec: RunSpec) -> dict[str, DataFrame]:
        return Engine(spark).generate(spec)


class Registry:
    """Packs by name: the same class may come twice, another one under a taken name may not."""

    def __init__(self) -> None:
        self._packs: dict[str, type] = {}

    def add(self, pack: type) -> type:
        held = self._packs.setdefault(pack.name, pack)
        if held is not pack:
            raise ValueError(f"pack {pack.name!r} is taken by {held.__name__}")
        return pack

    def discover(self, group: str = "ledgerspark.packs") -> None:
        for point in importlib.metadata.entry_points(group=group):
            self.add(point.load())

    def get(self, name: str) -> Pack:
        if name not in self._packs:
            raise KeyError(f"no pack {name!r}; known: {', '.join(sorted(self._packs))}")
        return self._packs[name]()


REGISTRY = Registry()
REGISTRY.add(InvoicePack)

#: A provider answers item ids with texts; it runs on executors, a group of items at a time.
Provider = Callable[[list[str]], list[str]]


def complete(items: DataFrame, provider: Provider, key: str = "item_id") -> DataFrame:
    """Ask a provider for every item: (key, text, status); an empty text is a failure."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = provider(frame[key].tolist())
            if len(texts) != len(frame):
                raise ValueError("a provider must answer every item")
            yield pd.DataFrame({key: frame[key], "text": texts, "status": ["ok" if (t or "").strip() else "empty" for t in texts]})

    return items.select(key).mapInPandas(run, f"`{key}` string, text string, status string")


def fill(skeleton: DataFrame, provider: Provider, key: str = "item_id", column: str = "description", rounds: int = 3) -> tuple[DataFrame, int]:
    """Lay a provider's texts over a skeleton, asking again for what was empty or broke a rule; (rows, left over)."""
    done, waiting = None, skeleton
    for turn in range(rounds):
        asked = waiting.withColumn("_ask", F.concat(F.col(key), F.lit(f"#r{turn}")))
        answers = complete(asked, provider, "_ask").withColumn(key, F.element_at(F.split("_ask", "#r"), 1))
        bad = gates.gate_findings(answers, key, "text").select(key).distinct()
        good = answers.where("status = 'ok'").join(bad, key, "left_anti").select(key, F.col("text").alias(column))
        laid = catalogue.overlay(waiting, good, [key], column)
        ready = laid.where("filled").drop("filled")
        done = ready if done is None else done.unionByName(ready)
        waiting = laid.where("not filled").drop("filled").checkpoint()
        if waiting.isEmpty():
            break
    return done.unionByName(waiting), waiting.count()


def judged(skeleton: DataFrame, column: str, reply: str, band_fits: Column) -> DataFrame:
    """A skeleton with its replies laid over where they are usable, and what became of each: ``filled``, ``rejected`` (the
    reply breaks a rule) and ``bad_band`` (filled, but the price band doesn't fit)."""
    said = stripped(F.coalesce(F.col(reply), F.lit("")))
    ready = skeleton.withColumn("_said", said).withColumn("_bad", F.size(findings_of_stripped(F.col("_said"))) > 0)
    ready = ready.withColumn("rejected", (F.col("_said") != "") & F.col("_bad")).withColumn("filled", (F.col("_said") != "") & ~F.col("_bad"))
    laid = ready.withColumn("bad_band", F.col("filled") & ~band_fits)
    return laid.withColumn(column, F.when(F.col("filled"), F.col("_said")).otherwise(F.col(column))).drop("_said", "_bad", reply)


def _measures() -> list[Column]:
    count = lambda c: F.count(F.when(c, 1))
    filled = count(F.col("filled"))
    return [F.count("*").alias("products"), filled.alias("llm_filled"), count(~F.col("filled")).alias("procedural_fallback"), count(F.col("rejected")).alias("rejected_descriptions"), count(F.col("bad_band")).alias("bad_price_bands")]


def build_report(rows: DataFrame) -> DataFrame:
    """Counts of a judged build and the filled fraction to four decimals (0 of nothing)."""
    share = F.when(F.col("products") == 0, F.lit(0)).otherwise(F.round(F.col("llm_filled") * 10000 / F.col("products"), 0))
    return rows.agg(*_measures()).withColumn("llm_fraction", (share.cast("decimal(9,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(9,4)"))


def write_with_report(rows: DataFrame, path: str) -> dict:
    """Write a judged build; its report is counted while the rows are written, without another pass."""
    seen = Observation("build")
    rows.observe(seen, *_measures()).drop("rejected", "bad_band").write.mode("overwrite").parquet(path)
    report = dict(seen.get)
    return report | {"llm_fraction": round(report["llm_filled"] / report["products"], 4) if report["products"] else 0.0}
