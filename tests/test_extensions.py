"""Packs, providers and overlays."""

import pytest
from pyspark.sql import functions as F

from ledgerspark.plans import extensions
from ledgerspark.plans.engine import RunSpec


def test_registry(spark):
    r = extensions.Registry()
    assert r.add(extensions.InvoicePack) is r.add(extensions.InvoicePack)

    class Other:
        name = "invoice"

    with pytest.raises(ValueError):
        r.add(Other)
    with pytest.raises(KeyError, match="invoice"):
        r.get("receipt")
    made = extensions.REGISTRY.get("invoice").generate(spark, RunSpec("x", total=5, companies=20))
    assert set(made) == set(extensions.InvoicePack.tables) and made["invoices"].count() == 5


def test_fill(spark):
    def answer(ids):
        # the first round leaves one item empty and one breaks a rule; the second only the latter
        out = []
        for i in ids:
            name, turn = i.split("#r")
            out.append("" if name == "b" and turn == "0" else "write to me@x.org" if name == "c" else f"Steel bracket {name}")
        return out

    rows = spark.createDataFrame([(k, f"plain {k}") for k in "abc"], "item_id string, description string")
    done, left = extensions.fill(rows, answer, rounds=2)
    assert left == 1
    assert {r.item_id: r.description for r in done.collect()} == {"a": "Steel bracket a", "b": "Steel bracket b", "c": "plain c"}


def test_complete(spark):
    items = spark.range(10).select(F.col("id").cast("string").alias("item_id"))
    got = extensions.complete(items, lambda ids: ["" if i == "3" else "x" for i in ids]).groupBy("status").count().collect()
    assert {r.status: r["count"] for r in got} == {"ok": 9, "empty": 1}
    with pytest.raises(Exception, match="every item"):
        extensions.complete(items, lambda ids: []).collect()
