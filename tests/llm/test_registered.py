"""The registered queries on the smallest tables."""

import sys

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [f"op{n}_" for n in range(1, 14)]


def test_all_are_registered():
    names = list(entry.queries())
    assert all(sum(n.startswith(p) for n in names) == 1 for p in NAMES) and "pipeline" in names


@pytest.mark.parametrize("name", ["op5_exact_topk", "op6_secret_scan", "op11_chat_formats", "op13_hard_negatives"])
def test_same_as_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = entry.queries()[name](spark, sf), c.sql(entry.oracle_sql()[name])
    at = [want.columns.index(n) for n in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("missing", ["ledgerspark.llm", "ahocorasick"])
def test_the_rest_works_without(monkeypatch, missing):
    import ledgerspark

    for name in [n for n in sys.modules if n.startswith("ledgerspark.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(ledgerspark, "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries()) and "golden_invoices" in entry.queries()
    assert "op6_secret_scan" not in entry.oracle_sql()
