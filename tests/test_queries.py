"""Every registered query of the library against its SQL twin."""

import decimal

import duckdb
import pytest

from ledgerspark.operators import golden, records
from ledgerspark.plans.build_queries import BUILT, BUILT_SQL
from ledgerspark.plans.more_queries import ALL, MORE_SQL
from ledgerspark.plans.oracle import ORACLE as FIRST_SQL
from ledgerspark.plans.record_queries import RECORD_SQL, RECORDS

QUERIES, ORACLE = ALL | RECORDS | BUILT, FIRST_SQL | MORE_SQL | RECORD_SQL | BUILT_SQL


def norm(v):
    if isinstance(v, decimal.Decimal):
        return "d", v.normalize() if v else decimal.Decimal(0)
    return v


@pytest.fixture(scope="module")
def duck():
    from pathlib import Path

    c = duckdb.connect()
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def test_each_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(repr([norm(r[c]) for c in order]) for r in got.toArrow().to_pylist())
    at = [want.columns.index(c) for c in order]
    assert a == sorted(repr([norm(r[i]) for i in at]) for r in want.fetchall())


def test_whole_records(spark, sf):
    rows = QUERIES["invoice_rows"](spark, sf)
    assert len(rows.columns) == 52 and len(QUERIES["line_item_rows"](spark, sf).columns) == 39
    notes = rows.where("goods_receipt").select("invoice_id", "issue_date", "received_date", "is_handwritten").collect()
    assert all(r.is_handwritten and 0 <= (r.received_date - r.issue_date).days <= 6 for r in notes)


def test_declared_types(spark, sf):
    whole, lines = records.invoice_rows(spark, sf), records.line_rows(spark, sf)
    assert [(f.name, f.dataType) for f in whole.schema] == [(f.name, f.dataType) for f in records.schema_of(records.INVOICE_COLUMNS)]
    assert [(f.name, f.dataType) for f in lines.schema] == [(f.name, f.dataType) for f in records.schema_of(records.LINE_COLUMNS)]
    kinds = dict(whole.dtypes) | dict(lines.dtypes)
    assert kinds["billing_models"] == "array<string>" and kinds["wear"] == "double" and kinds["tier_upper"] == "decimal(18,4)" and kinds["discount_percent"] == "decimal(9,4)" and kinds["page_count"] == "int"
    cut = lines.where("discount_percent is not null and tier_index is null")
    assert cut.count() > 0 and cut.where("abs(discount_amount - (extended_amount + discount_amount) * discount_percent / 100) > 0.01").count() == 0
    assert lines.where("tier_index is null and abs(quantity * unit_price - discount_amount - extended_amount) > 0.01 + quantity * 0.00005").count() == 0


def test_delivery_notes_fall_back_to_all_lines(spark):
    lines = spark.createDataFrame([(1, 1, "fee"), (1, 2, "product"), (1, 3, "part"), (2, 1, "fee"), (2, 2, "labour")], "invoice_index long, line_no long, kind string")
    got = {(r.invoice_index, r.line_no): (r.delivery_no, r.fallback) for r in records.delivery_lines(lines).collect()}
    assert got == {(1, 2): (1, False), (1, 3): (2, False), (2, 1): (1, True), (2, 2): (2, True)}
    assert records.delivery_lines(lines, most=1).count() == 2


def test_layout_does_not_change_rows(spark, sf):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = lambda: sorted(map(repr, QUERIES["golden_invoices"](spark, sf).collect()))
    one = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert rows() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_range_joins_are_equi_joins(spark, sf):
    plan = QUERIES["weighted_cdf_draw"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scan_reads_only_what_is_asked_for(spark, sf):
    plan = QUERIES["spend_rollup"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<user_id:bigint,event_type:string,props:string>" in plan.replace("event_id:bigint,", "")


def test_tasks_follow_the_lines(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    whole = sorted(map(tuple, golden.parent_lines(spark, sf).collect()))
    monkeypatch.setattr(golden, "LINES_PER_TASK", lines // 40)
    dealt = golden.parent_lines(spark, sf)
    assert dealt.rdd.getNumPartitions() >= 40 and sorted(map(tuple, dealt.collect())) == whole


@pytest.mark.parametrize("name", ["page_fill", "spanning_sections"])
def test_pages_number_the_lines_once(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # one window for the lines' numbers, and two over sections
    assert plan.count("l_partkey") and plan.count("Relation [") == 1 and plan.count("Window [") <= 3


def test_invoices_sum_the_lines_once(spark, sf):
    plan = QUERIES["invoice_rows"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("Relation [l_orderkey") == 1 and plan.count("Relation [o_orderkey") == 1 and "collect_set" not in plan
