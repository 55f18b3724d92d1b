"""Runs end to end: generation, shards, sinks, selection, states, streaming."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import catalogue, evaluate, golden, routing, runs, usage
from ledgerspark.operators.selection import Selection, UnsupportedConstraint, subset
from ledgerspark.plans.engine import Engine, RunSpec
from ledgerspark.plans.queries import firms
from ledgerspark.sources import shards
from ledgerspark.streaming import usage_stream


@pytest.fixture(scope="module")
def made(spark):
    spec = RunSpec("r1", total=200, unit_size=50, companies=60)
    tables = Engine(spark).generate(spec)
    return spec, {k: v.cache() for k, v in tables.items()}


def test_generated_run_balances(spark, made):
    _, t = made
    assert t["invoices"].count() == 200 == t["invoices"].select("invoice_id").distinct().count()
    assert t["invoices"].agg(F.min("line_item_count"), F.max("line_item_count")).first()[0] >= 3
    assert all(r.violations == 0 for r in golden.violations(t["invoices"]).collect())
    sums = t["line_items"].groupBy("invoice_id").agg(F.sum("extended_amount").alias("s"))
    assert t["invoices"].join(sums, "invoice_id").where("s <> subtotal").isEmpty()
    # no product comes twice before the pool is used up
    assert t["line_items"].where("line_no <= 12").groupBy("invoice_id", "sku").count().where("count > 1").isEmpty()


def test_same_run_same_rows(spark, made):
    spec, t = made
    again = Engine(spark).generate(spec)["invoices"]
    assert t["invoices"].exceptAll(again).isEmpty()


def test_one_cent_is_no_match(made):
    _, t = made
    victim = t["invoices"].agg(F.min("invoice_id")).first()[0]
    read = t["invoices"].withColumn("grand_total", F.when(F.col("invoice_id") == victim, F.col("grand_total") + Decimal("0.01")).otherwise(F.col("grand_total")))
    assert evaluate.exact_join(t["invoices"], read).where("matches").count() == 199


def test_shards_keep_types(spark, made, tmp_path):
    _, t = made
    back = Engine(spark).shard(t["invoices"], str(tmp_path / "s"))
    assert back.schema.simpleString() == t["invoices"].schema.simpleString()
    assert back.exceptAll(t["invoices"]).isEmpty() and back.count() == 200
    extreme = spark.createDataFrame([(Decimal("0.0001"), date(2026, 1, 2), None), (Decimal("12345.6789"), None, "x")], "a decimal(18,4), b date, c string")
    shards.write_shards(extreme, str(tmp_path / "e"))
    assert sorted(map(repr, shards.read_shards(spark, str(tmp_path / "e"), extreme.schema).collect())) == sorted(map(repr, extreme.collect()))


def test_publishing_twice_does_not_double(spark, made, tmp_path):
    _, t = made
    e = Engine(spark)
    first = e.publish(t, f"view:{tmp_path}/out")
    assert first == e.publish(t, f"view:{tmp_path}/out") and first["invoices"] == 200
    assert spark.sql("select count(*) from invoices join line_items using (run_id, invoice_id)").first()[0] == first["line_items"]


def test_rows_need_all_keys(spark):
    schema = spark.createDataFrame([], "a int, b string").schema
    assert shards.rows_to_frame(spark, [{"a": 1, "b": None}], schema).count() == 1
    with pytest.raises(KeyError):
        shards.rows_to_frame(spark, [{"a": 1}], schema)


def test_resume_finds_missing_units(spark, made):
    spec, t = made
    left = t["invoices"].where("unit_index <> 2")
    assert [r.unit_index for r in Engine(spark).missing_units(spec, left).collect()] == [2]


def test_selection(spark, sf):
    pool = firms(spark, sf)
    assert Selection.of({}).is_empty() and Selection.of({"locales": "all"}).is_empty()
    assert Selection.of({"wear": "crisp"}).wear == (0.0, 0.25)
    assert Selection.of({"locales": "en-US"}).merged(Selection.of({"goods_receipts": True})) == Selection(locales=("en-US",), goods_receipts=True)
    assert {r.business_type for r in Selection.of({"goods_receipts": True}).compose(pool).collect()} == {"retail", "wholesale"}
    for spec in ({"business_types": "bakery"}, {"conditions": ["wet"]}, {"wear": 2}, {"dates": ["2026-02-01", "2026-01-01"]}, {"goods_receipts": True, "business_types": "legal"}):
        with pytest.raises(UnsupportedConstraint):
            Selection.of(spec)
    for spec in ({"companies": ["nobody"]}, {"locales": ["xx-XX"]}):
        with pytest.raises(UnsupportedConstraint):
            Selection.of(spec).compose(pool)
    with pytest.raises(UnsupportedConstraint):
        subset(pool, 10**6, "company_id", check=True)
    assert subset(pool, 5, "company_id").collect() == subset(pool.repartition(7), 5, "company_id").collect()


def test_units_and_shares(spark):
    assert [tuple(r) for r in runs.plan_units(spark, 2500, 1000).select("unit_index", "start_index", "n").collect()] == [(0, 0, 1000), (1, 1000, 1000), (2, 2000, 500)]
    for bad in ((0, 5), (5, 0)):
        with pytest.raises(ValueError):
            runs.plan_units(spark, *bad)
    shares = spark.createDataFrame([(1, "33.3"), (2, "33.3"), (3, "33.4")], "no int, share string")
    assert sum(r.n for r in runs.apportion(shares, 1001, "no", "share").collect()) == 1001


def test_states_follow_events(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    unit = spark.createDataFrame([(0, "pending", None, 0)], "unit_index long, state string, lease_until timestamp, attempts int")
    claimed = runs.step(unit, "claim", now)
    assert claimed.first().state == "running" and claimed.first().attempts == 1
    assert runs.step(claimed, "reclaim", now).first().state == "running"
    assert runs.step(claimed, "reclaim", now + F.make_interval(secs=F.lit(900))).first().state == "pending"
    assert runs.step(runs.step(claimed, "fail", now), "reset", now).first().state == "pending"
    assert runs.step(claimed, "complete", now).first().lease_until is None


def test_routing_follows_the_mix(spark):
    shares = {r.provider: r["count"] / 20_000 for r in routing.route(spark.range(20_000), F.col("id")).groupBy("provider").count().collect()}
    assert all(abs(shares[p] - w / 100) < 0.02 for p, w in routing.MIX)


def test_companies_do_not_depend_on_the_range(spark):
    whole = catalogue.companies(spark, 0, 50)
    parts = catalogue.companies(spark, 0, 20).union(catalogue.companies(spark, 20, 50))
    assert whole.exceptAll(parts).isEmpty()
    with pytest.raises(ValueError):
        catalogue.products(spark, whole, 10**6)


def test_strict_rows_raise(spark):
    rows = spark.createDataFrame([(1,), (-1,)], "a int")
    with pytest.raises(Exception, match="not negative"):
        golden.strict(rows, F.col("a") > 0, "not negative").collect()


def test_streaks(spark):
    rows = [(i, "m", s) for i, s in enumerate(["ok", "error", "error", "ok", "error", "error", "error"])]
    got = usage.failure_streaks(spark.createDataFrame(rows, "event_id long, model string, status string")).first()
    assert (got.longest_streak, got.streaks) == (3, 2)


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in/a"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in/*"))
    usage_stream.rollup(stream).writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("rolled").exceptAll(usage_stream.rollup(events)).isEmpty() and spark.table("rolled").count() > 0
    usage_stream.write_usage(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()


def test_stream_breaker(spark, sf, tmp_path):
    rows = [(i, "m" if i % 2 else "n", "error" if i % 2 else "ok") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, model string, status string").write.parquet(str(tmp_path / "c/a"))
    stream = spark.readStream.schema("event_id long, model string, status string").parquet(str(tmp_path / "c/*"))
    usage_stream.breaker(stream).writeStream.format("memory").queryName("tripped").outputMode("append").option("checkpointLocation", str(tmp_path / "k")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("tripped").collect()] == [("m", 20)]
