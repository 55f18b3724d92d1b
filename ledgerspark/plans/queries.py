"""Registered queries: every operator of the library applied to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, locale, money, text
from ..operators import catalogue, evaluate, gates, golden, routing, runs, selection, usage
from ..operators.golden import table
from ..streaming import usage_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEAD = ["invoice_id", "invoice_index", "company_id", "invoice_number", "issue_date", "due_date", "jurisdiction", "currency", "locale", "line_item_count", "subtotal", "discount_scheme", "discount_timing", "discount_total", "shipping_total", "taxable_base", "tax_total", "tax_bucket_count", "deposit", "grand_total"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def firms(spark: SparkSession, d: str) -> DataFrame:
    """Customers as companies."""
    places = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % len(golden.JURISDICTIONS)).alias("jurisdiction_no")).join(F.broadcast(golden.jurisdictions(spark)), "jurisdiction_no")
    kind = F.element_at(F.array(*map(F.lit, selection.BUSINESS_TYPES)), (F.col("c_custkey") % len(selection.BUSINESS_TYPES) + 1).cast("int"))
    return table(spark, d, "customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(F.format_string("c%06d", "c_custkey").alias("company_id"), kind.alias("business_type"), "locale")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Orders as work units."""
    state = F.element_at(F.array(*map(F.lit, runs.STATES[:3])), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_index"), state.alias("state"), F.col("o_orderdate").cast("timestamp").alias("lease_until"), F.lit(0).cast("long").alias("attempts"))


def calls(spark: SparkSession, d: str) -> DataFrame:
    return usage.calls(table(spark, d, "events"))


@query
def golden_invoices(spark, d):
    return golden.invoices(spark, d).select(*HEAD)


@query
def golden_line_items(spark, d):
    return golden.printed_rows(spark, d)


@query
def line_tax_buckets(spark, d):
    return golden.tax_buckets(spark, golden.bases(spark, d))


@query
def reconcile_totals_violations(spark, d):
    return golden.violations(golden.invoices(spark, d))


@query
def line_sum_check(spark, d):
    sums = golden.parent_lines(spark, d).groupBy("invoice_index").agg(money.sum_money(F.col("amount")).alias("lines"))
    return golden.invoices(spark, d).join(sums, "invoice_index").agg(F.count("*").alias("invoices"), F.count(F.when(F.col("lines") != F.col("subtotal"), 1)).alias("differing"))


@query
def tax_sum_check(spark, d):
    sums = golden.tax_buckets(spark, golden.bases(spark, d)).groupBy("invoice_index").agg(money.sum_money(F.col("tax_amount")).alias("buckets"))
    joined = golden.invoices(spark, d).join(sums, "invoice_index")
    return joined.groupBy("jurisdiction").agg(F.count("*").alias("invoices"), money.sum_money(F.col("tax_total")).alias("tax_total"), F.count(F.when(F.col("buckets") != F.col("tax_total"), 1)).alias("differing"))


def _tiered(spark, d, how):
    lines = golden.parent_lines(spark, d).where("billing_model = 'graduated_tier'").withColumn("units", F.col("quantity") * 3000)
    return golden.tiered(lines, spark, how)


@query
def tier_graduated(spark, d):
    return _tiered(spark, d, "graduated").select("invoice_index", "line_no", "tier_index", "units_in_tier", "tier_amount")


@query
def tier_volume(spark, d):
    return _tiered(spark, d, "volume").select("invoice_index", "line_no", "tier_index", "units_in_tier", "tier_amount")


@query
def tier_sum_check(spark, d):
    both = _tiered(spark, d, "graduated").withColumnRenamed("tier_amount", "g")
    reached = F.when((F.col("units") > F.col("lo")) & (F.col("units") <= F.coalesce(F.col("hi"), F.lit(2**62))), F.col("units")).otherwise(F.lit(0))
    both = both.withColumn("v", money.money(reached.cast("decimal(18,0)") * F.col("rate")))
    return both.agg(F.count(F.when(F.col("tier_index") == 1, 1)).alias("lines"), F.sum("units_in_tier").alias("units"), money.sum_money(F.col("g")).alias("graduated"), money.sum_money(F.col("v")).alias("volume"))


@query
def billing_amounts_by_model(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("part_no"), F.col("p_retailprice").cast(money.CENTS).alias("unit_price"))
    billed = golden.billed(golden.parent_lines(spark, d).join(parts, "part_no"))
    return billed.groupBy("billing_model").agg(F.count("*").alias("lines"), F.sum("billed_quantity").cast("decimal(18,1)").alias("quantity"), money.sum_money(F.col("billed_amount")).alias("amount"))


@query
def telecom_grouping_subtotals(spark, d):
    kind = F.element_at(F.array(*map(F.lit, selection.BUSINESS_TYPES)), (F.col("o_custkey") % len(selection.BUSINESS_TYPES) + 1).cast("int"))
    phone = table(spark, d, "orders").where(kind == "telecom").select(F.col("o_orderkey").alias("invoice_index"))
    lines = golden.parent_lines(spark, d).join(phone, "invoice_index", "left_semi")
    group = F.concat(F.lit("line-"), (1 + draws.hash52("subscriber", F.col("invoice_index"), F.col("line_no")) % 3).cast("string"))
    rows = lines.select("invoice_index", group.alias("group_key"), F.col("billing_model").alias("section"), "line_no", "amount")
    both = rows.groupingSets([["invoice_index", "group_key", "section"], ["invoice_index", "group_key"]], "invoice_index", "group_key", "section")
    return both.agg(F.min("line_no").alias("first_line"), money.sum_money(F.col("amount")).alias("subtotal")).withColumn("section", F.coalesce("section", F.lit("*")))


@query
def printed_row_counts(spark, d):
    return golden.printed_rows(spark, d).groupBy("invoice_index").agg(F.count(F.when(F.col("tier_index").isNull(), 1)).alias("line_item_count"), F.count("*").alias("printed_row_count"))


@query
def billing_models_set(spark, d):
    return golden.parent_lines(spark, d).groupBy("invoice_index").agg(F.array_join(F.array_sort(F.collect_set("billing_model")), ",").alias("billing_models"))


@query
def evaluation_exact_join(spark, d):
    gold = golden.invoices(spark, d)
    return evaluate.exact_join(gold, evaluate.perturbed(gold))


@query
def evaluation_field_accuracy(spark, d):
    gold = golden.invoices(spark, d)
    return evaluate.field_accuracy(gold, evaluate.perturbed(gold), ["grand_total", "tax_total", "invoice_number"], "locale")


@query
def evaluation_row_precision_recall(spark, d):
    lines = golden.parent_lines(spark, d).select("invoice_index", "line_no", "amount")
    key = (F.col("invoice_index"), F.col("line_no"))
    cent = F.when(draws.hash52("wrong", *key) % 20 == 0, F.lit("0.01").cast(money.CENTS)).otherwise(F.lit(0).cast(money.CENTS))
    read = lines.where(draws.hash52("lost", *key) % 25 != 0).withColumn("amount", (F.col("amount") + cent).cast(money.CENTS))
    made_up = lines.where(draws.hash52("made up", *key) % 40 == 0).withColumn("line_no", F.col("line_no") + 1000)
    return evaluate.row_scores(lines, read.unionByName(made_up), ["invoice_index", "line_no"], "amount")


@query
def selection_compose(spark, d):
    wanted = selection.Selection.of({"locales": ["en-US", "fr-FR", "en-CA"], "goods_receipts": True, "conditions": ["handwritten"]})
    return wanted.compose(firms(spark, d), check=False)


@query
def selection_unknown_ids(spark, d):
    return selection.unknown_ids(firms(spark, d), ["c000001", "c000002", "nobody", "c999999"])


@query
def subset_n_of(spark, d):
    return selection.subset(firms(spark, d).select("company_id"), 25, "company_id")


@query
def weighted_cdf_draw(spark, d):
    weights = table(spark, d, "customer").select("c_custkey", (F.floor(F.greatest("c_acctbal", F.lit(0.0))) + 1).cast("long").alias("weight"))
    rows = table(spark, d, "orders").select("o_orderkey")
    return routing.by_weight(rows, F.col("o_orderkey"), weights, "c_custkey", "weight", "company").select("o_orderkey", "c_custkey")


@query
def provider_routing(spark, d):
    return routing.route(table(spark, d, "documents").select("doc_id"), F.col("doc_id")).select("doc_id", "provider")


@query
def provider_fallback(spark, d):
    return routing.route(table(spark, d, "documents").select("doc_id"), F.col("doc_id"), quarantined=("fast",))


@query
def distinct_then_reshuffle(spark, d):
    slots = golden.parent_lines(spark, d).select("invoice_index", (F.col("line_no") - 1).alias("slot"))
    return routing.distinct_then_reshuffle(slots, 5, "invoice_index", "slot")


@query
def stable_seed_values(spark, d):
    return table(spark, d, "orders").select("o_orderkey", draws.stable_seed("run", F.col("o_orderkey")).cast("string").alias("seed"))


@query
def plan_units(spark, d):
    return runs.plan_units(spark, table(spark, d, "orders").count(), 1000)


@query
def slice_apportion(spark, d):
    shares = spark.createDataFrame([(1, "pinned", "12.5"), (2, "mixed", "51.25"), (3, "french", "23.125"), (4, "hand", "13.125")], "no int, name string, share string")
    return runs.apportion(shares, table(spark, d, "orders").count(), "no", "share").select("no", "name", "n")


@query
def unit_progress(spark, d):
    return runs.progress(units(spark, d))


@query
def next_claimable(spark, d):
    return runs.claimable(units(spark, d), 3).select("unit_index", "state")


@query
def expired_leases(spark, d):
    return runs.expired(units(spark, d), F.lit("1996-01-01").cast("timestamp")).select("unit_index")


@query
def unit_transitions(spark, d):
    now = F.lit("1996-01-01").cast("timestamp")
    before = units(spark, d).withColumn("was", F.col("state"))
    after = runs.step(runs.step(before, "complete", now), "claim", now)
    return after.groupBy("was", "state").agg(F.sum("attempts").alias("attempts"), F.count("*").alias("units")).drop("was")


@query
def manifest_parts(spark, d):
    return runs.manifest_parts(table(spark, d, "documents"), F.expr("doc_id div 100"), "doc_id", "text")


@query
def manifest_table_rows(spark, d):
    heads = golden.parent_lines(spark, d).select("invoice_index").distinct().select(F.lit("invoices").alias("table"))
    rows = heads.unionAll(golden.printed_rows(spark, d).select(F.lit("line_items")))
    return rows.rollup("table").agg(F.count("*").alias("n")).withColumn("table", F.coalesce("table", F.lit("*")))


@query
def manifest_gaps(spark, d):
    docs = table(spark, d, "documents")
    planned = runs.plan_units(spark, docs.agg(F.max("doc_id")).first()[0] + 1, 100)
    parts = docs.select(F.expr("doc_id div 100").alias("unit_index")).distinct().where("unit_index % 7 <> 3")
    return runs.gaps(parts, planned)


@query
def verify_hashes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    entries = docs.select("doc_id", F.sha2("text", 256).alias("sha"))
    blobs = docs.where("doc_id % 97 <> 5").withColumn("text", F.when(F.col("doc_id") % 97 == 11, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    return runs.verify(entries, blobs, "doc_id", "text")


@query
def gate_findings(spark, d):
    return gates.gate_findings(table(spark, d, "documents"), "doc_id", "text")


@query
def gate_report(spark, d):
    return gates.by_rule(gates.gate_findings(table(spark, d, "conversations"), "conv_id", "text"))


@query
def gate_rejection_rate(spark, d):
    return gates.rejection(table(spark, d, "part"), "p_partkey", "p_name")


@query
def near_duplicates(spark, d):
    return gates.duplicate_groups(table(spark, d, "documents"), "doc_id", "text")


@query
def duplicate_totals(spark, d):
    return gates.duplicate_totals(table(spark, d, "documents"), "doc_id", "text")


@query
def first_wins_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", gates.digest(text.normalised(F.col("text"))).alias("norm"))
    return docs.groupBy("source", "norm").agg(F.min("doc_id").alias("doc_id")).select("source", "doc_id")


@query
def llm_usage_rows(spark, d):
    return calls(spark, d).drop("ts")


@query
def spend_rollup(spark, d):
    return usage.spend(calls(spark, d))


@query
def spend_nano(spark, d):
    nano = money.to_nano(F.col("cost_usd"))
    return calls(spark, d).select("event_id", nano.alias("nano"), money.from_nano(nano).alias("usd"))


@query
def budget_prefix(spark, d):
    return usage.budget_prefix(calls(spark, d), F.lit("0.05").cast(money.COST)).select("event_id", "model", "spent")


@query
def breaker_streaks(spark, d):
    return usage.failure_streaks(calls(spark, d))


@query
def observed_max_output(spark, d):
    return usage.running_max(calls(spark, d)).select("event_id", "model", "observed_max")


@query
def usage_by_provider(spark, d):
    ok = F.col("status") == "ok"
    return calls(spark, d).groupBy("model").agg(F.count(F.when(ok, 1)).alias("filled"), F.count(F.when(~ok, 1)).alias("failed"), F.sum("cost_usd").cast(money.COST).alias("cost_usd"))


@query
def format_amount_locales(spark, d):
    value = F.when(F.col("invoice_index") % 9 == 0, -F.col("grand_total")).otherwise(F.col("grand_total")).cast(money.CENTS)
    shown = lambda symbol: locale.format_amount(value, F.col("currency"), F.col("locale"), symbol)
    return golden.invoices(spark, d).select("invoice_index", shown(True).alias("shown"), shown(False).alias("bare"))


@query
def format_dates(spark, d):
    day, place = F.col("issue_date"), F.col("locale")
    return golden.invoices(spark, d).select("invoice_index", locale.format_date(day, place).alias("short"), locale.format_date_long(day, place).alias("long"))


@query
def format_rate_qty(spark, d):
    buckets = golden.tax_buckets(spark, golden.bases(spark, d)).select("invoice_index", "rule_no", "rate")
    heads = golden.invoices(spark, d).select("invoice_index", "locale")
    quantity = (F.col("invoice_index").cast("decimal(14,0)") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,4)")
    return buckets.join(heads, "invoice_index").select("invoice_index", "rule_no", locale.format_rate(F.col("rate"), F.col("locale")).alias("rate"), locale.format_quantity(quantity).alias("quantity"))


@query
def tier_labels(spark, d):
    return golden.bands(spark).select("tier_index", golden.tier_label(F.col("lo"), F.col("hi")).alias("label"))


@query
def identifiers(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.format_string("inv_%08d", "o_orderkey").alias("invoice_id"), F.format_string("c%06d", "o_custkey").alias("company_id"), F.format_string("INV-%d-%06d", F.year("o_orderdate"), "o_orderkey").alias("invoice_number"), F.format_string("unit-%06d", F.expr("o_orderkey div 1000")).alias("unit_key"))


@query
def names_and_slugs(spark, d):
    words = F.regexp_replace("c_name", "#", " ")
    return table(spark, d, "customer").select("c_custkey", text.initials(words).alias("initials"), text.slug(F.col("c_name")).alias("slug"))


@query
def band_coercion(spark, d):
    low = F.col("value").cast("decimal(18,6)")
    high = (low * F.element_at(F.array(*map(F.lit, [1, 2, 7, 0])), (F.col("event_id") % 4 + 1).cast("int"))).cast("decimal(18,6)")
    band = catalogue.coerced_band(low, high, F.lit("0.5").cast("decimal(9,4)"), F.lit(600))
    return table(spark, d, "events").select("event_id", band["low"].alias("low"), band["high"].alias("high"))


@query
def catalogue_overlay(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    reply = F.when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("generated "), F.col("p_partkey").cast("string"))).otherwise(F.lit("  "))
    return catalogue.overlay(parts, parts.where("p_partkey % 4 <> 2").withColumn("p_name", reply), ["p_partkey"], "p_name").select("p_partkey", "p_name", "filled")


@query
def orphan_companies(spark, d):
    return catalogue.orphans(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query
def quarantine_union(spark, d):
    failed = calls(spark, d).where("status = 'error'").select("model")
    return failed.union(spark.createDataFrame([("local",)], "model string")).distinct()


@query
def render_html_documents(spark, d):
    shown = locale.format_amount(F.col("grand_total"), F.col("currency"), F.col("locale"))
    company = text.escaped(F.concat(F.col("company_id"), F.lit(" & Co <"), F.col("locale"), F.lit(">")))
    html = F.concat(F.lit("<article><h1>"), text.escaped(F.col("invoice_number")), F.lit("</h1><p>"), company, F.lit('</p><p class="total">'), text.escaped(shown), F.lit("</p></article>"))
    return golden.invoices(spark, d).select("invoice_index", html.alias("html"))


@query
def usage_stream_rollup(spark, d):
    return usage_stream.rollup(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("day", F.col("day").cast("timestamp_ntz"))
