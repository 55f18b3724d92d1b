"""The engine's surface: plan a run, generate golden tables, export, evaluate, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.draws import hash52
from ..functions.money import CENTS, money, sum_money
from ..operators import catalogue, evaluate, gates, golden, routing, runs
from ..operators.selection import Selection
from ..sources.shards import Sink, read_shards, write_shards


@dataclass(frozen=True)
class RunSpec:
    """What to generate: how many invoices, in units of what size, from which companies."""

    run_id: str
    total: int
    unit_size: int = 1000
    companies: int = 1000
    products: int = 12
    selection: Selection = field(default_factory=Selection)
    first_day: str = "2026-01-01"
    days: int = 330


class Engine:
    """Generation and evaluation on one session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def plan(self, spec: RunSpec) -> DataFrame:
        return runs.plan_units(self.spark, spec.total, spec.unit_size, spec.run_id)

    def build_catalogue(self, spec: RunSpec) -> tuple[DataFrame, DataFrame]:
        """Companies that meet the selection, and their products; a company without any raises."""
        made = spec.selection.compose(catalogue.companies(self.spark, 0, spec.companies))
        products = catalogue.products(self.spark, made, spec.products)
        if not catalogue.orphans(made, products, "company_no").isEmpty():
            raise ValueError("companies without products")
        return made, products

    def generate(self, spec: RunSpec) -> dict[str, DataFrame]:
        """Golden tables of a run, a pure function of the specification.

        One range of indices is joined to companies by weight and to products by place; the only shuffle on the data's
        own size is the one on the invoice index.
        """
        i = F.col("invoice_index")
        made, products = self.build_catalogue(spec)
        weights = made.select("company_no", F.greatest(F.lit(1), F.round(F.col("weight") * 1000, 0)).cast("long").alias("w"))
        heads = self.spark.range(spec.total).withColumnRenamed("id", "invoice_index")
        heads = routing.by_weight(heads, i, weights, "company_no", "w", f"{spec.run_id} company").drop("w").join(made, "company_no")
        day = F.date_add(F.lit(spec.first_day).cast("date"), (hash52("day", i, run_id=spec.run_id) % (spec.days + 1)).cast("int"))
        heads = heads.withColumn("issue_date", day).withColumn("due_date", F.date_add("issue_date", 30))
        heads = heads.withColumn("invoice_id", F.format_string("inv_%08d", "invoice_index")).withColumn("run_id", F.lit(spec.run_id)).withColumn("unit_index", F.expr(f"invoice_index div {spec.unit_size}"))
        count = (3 + hash52("lines", i, run_id=spec.run_id) % 10).cast("int")
        slots = heads.select("invoice_index", "company_no", F.posexplode(F.sequence(F.lit(1), count)).alias("slot", "line_no"))
        places = routing.distinct_then_reshuffle(slots.select("invoice_index", "slot"), spec.products, "invoice_index", "slot")
        numbered = products.withColumn("choice", F.row_number().over(Window.partitionBy("company_no").orderBy("sku_id")) - 1)
        lines = slots.join(places, ["invoice_index", "slot"]).join(numbered, ["company_no", "choice"])
        share = (hash52("price", i, F.col("line_no"), run_id=spec.run_id) % 1000).cast("decimal(9,0)") * F.lit("0.001").cast("decimal(4,3)")
        lines = lines.withColumn("unit_price", F.round(F.col("price_low") + (F.col("price_high") - F.col("price_low")) * share, 4).cast("decimal(18,4)"))
        lines = lines.withColumn("quantity", (1 + hash52("quantity", i, F.col("line_no"), run_id=spec.run_id) % 500).cast("decimal(18,4)"))
        lines = lines.withColumn("extended_amount", money(F.col("quantity").cast("decimal(9,0)") * F.col("unit_price")))
        sums = lines.groupBy("invoice_index").agg(sum_money(F.col("extended_amount")).alias("subtotal"), F.count("*").alias("line_item_count"))
        codes = self.spark.createDataFrame([(j, n) for n, (j, *_) in enumerate(golden.JURISDICTIONS)], "jurisdiction string, jurisdiction_no int")
        priced = golden.priced(heads.join(sums, "invoice_index").join(F.broadcast(codes), "jurisdiction"))
        buckets = golden.tax_buckets(self.spark, priced)
        tax = buckets.groupBy("invoice_index").agg(sum_money(F.col("tax_amount")).alias("tax_total"), F.count("*").alias("tax_bucket_count"))
        post = F.when(F.col("discount_timing") == "post_tax", F.col("discount_total")).otherwise(F.lit(0).cast(CENTS))
        whole = priced.join(tax, "invoice_index").withColumn("grand_total", (F.col("taxable_base") - post + F.col("tax_total") - F.col("deposit")).cast(CENTS))
        items = lines.select(F.lit(spec.run_id).alias("run_id"), F.format_string("inv_%08d", "invoice_index").alias("invoice_id"), F.expr(f"invoice_index div {spec.unit_size}").alias("unit_index"), F.col("line_no").cast("long").alias("line_no"), "description", F.col("sku_id").alias("sku"), "quantity", "unit_price", "extended_amount")
        return {"invoices": whole.drop("jurisdiction_no", "company_no"), "line_items": items, "tax_buckets": buckets}

    def publish(self, tables: dict[str, DataFrame], uri: str) -> dict[str, int]:
        """Write and register tables by run; rows per table. Writing a run again replaces it."""
        sink = Sink(self.spark, uri)
        run = tables["invoices"].select("run_id").first()
        counts = {}
        for name, rows in tables.items():
            sink.write(name, rows if "run_id" in rows.columns else rows.withColumn("run_id", F.lit(run.run_id if run else "")))
            counts[name] = self.spark.read.parquet(f"{sink.path}/{name}").where(F.col("run_id") == (run.run_id if run else "")).count()
        if sink.named:
            sink.register()
        return counts

    def shard(self, rows: DataFrame, path: str) -> DataFrame:
        """Write tagged shards and read them back with their types."""
        write_shards(rows, path)
        return read_shards(self.spark, path, rows.schema)

    def evaluate(self, golden_rows: DataFrame, extracted: DataFrame, fields: list[str], by: str) -> DataFrame:
        return evaluate.field_accuracy(golden_rows, extracted, fields, by)

    def screen(self, items: DataFrame, key: str, text: str, ceiling: float = 0.02) -> DataFrame:
        """Findings by rule; more rejected items than the ceiling allows raises."""
        if not gates.within_ceiling(items, key, text, ceiling):
            raise ValueError("too many texts break the rules")
        return gates.by_rule(gates.gate_findings(items, key, text))

    def missing_units(self, spec: RunSpec, published: DataFrame) -> DataFrame:
        """Units that a resumed run still has to do."""
        return runs.gaps(published.select("unit_index").distinct(), self.plan(spec))

    def require(self, rows: DataFrame, condition: Column, message: str) -> DataFrame:
        return golden.strict(rows, condition, message)
