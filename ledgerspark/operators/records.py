"""Golden records at their full width: 52 columns of an invoice, 39 of a printed line, and delivery notes.

Invoices are one sum over the lines that meets one head an invoice; printed lines need a shuffle on the invoice index beyond
the lines' own numbering.  All other columns are draws from the company's or the invoice's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.draws import RUN, hash52, pick
from ..functions.money import CENTS
from . import catalogue, golden
from .identity import layout, wear
from .selection import BUSINESS_TYPES, DIGITAL_NATIVE, GOODS

# Kinds of lines by billing model, those that can be delivered, and units of use.
KINDS = {"per_unit": "product", "flat_rate": "fee", "subscription": "subscription", "hourly_labour": "labour", "seat_based": "seat", "metered_usage": "usage", "graduated_tier": "usage"}
DELIVERED = ["product", "part"]
UNITS_OF_USE = {"hourly_labour": "hours", "seat_based": "seats", "metered_usage": "kwh", "graduated_tier": "api_calls"}
PERIODIC = ["subscription", "seat_based", "metered_usage", "graduated_tier"]
# Looks of our own, drawn once for each company; capture conditions in percent.
LOOKS = {"meta_position": ["top", "left", "right"], "totals_style": ["plain", "boxed", "banded"], "table_style": ["ruled", "striped", "open"], "typeface": ["serif", "sans", "mono"]}
# Kinds of use on a telephone bill.
USE_TYPES = ["Brwsr", "Voice", "SMS", "Roam"]

# The names of both tables' columns, and their types by name.
INVOICE_COLUMNS = "invoice_id run_id invoice_index company_id business_type product_category llm_niche template_id invoice_number issue_date due_date billing_period_start billing_period_end locale language jurisdiction currency issuer_name recipient_name subtotal discount_total shipping_total taxable_base tax_total deposit grand_total discount_scheme discount_timing tax_bucket_count line_item_count printed_row_count billing_models condition is_handwritten is_degraded catalogue_version wear is_crisp goods_receipt received_date page_count meta_position totals_style table_style column_vocabulary typeface font_scale has_logo logo_style has_watermark gcs_pdf_path gcs_golden_shard".split()
LINE_COLUMNS = "invoice_id run_id line_no parent_line_no tier_index tier_count kind billing_model description sku part_number code code_system quantity unit_price discount_percent discount_amount extended_amount tax_code is_credit tier_lower tier_upper tier_rate period_start period_end is_prorated proration_factor included_quantity overage_quantity usage_unit usage_start duration_seconds volume usage_type counterparty rate_per_unit group_key group_label section".split()

TYPES = {
    "long": "invoice_index tax_bucket_count line_item_count printed_row_count line_no parent_line_no tier_index tier_count duration_seconds".split(),
    "date": "issue_date due_date billing_period_start billing_period_end received_date period_start period_end".split(),
    CENTS: "subtotal discount_total shipping_total taxable_base tax_total deposit grand_total discount_amount extended_amount".split(),
    "decimal(18,4)": "quantity tier_lower tier_upper included_quantity overage_quantity volume".split(),
    "decimal(18,6)": "unit_price rate_per_unit tier_rate".split(),
    "decimal(9,4)": "discount_percent proration_factor".split(),
    "boolean": "is_handwritten is_degraded is_crisp goods_receipt has_logo has_watermark is_credit is_prorated".split(),
    "double": "wear font_scale".split(),
    "int": ["page_count"],
    "array<string>": ["billing_models"],
}
_TYPE = {name: kind for kind, names in TYPES.items() for name in names}


def schema_of(columns: list[str]) -> StructType:
    """The declared schema of a table; what is not named in ``TYPES`` is text."""
    return StructType.fromDDL(", ".join(f"{c} {_TYPE.get(c, 'string')}" for c in columns))


def declared(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in their order and of their declared types."""
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(columns)))


def _by(values: dict[str, str], key: Column, otherwise: Column) -> Column:
    out = otherwise
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def business(company: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BUSINESS_TYPES)), (company % len(BUSINESS_TYPES) + 1).cast("int"))


def month_before(day: Column) -> tuple[Column, Column]:
    """First and last day of the month before a day: a billing period in arrears."""
    first = F.trunc(day, "MM")
    return F.add_months(first, -1), F.date_sub(first, 1)


def condition(invoice: Column, kind: Column) -> Column:
    """Capture condition: none on paper for digital natives, no handwriting for telecom."""
    point = hash52("condition", invoice) % 100
    drawn = F.when(point < 70, "clean").when(point < 85, "light_scan").when(point < 95, "heavy_scan").otherwise("handwritten")
    return F.when(kind.isin(DIGITAL_NATIVE), "clean").when((kind == "telecom") & (drawn == "handwritten"), "heavy_scan").otherwise(drawn)


def language(locale: Column) -> Column:
    return F.when(locale.startswith("en"), "en").otherwise(locale)


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice heads with the company's number, name and business type."""
    customers = golden.table(spark, sf_dir, "customer").select(F.format_string("c%06d", "c_custkey").alias("company_id"), F.col("c_custkey").alias("company_no"), F.col("c_name").alias("issuer_name"))
    return golden.invoice_heads(spark, sf_dir).join(customers, "company_id").withColumn("business_type", business(F.col("company_no")))


def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole row of every invoice; paths name where its documents and shards go."""
    model = F.col("billing_model")
    # which models occur is a bit each, so that lines are summed up by hash
    of_models = sorted(golden.MODELS)
    bit = _by({m: 1 << k for k, m in enumerate(of_models)}, model, F.lit(None).cast("int"))
    facts = [
        F.bit_or(bit).alias("model_bits"),
        (F.count("*") + len(golden.BANDS) * F.count(F.when(model == "graduated_tier", 1))).alias("printed_row_count"),
        F.min(_by(KINDS, model, F.lit("product")).isin(DELIVERED)).alias("deliverable"),
    ]
    models = F.filter(F.array(*(F.when(F.col("model_bits").bitwiseAND(1 << k) > 0, m) for k, m in enumerate(of_models))), lambda m: m.isNotNull())
    i, c, kind = F.col("invoice_index"), F.col("company_no"), F.col("business_type")
    key = F.col("c_custkey")
    sells = catalogue.category(business(key), key)
    of_issuer = {
        "company_no": key,
        "issuer_name": F.col("c_name"),
        "business_type": business(key),
        "product_category": sells,
        "llm_niche": catalogue.niche(sells, F.col("locale"), key),
        "typeset": layout(key, F.lit(False)),
        **{name: pick(name, options, key) for name, options in LOOKS.items()},
        "font_scale": ((92 + hash52("font", key) % 21).cast("decimal(9,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(4,2)"),
        "has_logo": hash52("logo", key) % 10 < 8,
        "logo_style": pick("logo style", ["wordmark", "mark"], key),
        "has_watermark": hash52("watermark", key) % 10 == 0,
    }
    out = golden.invoices(spark, sf_dir, facts, of_issuer).withColumn("models", models)
    none = lambda kind: F.lit(None).cast(kind)
    out = out.withColumn("condition", condition(i, kind)).withColumn("is_handwritten", F.col("condition") == "handwritten").withColumn("wear", F.when(F.col("condition") == "clean", F.lit(1).cast("decimal(4,3)")).otherwise(wear(i, 50, 1000)))
    out = out.withColumn("goods_receipt", F.col("is_handwritten") & kind.isin(GOODS) & F.col("deliverable"))
    out = out.withColumns({
        "run_id": F.lit(RUN),
        "template_id": F.when((kind == "telecom") & ~F.col("is_handwritten"), "telecom-itemized-37").when(F.col("is_handwritten"), layout(c, F.lit(True))).otherwise(F.col("typeset")),
        # declared, and filled by nobody yet: periods, the page count (layouts are worked out in ``pages``), and paths
        "billing_period_start": none("date"),
        "billing_period_end": none("date"),
        "page_count": none("int"),
        "gcs_pdf_path": none("string"),
        "gcs_golden_shard": none("string"),
        "language": language(F.col("locale")),
        "recipient_name": F.concat(pick("recipient stem", catalogue.STEMS, i), pick("recipient end", catalogue.ENDS, i), F.lit(" "), catalogue.suffix(F.col("jurisdiction"), "recipient suffix", i)),
        "billing_models": F.col("models"),
        "is_degraded": F.col("condition") != "clean",
        "catalogue_version": F.lit("star-1"),
        "is_crisp": F.col("wear") <= F.lit("0.25").cast("decimal(4,3)"),
        "received_date": F.when(F.col("goods_receipt"), F.date_add("issue_date", (hash52("received", i) % 7).cast("int"))),
        "column_vocabulary": F.when(kind == "telecom", "telecom").otherwise("standard"),
    })
    return declared(out, INVOICE_COLUMNS)


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole row of every printed line: parents, and under a graduated one its bands without identifiers."""
    parts = golden.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_no"), F.col("p_name").alias("description"))
    rules = F.broadcast(golden.tax_rules(spark).where("rule_no = 0").select("jurisdiction_no", "tax_code"))
    of_invoice = heads(spark, sf_dir).join(rules, "jurisdiction_no").select("invoice_index", "invoice_id", "issue_date", "business_type", "tax_code")
    lines = golden.parent_lines(spark, sf_dir).join(parts, "part_no").join(of_invoice, "invoice_index")
    model, i, n = F.col("billing_model"), F.col("invoice_index"), F.col("line_no")
    phone, amount, tiers = F.col("business_type") == "telecom", F.col("amount"), model == "graduated_tier"
    start, end = month_before(F.col("issue_date"))
    none = lambda kind: F.lit(None).cast(kind)
    use = pick("use", USE_TYPES, i, n)
    subscriber = (1 + hash52("subscriber", i, n) % 3).cast("string")
    quantity = F.when(tiers, F.col("quantity") * 3000).otherwise(F.col("quantity"))
    # the amount is net: quantity times price, less the discount
    off = F.when(tiers, F.lit(0).cast("long")).otherwise(F.col("discount"))
    less = F.when(off > 0, F.round(amount * off.cast("decimal(9,0)") / (100 - off).cast("decimal(9,0)"), 2)).otherwise(F.lit(0)).cast(CENTS)
    lines = lines.withColumn("units", quantity).withColumn("discount_percent", F.when(off > 0, off.cast("decimal(9,4)"))).withColumn("discount_amount", less)
    lines = lines.withColumn("unit_price", F.round((amount + F.col("discount_amount")) / F.col("units").cast("decimal(18,0)"), 4).cast("decimal(18,6)"))
    parents = lines.withColumns({
        "run_id": F.lit(RUN),
        "parent_line_no": none("long"),
        "tier_index": none("long"),
        "tier_count": F.when(tiers, F.lit(len(golden.BANDS))).otherwise(F.lit(0)).cast("long"),
        "kind": _by(KINDS, model, F.lit("product")),
        "sku": F.format_string("SKU-%d", "part_no"),
        "part_number": F.when(model == "per_unit", F.format_string("PN-%06d", "part_no")),
        "code": F.when(model == "per_unit", F.format_string("%08d", "part_no")),
        "code_system": F.when(model == "per_unit", "sku").otherwise("none"),
        "extended_amount": amount,
        "is_credit": amount < 0,
        "tier_lower": none("long"),
        "tier_upper": none("long"),
        "tier_rate": none("decimal(18,6)"),
        "period_start": F.when(model.isin(PERIODIC), start),
        "period_end": F.when(model.isin(PERIODIC), end),
        "is_prorated": F.lit(False),
        "proration_factor": none("decimal(9,4)"),
        "included_quantity": F.when(model == "seat_based", F.lit(5).cast("long")),
        "overage_quantity": F.when(model == "seat_based", F.greatest(F.col("quantity") - 5, F.lit(0)).cast("long")),
        "usage_unit": _by(UNITS_OF_USE, model, F.lit("none")),
        "usage_start": F.when(phone, F.format_string("%02d %02d:%02d", 1 + hash52("day of use", i, n) % 28, hash52("hour", i, n) % 24, hash52("minute", i, n) % 60)),
        "duration_seconds": F.when(phone, hash52("seconds", i, n) % 3600),
        "volume": F.when(model == "metered_usage", F.col("quantity")),
        "usage_type": F.when(phone, use),
        "counterparty": F.when(phone, F.format_string("+1555%07d", hash52("called", i, n) % 10_000_000)),
        "rate_per_unit": F.when(model == "metered_usage", F.col("unit_price")),
        "group_key": F.when(phone, F.concat(F.lit("line-"), subscriber)),
        "group_label": F.when(phone, F.concat(F.lit("Subscriber "), subscriber)),
        "section": F.when(phone, F.when(use == "Brwsr", "Packet data").otherwise("Usage")),
    }).drop("quantity").withColumnRenamed("units", "quantity")
    banded = golden.tiered(parents.where("billing_model = 'graduated_tier'").drop("tier_index"), spark, units="quantity")
    under = banded.withColumns({
        "parent_line_no": F.col("line_no"),
        "tier_index": F.col("tier_index").cast("long"),
        "description": golden.tier_label(F.col("lo"), F.col("hi"), "api_calls"),
        "quantity": F.col("units_in_tier"),
        "unit_price": F.col("rate"),
        "rate_per_unit": F.col("rate"),
        "extended_amount": F.col("tier_amount"),
        "tier_lower": F.col("lo"),
        "tier_upper": F.col("hi"),
        "tier_rate": F.col("rate"),
        "discount_percent": none("decimal(9,4)"),
        "discount_amount": F.lit(0).cast(CENTS),
        "sku": none("string"),
        "part_number": none("string"),
        "code": none("string"),
        "is_credit": F.col("tier_amount") < 0,
    })
    return declared(parents, LINE_COLUMNS).unionByName(declared(under, LINE_COLUMNS))


def delivery_lines(lines: DataFrame, most: int = 8_000) -> DataFrame:
    """Lines of a delivery note: what can be delivered, or all lines where nothing can, at most ``most`` by number.

    ``lines`` has invoice_index, line_no and kind; whether an invoice has goods is aggregated before it is joined back.
    """
    goods = F.col("kind").isin(DELIVERED)
    of_invoice = lines.groupBy("invoice_index").agg(F.max(goods).alias("has_goods"))
    kept = lines.join(of_invoice, "invoice_index").where(goods | ~F.col("has_goods"))
    # lines are numbered from 1, so the cap is a rank only where lines were left out
    rank = F.row_number().over(golden.Window.partitionBy("invoice_index").orderBy("line_no"))
    return kept.withColumn("delivery_no", rank.cast("long")).where(F.col("delivery_no") <= most).withColumn("fallback", ~F.col("has_goods")).drop("has_goods")
