"""Registered queries over whole golden records, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import catalogue, golden, records
from ..operators.identity import LAYOUTS
from ..operators.selection import BUSINESS_TYPES, DIGITAL_NATIVE, GOODS
from .oracle import BAND_ROWS, BASES, LINES, RULES, dec, h, of_key, one_of, q, values

RECORDS: dict = {}
RECORD_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        RECORDS[f.__name__], RECORD_SQL[f.__name__] = f, sql
        return f

    return add


def _in(options: list[str]) -> str:
    return "(" + ", ".join(map(q, options)) + ")"


def _case(pairs: dict[str, str], otherwise: str) -> str:
    return "CASE billing_model " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs.items()) + f" ELSE {q(otherwise)} END"


def _pick(name: str, options: list[str], *keys: str) -> str:
    return one_of(options, f"{h(name, *keys)} % {len(options)}")


def _layout() -> str:
    point, edge, parts = f"({h('layout', 'company_no')} % 100)", 0, []
    for name, weight in LAYOUTS:
        edge += weight
        parts.append(f"WHEN {point} < {edge} THEN {q(name)}")
    return "CASE " + " ".join(parts) + " END"


_PERIOD = "CAST(date_trunc('month', issue_date) - INTERVAL 1 MONTH AS DATE)", "CAST(date_trunc('month', issue_date) - INTERVAL 1 DAY AS DATE)"
_KIND = one_of(BUSINESS_TYPES, f"company_no % {len(BUSINESS_TYPES)}")
_FIRMS = f"named AS (SELECT c_custkey AS company_no, format('c{{:06d}}', c_custkey) AS company_id, c_name AS issuer_name, {one_of(BUSINESS_TYPES, f'c_custkey % {len(BUSINESS_TYPES)}')} AS business_type FROM customer)"
_POINT = f"({h('condition', 'invoice_index')} % 100)"

INVOICES_SQL = f"""WITH {BASES}, {_FIRMS},
facts AS (
  SELECT invoice_index, array_to_string(list_sort(list(DISTINCT billing_model)), ',') AS billing_models, count(*) + {len(golden.BANDS)} * count(*) FILTER (billing_model = 'graduated_tier') AS printed_row_count,
    bool_and({_case(records.KINDS, 'product')} IN {_in(records.DELIVERED)}) AS deliverable
  FROM lines GROUP BY 1),
caught AS (
  SELECT *, CASE WHEN business_type IN {_in(DIGITAL_NATIVE)} THEN 'clean' WHEN {_POINT} < 70 THEN 'clean' WHEN {_POINT} < 85 THEN 'light_scan' WHEN {_POINT} < 95 OR business_type = 'telecom' THEN 'heavy_scan' ELSE 'handwritten' END AS condition
  FROM gold JOIN facts USING (invoice_index) JOIN named USING (company_id)),
worn AS (SELECT *, CASE WHEN condition = 'clean' THEN 1000 ELSE 50 + {h('wear', 'invoice_index')} % 951 END AS milli, condition = 'handwritten' AND business_type IN {_in(GOODS)} AND deliverable AS goods_receipt, {of_key(catalogue.FAMILIES, 'business_type', h('category', 'company_no'))} AS family FROM caught)
SELECT invoice_id, 'run' AS run_id, invoice_index, company_id, business_type, family AS product_category,
  family || CASE WHEN locale LIKE 'fr%' THEN ', spécialité ' ELSE ', specialty ' END || ({h('niche', 'company_no')} % {catalogue.NICHES} + 1) AS llm_niche,
  CASE WHEN condition = 'handwritten' THEN 'handwritten-form-01' WHEN business_type = 'telecom' THEN 'telecom-itemized-37' ELSE {_layout()} END AS template_id,
  invoice_number, issue_date, due_date, CAST(NULL AS DATE) AS billing_period_start, CAST(NULL AS DATE) AS billing_period_end,
  locale, CASE WHEN locale LIKE 'en%' THEN 'en' ELSE locale END AS language, jurisdiction, currency, issuer_name, {_pick('recipient stem', catalogue.STEMS, 'invoice_index')} || {_pick('recipient end', catalogue.ENDS, 'invoice_index')} || ' ' || coalesce({of_key(catalogue.SUFFIXES, 'jurisdiction', h('recipient suffix', 'invoice_index'))}, 'Ltd.') AS recipient_name,
  {dec('sub')} AS subtotal, {dec('disc')} AS discount_total, {dec('shipping')} AS shipping_total, {dec('base')} AS taxable_base, {dec('tax')} AS tax_total, {dec('dep')} AS deposit, {dec('grand')} AS grand_total,
  CASE WHEN NOT has_discount THEN 'none' WHEN by_percent THEN 'percent' ELSE 'flat' END AS discount_scheme, CASE WHEN pre THEN 'pre_tax' ELSE 'post_tax' END AS discount_timing,
  tax_bucket_count, line_item_count, printed_row_count, billing_models, condition, condition = 'handwritten' AS is_handwritten, condition <> 'clean' AS is_degraded, 'star-1' AS catalogue_version,
  CAST(CAST(milli * 0.001 AS DECIMAL(4,3)) AS DOUBLE) AS wear, milli <= 250 AS is_crisp, goods_receipt, CASE WHEN goods_receipt THEN CAST(issue_date + CAST({h('received', 'invoice_index')} % 7 AS INTEGER) AS DATE) END AS received_date,
  CAST(NULL AS INTEGER) AS page_count, {', '.join(f"{_pick(n, o, 'company_no')} AS {n}" for n, o in records.LOOKS.items())},
  CASE WHEN business_type = 'telecom' THEN 'telecom' ELSE 'standard' END AS column_vocabulary, CAST(CAST((92 + {h('font', 'company_no')} % 21) * 0.01 AS DECIMAL(4,2)) AS DOUBLE) AS font_scale,
  {h('logo', 'company_no')} % 10 < 8 AS has_logo, {_pick('logo style', ['wordmark', 'mark'], 'company_no')} AS logo_style, {h('watermark', 'company_no')} % 10 = 0 AS has_watermark,
  CAST(NULL AS VARCHAR) AS gcs_pdf_path, CAST(NULL AS VARCHAR) AS gcs_golden_shard
FROM worn"""


@query(INVOICES_SQL)
def invoice_rows(spark, d):
    # lists are compared as text
    return records.invoice_rows(spark, d).withColumn("billing_models", F.array_join("billing_models", ","))


_KEY = "invoice_index", "line_no"
_PHONE = "business_type = 'telecom'"
_CODES = values([(i, code) for i, k, code, _ in RULES if k == 0], "jurisdiction_no, tax_code")
_PARENTS = f"""{LINES}, {_FIRMS},
of_invoice AS (
  SELECT o_orderkey AS invoice_index, format('inv_{{:08d}}', o_orderkey) AS invoice_id, CAST(o_orderdate AS DATE) AS issue_date, business_type, tax_code
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN named ON company_no = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN {_CODES} codes ON codes.jurisdiction_no = n_nationkey % {len(golden.JURISDICTIONS)}),
parents AS (
  SELECT lines.*, of_invoice.* EXCLUDE (invoice_index), p_name, billing_model = 'graduated_tier' AS tiers, CASE WHEN billing_model = 'graduated_tier' THEN quantity * 3000 ELSE quantity END AS units, {_case(records.KINDS, 'product')} AS kind
  FROM lines JOIN of_invoice USING (invoice_index) JOIN part ON p_partkey = part_no),
worked AS (
  SELECT *, (2 * (cents + less) * 100 + units) // (2 * units) AS unit_myriad, billing_model IN {_in(records.PERIODIC)} AS periodic,
    {_pick('use', records.USE_TYPES, *_KEY)} AS use, CAST(1 + {h('subscriber', *_KEY)} % 3 AS VARCHAR) AS subscriber
  FROM (SELECT *, CASE WHEN off > 0 THEN (2 * cents * off + 100 - off) // (2 * (100 - off)) ELSE 0 END AS less FROM (SELECT *, CASE WHEN tiers THEN 0 ELSE discount END AS off FROM parents)))"""
_COMMON = f"""tax_code, CASE WHEN periodic THEN {_PERIOD[0]} END AS period_start, CASE WHEN periodic THEN {_PERIOD[1]} END AS period_end, false AS is_prorated,
  CAST(NULL AS DECIMAL(9,4)) AS proration_factor, CASE WHEN billing_model = 'seat_based' THEN 5::DECIMAL(18,4) END AS included_quantity,
  CASE WHEN billing_model = 'seat_based' THEN greatest(quantity - 5, 0)::DECIMAL(18,4) END AS overage_quantity, {_case(records.UNITS_OF_USE, 'none')} AS usage_unit,
  CASE WHEN {_PHONE} THEN format('{{:02d}} {{:02d}}:{{:02d}}', 1 + {h('day of use', *_KEY)} % 28, {h('hour', *_KEY)} % 24, {h('minute', *_KEY)} % 60) END AS usage_start,
  CASE WHEN {_PHONE} THEN {h('seconds', *_KEY)} % 3600 END AS duration_seconds, CASE WHEN billing_model = 'metered_usage' THEN quantity::DECIMAL(18,4) END AS volume, CASE WHEN {_PHONE} THEN use END AS usage_type,
  CASE WHEN {_PHONE} THEN format('+1555{{:07d}}', {h('called', *_KEY)} % 10000000) END AS counterparty, CASE WHEN {_PHONE} THEN 'line-' || subscriber END AS group_key,
  CASE WHEN {_PHONE} THEN 'Subscriber ' || subscriber END AS group_label, CASE WHEN {_PHONE} THEN (CASE WHEN use = 'Brwsr' THEN 'Packet data' ELSE 'Usage' END) END AS section"""
_RATE = "CAST(myriad * 0.0001 AS DECIMAL(18,6))"
_CODE = "CASE WHEN billing_model = 'per_unit' THEN {0} END"
LINES_SQL = f"""WITH {_PARENTS}
SELECT invoice_id, 'run' AS run_id, line_no, CAST(NULL AS BIGINT) AS parent_line_no, CAST(NULL AS BIGINT) AS tier_index, CASE WHEN tiers THEN {len(golden.BANDS)} ELSE 0 END::BIGINT AS tier_count, kind, billing_model, p_name AS description,
  'SKU-' || part_no AS sku, {_CODE.format("format('PN-{:06d}', part_no)")} AS part_number, {_CODE.format("format('{:08d}', part_no)")} AS code, CASE WHEN billing_model = 'per_unit' THEN 'sku' ELSE 'none' END AS code_system,
  units::DECIMAL(18,4) AS quantity, CAST(CAST(unit_myriad AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,6)) AS unit_price, CASE WHEN off > 0 THEN CAST(off AS DECIMAL(9,4)) END AS discount_percent, {dec('less')} AS discount_amount, {dec('cents')} AS extended_amount, cents < 0 AS is_credit,
  CAST(NULL AS DECIMAL(18,4)) AS tier_lower, CAST(NULL AS DECIMAL(18,4)) AS tier_upper, CAST(NULL AS DECIMAL(18,6)) AS tier_rate, {_COMMON}, CASE WHEN billing_model = 'metered_usage' THEN CAST(CAST(unit_myriad AS DECIMAL(18,0)) * 0.0001 AS DECIMAL(18,6)) END AS rate_per_unit
FROM worked
UNION ALL BY NAME
SELECT invoice_id, 'run' AS run_id, line_no, line_no AS parent_line_no, tier_index, {len(golden.BANDS)}::BIGINT AS tier_count, kind, billing_model,
  CASE WHEN hi IS NULL THEN format('{{:,}}', lo) || '+ api_calls' ELSE format('{{:,}}', lo) || ' – ' || format('{{:,}}', hi) || ' api_calls' END AS description,
  NULL AS sku, NULL AS part_number, NULL AS code, 'none' AS code_system, greatest(0, least(units, coalesce(hi, 4611686018427387904)) - lo)::DECIMAL(18,4) AS quantity, {_RATE} AS unit_price, CAST(NULL AS DECIMAL(9,4)) AS discount_percent, CAST(0 AS DECIMAL(18,2)) AS discount_amount,
  {dec('(greatest(0, least(units, coalesce(hi, 4611686018427387904)) - lo) * myriad + 50) // 100')} AS extended_amount, false AS is_credit, CAST(lo AS DECIMAL(18,4)) AS tier_lower, CAST(hi AS DECIMAL(18,4)) AS tier_upper, {_RATE} AS tier_rate, {_COMMON}, {_RATE} AS rate_per_unit
FROM worked, {BAND_ROWS} bands WHERE tiers"""


@query(LINES_SQL)
def line_item_rows(spark, d):
    return records.line_rows(spark, d)


@query(
    f"""WITH {LINES}, kinds AS (SELECT invoice_index, line_no, {_case(records.KINDS, 'product')} AS kind FROM lines),
marked AS (SELECT *, kind IN {_in(records.DELIVERED)} AS goods, bool_or(kind IN {_in(records.DELIVERED)}) OVER (PARTITION BY invoice_index) AS has_goods FROM kinds)
SELECT * FROM (SELECT invoice_index, line_no, kind, row_number() OVER (PARTITION BY invoice_index ORDER BY line_no) AS delivery_no, NOT has_goods AS fallback FROM marked WHERE goods OR NOT has_goods) WHERE delivery_no <= 8000"""
)
def delivery_note_lines(spark, d):
    model = F.col("billing_model")
    lines = golden.parent_lines(spark, d).select("invoice_index", "line_no", records._by(records.KINDS, model, F.lit("product")).alias("kind"))
    return records.delivery_lines(lines)


@query(
    f"""WITH {LINES}, parts AS (SELECT p_partkey AS part_no, CAST(round(p_retailprice * 100) AS BIGINT) AS price FROM part)
SELECT model AS billing_model, count(*) AS lines, sum(n)::BIGINT AS quantity, {dec('sum(n * price)')} AS amount
FROM (SELECT ['fee_schedule', 'milestone', 'interest', 'prepaid_credit', 'volume_tier'][part_no % 5 + 1] AS model, 1 + {h('quantity', *_KEY)} % 500 AS n, price FROM lines JOIN parts USING (part_no)) GROUP BY 1"""
)
def other_billing_models(spark, d):
    parts = golden.table(spark, d, "part").select(F.col("p_partkey").alias("part_no"), F.col("p_retailprice").cast(money.CENTS).alias("unit_price"))
    lines = golden.parent_lines(spark, d).join(parts, "part_no").withColumn("billing_model", golden.other_model(F.col("part_no")))
    billed = lines.withColumn("quantity", golden.counted(F.col("invoice_index"), F.col("line_no")))
    amount = money.money(F.col("quantity").cast("decimal(18,0)") * F.col("unit_price"))
    return billed.groupBy("billing_model").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"), money.sum_money(amount).alias("amount"))
