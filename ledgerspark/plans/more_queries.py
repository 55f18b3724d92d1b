"""Further registered queries with their SQL twins: identities, page profiles, requests, flags, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws, money
from ..functions.text import ACCENTED, PLAIN
from ..operators import gates, golden, identity, runs
from ..operators.golden import table
from .oracle import BASES, LINES, USAGE, _found, dec, h, one_of, q
from .queries import QUERIES, calls

MORE: dict = {}
MORE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        MORE[f.__name__], MORE_SQL[f.__name__] = f, sql
        return f

    return add


def _lpad(name: str, n: int) -> str:
    return f"lpad(CAST({h(name, 'c_custkey')} % {10**n} AS VARCHAR), {n}, '0')"


_SLUG = f"trim(regexp_replace(translate(lower(c_name), {q(ACCENTED)}, {q(PLAIN)}), '[^a-z0-9]+', '-', 'g'), '-')"


@query(
    f"SELECT c_custkey, CAST(1 + {h('house', 'c_custkey')} % 240 AS VARCHAR) || ' ' || {one_of(identity.STREETS, h('street', 'c_custkey') + f' % {len(identity.STREETS)}')} AS address, 'billing@' || {_SLUG} || '.example.com' AS email, 'https://www.' || {_SLUG} || '.example.com' AS website, {_lpad('siren', 9)} || {_lpad('nic', 5)} AS siret, 'GB' || {_lpad('vat', 9)} AS vat, {_lpad('ein head', 2)} || '-' || {_lpad('ein', 7)} AS ein FROM customer"
)
def company_identity(spark, d):
    return identity.identity(table(spark, d, "customer"), "c_custkey", "c_name")


_P = f"({h('layout', 'o_orderkey')} % 100)"


@query(
    f"SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'handwritten-form-01' WHEN {_P} < 40 THEN 'meta-sidebar-01' WHEN {_P} < 60 THEN 'banner-header-06' WHEN {_P} < 77 THEN 'boxed-form-01' WHEN {_P} < 90 THEN 'fullbleed-05' ELSE 'receipt-compact-01' END AS layout FROM orders"
)
def archetype_choice(spark, d):
    return table(spark, d, "orders").select("o_orderkey", identity.layout(F.col("o_orderkey"), F.col("o_orderkey") % 11 == 0).alias("layout"))


_W = f"(350 + {h('wear', 'o_orderkey')} % 651)"


@query(f"SELECT o_orderkey, CAST({_W} * 0.001 AS DECIMAL(4,3)) AS wear, {_W} <= 250 AS is_crisp, CAST((1500 * greatest({_W}, 150) + 500) // 1000 * 0.001 AS DECIMAL(9,3)) AS rotation FROM orders")
def wear_profile(spark, d):
    w = identity.wear(F.col("o_orderkey"), 350, 1000)
    return table(spark, d, "orders").select("o_orderkey", w.alias("wear"), (w <= F.lit("0.25").cast("decimal(4,3)")).alias("is_crisp"), identity.scaled(F.lit("1.5"), w).alias("rotation"))


@query(
    f"""WITH w AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAY AS DATE) AS z FROM orders),
    s AS (SELECT *, greatest(a, least(DATE '1995-06-01', z)) AS s FROM w)
    SELECT o_orderkey, CAST(s + CAST({h('day', 'o_orderkey')} % (z - s + 1) AS INTEGER) AS DATE) AS issue_date FROM s"""
)
def issue_date_era_floor(spark, d):
    first = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", identity.issue_day(F.col("o_orderkey"), first, F.date_add(first, 60), F.lit("1995-06-01").cast("date")).alias("issue_date"))


@query(
    "SELECT o_orderkey, o_custkey % 7 AS issuer, coalesce(list_filter(["
    + ", ".join(f"{h(f'receiver {a}', 'o_orderkey')} % 7" for a in range(12))
    + "], lambda x: x <> o_custkey % 7)[1], (o_custkey % 7 + 1) % 7) AS receiver FROM orders"
)
def receiver_redraw(spark, d):
    issuer = F.col("o_custkey") % 7
    return table(spark, d, "orders").select("o_orderkey", issuer.alias("issuer"), identity.receiver(F.col("o_orderkey"), issuer, 7).alias("receiver"))


@query("WITH n AS (SELECT p_size, p_partkey, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1) // 50 AS chunk FROM part) SELECT p_size, chunk, count(*) AS n, min(p_partkey) AS first, format('build:{:d}:{:d}:r0', p_size, chunk) AS item_id FROM n GROUP BY p_size, chunk")
def request_chunks(spark, d):
    return identity.chunks(table(spark, d, "part").select("p_size", "p_partkey"), "p_size", "p_partkey")


@query("SELECT event_id, i AS place, 'slot ' || i AS slot, CASE WHEN i < event_id % 4 THEN 'text ' || i END AS text FROM events, range(3) t(i)")
def positional_zip(spark, d):
    rows = table(spark, d, "events").select("event_id")
    asked = rows.withColumn("slots", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("slot "), i.cast("string"))))
    given = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: F.concat(F.lit("text "), i.cast("string")))
    replies = rows.withColumn("texts", F.slice(given, F.lit(1), (F.col("event_id") % 4).cast("int")))
    return identity.zipped(asked, replies, "event_id").withColumn("place", F.col("place").cast("long"))


@query("SELECT event_id, user_id AS input_tokens, event_id % 50 AS output_tokens, CASE event_id % 3 WHEN 0 THEN 0 ELSE user_id // 2 END AS cached_tokens FROM events")
def parse_usage_shapes(spark, d):
    u, e = F.col("user_id").cast("string"), (F.col("event_id") % 50).cast("string")
    half = F.expr("user_id div 2").cast("string")
    shape = F.expr("event_id % 3")
    plain = F.concat(F.lit('{"usage":{"prompt_tokens":'), u, F.lit(',"completion_tokens":'), e, F.lit("}}"))
    nested = F.concat(F.lit('{"usage":{"prompt_tokens":'), u, F.lit(',"completion_tokens":'), e, F.lit(',"prompt_tokens_details":{"cached_tokens":'), half, F.lit("}}}"))
    other = F.concat(F.lit('{"usage":{"input_tokens":'), u, F.lit(',"output_tokens":'), e, F.lit(',"cache_read_input_tokens":'), half, F.lit("}}"))
    counts = identity.usage_counts(F.when(shape == 0, plain).when(shape == 1, nested).otherwise(other))
    return table(spark, d, "events").select("event_id", *(c.alias(n) for c, n in zip(counts, ("input_tokens", "output_tokens", "cached_tokens"), strict=True)))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Donne 50 lignes d''une entreprise ' || p_type || ' en JSON. Exemples : ' ELSE 'List 50 line items of a ' || p_type || ' business as JSON. Examples: ' END || '["' || p_name || '","' || p_brand || '"]' AS prompt FROM part""")
def prompt_texts(spark, d):
    language = F.when(F.col("p_partkey") % 2 == 0, "fr-FR").otherwise("en-US")
    return table(spark, d, "part").select("p_partkey", identity.prompt(F.col("p_type"), language, F.lit(50), F.array("p_name", "p_brand")).alias("prompt"))


@query(f"WITH {LINES} SELECT invoice_index, line_no, cents < 0 AS is_credit, billing_model IN ('subscription', 'metered_usage') AS has_period, billing_model = 'graduated_tier' AS has_tiers FROM lines")
def line_flags(spark, d):
    model = F.col("billing_model")
    return golden.parent_lines(spark, d).select("invoice_index", "line_no", (F.col("amount") < 0).alias("is_credit"), model.isin("subscription", "metered_usage").alias("has_period"), (model == "graduated_tier").alias("has_tiers"))


@query(f"WITH {BASES} SELECT invoice_index, CAST(issue_date - CAST({h('arrears', 'invoice_index')} % 6 AS INTEGER) AS DATE) AS period_end, CAST(issue_date - CAST({h('arrears', 'invoice_index')} % 6 AS INTEGER) - 29 AS DATE) AS period_start FROM heads")
def billing_periods(spark, d):
    end = F.date_sub("issue_date", (draws.hash52("arrears", F.col("invoice_index")) % 6).cast("int"))
    return golden.invoice_heads(spark, d).select("invoice_index", end.alias("period_end"), F.date_sub(end, 29).alias("period_start"))


@query(f"WITH {LINES}, g AS (SELECT invoice_index, bool_and(billing_model IN ('per_unit', 'graduated_tier')) AS goods FROM lines GROUP BY 1) SELECT goods, count(*) AS invoices FROM g GROUP BY 1")
def goods_receipt_constraint(spark, d):
    goods = golden.parent_lines(spark, d).groupBy("invoice_index").agg(F.bool_and(F.col("billing_model").isin("per_unit", "graduated_tier")).alias("goods"))
    return goods.groupBy("goods").agg(F.count("*").alias("invoices"))


@query(f"WITH {_found('documents', 'doc_id', 'text')} SELECT rule, count(*) AS findings FROM (SELECT unnest(rules) AS rule FROM found) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def top_rules(spark, d):
    return gates.by_rule(gates.gate_findings(table(spark, d, "documents"), "doc_id", "text")).orderBy(F.desc("findings"), "rule").limit(3)


@query("SELECT event_id, CAST(CASE WHEN value / 100 < 1 THEN CAST(round(value * 100) AS BIGINT) ELSE (CAST(round(value * 100) AS BIGINT) + 50) // 100 * 100 END * 0.0001 AS DECIMAL(18,4)) AS price FROM events")
def price_quantised(spark, d):
    value = (F.col("value").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,4)")
    return table(spark, d, "events").select("event_id", money.price(value).alias("price"))


@query("SELECT conv_id, turn, length(text) // 4 AS tokens, CAST((length(text) // 4) * 0.00000014 AS DECIMAL(28,12)) AS estimate FROM conversations")
def token_estimates(spark, d):
    tokens = money.estimated_tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", tokens.alias("tokens"), (tokens.cast("decimal(12,0)") * F.lit("0.00000014").cast("decimal(9,8)")).cast(money.COST).alias("estimate"))


@query(f"WITH {USAGE} SELECT c.event_id, c.model, d.source FROM costs c JOIN documents d ON d.doc_id = c.event_id % (SELECT max(doc_id) + 1 FROM documents) WHERE c.status = 'ok'")
def usage_correlation(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source")
    places = docs.agg(F.max("document_id")).first()[0] + 1  # calls go round all documents
    return calls(spark, d).where("status = 'ok'").withColumn("document_id", F.col("event_id") % places).join(docs, "document_id").select("event_id", "model", "source")


@query("WITH w AS (SELECT c_custkey, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) + 1 AS weight FROM customer) SELECT c_custkey, (sum(weight) OVER (ORDER BY c_custkey) - weight)::BIGINT AS lo, (sum(weight) OVER (ORDER BY c_custkey))::BIGINT AS hi FROM w")
def weight_ranges(spark, d):
    weights = table(spark, d, "customer").select("c_custkey", (F.floor(F.greatest("c_acctbal", F.lit(0.0))) + 1).cast("long").alias("weight"))
    return draws.cumulative(weights, "c_custkey", "weight").select("c_custkey", "lo", "hi")


@query("SELECT DISTINCT p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def membership_semi_join(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_semi").select("p_type").distinct()


@query("SELECT doc_id // 100 AS unit_index, count(*) AS documents, count(*) AS entries FROM documents GROUP BY 1")
def manifest_json(spark, d):
    parts = runs.manifest_parts(table(spark, d, "documents"), F.expr("doc_id div 100"), "doc_id", "text")
    coded = parts.select(F.to_json(F.struct("unit_index", "documents", "part_sha"), {"ignoreNullFields": "false"}).alias("j"))
    back = F.from_json("j", "unit_index bigint, documents bigint, part_sha string")
    return coded.select(back.alias("m")).where(F.length("m.part_sha") == 64).select("m.unit_index", "m.documents", F.col("m.documents").alias("entries"))


@query(f"WITH {BASES} SELECT jurisdiction, {dec('sum(sub)')} AS subtotal, {dec('sum(grand)')} AS grand_total, {dec('max(grand)')} AS largest, {dec('min(grand)')} AS smallest FROM gold GROUP BY 1")
def totals_by_jurisdiction(spark, d):
    return golden.invoices(spark, d).groupBy("jurisdiction").agg(money.sum_money(F.col("subtotal")).alias("subtotal"), money.sum_money(F.col("grand_total")).alias("grand_total"), F.max("grand_total").alias("largest"), F.min("grand_total").alias("smallest"))


ALL = QUERIES | MORE
