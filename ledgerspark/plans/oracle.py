"""The queries of :mod:`.queries` in DuckDB's SQL, in integer cents and independent of the Spark expressions."""

from __future__ import annotations

from ..functions.text import ACCENTED, PLAIN
from ..operators.golden import BANDS, JURISDICTIONS, LINE_ORDER, MODELS
from ..operators.routing import MIX
from ..operators.selection import BUSINESS_TYPES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else q(v) if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


def h(name: str, *keys: str) -> str:
    """52 bits of SHA-256 over run, keys and draw name."""
    text = "concat_ws('/', 'run', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f", {q(name)})"
    return f"CAST(('0x' || substr(sha256({text}), 1, 13)) AS BIGINT)"


def one_of(options: list[str], index: str) -> str:
    return f"[{', '.join(map(q, options))}][{index} + 1]"


def of_key(options: dict, key: str, draw: str) -> str:
    """One of the options that belong to a key."""
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {one_of(list(v), f'{draw} % {len(v)}')}" for k, v in options.items()) + " END"


def dec(cents: str, kind: str = "DECIMAL(18,2)") -> str:
    return f"CAST(CAST({cents} AS DECIMAL(18,0)) * 0.01 AS {kind})"


RULES = [(i, k, code, round(float(rate) * 1000)) for i, (*_, rules) in enumerate(JURISDICTIONS) for k, (code, rate) in enumerate(rules)]
LINES = f"""lines AS (
  SELECT l_orderkey AS invoice_index, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)}) AS line_no,
    {one_of(MODELS, f'l_partkey % {len(MODELS)}')} AS billing_model, l_partkey AS part_no, CAST(l_quantity AS BIGINT) AS quantity,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS discount
  FROM lineitem)"""
BASES = f"""{LINES},
heads AS (
  SELECT o_orderkey AS invoice_index, format('inv_{{:08d}}', o_orderkey) AS invoice_id, format('c{{:06d}}', c_custkey) AS company_id,
    format('INV-{{:d}}-{{:06d}}', year(o_orderdate), o_orderkey) AS invoice_number, CAST(o_orderdate AS DATE) AS issue_date,
    CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due_date, n_nationkey % {len(JURISDICTIONS)} AS jurisdiction_no
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
summed AS (SELECT invoice_index, sum(cents)::BIGINT AS sub, count(*) AS line_item_count FROM lines GROUP BY 1),
drawn AS (
  SELECT *, {h('discount', 'invoice_index')} % 100 < 30 AS has_discount, {h('scheme', 'invoice_index')} % 100 < 70 AS by_percent,
    {h('timing', 'invoice_index')} % 100 < 70 AS pre, {h('ship', 'invoice_index')} % 100 < 25 AS ships, {h('deposit', 'invoice_index')} % 100 < 15 AS deposits
  FROM heads JOIN summed USING (invoice_index)),
amounts AS (
  SELECT *, CASE WHEN NOT has_discount THEN 0 ELSE (sub * (CASE WHEN by_percent THEN [5, 10, 12, 15, 20][{h('percent', 'invoice_index')} % 5 + 1] ELSE 5 + {h('flat', 'invoice_index')} % 21 END) + 50) // 100 END AS disc,
    CASE WHEN ships THEN 800 + {h('shipping', 'invoice_index')} % 5201 ELSE 0 END AS shipping,
    CASE WHEN deposits THEN (sub * (10 + {h('deposit rate', 'invoice_index')} % 21) + 50) // 100 ELSE 0 END AS dep
  FROM drawn),
based AS (SELECT *, sub - (CASE WHEN pre THEN disc ELSE 0 END) + shipping AS base FROM amounts),
rules AS {values(RULES, 'jurisdiction_no, rule_no, tax_code, milli')},
places AS {values([(i, j, c, loc) for i, (j, c, loc, _) in enumerate(JURISDICTIONS)], 'jurisdiction_no, jurisdiction, currency, locale')},
buckets AS (SELECT invoice_index, rule_no, tax_code, milli, base, (base * milli + 50000) // 100000 AS tax FROM based JOIN rules USING (jurisdiction_no)),
gold AS (
  SELECT *, base - (CASE WHEN pre THEN 0 ELSE disc END) + tax - dep AS grand
  FROM based JOIN places USING (jurisdiction_no) JOIN (SELECT invoice_index, sum(tax)::BIGINT AS tax, count(*) AS tax_bucket_count FROM buckets GROUP BY 1) USING (invoice_index))"""
BAND_ROWS = values([(i, lo, hi, round(float(r) * 10_000)) for i, lo, hi, r in BANDS], "tier_index, lo, hi, myriad")
TIERED = f"""tiers AS (SELECT invoice_index, line_no, quantity * 3000 AS units FROM lines WHERE billing_model = 'graduated_tier'),
banded AS (
  SELECT *, greatest(0, least(units, coalesce(hi, 4611686018427387904)) - lo) AS shared, CASE WHEN units > lo AND units <= coalesce(hi, 4611686018427387904) THEN units ELSE 0 END AS reached
  FROM tiers, {BAND_ROWS} bands)"""
EXTRACTED = f"""extracted AS (SELECT *, grand + (CASE WHEN {h('cent', 'invoice_index')} % 10 = 0 THEN 1 ELSE 0 END) AS seen FROM gold WHERE {h('missing', 'invoice_index')} % 50 <> 0)"""
PRINTED = f"""printed AS (
  SELECT invoice_index, line_no, CAST(NULL AS BIGINT) AS tier_index, billing_model, 'SKU-' || part_no AS sku, quantity, cents FROM lines
  UNION ALL SELECT invoice_index, line_no, tier_index, 'graduated_tier', NULL, shared, (shared * myriad + 50) // 100 FROM banded)"""
COMPANIES = f"""firms AS (
  SELECT c_custkey, format('c{{:06d}}', c_custkey) AS company_id, {one_of(BUSINESS_TYPES, f'c_custkey % {len(BUSINESS_TYPES)}')} AS business_type, locale
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN {values([(i, loc) for i, (_, _, loc, _) in enumerate(JURISDICTIONS)], 'no, locale')} p ON p.no = n_nationkey % {len(JURISDICTIONS)})"""
# White space, word characters and word edges of Unicode, for an engine whose own classes are ASCII and which looks neither
# back nor ahead: a word's neighbours are matched along with it.
_S = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_W = "\\pL\\pN_"
_LEFT, _RIGHT = f"(?:^|[^{_W}])", f"(?:[^{_W}]|$)"


def _stripped(text: str) -> str:
    return f"regexp_replace(coalesce({text}, ''), '^[{_S}]+|[{_S}]+$', '', 'g')"


NORMAL = f"trim(regexp_replace(translate(lower(coalesce({{0}}, '')), {q(ACCENTED)}, {q(PLAIN)}), '[^a-z0-9]+', ' ', 'g'))"


def _found(table: str, key: str, text: str) -> str:
    s = _stripped(text)
    safe = "contains(lower(m), '.example') OR contains(lower(m), 'example.com') OR contains(lower(m), 'example.org') OR contains(lower(m), 'example.net')"
    rule = lambda test, name: f"CASE WHEN {test} THEN [{q(name)}] ELSE [] END"
    has = lambda pattern: f"regexp_matches(s, {q(pattern)})"
    preamble = f"(?i)^[{_S}]*(?:(?:here's|here is|here are|as requested|i've|i have|below is|below are){_RIGHT}|(?:sure|certainly|of course|okay|ok)[,!.]|(?:product description|description)[{_S}]*[:-])"
    markup = f"(?m)^[{_S}]*[-*#>][{_S}]|```|^[{_S}]*[[{{]|[*][*]|__"
    promo = f"(?i){_LEFT}(?:enhance|ensures?|delivers?|boosts?|maximi[sz]e[sd]?|experience|discover|introducing|upgrade|transforms?|achieves?|unlocks?|elevates?|streamlines?|optimi[sz]e[sd]?|optimise[rz]|empowers?|revolutioni[sz]e[sd]?|améliore[rz]?|garantit|assure[rz]?|profitez|découvrez){_RIGHT}"
    digits = f"{_LEFT}\\p{{Nd}}[\\p{{Nd}}{_S}().-]{{8,}}\\p{{Nd}}{_RIGHT}"
    entity = f"{_LEFT}(?:(?:Inc|LLC|Ltd|PLC|GmbH|SARL|SAS|Pty|Pvt|Corp|Corporation|Holdings|Incorporated){_RIGHT}|S[.]A[.])"
    person = f"{_LEFT}(?:Mr|Mrs|Ms|Dr|Prof)[.]?[{_S}]+[A-Z][{_W}]"
    found = lambda pattern, group: f"list_filter(regexp_extract_all(s, {q(pattern)}, {group}), lambda m: NOT ({safe}))"
    return f"""s AS (SELECT {key} AS k, {s} AS s FROM {table}),
found AS (SELECT k, CASE WHEN s = '' THEN ['empty'] ELSE list_concat({rule('length(s) < 8', 'too_short')}, {rule('length(s) > 160', 'too_long')}, {rule(has(preamble), 'preamble')},
  {rule(has(markup), 'markup')}, {rule("contains(s, chr(10))", 'multiline')}, {rule(has(promo), 'marketing')}, {rule(f"NOT {has(promo)} AND length(s) > 90 AND contains(s, ' ')", 'prose')},
  list_transform({found(f'[{_W}.+-]+@[{_W}-]+[.][{_W}.]+', 0)}, lambda m: 'pii_email'), list_transform({found(f'(?i){_LEFT}((?:https?://|www[.])[^{_S}]+)', 1)}, lambda m: 'pii_url'),
  {rule(has(digits), 'pii_digits')}, {rule(has(entity), 'entity_name')}, {rule(has(person), 'personal_name')}, {rule("contains(lower(s), 'lorem ipsum')", 'placeholder')}) END AS rules FROM s)"""


USAGE = """calls AS (
  SELECT event_id, ts, ['deepseek-v4-flash', 'qwen3.5-flash', 'claude-haiku-4-5', 'local'][user_id % 4 + 1] AS model, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN event_type = 'error' THEN 0 ELSE coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) END AS input_tokens, CASE WHEN event_type = 'error' THEN 0 ELSE user_id END AS output_tokens, event_type = 'view' AS is_batch
  FROM events),
costs AS (
  SELECT *, input_tokens // 2 AS cached_input_tokens, input_tokens + output_tokens AS total_tokens,
    ((input_tokens - input_tokens // 2) * coalesce(p_in, 0) + output_tokens * coalesce(p_out, 0) + (input_tokens // 2) * coalesce(p_cached, p_in, 0)) * (CASE WHEN is_batch THEN 5 ELSE 10 END) AS e11
  FROM calls LEFT JOIN (SELECT * FROM (VALUES ('deepseek-v4-flash', 1400, 2800, 28), ('qwen3.5-flash', 500, 4000, NULL), ('claude-haiku-4-5', 10000, 50000, NULL)) AS t(model, p_in, p_out, p_cached)) USING (model))"""
COST = "CAST(CAST({0} AS DECIMAL(26,0)) * 0.00000000001 AS DECIMAL(28,12))"
NANO = "(e11 + 50) // 100"
UNITS = "units AS (SELECT o_orderkey AS unit_index, ['pending', 'running', 'done'][o_orderkey % 3 + 1] AS state, CAST(o_orderdate AS TIMESTAMP) AS lease_until FROM orders)"


def _amount(symbol: bool) -> str:
    digits = "format('{:,.2f}', abs(v))"
    nar = "chr(8239)"
    fr = f"translate({digits}, ',.', {nar} || ',')"
    sym = "CASE currency WHEN 'GBP' THEN '£' WHEN 'EUR' THEN '€' ELSE '$' END" if symbol else "''"
    return f"CASE WHEN locale LIKE 'fr%' THEN (CASE WHEN v < 0 THEN '-' || {nar} ELSE '' END) || {fr} || {f'{nar} || {sym}' if symbol else "''"} ELSE (CASE WHEN v < 0 THEN '-' ELSE '' END) || {sym} || {digits} END"


_LONG = """CASE WHEN locale LIKE 'fr%' THEN day(d) || ' ' || ['janvier','février','mars','avril','mai','juin','juillet','août','septembre','octobre','novembre','décembre'][month(d)] || ' ' || year(d)
  WHEN locale = 'en-GB' THEN day(d) || ' ' || strftime(d, '%B %Y') ELSE strftime(d, '%B ') || day(d) || ', ' || year(d) END"""
_SHORT = f"CASE locale WHEN 'en-US' THEN strftime(d, '%m/%d/%Y') WHEN 'en-CA' THEN strftime(d, '%Y-%m-%d') WHEN 'fr-CA' THEN {_LONG} ELSE strftime(d, '%d/%m/%Y') END"
_TRIM = "regexp_replace(regexp_replace(CAST({0} AS VARCHAR), '(\\.\\d*?)0+$', '\\1'), '\\.$', '')"
_MIX = values([(p, sum(w for _, w in MIX[:i]), sum(w for _, w in MIX[: i + 1])) for i, (p, w) in enumerate(MIX)], "provider, lo, hi")

ORACLE = {
    "golden_invoices": f"WITH {BASES} SELECT invoice_id, invoice_index, company_id, invoice_number, issue_date, due_date, jurisdiction, currency, locale, line_item_count, {dec('sub')} AS subtotal, CASE WHEN NOT has_discount THEN 'none' WHEN by_percent THEN 'percent' ELSE 'flat' END AS discount_scheme, CASE WHEN pre THEN 'pre_tax' ELSE 'post_tax' END AS discount_timing, {dec('disc')} AS discount_total, {dec('shipping')} AS shipping_total, {dec('base')} AS taxable_base, {dec('tax')} AS tax_total, tax_bucket_count, {dec('dep')} AS deposit, {dec('grand')} AS grand_total FROM gold",
    "golden_line_items": f"WITH {LINES}, {TIERED}, {PRINTED} SELECT invoice_index, line_no, tier_index, billing_model, sku, quantity, {dec('cents')} AS amount FROM printed",
    "line_tax_buckets": f"WITH {BASES} SELECT invoice_index, rule_no, tax_code, CAST(milli * 0.001 AS DECIMAL(9,3)) AS rate, {dec('base')} AS taxable_base, {dec('tax')} AS tax_amount FROM buckets",
    "reconcile_totals_violations": f"WITH {BASES}, c AS (SELECT count(*) AS n FROM gold) SELECT rule, CAST(0 AS BIGINT) AS violations, n AS checked FROM c, (VALUES ('balance'), ('base'), ('period'), ('negative')) r(rule)",
    "line_sum_check": f"WITH {BASES}, s AS (SELECT invoice_index, sum(cents) AS c FROM lines GROUP BY 1) SELECT count(*) AS invoices, count(*) FILTER (c <> sub) AS differing FROM gold JOIN s USING (invoice_index)",
    "tax_sum_check": f"WITH {BASES}, s AS (SELECT invoice_index, sum(b.tax) AS c FROM buckets b GROUP BY 1) SELECT jurisdiction, count(*) AS invoices, {dec('sum(tax)')} AS tax_total, count(*) FILTER (c <> tax) AS differing FROM gold JOIN s USING (invoice_index) GROUP BY 1",
    "tier_graduated": f"WITH {LINES}, {TIERED} SELECT invoice_index, line_no, tier_index, shared AS units_in_tier, {dec('(shared * myriad + 50) // 100')} AS tier_amount FROM banded",
    "tier_volume": f"WITH {LINES}, {TIERED} SELECT invoice_index, line_no, tier_index, reached AS units_in_tier, {dec('(reached * myriad + 50) // 100')} AS tier_amount FROM banded",
    "tier_sum_check": f"WITH {LINES}, {TIERED} SELECT count(DISTINCT (invoice_index, line_no)) AS lines, sum(shared)::BIGINT AS units, {dec('sum((shared * myriad + 50) // 100)')} AS graduated, {dec('sum((reached * myriad + 50) // 100)')} AS volume FROM banded",
    "billing_amounts_by_model": f"""WITH {LINES}, priced AS (SELECT invoice_index, line_no, billing_model, CAST(round(p_retailprice * 100) AS BIGINT) AS price, CASE billing_model WHEN 'flat_rate' THEN 10 WHEN 'subscription' THEN 10 WHEN 'hourly_labour' THEN 5 * (1 + {h('hours', 'invoice_index', 'line_no')} % 16)
      WHEN 'metered_usage' THEN 1 + {h('volume', 'invoice_index', 'line_no')} % 5000 WHEN 'seat_based' THEN 10 * (1 + {h('seats', 'invoice_index', 'line_no')} % 20) ELSE 10 * quantity END AS tenths FROM lines JOIN part ON part_no = p_partkey)
      SELECT billing_model, count(*) AS lines, CAST(sum(tenths) * 0.1 AS DECIMAL(18,1)) AS quantity, {dec('sum((tenths * price + 5) // 10)')} AS amount FROM priced GROUP BY 1""",
    "telecom_grouping_subtotals": f"WITH {LINES}, g AS (SELECT invoice_index, 'line-' || (1 + {h('subscriber', 'invoice_index', 'line_no')} % 3) AS group_key, billing_model AS section, line_no, cents FROM lines WHERE invoice_index IN (SELECT o_orderkey FROM orders WHERE {one_of(BUSINESS_TYPES, f'o_custkey % {len(BUSINESS_TYPES)}')} = 'telecom')) SELECT invoice_index, group_key, coalesce(section, '*') AS section, min(line_no) AS first_line, {dec('sum(cents)')} AS subtotal FROM g GROUP BY GROUPING SETS ((invoice_index, group_key, section), (invoice_index, group_key))",
    "printed_row_counts": f"WITH {LINES}, {TIERED}, {PRINTED} SELECT invoice_index, count(*) FILTER (tier_index IS NULL) AS line_item_count, count(*) AS printed_row_count FROM printed GROUP BY 1",
    "billing_models_set": f"WITH {LINES} SELECT invoice_index, array_to_string(list_sort(list(DISTINCT billing_model)), ',') AS billing_models FROM lines GROUP BY 1",
    "evaluation_exact_join": f"WITH {BASES}, {EXTRACTED} SELECT g.invoice_id, {dec('g.grand')} AS golden, {dec('e.seen')} AS extracted, g.grand = e.seen AS matches FROM gold g JOIN extracted e USING (invoice_id)",
    "evaluation_field_accuracy": f"WITH {BASES}, {EXTRACTED} SELECT g.locale, count(*) AS invoices, count(*) FILTER (g.grand = e.seen) AS grand_total_hits, count(*) FILTER (g.tax = e.tax) AS tax_total_hits, count(*) FILTER (g.invoice_number = e.invoice_number) AS invoice_number_hits FROM gold g LEFT JOIN extracted e USING (invoice_id) GROUP BY 1",
    "evaluation_row_precision_recall": f"""WITH {LINES}, e AS (SELECT invoice_index, line_no, cents + (CASE WHEN {h('wrong', 'invoice_index', 'line_no')} % 20 = 0 THEN 1 ELSE 0 END) AS cents FROM lines WHERE {h('lost', 'invoice_index', 'line_no')} % 25 <> 0
      UNION ALL SELECT invoice_index, line_no + 1000, cents FROM lines WHERE {h('made up', 'invoice_index', 'line_no')} % 40 = 0)
      SELECT count(*) FILTER (l.cents = e.cents) AS true_positives, count(*) FILTER (e.cents IS NOT NULL AND l.cents IS DISTINCT FROM e.cents) AS false_positives, count(*) FILTER (l.cents IS NOT NULL AND l.cents IS DISTINCT FROM e.cents) AS false_negatives FROM lines l FULL JOIN e USING (invoice_index, line_no)""",
    "selection_compose": f"WITH {COMPANIES} SELECT company_id, business_type, locale FROM firms WHERE locale IN ('en-US', 'fr-FR', 'en-CA') AND business_type IN ('retail', 'wholesale') AND business_type <> 'telecom'",
    "selection_unknown_ids": f"WITH {COMPANIES} SELECT id FROM (VALUES ('c000001'), ('c000002'), ('nobody'), ('c999999')) w(id) WHERE id NOT IN (SELECT company_id FROM firms)",
    "subset_n_of": f"WITH {COMPANIES} SELECT company_id FROM firms ORDER BY {h('subset', 'company_id')}, company_id LIMIT 25",
    "weighted_cdf_draw": f"WITH w AS (SELECT c_custkey, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) + 1 AS weight FROM customer), r AS (SELECT c_custkey, weight, sum(weight) OVER (ORDER BY c_custkey) - weight AS lo, sum(weight) OVER (ORDER BY c_custkey) AS hi, sum(weight) OVER () AS total FROM w), p AS (SELECT o_orderkey, {h('company', 'o_orderkey')} % (SELECT max(total) FROM r) AS point FROM orders) SELECT o_orderkey, c_custkey FROM p JOIN r ON point >= lo AND point < hi",
    "provider_routing": f"SELECT doc_id, provider FROM documents JOIN {_MIX} m ON {h('route', 'doc_id')} % 100 >= lo AND {h('route', 'doc_id')} % 100 < hi",
    "provider_fallback": f"SELECT doc_id, CASE WHEN m.provider = 'fast' THEN (CASE WHEN {h('fallback', 'doc_id')} % 60 < 40 THEN 'batch' ELSE 'local' END) ELSE m.provider END AS provider, m.provider = 'fast' AS fallback FROM documents JOIN {_MIX} m ON {h('route', 'doc_id')} % 100 >= lo AND {h('route', 'doc_id')} % 100 < hi",
    "distinct_then_reshuffle": f"WITH {LINES}, s AS (SELECT invoice_index, line_no - 1 AS slot FROM lines), w AS (SELECT DISTINCT invoice_index, slot // 5 AS pass FROM s), r AS (SELECT invoice_index, pass, choice, row_number() OVER (PARTITION BY invoice_index, pass ORDER BY {h('shuffle', 'invoice_index', 'pass', 'choice')}, choice) - 1 AS place FROM w, range(5) t(choice)) SELECT s.invoice_index, s.slot, r.choice::INTEGER AS choice FROM s JOIN r ON r.invoice_index = s.invoice_index AND r.pass = s.slot // 5 AND r.place = s.slot % 5",
    "stable_seed_values": "SELECT o_orderkey, CAST(CAST(('0x' || substr(sha256('run' || chr(0) || CAST(o_orderkey AS VARCHAR)), 1, 16)) AS UBIGINT) AS VARCHAR) AS seed FROM orders",
    "plan_units": "WITH n AS (SELECT count(*) AS n FROM orders) SELECT 'run' AS run_id, i AS unit_index, i * 1000 AS start_index, least(1000, n - i * 1000) AS n FROM n, range((SELECT (n + 999) // 1000 FROM n)) t(i)",
    "slice_apportion": f"WITH s AS {values([(1, 'pinned', 12500), (2, 'mixed', 51250), (3, 'french', 23125), (4, 'hand', 13125)], 'no, name, milli')}, n AS (SELECT count(*) AS total FROM orders), r AS (SELECT no, name, total, CAST((milli * total + 50000) // 100000 AS BIGINT) AS n FROM s, n) SELECT no, name, CASE WHEN no = 4 THEN total - (SELECT sum(n) FROM r WHERE no < 4)::BIGINT ELSE n END AS n FROM r",
    "unit_progress": f"WITH {UNITS} SELECT state, count(unit_index) AS units FROM (VALUES ('pending'), ('running'), ('done'), ('failed')) s(state) LEFT JOIN units USING (state) GROUP BY 1",
    "next_claimable": f"WITH {UNITS} SELECT unit_index, state FROM units WHERE state = 'pending' ORDER BY unit_index LIMIT 3",
    "expired_leases": f"WITH {UNITS} SELECT unit_index FROM units WHERE state = 'running' AND lease_until <= TIMESTAMP '1996-01-01'",
    "unit_transitions": f"WITH {UNITS} SELECT CASE WHEN state = 'pending' THEN 'running' WHEN state = 'running' THEN 'done' ELSE state END AS state, sum(CASE WHEN state = 'pending' THEN 1 ELSE 0 END)::BIGINT AS attempts, count(*) AS units FROM (SELECT * FROM units) GROUP BY state",
    "manifest_parts": "SELECT doc_id // 100 AS unit_index, count(*) AS documents, sum(octet_length(encode(text)))::BIGINT AS bytes, sha256(string_agg(sha256(text), ',' ORDER BY doc_id)) AS part_sha FROM documents GROUP BY 1",
    "manifest_table_rows": f"WITH {LINES}, {TIERED}, {PRINTED} SELECT 'invoices' AS \"table\", count(DISTINCT invoice_index) AS n FROM lines UNION ALL SELECT 'line_items', count(*) FROM printed UNION ALL SELECT '*', (SELECT count(DISTINCT invoice_index) FROM lines) + (SELECT count(*) FROM printed)",
    "manifest_gaps": "SELECT i AS unit_index FROM range((SELECT (max(doc_id) + 100) // 100 FROM documents)) t(i) WHERE i % 7 = 3",
    "verify_hashes": "SELECT doc_id, CASE WHEN doc_id % 97 = 5 THEN 'missing' ELSE 'altered' END AS problem FROM documents WHERE doc_id % 97 IN (5, 11)",
    "gate_findings": f"WITH {_found('documents', 'doc_id', 'text')} SELECT k AS doc_id, unnest(rules) AS rule FROM found",
    "gate_report": f"WITH {_found('conversations', 'conv_id', 'text')} SELECT rule, count(*) AS findings FROM (SELECT unnest(rules) AS rule FROM found) GROUP BY 1",
    "gate_rejection_rate": f"WITH {_found('part', 'p_partkey', 'p_name')} SELECT count(*) AS items, count(*) FILTER (len(rules) > 0) AS rejected, CAST(round(count(*) FILTER (len(rules) > 0) * 10000 / count(*)) AS BIGINT) AS rate_bp FROM found",
    "near_duplicates": f"SELECT min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY {NORMAL.format('text')} HAVING count(*) > 1",
    "duplicate_totals": f"SELECT count(*) AS groups, coalesce(sum(n), 0)::BIGINT AS items FROM (SELECT count(*) AS n FROM documents GROUP BY {NORMAL.format('text')} HAVING count(*) > 1)",
    "first_wins_dedup": f"SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, {NORMAL.format('text')}",
    "llm_usage_rows": f"WITH {USAGE} SELECT event_id, model, status, input_tokens, output_tokens, cached_input_tokens, total_tokens, is_batch, {COST.format('e11')} AS cost_usd FROM costs",
    "spend_rollup": f"WITH {USAGE} SELECT coalesce(model, '*') AS model, sum({NANO})::BIGINT AS nano, sum(total_tokens)::BIGINT AS tokens, count(*) AS calls FROM costs GROUP BY ROLLUP (model)",
    "spend_nano": f"WITH {USAGE} SELECT event_id, {NANO} AS nano, CAST(CAST({NANO} AS DECIMAL(20,0)) * 0.000000001 AS DECIMAL(28,9)) AS usd FROM costs",
    "budget_prefix": f"WITH {USAGE}, r AS (SELECT event_id, model, sum(e11) OVER (PARTITION BY model ORDER BY event_id) AS run, sum(e11) OVER (PARTITION BY model) AS whole FROM costs) SELECT event_id, model, {COST.format('run')} AS spent FROM r WHERE run <= 100000000000 * 0.05",
    "breaker_streaks": f"WITH {USAGE}, m AS (SELECT model, status, row_number() OVER (PARTITION BY model ORDER BY event_id) - row_number() OVER (PARTITION BY model, status ORDER BY event_id) AS island FROM calls), r AS (SELECT model, count(*) AS n FROM m WHERE status = 'error' GROUP BY model, island) SELECT model, max(n) AS longest_streak, count(*) AS streaks FROM r GROUP BY 1",
    "observed_max_output": f"WITH {USAGE} SELECT event_id, model, max(output_tokens) OVER (PARTITION BY model ORDER BY event_id) AS observed_max FROM calls",
    "usage_by_provider": f"WITH {USAGE} SELECT model, count(*) FILTER (status = 'ok') AS filled, count(*) FILTER (status = 'error') AS failed, {COST.format('sum(e11)')} AS cost_usd FROM costs GROUP BY 1",
    "format_amount_locales": f"WITH {BASES}, a AS (SELECT invoice_index, locale, currency, {dec('CASE WHEN invoice_index % 9 = 0 THEN -grand ELSE grand END')} AS v FROM gold) SELECT invoice_index, {_amount(True)} AS shown, {_amount(False)} AS bare FROM a",
    "format_dates": f"WITH {BASES}, a AS (SELECT invoice_index, locale, issue_date AS d FROM gold) SELECT invoice_index, {_SHORT} AS short, {_LONG} AS long FROM a",
    "format_rate_qty": f"WITH {BASES}, a AS (SELECT invoice_index, rule_no, locale, CAST(milli * 0.001 AS DECIMAL(9,3)) AS rate FROM gold JOIN rules USING (jurisdiction_no)) SELECT invoice_index, rule_no, CASE WHEN locale LIKE 'fr%' THEN replace({_TRIM.format('rate')}, '.', ',') || chr(8239) || '%' ELSE {_TRIM.format('rate')} || '%' END AS rate, {_TRIM.format('CAST(invoice_index * 0.25 AS DECIMAL(18,4))')} AS quantity FROM a",
    "tier_labels": f"SELECT tier_index, CASE WHEN hi IS NULL THEN format('{{:,}}+ calls', lo) ELSE format('{{:,}} – {{:,}} calls', lo, hi) END AS label FROM {BAND_ROWS}",
    "identifiers": "SELECT o_orderkey, format('inv_{:08d}', o_orderkey) AS invoice_id, format('c{:06d}', o_custkey) AS company_id, format('INV-{:d}-{:06d}', year(o_orderdate), o_orderkey) AS invoice_number, format('unit-{:06d}', o_orderkey // 1000) AS unit_key FROM orders",
    "names_and_slugs": f"SELECT c_custkey, upper(array_to_string(list_transform(list_filter(regexp_split_to_array(c_name, '[#\\s]+'), lambda w: w <> '')[1:2], lambda w: w[1]), '')) AS initials, trim(regexp_replace(translate(lower(c_name), {q(ACCENTED)}, {q(PLAIN)}), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer",
    "band_coercion": "WITH b AS (SELECT event_id, CAST(value AS DECIMAL(18,6)) AS lo, CAST(CAST(value AS DECIMAL(18,6)) * [1, 2, 7, 0][event_id % 4 + 1] AS DECIMAL(18,6)) AS hi FROM events) SELECT event_id, CASE WHEN lo > 0 AND hi >= lo AND lo >= 0.5 AND hi <= 600 AND hi <= lo * 6 THEN CAST(lo AS DECIMAL(18,4)) END AS low, CASE WHEN lo > 0 AND hi >= lo AND lo >= 0.5 AND hi <= 600 AND hi <= lo * 6 THEN CAST(hi AS DECIMAL(18,4)) END AS high FROM b",
    "catalogue_overlay": "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN 'generated ' || p_partkey ELSE p_name END AS p_name, p_partkey % 4 = 1 AS filled FROM part",
    "orphan_companies": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "quarantine_union": "SELECT DISTINCT model FROM (SELECT ['deepseek-v4-flash', 'qwen3.5-flash', 'claude-haiku-4-5', 'local'][user_id % 4 + 1] AS model FROM events WHERE event_type = 'error' UNION ALL SELECT 'local')",
    "render_html_documents": f"WITH {BASES}, a AS (SELECT invoice_index, invoice_number, locale, currency, {dec('grand')} AS v, company_id FROM gold) SELECT invoice_index, '<article><h1>' || invoice_number || '</h1><p>' || company_id || ' &amp; Co &lt;' || locale || '&gt;</p><p class=\"total\">' || ({_amount(True)}) || '</p></article>' AS html FROM a",
    "usage_stream_rollup": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS calls, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1, 2",
}
