"""Registered queries over catalogues, pages, replies, manifests and exports, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import alias, permute
from ..operators import catalogue, golden, labels, manifest, pages, replies
from ..operators.catalogue import BILLING, ENDS, FAMILIES, MARKETS, NICHES, PRICE_BANDS, SIZES, SLOTS, STEMS, SUFFIXES, by_rule
from ..operators.golden import table
from ..operators.selection import BUSINESS_TYPES
from ..sources import export, files
from ..sources.shards import Sink
from . import extensions
from .oracle import COMPANIES, LINES, PRINTED, TIERED, dec, h, of_key, one_of, q, values
from .queries import firms

BUILT: dict = {}
BUILT_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        BUILT[f.__name__], BUILT_SQL[f.__name__] = f, sql
        return f

    return add


# -- catalogue -------------------------------------------------------------------


def _firms(table_name: str) -> str:
    market = ", ".join(f"{one_of([m[n] for m in MARKETS], f'i % {len(MARKETS)}')} AS {c}" for n, c in enumerate(("jurisdiction", "locale", "currency")))
    return f"""made AS (SELECT i AS company_no, format('c{{:06d}}', i) AS company_id, {market}, {one_of(BUSINESS_TYPES, f'i % {len(BUSINESS_TYPES)}')} AS business_type FROM range((SELECT count(*) FROM {table_name})) t(i)),
      firms AS (SELECT *, {of_key(FAMILIES, 'business_type', h('category', 'company_no'))} AS product_category FROM made)"""


_WORDS = values([(f, s, i, *by_rule(f, s, i)) for f, sizes in SIZES.items() for s, n in zip(SLOTS, sizes, strict=True) for i in range(n)], "family, slot, place, en, fr")
_SHELVES = f"words AS {_WORDS}, shelves AS (SELECT family, {', '.join(f'list(en ORDER BY place) FILTER (slot = {q(s)}) AS {s}, list(coalesce(fr, en) ORDER BY place) FILTER (slot = {q(s)}) AS {s}_fr' for s in SLOTS)} FROM words GROUP BY 1)"


@query(
    f"""WITH {_firms('customer')} SELECT company_no, company_id, jurisdiction, locale, currency, business_type, product_category,
      product_category || CASE WHEN locale LIKE 'fr%' THEN ', spécialité ' ELSE ', specialty ' END || ({h('niche', 'company_no')} % {NICHES} + 1) AS niche,
      {one_of(STEMS, f"{h('stem', 'company_no')} % {len(STEMS)}")} || {one_of(ENDS, f"{h('end', 'company_no')} % {len(ENDS)}")} || ' ' || {of_key(SUFFIXES, 'jurisdiction', h('suffix', 'company_no'))} AS name,
      round(pow(1 - {h('weight', 'company_no')} / CAST(4503599627370496 AS DOUBLE), CAST({-1 / 1.5!r} AS DOUBLE)), 3) AS weight FROM firms"""
)
def catalogue_companies(spark, d):
    return catalogue.companies(spark, 0, table(spark, d, "customer").count())


@query(
    f"""WITH {_firms('customer')}, {_SHELVES} SELECT family, {' * '.join(f'len({s})' for s in SLOTS)} AS combinations, {' + '.join(f'len({s})' for s in SLOTS)} AS "values", count(company_no) AS companies
      FROM shelves LEFT JOIN firms ON product_category = family GROUP BY ALL"""
)
def catalogue_space(spark, d):
    families = catalogue.shelves(catalogue.vocabulary(spark))
    width = sum((F.size(s) for s in SLOTS[1:]), F.size(SLOTS[0])).cast("long")
    firms = catalogue.companies(spark, 0, table(spark, d, "customer").count()).groupBy(F.col("product_category").alias("family")).agg(F.count("*").alias("companies"))
    return families.select("family", "combinations", width.alias("values")).join(firms, "family", "left").fillna(0, ["companies"])


@query(
    f"""WITH {_firms('customer')}, words AS {_WORDS} SELECT slot, string_agg(DISTINCT en, '|' ORDER BY en) AS missing FROM words WHERE fr IS NULL
      AND family IN (SELECT product_category FROM firms WHERE locale LIKE 'fr%') GROUP BY 1"""
)
def catalogue_untranslated(spark, d):
    french = catalogue.companies(spark, 0, table(spark, d, "customer").count()).where("locale like 'fr%'").select(F.col("product_category").alias("family"))
    return catalogue.untranslated(catalogue.vocabulary(spark).join(french, "family", "left_semi"))


def _mixed(digit: str, r: int) -> str:
    moved = f"(({digit} + k{2 * r}) % {permute.PRIME})"
    return f"(({moved} * {moved}) % {permute.PRIME} * k{2 * r + 1}) % {permute.PRIME}"


def _permuted(rows: str) -> str:
    """walked(..., combination): the n-th combination of rows (size, nth, sha), by walking until a value is below the size."""
    inner = "SELECT *, place // b AS l0, place % b AS r0 FROM walk WHERE steps = 0 OR place >= size"
    for r in range(permute.ROUNDS):
        inner = f"SELECT *, r{r} AS l{r + 1}, (l{r} + {_mixed(f'r{r}', r)}) % {'ab'[r % 2]} AS r{r + 1} FROM ({inner})"
    keys = ", ".join(f"CAST(('0x' || substr(sha, {1 + 8 * i}, 8)) AS BIGINT) % {permute.PRIME} AS k{i}" for i in range(2 * permute.ROUNDS))
    names = "company_no, nth, size, a, b, " + ", ".join(f"k{i}" for i in range(2 * permute.ROUNDS))
    return f"""keyed AS (SELECT company_no, nth, size, CAST(ceil(sqrt(size)) AS BIGINT) AS a, {keys} FROM {rows}),
      walk AS (SELECT company_no, nth, size, a, CAST(ceil(size / a) AS BIGINT) AS b, {', '.join(f'k{i}' for i in range(2 * permute.ROUNDS))}, nth AS place, 0 AS steps FROM keyed
        UNION ALL SELECT {names}, l{permute.ROUNDS} * b + r{permute.ROUNDS}, steps + 1 FROM ({inner})),
      walked AS (SELECT company_no, nth, place AS combination FROM walk WHERE steps > 0 AND place < size)"""


_BANDS = values([(k, round(float(PRICE_BANDS[k][0]) * 10000), round(float(PRICE_BANDS[k][1]) * 10000), *BILLING[k], k[:3].upper()) for k in BUSINESS_TYPES], "business_type, lo, hi, kind, billing_model, code_system, usage_unit, code_prefix")
PRODUCTS = 250


@query(
    f"""WITH RECURSIVE {_firms('supplier')}, {_SHELVES},
      asked AS (SELECT company_no, nth, {' * '.join(f'len({s})' for s in SLOTS)} AS size, sha256('run/' || company_no || '/product') AS sha FROM firms JOIN shelves ON family = product_category, range({PRODUCTS}) t(nth)),
      {_permuted('asked')},
      picked AS (SELECT *, combination // (len(form) * len(variant) * len(pack)) % len(material) + 1 AS m, combination // (len(variant) * len(pack)) % len(form) + 1 AS f, combination // len(pack) % len(variant) + 1 AS v, combination % len(pack) + 1 AS p
        FROM walked JOIN firms USING (company_no) JOIN shelves ON family = product_category JOIN {_BANDS} b USING (business_type)),
      low AS (SELECT *, (lo::BIGINT * 10000 + (hi - lo)::BIGINT * 9 * ({h('price', 'company_no', 'combination')} % 1000) + 5000) // 10000 AS low FROM picked),
      high AS (SELECT *, (low * (1100 + {h('spread', 'company_no', 'combination')} % 1101) + 500) // 1000 AS high FROM low)
      SELECT company_no, company_id || '-' || format('{{:05d}}', nth) AS sku_id, family, combination, material[m] || ' ' || form[f] || ', ' || variant[v] || ' (' || pack[p] || ')' AS description,
        form_fr[f] || ' ' || material_fr[m] || ', ' || variant_fr[v] || ' (' || pack_fr[p] || ')' AS description_fr, CAST(low * 0.0001 AS DECIMAL(18,4)) AS price_low, CAST(high * 0.0001 AS DECIMAL(18,4)) AS price_high,
        kind, billing_model, code_system, usage_unit, code_prefix FROM high"""
)
def catalogue_products(spark, d):
    return catalogue.products(spark, catalogue.companies(spark, 0, table(spark, d, "supplier").count()), PRODUCTS)


def _roster_slots() -> str:
    """The alias table of the built-in roster, worked out again from its weights alone: slots, points kept, both choices."""
    ids = sorted([("anchor", 5_000_000), *((f"fr{i}", 100_000) for i in range(5)), *((f"co{i}", 195_000) for i in range(100))])
    made = alias.alias_table([w for _, w in ids])
    return values([(i, keep, ids[i][0], ids[other][0]) for i, (keep, other) in enumerate(made)], "slot, keep, own, other")


_TOTAL = 5_000_000 + 5 * 100_000 + 100 * 195_000


@query(
    f"""WITH r AS (SELECT o_orderkey, {h('roster', 'o_orderkey')} AS draw FROM orders)
      SELECT o_orderkey, CASE WHEN draw // 106 % {_TOTAL} < keep THEN own ELSE other END AS company_id FROM r JOIN {_roster_slots()} s ON s.slot = draw % 106"""
)
def seed_roster_draws(spark, d):
    return alias.drawn(table(spark, d, "orders").select("o_orderkey"), "roster", F.col("o_orderkey"), catalogue.seed_roster(spark), "company_id", "weight")


# -- pages -----------------------------------------------------------------------

_PLACED = f"""{LINES}, {TIERED}, {PRINTED},
      seen AS (SELECT *, min(line_no) OVER (PARTITION BY invoice_index, billing_model) AS first_line FROM printed),
      sectioned AS (SELECT *, dense_rank() OVER (PARTITION BY invoice_index ORDER BY first_line) AS section_no FROM seen),
      placed AS (SELECT *, row_number() OVER (PARTITION BY invoice_index ORDER BY section_no, line_no, tier_index NULLS FIRST) + section_no - 1 AS row_no FROM sectioned)"""


@query(
    f"""WITH {_PLACED}, s AS (SELECT invoice_index, section_no, billing_model, count(*) AS rows, sum(CASE WHEN tier_index IS NULL THEN cents END) AS cents, min(row_no) AS top, max(row_no) AS bottom FROM placed GROUP BY ALL)
      SELECT invoice_index, section_no, billing_model, rows, {dec('cents')} AS subtotal, (top - 1) // 54 + 1 AS first_page, bottom // 54 + 1 AS last_page, (top - 1) // 54 < bottom // 54 AS spans FROM s"""
)
def spanning_sections(spark, d):
    return pages.sections(golden.printed_rows(spark, d), "invoice_index", "billing_model", ["line_no"], "amount", F.col("tier_index").isNull())


@query(
    f"""WITH {_PLACED}, s AS (SELECT invoice_index, section_no, count(*) AS n, min(row_no) AS top, max(row_no) AS bottom FROM placed GROUP BY ALL),
      w AS (SELECT invoice_index, sum(n)::BIGINT AS printed, count(*) AS sections, count(*) FILTER ((top - 1) // 54 < bottom // 54) AS spanning, (sum(n) + count(*))::BIGINT AS content_rows FROM s GROUP BY 1),
      p AS (SELECT *, (content_rows + 53) // 54 AS pages, content_rows - 54 * ((content_rows + 53) // 54 - 1) AS last_page_rows FROM w)
      SELECT *, CAST((CASE WHEN pages = 1 OR 4 * last_page_rows >= 54 THEN 10000 ELSE greatest(8000, CAST(floor(540000 * (pages - 1) / content_rows + 0.5) AS BIGINT)) END) * 0.0001 AS DECIMAL(5,4)) AS scale FROM p"""
)
def page_fill(spark, d):
    return pages.pages(golden.printed_rows(spark, d), "invoice_index", "billing_model", ["line_no"])


# -- replies ---------------------------------------------------------------------

_REPLIES = """replies AS (SELECT event_id, CASE event_id % 6 WHEN 4 THEN '[{"name": "cut off", "min": 1' WHEN 5 THEN '{"name": "no array"}' ELSE
  '```json' || chr(10) || '[{"name": " item ' || event_id || ' ", "min": ' || (event_id % 7) || ', "max": ' || (event_id % 7 + 3) || '.5}, {"nom": "article ' || user_id || '", "low": "2", "high": 4}, ' || event_id
  || ', {"name": "  "}, {"name": 7, "nom": "number"}, {"name": "", "description": "' || event_type || '", "min": null, "low": 9}, "text", null]' || chr(10) || '```' END AS reply FROM events)"""


@query(
    f"""WITH {_REPLIES}, bare AS (SELECT event_id, trim(regexp_replace(regexp_replace(reply, '^```json', ''), '```$', ''), ' ' || chr(10)) AS t FROM replies),
      each AS (SELECT event_id, unnest(json_extract(t, '$[*]')) AS e, generate_subscripts(json_extract(t, '$[*]'), 1) - 1 AS place FROM bare WHERE json_valid(t) AND json_type(t) = 'ARRAY'),
      named AS (SELECT event_id, CAST(place AS INTEGER) AS place, e, CASE WHEN json_type(e, '$.name') = 'VARCHAR' AND e->>'$.name' <> '' THEN trim(e->>'$.name') WHEN json_exists(e, '$.name') AND json_type(e, '$.name') <> 'VARCHAR' THEN NULL WHEN e->>'$.nom' <> '' THEN trim(e->>'$.nom') ELSE trim(e->>'$.description') END AS name FROM each WHERE json_type(e) = 'OBJECT')
      SELECT event_id, place, name, CASE WHEN json_exists(e, '$.min') THEN e->>'$.min' ELSE e->>'$.low' END AS low, CASE WHEN json_exists(e, '$.max') THEN e->>'$.max' ELSE e->>'$.high' END AS high FROM named WHERE name <> ''"""
)
def parse_llm_json(spark, d):
    key, other = F.col("event_id").cast("string"), F.col("event_id") % 7
    whole = F.concat(
        F.lit('```json\n[{"name": " item '), key, F.lit(' ", "min": '), other.cast("string"), F.lit(', "max": '), (other + 3).cast("string"), F.lit('.5}, {"nom": "article '), F.col("user_id").cast("string"), F.lit('", "low": "2", "high": 4}, '), key,
        F.lit(', {"name": "  "}, {"name": 7, "nom": "number"}, {"name": "", "description": "'), F.col("event_type"), F.lit('", "min": null, "low": 9}, "text", null]\n```'),
    )
    reply = F.when(F.col("event_id") % 6 == 4, F.lit('[{"name": "cut off", "min": 1')).when(F.col("event_id") % 6 == 5, F.lit('{"name": "no array"}')).otherwise(whole)
    return replies.items(table(spark, d, "events").select("event_id", reply.alias("reply")), "reply")


# -- manifests -------------------------------------------------------------------

_ENTRIES = "entries AS (SELECT doc_id // 50 AS unit_index, 'documents/' || format('{:09d}', doc_id) || '.txt' AS key, sha256(coalesce(text, '')) AS sha256, octet_length(encode(coalesce(text, ''))) AS bytes, doc_id FROM documents)"
_PARTS = "{0} AS (SELECT unit_index AS node, 0::BIGINT AS children, count(*) AS documents, sum(bytes)::BIGINT AS bytes, sha256(string_agg('document|' || key || '|' || bytes || '|' || sha256, ',' ORDER BY key)) AS sha FROM {1} GROUP BY 1)"
TREE_FAN, UNIT = 8, 50


def _listed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select(F.expr(f"doc_id div {UNIT}").alias("unit_index"), F.format_string("documents/%09d.txt", "doc_id").alias("key"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"))
    none = rows.where("false").select("unit_index", F.lit("").alias("table"), "key", "sha256", "bytes", F.lit(0).cast("long").alias("rows"))
    return manifest.entries(rows, none)


def _levels() -> str:
    up = "l{0} AS (SELECT node // {2} AS node, count(*) AS children, sum(documents)::BIGINT AS documents, sum(bytes)::BIGINT AS bytes, sha256(string_agg(sha, ',' ORDER BY node)) AS sha FROM l{1} WHERE (SELECT count(*) FROM l{1}) > 1 GROUP BY 1)"
    return ", ".join(up.format(n, n - 1, TREE_FAN) for n in range(1, 9))


@query(f"WITH {_ENTRIES}, {_PARTS.format('l0', 'entries')}, {_levels()} " + " UNION ALL ".join(f"SELECT {n}::INTEGER AS level, * FROM l{n}" for n in range(9)))
def manifest_tree(spark, d):
    made = manifest.parts(_listed(spark, d))
    units = table(spark, d, "documents").agg(F.max("doc_id")).first()[0] // UNIT + 1
    levels = manifest.tree(made, units, TREE_FAN)
    out = levels[0]
    for rows in levels[1:]:
        out = out.unionByName(rows)
    return out


_CHANGED = "doc_id % 977 IN (5, 11)"


@query(
    f"""WITH {_ENTRIES} SELECT unit_index, key, CASE WHEN doc_id % 977 = 5 THEN 'missing blob' ELSE 'altered blob' END AS problem FROM entries WHERE {_CHANGED}
      UNION ALL SELECT DISTINCT unit_index, NULL, 'altered part' FROM entries WHERE {_CHANGED}"""
)
def manifest_problems(spark, d):
    listed = _listed(spark, d)
    docs = table(spark, d, "documents").where("doc_id % 977 <> 5")
    content = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 977 == 11, F.lit("x")).otherwise(F.lit("")))
    blobs = docs.select(F.format_string("documents/%09d.txt", "doc_id").alias("key"), content.alias("content"))
    # what a part would be over the blobs that are there
    now = blobs.select("key", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"))
    there = listed.drop("sha256", "bytes").join(now, "key").select(listed.columns)
    found = manifest.part_problems(there, manifest.parts(listed))
    return manifest.blob_problems(listed, blobs).unionByName(found.select("unit_index", F.lit(None).cast("string").alias("key"), "problem"))


# -- exports and build reports -----------------------------------------------------

_EXPORTED = {"customer": ("c_acctbal", 5), "supplier": ("s_acctbal", 4), "part": ("p_retailprice", 6)}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, {n}::BIGINT AS columns, sum(CAST(round({c} * 100) AS BIGINT))::BIGINT AS cents FROM {t}" for t, (c, n) in _EXPORTED.items()))
def exported_tables(spark, d):
    """Tables written as tagged shards by unit, found again below the run's folder and exported."""
    root, sink = files.scratch(spark, "export"), Sink(spark, files.scratch(spark, "golden"))
    for t in _EXPORTED:
        rows = table(spark, d, t)
        money = [c for c, kind in rows.dtypes if kind == "double"]
        exact = rows.withColumns({c: F.col(c).cast("decimal(18,2)") for c in money})
        export.write_unit_shards(exact.withColumn("unit_index", F.col(rows.columns[0]) % 8), root, "r1", t)
    export.export_run(spark, "r1", root, sink)
    out = None
    for t, (amount, _) in _EXPORTED.items():
        back = spark.read.parquet(f"{sink.path}/{t}").drop("run_id")
        cents = (F.sum(amount) * 100).cast("long").alias("cents")
        one = back.groupBy(F.lit(t).alias("table")).agg(F.count("*").alias("rows"), F.lit(len(back.columns)).cast("long").alias("columns"), cents)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    """WITH r AS (SELECT p_partkey, p_partkey % 4 = 1 AS answered, p_partkey % 12 = 5 AS rejected, p_partkey % 20 = 1 AS bad FROM part)
      SELECT count(*) AS products, count(*) FILTER (answered AND NOT rejected) AS llm_filled, count(*) FILTER (NOT answered OR rejected) AS procedural_fallback, count(*) FILTER (rejected) AS rejected_descriptions,
        count(*) FILTER (answered AND bad AND NOT rejected) AS bad_price_bands, CAST(round(count(*) FILTER (answered AND NOT rejected) * 10000 / count(*)) * 0.0001 AS DECIMAL(9,4)) AS llm_fraction FROM r"""
)
def build_report(spark, d):
    no = F.col("p_partkey")
    answered = no % 4 == 1
    said = F.when(no % 12 == 5, F.lit("Sure, here you go")).when(answered, F.concat(F.lit("generated "), no.cast("string")))
    band = F.when(answered & (no % 20 != 1), F.lit(True))
    return extensions.build_report(extensions.judged(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("description"), said.alias("reply"), band.alias("band")), "description", "reply", F.col("band").isNotNull()))


# -- printed vocabulary ------------------------------------------------------------

_NATION_LANGUAGE = "CASE WHEN locale LIKE 'en%' THEN 'en' ELSE locale END"
_ASKED = ["standard", "caps", "product", "prix_unite", "minimal"]
_HEADERS = values([(lang, name, ", ".join(x for x in row if x)) for lang, by in labels.HEADERS.items() for name, row in by.items()], "language, vocabulary, headers")
_LABELS = values([(lang, row[0], row[n + 1]) for row in labels.LABELS for n, lang in enumerate(labels.HEADERS)], "language, key, shown")


@query(
    f"""WITH {COMPANIES}, h AS {_HEADERS}, l AS {_LABELS}, a AS (SELECT o_orderkey, {_NATION_LANGUAGE} AS language, {one_of(_ASKED, f'o_orderkey % {len(_ASKED)}')} AS vocabulary, {one_of([r[0] for r in labels.LABELS], f'o_orderkey % {len(labels.LABELS)}')} AS key FROM orders JOIN firms ON o_custkey = c_custkey)
      SELECT o_orderkey, coalesce(own.headers, std.headers) AS headers, own.headers IS NULL AS fell_back, l.shown AS label
      FROM a LEFT JOIN h own ON own.language = a.language AND own.vocabulary = a.vocabulary JOIN h std ON std.language = a.language AND std.vocabulary = 'standard' JOIN l ON l.language = a.language AND l.key = a.key"""
)
def label_lookup_fallback(spark, d):
    known, no = labels.Labels.built_in(spark), F.col("o_orderkey")
    of = lambda options: F.element_at(F.array(*map(F.lit, options)), (no % len(options) + 1).cast("int"))
    tongue = F.when(F.col("locale").startswith("en"), "en").otherwise(F.col("locale"))
    homes = firms(spark, d).select("company_id", tongue.alias("language"))
    asked = table(spark, d, "orders").select("o_orderkey", F.format_string("c%06d", "o_custkey").alias("company_id")).join(homes, "company_id")
    named = known.column_headers(known.shown(asked, F.col("language"), of([r[0] for r in labels.LABELS]), "label"), F.col("language"), of(_ASKED))
    return named.select("o_orderkey", F.array_join("headers.shown", ", ").alias("headers"), "fell_back", "label")


@query(
    f"""WITH {COMPANIES} SELECT o_orderkey, 'meta-' || m || ' totals-' || t || ' table-' || b || ' lang-' || replace(lower({_NATION_LANGUAGE}), '-', '_') || CASE WHEN o_custkey % 10 < 8 THEN ' has-logo' ELSE ' no-logo' END || CASE WHEN m = 'top-row' THEN ' meta-banner' ELSE '' END AS classes
      FROM (SELECT *, {one_of(['top-row', 'left', 'right'], 'o_custkey % 3')} AS m, {one_of(['plain', 'boxed'], 'o_custkey % 2')} AS t, {one_of(['ruled', 'striped', 'open', 'grid'], 'o_custkey % 4')} AS b FROM orders JOIN firms ON o_custkey = c_custkey)"""
)
def page_classes(spark, d):
    no = F.col("o_custkey")
    of = lambda options: F.element_at(F.array(*map(F.lit, options)), (no % len(options) + 1).cast("int"))
    tongue = F.when(F.col("locale").startswith("en"), "en").otherwise(F.col("locale"))
    homes = firms(spark, d).select("company_id", tongue.alias("language"))
    rows = table(spark, d, "orders").withColumn("company_id", F.format_string("c%06d", "o_custkey")).join(homes, "company_id")
    return rows.select("o_orderkey", labels.body_classes(F.col("language"), of(["top-row", "left", "right"]), of(["plain", "boxed"]), of(["ruled", "striped", "open", "grid"]), no % 10 < 8).alias("classes"))


@query(
    f"""WITH {_firms('supplier')}, {_SHELVES} SELECT business_type, count(*) AS companies, sum(least({PRODUCTS}, {' * '.join(f'len({s})' for s in SLOTS)}))::BIGINT AS products, count(DISTINCT family) AS families
      FROM firms JOIN shelves ON family = product_category GROUP BY 1"""
)
def pooled_products(spark, d):
    """Products pooled over the companies of each business type."""
    made = catalogue.companies(spark, 0, table(spark, d, "supplier").count())
    pool = catalogue.pooled(made, catalogue.products(spark, made, PRODUCTS))
    return pool.groupBy("business_type").agg(F.countDistinct("company_no").alias("companies"), F.count("*").alias("products"), F.countDistinct("family").alias("families"))
