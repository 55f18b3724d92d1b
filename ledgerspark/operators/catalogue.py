"""Catalogues: companies by round-robin and hash, products by keyed permutations of slot words, overlays and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import permute
from ..functions.draws import hash52, pick
from ..functions.money import PRICE, price
from .selection import BUSINESS_TYPES

# Markets in round-robin order (jurisdiction, locale, currency).
MARKETS = [("US", "en-US", "USD"), ("CA-ON", "en-CA", "CAD"), ("CA-BC", "en-CA", "CAD"), ("GB", "en-GB", "GBP"), ("FR", "fr-FR", "EUR"), ("CA-QC", "fr-CA", "CAD")]
# Price bands by business type.
PRICE_BANDS = {"retail": ("0.30", "220"), "wholesale": ("6", "180"), "auto_repair": ("9", "480"), "b2b_saas": ("12", "1800"), "accounting": ("90", "2400"), "ai_platform": ("0.0004", "6"), "telecom": ("0.01", "0.60"), "legal": ("120", "3500"), "consulting": ("180", "4500"), "marketing_agency": ("150", "6000")}
# Slot sizes (material, form, variant, pack) of each product family, and the families of each business type.
SIZES = {
    "hardware and fasteners": (8, 10, 8, 5), "office and IT supplies": (7, 12, 6, 4), "apparel and accessories": (7, 10, 6, 3), "home and kitchenware": (8, 10, 6, 4),
    "packaging and shipping supplies": (7, 8, 7, 5), "auto parts and repair": (6, 8, 6, 4), "software subscriptions": (5, 6, 5, 3), "accounting and tax services": (6, 6, 4, 3),
    "AI platform usage": (6, 5, 4, 3), "telecom services": (5, 5, 5, 3), "garden and outdoor": (8, 10, 6, 4), "pet supplies": (7, 10, 6, 4), "sporting goods": (7, 10, 6, 4),
    "health and beauty": (7, 10, 6, 4), "toys and games": (7, 10, 6, 4), "legal services": (6, 8, 4, 3), "consulting services": (6, 8, 4, 3), "marketing services": (6, 8, 4, 3),
}
FAMILIES = {
    "retail": ("hardware and fasteners", "office and IT supplies", "apparel and accessories", "home and kitchenware", "garden and outdoor", "pet supplies", "sporting goods", "health and beauty", "toys and games"),
    "wholesale": ("packaging and shipping supplies",), "auto_repair": ("auto parts and repair",), "b2b_saas": ("software subscriptions",), "accounting": ("accounting and tax services",),
    "ai_platform": ("AI platform usage",), "telecom": ("telecom services",), "legal": ("legal services",), "consulting": ("consulting services",), "marketing_agency": ("marketing services",),
}
# How each business type bills (line kind, billing model, code system, usage unit).
BILLING = {
    "retail": ("product", "per_unit", "sku", "none"), "wholesale": ("product", "per_unit", "unspsc", "none"), "auto_repair": ("part", "per_unit", "mpn", "none"),
    "b2b_saas": ("subscription", "subscription", "none", "none"), "accounting": ("service", "flat_rate", "none", "none"), "ai_platform": ("usage", "metered_usage", "none", "tokens_input"),
    "telecom": ("usage", "metered_usage", "none", "megabytes"), "legal": ("service", "flat_rate", "none", "none"), "consulting": ("service", "flat_rate", "none", "none"), "marketing_agency": ("service", "flat_rate", "none", "none"),
}
# Legal forms by jurisdiction.
SUFFIXES = {"US": ("Inc.", "LLC", "Co.", "Corp.", "Holdings"), "CA-ON": ("Inc.", "Ltd.", "Group"), "CA-QC": ("inc.", "ltée", "Groupe"), "CA-BC": ("Inc.", "Ltd."), "CA-AB": ("Inc.", "Ltd."), "GB": ("Ltd", "PLC", "Group", "& Co"), "FR": ("SARL", "SAS", "SA", "et Cie")}
SLOTS, NICHES = ("material", "form", "variant", "pack"), 10
# Name stems by rule: 36 beginnings, 24 ends.
STEMS = [a + b for a in ("Bal", "Cor", "Den", "Fal", "Gar", "Hol") for b in ("a", "e", "i", "o", "u", "y")]
ENDS = [a + b for a in ("berg", "dale", "fort", "mere") for b in ("", "en", "ine", "on", "ham", "ton")]


def by_rule(family: str, slot: str, place: int) -> tuple[str, str | None]:
    """A slot's value and its French rendering, for a vocabulary that nobody has written: numbered kinds of the family.

    Variants of services stay without a rendering, as words that need none.
    """
    no = place + 1
    if slot == "material":
        return f"Grade {chr(65 + place)}", f"de qualité {chr(65 + place)}"
    if slot == "form":
        return f"{family.split()[0]} item {no}", f"Article {no} ({family.split()[0]})"
    if slot == "variant":
        return f"level {no}" if family.endswith("services") else f"size {no}", None if family.endswith("services") else f"taille {no}"
    return f"pack of {no * no}", f"paquet de {no * no}"


def vocabulary(spark: SparkSession, rows: list[tuple] | DataFrame | None = None) -> DataFrame:
    """Slot values as (family, slot, place, en, fr); the given ones, or those of the rule at the fixed sizes."""
    if isinstance(rows, DataFrame):
        return rows.select("family", "slot", "place", "en", "fr")
    made = rows if rows is not None else [(f, s, i, *by_rule(f, s, i)) for f, sizes in SIZES.items() for s, n in zip(SLOTS, sizes, strict=True) for i in range(n)]
    return spark.createDataFrame(made, "family string, slot string, place int, en string, fr string")


def shelves(words: DataFrame) -> DataFrame:
    """One row for each family: its words by slot (English, and French where there is a rendering), and its combinations."""
    entry = F.struct("place", "en", F.coalesce("fr", "en").alias("fr"))
    rows = words.groupBy("family").agg(*(F.array_sort(F.collect_list(F.when(F.col("slot") == s, entry))).alias(s) for s in SLOTS))
    total = F.lit(1).cast("long")
    for s in SLOTS:
        total = total * F.size(s)
    return rows.withColumn("combinations", total)


def untranslated(words: DataFrame) -> DataFrame:
    """Words without a French rendering, by slot."""
    return words.where("fr is null").groupBy("slot").agg(F.array_join(F.array_sort(F.collect_set("en")), "|").alias("missing"))


def _of(table: dict, key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, F.array(*map(F.lit, v))) for k, v in table.items()))


def _one(options: Column, draw: str, no: Column) -> Column:
    return F.element_at(options, (hash52(draw, no) % F.size(options) + 1).cast("int"))


def category(business_type: Column, no: Column) -> Column:
    """The one product family that a company sells."""
    return _one(_of(FAMILIES, business_type), "category", no)


def niche(family: Column, locale: Column, no: Column) -> Column:
    """A company's specialty inside its family, in its own language."""
    nth = hash52("niche", no) % NICHES + 1
    return F.when(locale.startswith("fr"), F.format_string("%s, spécialité %d", family, nth)).otherwise(F.format_string("%s, specialty %d", family, nth))


def suffix(jurisdiction: Column, draw: str, no: Column) -> Column:
    """A legal form of the place; "Ltd." where it has none of its own."""
    return _one(F.coalesce(_of(SUFFIXES, jurisdiction), F.array(F.lit("Ltd."))), draw, no)


def companies(spark: SparkSession, start: int, end: int) -> DataFrame:
    """Companies of an index range, each from its index alone.

    Market and business type go round; family, niche and name are hashed apart from them and from each other.  The weight
    has a long tail (Pareto, 1.5).
    """
    i = F.col("id")
    market = F.element_at(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(m, ("jurisdiction", "locale", "currency"), strict=True))) for m in MARKETS)), (i % len(MARKETS) + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, BUSINESS_TYPES)), (i % len(BUSINESS_TYPES) + 1).cast("int"))
    weight = F.round(F.pow(1 - hash52("weight", i) / F.lit(2.0**52), F.lit(-1 / 1.5)), 3)
    rows = spark.range(start, end).select(i.alias("company_no"), F.format_string("c%06d", i).alias("company_id"), market.alias("m"), kind.alias("business_type"), weight.alias("weight")).select("company_no", "company_id", "m.*", "business_type", "weight")
    no = F.col("company_no")
    rows = rows.withColumn("product_category", category(F.col("business_type"), no))
    names = F.concat(pick("stem", STEMS, no), pick("end", ENDS, no), F.lit(" "), suffix(F.col("jurisdiction"), "suffix", no))
    return rows.withColumn("niche", niche(F.col("product_category"), F.col("locale"), no)).withColumn("name", names)


def products(spark: SparkSession, companies_df: DataFrame, count: int, words: DataFrame | None = None) -> DataFrame:
    """``count`` distinct products of each company, all of its family, priced inside its business type's band.

    The n-th product is the combination that a keyed permutation of the family's combinations has at place n, so products
    are computed one by one: there is no table of combinations, no sort and no shuffle.  More than the family has raises.
    """
    families = shelves(vocabulary(spark) if words is None else words)
    most = families.agg(F.max("combinations")).first()[0] or 0
    if count > most:
        raise ValueError(f"{count} products asked for, no family has more than {most}")
    shape = [(k, *PRICE_BANDS[k], *BILLING[k], k[:3].upper()) for k in BUSINESS_TYPES]
    band = spark.createDataFrame(shape, "business_type string, low string, high string, kind string, billing_model string, code_system string, usage_unit string, code_prefix string").withColumn("low", F.col("low").cast(PRICE)).withColumn("high", F.col("high").cast(PRICE))
    firms = companies_df.select("company_no", "company_id", "business_type", F.col("product_category").alias("family"))
    firms = firms.join(F.broadcast(families), "family").join(F.broadcast(band), "business_type").withColumn("_keys", permute.round_keys("run", "product", F.col("company_no")))
    chosen = firms.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    chosen = chosen.withColumn("combination", permute.permuted(F.col("nth"), F.col("combinations"), F.col("_keys")))
    rest, picked = F.col("combination"), {}
    for s in reversed(SLOTS):
        picked[s] = F.element_at(s, (rest % F.size(s) + 1).cast("int"))
        rest = (rest / F.size(s)).cast("long")
    say = lambda order, language: F.format_string("%s %s, %s (%s)", *(picked[s][language] for s in order))
    at = (hash52("price", F.col("company_no"), F.col("combination")) % 1000).cast("decimal(9,0)") * F.lit("0.0009").cast("decimal(5,4)")
    up = ((1100 + hash52("spread", F.col("company_no"), F.col("combination")) % 1101).cast("decimal(9,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(9,3)")
    out = chosen.withColumn("price_low", F.round(F.col("low") + (F.col("high") - F.col("low")) * at, 4).cast(PRICE))
    out = out.withColumn("price_high", F.round(F.col("price_low") * up, 4).cast(PRICE))
    described = (say(SLOTS, "en").alias("description"), say(("form", "material", "variant", "pack"), "fr").alias("description_fr"))
    return out.select("company_no", F.format_string("%s-%05d", "company_id", "nth").alias("sku_id"), "family", "combination", *described, "price_low", "price_high", "kind", "billing_model", "code_system", "usage_unit", "code_prefix")


def pooled(companies_df: DataFrame, products_df: DataFrame) -> DataFrame:
    """Every product with the business type of its company: what all companies of a type sell together."""
    return products_df.join(companies_df.select("company_no", "business_type"), "company_no")


def seed_roster(spark: SparkSession, anchor: int = 50_000, french: int = 5, french_each: int = 1_000, others: int = 100, others_total: int = 195_000) -> DataFrame:
    """The built-in roster: one anchor company, a few French ones, and the others that share the rest of the weight.

    Weights are whole numbers, in ``others``-ths so that equal shares stay exact.
    """
    unit = max(1, others)
    rows = [("anchor", "US", "en-US", "USD", anchor * unit)]
    rows += [(f"fr{i}", *(("FR", "fr-FR", "EUR") if i % 2 == 0 else ("CA-QC", "fr-CA", "CAD")), french_each * unit) for i in range(french)]
    places = [("US", "en-US", "USD"), ("CA-ON", "en-CA", "CAD"), ("GB", "en-GB", "GBP"), ("CA-BC", "en-CA", "CAD")]
    rows += [(f"co{i}", *places[i % 4], others_total) for i in range(others)]
    made = spark.createDataFrame(rows, "company_id string, jurisdiction string, locale string, currency string, weight long")
    kind = F.element_at(F.array(*map(F.lit, BUSINESS_TYPES)), (hash52("roster type", F.col("company_id")) % len(BUSINESS_TYPES) + 1).cast("int"))
    return made.withColumn("business_type", kind)


def orphans(companies_df: DataFrame, products_df: DataFrame, key: str) -> DataFrame:
    """Companies without a product."""
    return companies_df.join(products_df.select(key), key, "left_anti")


def overlay(skeleton: DataFrame, generated: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Generated text over a skeleton; where it is missing or blank the skeleton stays."""
    new = generated.select(*keys, F.col(column).alias("_new"))
    joined = skeleton.join(new, keys, "left")
    usable = F.trim(F.coalesce("_new", F.lit(""))) != ""
    return joined.withColumn("filled", usable).withColumn(column, F.when(usable, F.col("_new")).otherwise(F.col(column))).drop("_new")


def coerced_band(low, high, floor, ceiling):
    """A quoted price band: positive, in order, inside the envelope, not wider than six times; else null."""
    lo, hi = low.cast("decimal(18,6)"), high.cast("decimal(18,6)")
    fine = (lo > 0) & (hi >= lo) & (lo >= floor) & (hi <= ceiling) & (hi <= lo * 6)
    return F.when(fine, F.struct(price(lo).alias("low"), price(hi).alias("high")))
