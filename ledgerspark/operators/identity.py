"""What follows from an identifier alone: addresses, registrations, page profile, wear, receivers; and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash52, pick
from ..functions.text import slug
from .catalogue import STEMS

# Street names by rule: every name stem of the catalogue with every kind of street.
STREETS = [f"{stem} {kind}" for kind in ("Road", "Street", "Way", "Lane") for stem in STEMS]
# Weights in percent of the general page layouts; the capture conditions' rotation and noise.
LAYOUTS = [("meta-sidebar-01", 40), ("banner-header-06", 20), ("boxed-form-01", 17), ("fullbleed-05", 13), ("receipt-compact-01", 10)]
FLOOR_OF_WEAR = "0.15"


def identity(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Address, contact and registrations of a company, from its key and name."""
    k = F.col(key)
    digits = lambda what, n: F.lpad((hash52(what, k) % 10**n).cast("string"), n, "0")
    host = F.concat(slug(F.col(name)), F.lit(".example.com"))
    return rows.select(
        key,
        F.concat((1 + hash52("house", k) % 240).cast("string"), F.lit(" "), pick("street", STREETS, k)).alias("address"),
        F.concat(F.lit("billing@"), host).alias("email"),
        F.concat(F.lit("https://www."), host).alias("website"),
        F.concat(digits("siren", 9), digits("nic", 5)).alias("siret"),
        F.concat(F.lit("GB"), digits("vat", 9)).alias("vat"),
        F.concat(digits("ein head", 2), F.lit("-"), digits("ein", 7)).alias("ein"),
    )


def layout(key: Column, handwritten: Column) -> Column:
    """Page layout by weight; a handwritten capture has its own form."""
    point, edge, out = hash52("layout", key) % 100, 0, None
    for name, weight in LAYOUTS:
        edge += weight
        out = F.when(point < edge, name) if out is None else out.when(point < edge, name)
    return F.when(handwritten, "handwritten-form-01").otherwise(out)


def wear(key: Column, low_milli: int, high_milli: int) -> Column:
    """Wear to three decimals, evenly inside a preset."""
    return ((low_milli + hash52("wear", key) % (high_milli - low_milli + 1)).cast("decimal(9,0)") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(4,3)")


def scaled(value: Column, factor: Column) -> Column:
    """A degradation setting scaled by wear, which never falls below its floor."""
    least = F.greatest(factor, F.lit(FLOOR_OF_WEAR).cast("decimal(4,3)"))
    return F.round(value.cast("decimal(9,3)") * least, 3).cast("decimal(9,3)")


def issue_day(key: Column, first: Column, last: Column, floor: Column) -> Column:
    """A day of the window; the floor raises its start, but never past its end."""
    start = F.greatest(first, F.least(floor, last))
    return F.date_add(start, (hash52("day", key) % (F.datediff(last, start) + 1)).cast("int"))


def receiver(key: Column, issuer: Column, people: int, attempts: int = 12) -> Column:
    """A receiver other than the issuer: the first of a few independent draws that differs."""
    tries = F.array(*(hash52(f"receiver {a}", key) % people for a in range(attempts)))
    return F.coalesce(F.element_at(F.filter(tries, lambda x: x != issuer), 1), (issuer + 1) % people)


def chunks(items: DataFrame, group: str, order: str, size: int = 50, run: str = "build", turn: int = 0) -> DataFrame:
    """Requests of at most ``size`` items of a group, with an id that names the round."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    numbered = items.withColumn("chunk", F.expr("0").cast("long") + F.floor(nth / size))
    out = numbered.groupBy(group, "chunk").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return out.withColumn("item_id", F.format_string(f"{run}:%d:%d:r{turn}", F.col(group), F.col("chunk")))


def zipped(requests: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Slots of a request with the reply of the same place; slots beyond the reply stay unfilled."""
    slots = requests.select(key, F.posexplode("slots").alias("place", "slot"))
    texts = replies.select(key, F.posexplode("texts").alias("place", "text"))
    return slots.join(texts, [key, "place"], "left")


def usage_counts(reply: Column) -> tuple[Column, Column, Column]:
    """(input, output, cached) tokens across the shapes that providers answer in."""
    first = lambda *paths: F.coalesce(*(F.get_json_object(reply, p).cast("long") for p in paths), F.lit(0).cast("long"))
    return (
        first("$.usage.prompt_tokens", "$.usage.input_tokens"),
        first("$.usage.completion_tokens", "$.usage.output_tokens"),
        first("$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens", "$.usage.prompt_cache_hit_tokens"),
    )


def prompt(kind: Column, language: Column, count: Column, examples: Column) -> Column:
    """The request for line-item names, in the catalogue's language, with a few examples as JSON."""
    shown = F.to_json(F.slice(examples, 1, 6))
    english = F.concat(F.lit("List "), count.cast("string"), F.lit(" line items of a "), kind, F.lit(" business as JSON. Examples: "), shown)
    french = F.concat(F.lit("Donne "), count.cast("string"), F.lit(" lignes d'une entreprise "), kind, F.lit(" en JSON. Exemples : "), shown)
    return F.when(F.startswith(language, F.lit("fr")), french).otherwise(english)
