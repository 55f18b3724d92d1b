"""Printed vocabulary as tables: labels by language and key, column headers by language and vocabulary, and their checks.

A label that is not there fails the job that asks for it, so that no document is printed with a blank header; a vocabulary
that a language lacks gives way to the language's ``standard`` one as a whole.  Lookups are joins with the tables, which are
as small as their languages and keys; keys that share one hot value stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STANDARD = "standard"
# Printed labels (key, English, Canadian French, French).
LABELS = [
    ("invoice", "Invoice", "Facture", "Facture"),
    ("issue_date", "Date", "Date", "Date"),
    ("due_date", "Due", "Échéance", "Échéance"),
    ("bill_to", "Bill To", "Facturer à", "Facturé à"),
    ("discount", "Discount", "Rabais", "Remise"),
    ("subtotal", "Subtotal", "Sous-total", "Total HT"),
    ("tax_total", "Total Tax", "Total des taxes", "Total TVA"),
    ("total", "Total", "Total général", "Total TTC"),
]
# Headers of the four columns (description, quantity, unit price, amount) by language and vocabulary; none: no such column.
HEADERS = {
    "en": {"standard": ("Description", "Quantity", "Unit Price", "Amount"), "caps": ("DESCRIPTION", "QUANTITY", "UNIT PRICE", "AMOUNT"), "unit_cost": ("Description", "Qty", "Unit Cost", "Amount"), "product": ("Product", "Qty", "Rate", "Total"), "minimal": ("Item Name", None, None, "Cost")},
    "fr-CA": {"standard": ("Description", "Quantité", "Prix unitaire", "Montant"), "prix_unite": ("Description", "Quantité", "Prix d'unité", "Total"), "minimal": ("Description", None, None, "Montant")},
    "fr-FR": {"standard": ("Désignation", "Quantité", "Prix unitaire HT", "Montant HT"), "minimal": ("Désignation", None, None, "Montant")},
}
COLUMNS = ("description", "quantity", "unit_price", "amount")


@dataclass(frozen=True)
class Labels:
    """Tables (language, key, shown) and (language, vocabulary, place, key, shown), and the language that sets the keys."""

    labels: DataFrame
    headers: DataFrame
    reference: str = "en"

    @classmethod
    def built_in(cls, spark: SparkSession) -> Labels:
        labels = [(language, row[0], row[n + 1]) for row in LABELS for n, language in enumerate(HEADERS)]
        headers = [(language, name, place, COLUMNS[place], shown) for language, by in HEADERS.items() for name, row in by.items() for place, shown in enumerate(row) if shown is not None]
        return cls(spark.createDataFrame(labels, "language string, key string, shown string"), spark.createDataFrame(headers, "language string, vocabulary string, place int, key string, shown string"))

    def languages(self) -> DataFrame:
        return self.labels.select("language").distinct()

    def problems(self) -> DataFrame:
        """(language, problem, keys): keys that a language lacks, has beyond the reference's or leaves blank, and languages
        without headers or without the standard ones."""
        wanted = F.array(*(F.lit(r.key) for r in self.labels.where(F.col("language") == self.reference).select("key").distinct().orderBy("key").collect())).cast("array<string>")
        blank = F.when(F.trim(F.coalesce("shown", F.lit(""))) == "", F.col("key"))
        held = self.labels.groupBy("language").agg(F.collect_set("key").alias("own"), F.collect_set(blank).alias("blank"))
        listed = lambda keys, problem: held.select("language", F.lit(problem).alias("problem"), F.array_join(F.array_sort(keys), ", ").alias("keys")).where("keys <> ''")
        known = self.headers.groupBy("language").agg(F.max(F.col("vocabulary") == STANDARD).alias("has_standard"))
        of_language = self.languages().join(known, "language", "left")
        bare = of_language.where("has_standard is null").select("language", F.lit("no headers").alias("problem"), F.lit("").alias("keys"))
        no_standard = of_language.where("not has_standard").select("language", F.lit("no standard headers").alias("problem"), F.lit("").alias("keys"))
        found = listed(F.array_except(wanted, "own"), "missing").unionByName(listed(F.array_except("own", wanted), "unexpected")).unionByName(listed(F.col("blank"), "blank"))
        return found.unionByName(bare).unionByName(no_standard)

    def validate(self) -> None:
        if self.labels.where(F.col("language") == self.reference).isEmpty():
            raise ValueError(f"the reference language {self.reference!r} has no labels")
        wrong = [f"{r.language}: {r.problem} {r['keys']}".strip() for r in self.problems().orderBy("language", "problem").limit(20).collect()]
        if wrong:
            raise ValueError("label tables are inconsistent: " + "; ".join(wrong))

    def shown(self, rows: DataFrame, language: Column, key: Column, name: str = "shown") -> DataFrame:
        """Rows with the label of a key in a language; one that is not there fails."""
        asked = rows.withColumn("_language", language).withColumn("_key", key)
        table = self.labels.select(F.col("language").alias("_language"), F.col("key").alias("_key"), F.col("shown").alias("_shown"))
        miss = F.raise_error(F.concat(F.lit("no label "), F.coalesce("_key", F.lit("null")), F.lit(" for language "), F.coalesce("_language", F.lit("null")))).cast("string")
        return asked.join(table, ["_language", "_key"], "left").withColumn(name, F.coalesce("_shown", miss)).drop("_language", "_key", "_shown")

    def column_headers(self, rows: DataFrame, language: Column, vocabulary: Column) -> DataFrame:
        """Rows with ``headers`` (an array of key and text, in order) of a vocabulary, and whether it is the standard one in
        place of one that the language lacks; a language without a standard vocabulary fails."""
        lists = self.headers.groupBy("language", "vocabulary").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "shown"))), lambda c: F.struct(c["key"].alias("key"), c["shown"].alias("shown"))).alias("own"))
        standard = lists.where(F.col("vocabulary") == STANDARD).select(F.col("language").alias("_language"), F.col("own").alias("_standard"))
        asked = rows.withColumn("_language", language).withColumn("_vocabulary", vocabulary)
        own = lists.select(F.col("language").alias("_language"), F.col("vocabulary").alias("_vocabulary"), F.col("own").alias("_own"))
        met = asked.join(own, ["_language", "_vocabulary"], "left").join(standard, "_language", "left")
        miss = F.raise_error(F.concat(F.lit("no vocabulary for language "), F.coalesce("_language", F.lit("null")))).cast("array<struct<key: string, shown: string>>")
        return met.withColumn("headers", F.coalesce("_own", "_standard", miss)).withColumn("fell_back", F.col("_own").isNull()).drop("_language", "_vocabulary", "_own", "_standard")


def body_classes(language: Column, meta_position: Column, totals_style: Column, table_style: Column, has_logo: Column) -> Column:
    """The style classes of a page's body, space-joined."""
    logo = F.when(has_logo, "has-logo").otherwise("no-logo")
    banner = F.when(meta_position == "top-row", F.lit("meta-banner"))
    return F.concat_ws(" ", F.concat(F.lit("meta-"), meta_position), F.concat(F.lit("totals-"), totals_style), F.concat(F.lit("table-"), table_style), F.concat(F.lit("lang-"), F.replace(F.lower(language), F.lit("-"), F.lit("_"))), logo, banner)
