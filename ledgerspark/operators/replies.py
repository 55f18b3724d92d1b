"""Replies of language models read tolerantly: every item of a JSON array by itself, malformed ones left out one by one.

Cases: a fence around the reply goes; a reply that is null, no JSON or no array has no items; an item that is no object, or
whose name is no string or blank, is left out; the name is the first of ``name``, ``nom`` and ``description`` that says
anything; bounds come from ``min`` and ``max``, or where these keys are absent from ``low`` and ``high``, as text or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of a fenced reply, at line starts and ends.
FENCE = r"(?m)^```(?:json)?|```$"
# The keys under which items name themselves, and those of their bounds.
NAMES, LOW, HIGH = ("name", "nom", "description"), ("min", "low"), ("max", "high")


def _at(item: str, key: str) -> Column:
    return F.expr(f"try_variant_get({item}, '$.{key}', 'variant')")


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _says(value: Column) -> Column:
    """Whether a value is there and is not null, false, zero or empty."""
    text = F.coalesce(F.try_variant_get(value, "$", "string"), F.lit(""))
    empty = F.when(_kind(value) == "STRING", text == "").otherwise(text.isin("", "false", "0", "0.0", "[]", "{}"))
    return value.isNotNull() & (_kind(value) != "VOID") & ~empty


def items(replies: DataFrame, reply: str) -> DataFrame:
    """The rows of ``replies`` without the reply, one for each item: adds ``place`` (from 0), ``name``, ``low``, ``high``."""
    others = [c for c in replies.columns if c != reply]
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.col(reply), r"^\s+|\s+$", ""), FENCE, ""))
    read = replies.select(*(F.col(f"`{c}`") for c in others), F.try_parse_json(bare).alias("_reply"))
    array = F.when(F.startswith(_kind(F.col("_reply")), F.lit("ARRAY")), F.expr("try_variant_get(_reply, '$', 'array<variant>')"))
    each = read.select(*(F.col(f"`{c}`") for c in others), F.posexplode(array).alias("place", "_item"))
    each = each.where(F.startswith(_kind(F.col("_item")), F.lit("OBJECT")))
    named = F.coalesce(*(F.when(_says(_at("_item", k)), _at("_item", k)) for k in NAMES))
    each = each.withColumn("_name", named).where(_kind(F.col("_name")) == "STRING")
    bound = lambda keys: F.try_variant_get(F.coalesce(*(_at("_item", k) for k in keys)), "$", "string")
    out = each.select(*(F.col(f"`{c}`") for c in others), F.col("place").cast("int").alias("place"), F.regexp_replace(F.try_variant_get("_name", "$", "string"), r"^\s+|\s+$", "").alias("name"), bound(LOW).alias("low"), bound(HIGH).alias("high"))
    return out.where(F.col("name") != "")
