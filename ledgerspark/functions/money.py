"""Cent-exact money: decimals, rounded half away from zero at printed boundaries only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS, RATE, PRICE, COST = "decimal(18,2)", "decimal(9,3)", "decimal(18,4)", "decimal(28,12)"

# Provider prices, USD per million tokens (input, output, cached input; null: as input).
PRICES = [
    ("deepseek-v4-flash", "0.14", "0.28", "0.0028"),
    ("qwen3.5-flash", "0.05", "0.40", None),
    ("claude-haiku-4-5", "1.00", "5.00", None),
]


def money(x: Column) -> Column:
    return F.round(x, 2).cast(CENTS)


def pct(rate: Column, base: Column) -> Column:
    """A percentage of an amount, as printed."""
    return money(base.cast(CENTS) * rate.cast(RATE) / F.lit(100).cast("decimal(3,0)"))


def sum_money(x: Column) -> Column:
    """Exact sum, 0.00 of nothing."""
    return F.coalesce(F.sum(x.cast(CENTS)), F.lit(0).cast(CENTS)).cast(CENTS)


def price(x: Column) -> Column:
    """Two decimals, four below one unit."""
    return F.when(x < 1, F.round(x, 4)).otherwise(F.round(x, 2)).cast(PRICE)


def to_nano(cost: Column) -> Column:
    """USD as an integer count of 1e-9."""
    return F.round(cost.cast("decimal(28,12)") * F.lit(1_000_000_000).cast("decimal(10,0)"), 0).cast("long")


def from_nano(nano: Column) -> Column:
    return (nano.cast("decimal(20,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(28,9)")


def token_cost(tokens_in: Column, tokens_out: Column, cached: Column, rates: tuple[Column, Column, Column], batch: Column | None = None) -> Column:
    """Cost of a call: uncached input not below zero, unknown rates free, half price in a batch."""
    rate = lambda r: F.coalesce(r.cast("decimal(8,4)"), F.lit(0).cast("decimal(8,4)"))
    whole = lambda n: n.cast("decimal(12,0)")
    micro = (whole(F.greatest(tokens_in - cached, F.lit(0))) * rate(rates[0]) + whole(tokens_out) * rate(rates[1]) + whole(cached) * rate(F.coalesce(rates[2], rates[0]))).cast("decimal(24,4)")
    cost = (micro * F.lit("0.000001").cast("decimal(7,6)")).cast(COST)
    return cost if batch is None else F.when(batch, (cost * F.lit("0.5").cast("decimal(2,1)")).cast(COST)).otherwise(cost)


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")
