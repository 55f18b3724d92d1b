"""Keyed permutations of 0..size-1: the n-th value is computed, so nothing is drawn, compared or sorted to avoid repeats.

A value is two digits (left of ``a``, right of ``b``, a * b >= size), and each round adds a keyed function of one digit to
the other, which can be undone whatever the function.  Values past the size are permuted again until they fall inside
("cycle walking"); fewer than ``a`` of them exist, so walks are short.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, ROUNDS, WALK = 2_147_483_647, 4, 64


def round_keys(run_id: str, name: str, *keys: Column) -> Column:
    """Two numbers below ``PRIME`` for each round, from one SHA-256 of (run, keys, name)."""
    digest = F.sha2(F.concat_ws("/", F.lit(run_id), *(k.cast("string") for k in keys), F.lit(name)), 256)
    number = lambda i: F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME
    return F.array(*(F.struct(number(2 * r).alias("add"), number(2 * r + 1).alias("times")) for r in range(ROUNDS)))


def _mixed(digit: Column, key: Column) -> Column:
    moved = (digit + key["add"]) % PRIME
    return moved * moved % PRIME * key["times"] % PRIME


def permuted(value: Column, size: Column, keys: Column) -> Column:
    """The place of ``value`` (0 to size - 1) in the permutation that the round keys give; a value outside raises."""
    a = F.ceil(F.sqrt(size.cast("double"))).cast("long")
    b = F.ceil(size / a).cast("long")

    def once(x: Column) -> Column:
        start = F.struct((x / b).cast("long").alias("l"), (x % b).alias("r"), a.alias("m"), b.alias("n"))
        # the digits change places each round, and so do their moduli
        end = F.aggregate(keys, start, lambda s, k: F.struct(s["r"].alias("l"), ((s["l"] + _mixed(s["r"], k)) % s["m"]).alias("r"), s["n"].alias("m"), s["m"].alias("n")))
        return end["l"] * b + end["r"]

    walk = F.aggregate(F.sequence(F.lit(1), F.least(a, F.lit(WALK)).cast("int")), once(value), lambda at, _: F.when(at < size, at).otherwise(once(at)))
    inside = (value >= 0) & (value < size)
    return F.when(inside, walk).otherwise(F.raise_error(F.concat(value.cast("string"), F.lit(" asked of "), size.cast("string"), F.lit(" values"))).cast("long"))
