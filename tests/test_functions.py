"""Column functions against published numbers."""

import hashlib
import itertools
import re
import unicodedata
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerspark.functions import draws, locale, money, text
from ledgerspark.operators import golden


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_seed_is_the_head_of_the_digest(spark):
    want = int.from_bytes(hashlib.sha256(b"r\x0042").digest()[:8], "big")
    assert int(one(spark, draws.stable_seed("r", F.lit(42)))) == want


def test_money_rounds_half_away_from_zero(spark):
    assert one(spark, money.money(F.lit("1.005").cast("decimal(9,3)"))) == Decimal("1.01")
    assert one(spark, money.money(F.lit("-1.005").cast("decimal(9,3)"))) == Decimal("-1.01")
    assert one(spark, money.pct(F.lit("9.975"), F.lit("210.00"))) == Decimal("20.95")


@pytest.mark.parametrize("cost,nano", [("0.0000004", 400), ("0.0000000005", 1), ("0.0000000004", 0)])
def test_nano(spark, cost, nano):
    assert one(spark, money.to_nano(F.lit(cost).cast(money.COST))) == nano


def test_cost_of_cached_and_batched_tokens(spark):
    rates = [F.lit(x) for x in ("0.14", "0.28", "0.0028")]
    assert one(spark, money.token_cost(F.lit(1000), F.lit(10), F.lit(400), rates)) == Decimal("0.000087920000")
    assert one(spark, money.token_cost(F.lit(1), F.lit(0), F.lit(5), rates, F.lit(True))) == Decimal("0.000000007000")
    assert one(spark, money.token_cost(F.lit(9), F.lit(9), F.lit(0), [F.lit(None)] * 3)) == 0


@pytest.mark.parametrize(
    "place,currency,value,want",
    [("en-US", "USD", "1234567.50", "$1,234,567.50"), ("en-US", "USD", "-42.00", "-$42.00"), ("fr-FR", "EUR", "1234.50", "1 234,50 €"), ("fr-CA", "CAD", "-1.00", "- 1,00 $")],
)
def test_amounts(spark, place, currency, value, want):
    assert one(spark, locale.format_amount(F.lit(value).cast("decimal(18,2)"), F.lit(currency), F.lit(place))) == want


def test_rates_quantities_dates(spark):
    assert one(spark, locale.format_rate(F.lit("9.975").cast("decimal(9,3)"), F.lit("en-CA"))) == "9.975%"
    assert one(spark, locale.format_rate(F.lit("20.000").cast("decimal(9,3)"), F.lit("fr-FR"))) == "20 %"
    assert one(spark, locale.format_quantity(F.lit("12.50").cast("decimal(9,2)"))) == "12.5"
    assert one(spark, locale.format_quantity(F.lit("100").cast("decimal(9,0)"))) == "100"
    day = F.lit("2026-07-15").cast("date")
    assert one(spark, locale.format_date_long(day, F.lit("fr-FR"))) == "15 juillet 2026"
    assert one(spark, locale.format_date(day, F.lit("en-US"))) == "07/15/2026"
    assert one(spark, locale.format_date(day, F.lit("fr-CA"))) == "15 juillet 2026"


def test_graduated_and_volume_tiers(spark):
    lines = spark.createDataFrame([(1, 150_000), (2, 10_000), (3, 0)], "n int, units long")
    total = lambda how: {r.n: r.s for r in golden.tiered(lines, spark, how).groupBy("n").agg(F.sum("tier_amount").alias("s")).collect()}
    assert total("graduated") == {1: Decimal("205.00"), 2: Decimal("20.00"), 3: Decimal("0.00")}
    assert total("volume") == {1: Decimal("150.00"), 2: Decimal("20.00"), 3: Decimal("0.00")}


@pytest.mark.parametrize(
    "value,rules",
    [("", ["empty"]), ("  \n", ["empty"]), ("bolt", ["too_short"]), ("x" * 161, ["too_long"]), ("Sure, here it is", ["preamble"]), ("- steel bolts", ["markup"]), ("steel\nbolts", ["multiline"]),
     ("write to a@b.org or c@d.org", ["pii_email", "pii_email"]), ("mail me@example.com now", []), ("see https://x.io/abc", ["pii_url"]), ("see https://a.example.org/b", []), ("Ensures a tight fit", ["marketing"]), ("Here's a steel bolt", ["preamble"]), ("Découvrez la vis", ["marketing"]), ("call 555-123-4567 x", ["pii_digits"]), ("Acme Ltd brackets", ["entity_name"]), ("for Mr Smith only", ["personal_name"]), ("Lorem Ipsum dolor", ["placeholder"]), ("Galvanised steel bracket 40 mm", [])],
)
def test_gates(spark, value, rules):
    assert one(spark, text.findings(F.lit(value))) == rules


def test_normalised_texts_collide(spark):
    same = [one(spark, text.normalised(F.lit(t))) for t in ("Écrou  Acier", "ecrou acier", "ÉCROU-acier ")]
    assert same == ["ecrou acier"] * 3
    assert one(spark, text.normalised(F.lit(None).cast("string"))) == ""


def test_initials_and_slugs(spark):
    assert one(spark, text.initials(F.lit("  golden  ledger works "))) == "GL"
    assert one(spark, text.slug(F.lit("Café & Fils"))) == "cafe-fils"


@pytest.mark.parametrize("raw", ["Ærø ﬁnal ﬂow", "x² + y³ = ½", "Ｆｕｌｌ Ｗｉｄｔｈ", "Ĳssel №5 ℡", "Éléphant naïve Straße", "日本 abc", "", "Å\u0301ngström", "㎏ ㎜ ﬃ"])
def test_normal_form_folds_compatible_characters(spark, raw):
    folded = "".join(c for c in unicodedata.normalize("NFKD", raw.lower()) if not unicodedata.combining(c))
    assert one(spark, text.normalised(F.lit(raw))) == re.sub("[^a-z0-9]+", " ", folded).strip()


@pytest.mark.parametrize("raw,rule", [("Sure, here it is at last", "preamble"), ("Description - brake pads", "preamble"), ("surely a fine thing", None), ("Upgraded seat covers", None), ("Maximises the output", "marketing"), ("call +33 (0)1 23 45 67 89 now", "pii_digits"), ("mail a.b@corp.net today", "pii_email"), ("see WWW.corp.net today", "pii_url"), ("http://x.example ok then", None)])
def test_rules(spark, raw, rule):
    assert one(spark, text.findings(F.lit(raw))) == ([rule] if rule else [])


def test_running_values_over_many_buckets(spark, monkeypatch):
    from ledgerspark.operators import usage

    rows = [(i, "ab"[i % 7 % 2], "error" if i % 11 < 7 or 40 <= i < 90 else "ok", i * 37 % 101, Decimal(i % 9) / 1000) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, model string, status string, output_tokens long, cost_usd decimal(28,12)")
    read = lambda: [sorted(map(tuple, f.collect())) for f in (usage.failure_streaks(frame), usage.running_max(frame), usage.budget_prefix(frame, F.lit("0.3").cast("decimal(28,12)")))]
    whole = read()
    for size in (1, 4, 13):
        monkeypatch.setattr(usage, "BUCKET", size)
        assert read() == whole
    longest = max(len(list(g)) for k, g in itertools.groupby(r[2] for r in rows if r[1] == "a") if k == "error")
    assert dict((m, n) for m, n, _ in whole[0])["a"] == longest


def test_cumulative_weights_over_many_ranges(spark):
    frame = spark.createDataFrame([(i, i % 5) for i in range(500)], "k long, w long").repartition(7)
    got = sorted(map(tuple, draws.cumulative(frame, "k", "w").collect()))
    edge, want = 0, []
    for i in range(500):
        want.append((i, i % 5, edge + i % 5, edge, 1000))
        edge += i % 5
    assert got == want
