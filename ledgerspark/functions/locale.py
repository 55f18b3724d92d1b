"""Amounts, dates, rates and quantities as a locale prints them, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NARROW = "\u202f"
# Per locale the decimal mark, group mark, symbol side, gap, and short date pattern.
LOCALES = {
    "en-US": (".", ",", "before", "", "MM/dd/yyyy"),
    "en-CA": (".", ",", "before", "", "yyyy-MM-dd"),
    "en-GB": (".", ",", "before", "", "dd/MM/yyyy"),
    "fr-CA": (",", NARROW, "after", NARROW, "long"),
    "fr-FR": (",", NARROW, "after", NARROW, "dd/MM/yyyy"),
}
# Currency symbols and month names.
SYMBOLS = {"USD": "$", "CAD": "$", "GBP": "£", "EUR": "€"}
MONTHS = {
    "en": ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
}


def _by_locale(locale: Column, make) -> Column:
    out = None
    for name in LOCALES:
        out = F.when(locale == name, make(name)) if out is None else out.when(locale == name, make(name))
    return out


def format_amount(value: Column, currency: Column, locale: Column, with_symbol: bool = True) -> Column:
    """Grouped amount with two decimals; the symbol stands inside the negative prefix."""
    symbol = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SYMBOLS.items() for x in kv)), currency), F.lit(""))

    def make(name: str) -> Column:
        mark, group, side, gap, _ = LOCALES[name]
        digits = F.translate(F.format_number(F.abs(value), 2), ",.", group + mark)
        body = digits if not with_symbol else F.concat(symbol, F.lit(gap), digits) if side == "before" else F.concat(digits, F.lit(gap), symbol)
        return F.concat(F.when(value < 0, F.lit("-" + gap)).otherwise(F.lit("")), body)

    return _by_locale(locale, make)


def trimmed(value: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def format_rate(rate: Column, locale: Column) -> Column:
    return _by_locale(locale, lambda n: F.concat(F.translate(trimmed(rate), ".", LOCALES[n][0]), F.lit(LOCALES[n][3] + "%")))


def format_quantity(quantity: Column) -> Column:
    return trimmed(quantity)


def format_date_long(day: Column, locale: Column) -> Column:
    month = lambda lang: F.element_at(F.array(*map(F.lit, MONTHS[lang])), F.month(day))
    number, year = F.dayofmonth(day).cast("string"), F.year(day).cast("string")

    def make(name: str) -> Column:
        if name.startswith("fr"):
            return F.concat_ws(" ", number, month("fr"), year)
        if name == "en-GB":
            return F.concat_ws(" ", number, month("en"), year)
        return F.concat(month("en"), F.lit(" "), number, F.lit(", "), year)

    return _by_locale(locale, make)


def format_date(day: Column, locale: Column) -> Column:
    return _by_locale(locale, lambda n: format_date_long(day, F.lit(n)) if LOCALES[n][4] == "long" else F.date_format(day, LOCALES[n][4]))
