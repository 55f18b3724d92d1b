"""How a document's rows fall on its printed pages: sections in the order they are first seen, breaks, the last page's fill.

A page takes ``ROWS`` rows, and each section has a heading row above its own.  Everything is worked out within a document by
windows over its rows, so documents are laid out side by side and none is gathered.

Cases: a null section is a section; a document of one page never shrinks; an empty table has no pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import sum_money

# Rows a page, how full a last page has to be (in quarters of a page), and the least scale (in ten-thousandths).
ROWS, QUARTERS, LEAST_SCALE = 54, 1, 8_000


def placed(rows: DataFrame, key: str, section: str, order: list[str], rows_per_page: int = ROWS) -> DataFrame:
    """Rows with ``section_no`` (from 1, in first-seen order), ``row_no`` (from 0, headings counted) and ``page`` (from 1).

    ``order``: the columns that order a document's rows, the first without nulls; further ones sort nulls first.
    """
    by = [F.asc_nulls_first(c) for c in order]
    seen = F.first(F.struct(*order)).over(Window.partitionBy(key, section).orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    marked = rows.withColumn("_seen", seen)
    whole = Window.partitionBy(key).orderBy("_seen", F.asc_nulls_first(section))
    numbered = marked.withColumn("section_no", F.dense_rank().over(whole).cast("long"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("section_no", *by))
    out = numbered.withColumn("row_no", (nth + F.col("section_no") - 1).cast("long"))
    return out.withColumn("page", F.expr(f"row_no div {rows_per_page} + 1")).drop("_seen")


def _laid_out(rows: DataFrame, key: str, section: str, order: list[str], own: Column, rows_per_page: int) -> DataFrame:
    """One row a section: ``section_no``, ``rows``, ``subtotal``, ``first_page`` and ``last_page``.

    Rows are summed up first, so that windows hold a row for each section and not for each line.
    """
    first = F.min(order[0] if len(order) == 1 else F.struct(*order))
    found = rows.groupBy(key, section).agg(first.alias("_seen"), F.count("*").alias("rows"), sum_money(own).alias("subtotal"))
    whole = Window.partitionBy(key).orderBy("_seen", F.asc_nulls_first(section))
    numbered = found.withColumn("section_no", F.row_number().over(whole).cast("long"))
    upto = numbered.withColumn("_upto", F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    # the heading of a section is the row above its first one
    first_page = F.expr(f"(_upto - rows + section_no - 1) div {rows_per_page} + 1")
    return upto.withColumn("first_page", first_page).withColumn("last_page", F.expr(f"(_upto + section_no - 1) div {rows_per_page} + 1"))


def sections(rows: DataFrame, key: str, section: str, order: list[str], amount: str, counted: Column | None = None, rows_per_page: int = ROWS) -> DataFrame:
    """One row a section: rows, subtotal of those ``counted`` (all, if None), the pages from its heading to its last row, and
    whether it goes on past a page's end."""
    own = F.col(amount) if counted is None else F.when(counted, F.col(amount))
    at = _laid_out(rows, key, section, order, own, rows_per_page)
    return at.select(key, "section_no", section, "rows", "subtotal", "last_page", "first_page", (F.col("first_page") < F.col("last_page")).alias("spans"))


def pages(rows: DataFrame, key: str, section: str, order: list[str], rows_per_page: int = ROWS) -> DataFrame:
    """One row a document: printed rows, rows with headings, pages, rows on the last page, sections that span pages, and the
    scale that spares a last page of less than a quarter (not below four fifths)."""
    at = _laid_out(rows, key, section, order, F.lit(0), rows_per_page)
    spanning = F.count(F.when(F.col("first_page") < F.col("last_page"), 1))
    whole = at.groupBy(key).agg(F.sum("rows").alias("printed"), F.count("*").alias("sections"), spanning.alias("spanning"))
    content = F.col("printed") + F.col("sections")
    out = whole.withColumn("content_rows", content).withColumn("pages", F.expr(f"(content_rows + {rows_per_page - 1}) div {rows_per_page}"))
    out = out.withColumn("last_page_rows", content - rows_per_page * (F.col("pages") - 1))
    shrunk = F.expr(f"(20000 * (pages - 1) * {rows_per_page} + content_rows) div (2 * content_rows)")
    full = (F.col("pages") == 1) | (4 * F.col("last_page_rows") >= QUARTERS * rows_per_page)
    scale = F.when(full, F.lit(10_000).cast("long")).otherwise(F.greatest(shrunk, F.lit(LEAST_SCALE)))
    return out.withColumn("scale", (scale.cast("decimal(9,0)") * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(5,4)"))
