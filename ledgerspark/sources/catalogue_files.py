"""Catalogues as files: companies and products by build unit, and a manifest that is written last.

A unit is a pair of Parquet folders that can be written again; a catalogue is complete once it is sealed, that is once its
manifest is there.  The manifest names version, units and row counts, and a table beside it has length and SHA-256 of every
file, both computed where the files are read; nothing but counts comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.money import PRICE

#: The newest layout that this module writes and reads.
LAYOUT = 1
#: Rows of a file, which bounds what one task hashes at once.
FILE_ROWS = 1_000_000
TABLES = ("companies", "products")
# The declared columns of both tables.
COMPANY_COLUMNS = "company_id string, name string, business_type string, product_category string, llm_niche string, jurisdiction string, locale string, currency string, weight double"
PRODUCT_COLUMNS = f"company_id string, sku_id string, description string, description_fr string, kind string, billing_model string, code_system string, code_prefix string, usage_unit string, price_low {PRICE}, price_high {PRICE}"
COLUMNS = {"companies": COMPANY_COLUMNS, "products": PRODUCT_COLUMNS}


@dataclass(frozen=True)
class Catalogue:
    """A sealed catalogue as read."""

    manifest: dict
    companies: DataFrame
    products: DataFrame


def declared(df: DataFrame, table: str) -> DataFrame:
    """A frame's declared columns in order and type; those that it lacks are null, others are left out."""
    return df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(COLUMNS[table])))


def _folder(path: str, table: str, unit: int) -> str:
    return f"{path}/{table}/unit-{unit:06d}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def _there(spark: SparkSession, path: str) -> bool:
    fs, where = _file_system(spark, path)
    return fs.exists(where)


def _refuse_empty(companies: DataFrame, products: DataFrame, what: str) -> None:
    bare = [r.company_id for r in companies.join(products.select("company_id"), "company_id", "left_anti").select("company_id").orderBy("company_id").limit(3).collect()]
    if bare:
        raise ValueError(f"companies of {what} have no products, such as {bare}")


def write_unit(companies: DataFrame, products: DataFrame, path: str, unit: int = 0) -> None:
    """Write one unit's companies and products, in place of what the unit had; the catalogue has to be sealed again.

    Companies without a product and a unit without companies are refused before anything is written.
    """
    spark = companies.sparkSession
    companies, products = declared(companies, "companies"), declared(products, "products")
    if companies.isEmpty():
        raise ValueError("a catalogue needs at least one company")
    _refuse_empty(companies, products, f"unit {unit}")
    fs, manifest = _file_system(spark, f"{path}/manifest")
    fs.delete(manifest, True)
    for table, rows in zip(TABLES, (companies, products), strict=True):
        ranged = rows.repartitionByRange("company_id").sortWithinPartitions("company_id")
        ranged.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(_folder(path, table, unit))


def _hashes(spark: SparkSession, path: str, units: list[int]) -> DataFrame:
    """(file, length, sha256) of every file of the units, named from the catalogue's folder on."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load([_folder(path, t, u) for t in TABLES for u in units])
    return files.select(F.substring_index("path", "/", -3).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def _tables(spark: SparkSession, path: str, units: list[int]) -> list[DataFrame]:
    return [spark.read.schema(COLUMNS[t]).parquet(*(_folder(path, t, u) for u in units)) for t in TABLES]


def seal(spark: SparkSession, path: str, version: str, units: Iterable[int], provenance: dict | None = None) -> dict:
    """Write the manifest over these units; a repeated or missing one is refused."""
    listed = sorted(units)
    if not listed or len(set(listed)) != len(listed):
        raise ValueError(f"units must be there and differ: {listed}")
    missing = [u for u in listed for t in TABLES if not _there(spark, f"{_folder(path, t, u)}/_SUCCESS")]
    if missing:
        raise ValueError(f"units {sorted(set(missing))} of {path!r} are not written")
    _hashes(spark, path, listed).write.mode("overwrite").parquet(f"{path}/files")
    counts = dict(zip(TABLES, (t.count() for t in _tables(spark, path, listed)), strict=True))
    manifest = {"catalogue_version": version, "schema_version": LAYOUT, "units": listed, "rows": counts, "provenance": provenance or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def write_catalogue(companies: DataFrame, products: DataFrame, path: str, version: str, provenance: dict | None = None) -> dict:
    """A catalogue of one unit, sealed."""
    write_unit(companies, products, path)
    return seal(companies.sparkSession, path, version, [0], provenance)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The manifest; its absence and a newer layout are errors."""
    if not _there(spark, f"{path}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no manifest in {path!r}: the catalogue is not complete")
    manifest = json.loads(spark.read.text(f"{path}/manifest").first().value)
    if manifest["schema_version"] > LAYOUT:
        raise ValueError(f"the catalogue in {path!r} has layout {manifest['schema_version']}, known are those up to {LAYOUT}")
    return manifest


def load_catalogue(spark: SparkSession, path: str, verify: bool = True) -> Catalogue:
    """Companies and products of the sealed units; with ``verify`` every file is hashed again and compared."""
    manifest = read_manifest(spark, path)
    if verify:
        kept, found = spark.read.parquet(f"{path}/files"), _hashes(spark, path, manifest["units"])
        same = kept.withColumn("a", F.lit(1)).join(found.withColumn("b", F.lit(1)), ["file", "length", "sha256"], "full")
        wrong = [r.file for r in same.where("a is null or b is null").select("file").distinct().orderBy("file").limit(3).collect()]
        if wrong:
            raise ValueError(f"files of {path!r} are not as sealed, such as {wrong}")
    companies, products = _tables(spark, path, manifest["units"])
    _refuse_empty(companies, products, repr(path))
    return Catalogue(manifest, companies, products)


def by_company(products: DataFrame) -> DataFrame:
    """(company_id, products): the products of each company as one list in the order of their SKU.

    A list is as long as the company's range of products, which is set when the catalogue is made.
    """
    rest = [c for c in products.columns if c != "company_id"]
    ordered = ["sku_id", *(c for c in rest if c != "sku_id")]
    return products.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(*ordered))).alias("products"))
