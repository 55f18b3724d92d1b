"""Export of a run's golden shards: tables and their columns are found in the shards, not declared.

Shards lie below ``<root>/<prefix>/golden/<table>/`` as gzipped tagged JSON lines; a path's segment names the table,
and whatever else lies below the root (documents, manifests) is not looked at.  A table's columns come from one pass over its
lines as variants: names in the order of first sight, types by what was seen, decimals as wide as their widest value.

Damaged shards: a line that is no JSON object, or a file that breaks off, is named with its shard and the rest counts; the
export itself refuses tables with damaged shards unless told to leave the damaged lines out.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import exists
from .shards import Sink, encoded_row, tag_of, tagged_schema

#: Bytes of a shard that are decompressed at once.
CHUNK = 1 << 20


def golden_folder(root: str, run_id: str, prefix: str | None = None) -> str:
    return f"{root.rstrip('/')}/{prefix or run_id}/golden"


def write_unit_shards(rows: DataFrame, root: str, run_id: str, table: str, unit: str = "unit_index", prefix: str | None = None) -> None:
    """A table's rows as tagged shards, a file for each unit; a unit written again is replaced."""
    named = rows.select(F.format_string("unit-%06d", unit).alias("unit"), *(F.col(f"`{c}`") for c in rows.columns if c != unit))
    body = named.select("unit", encoded_row(named.drop("unit")).alias("value"))
    body.repartition("unit").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "gzip").partitionBy("unit").text(f"{golden_folder(root, run_id, prefix)}/{table}")


def lines(spark: SparkSession, root: str, run_id: str, prefix: str | None = None) -> DataFrame | None:
    """(table, shard, value) of every line of a run's shards, or None for a run that has none."""
    folder = golden_folder(root, run_id, prefix)
    if not exists(spark, folder):
        return None
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").option("ignoreCorruptFiles", "true").text(folder)
    below = F.regexp_extract(F.col("_metadata.file_path"), "/golden/(.+)$", 1)
    return read.select(F.element_at(F.split(below, "/"), 1).alias("table"), below.alias("shard"), "value")


def columns(found: DataFrame) -> DataFrame:
    """(table, name, place, kinds, whole, scale): what each column's values are, and the digits that its decimals need."""
    row = F.try_parse_json("value")
    each = found.select("table", row.alias("row")).where(F.startswith(F.schema_of_variant("row"), F.lit("OBJECT")))
    exploded = each.lateralJoin(each.sparkSession.tvf.variant_explode(F.col("row").outer())).select("table", "pos", F.col("key").alias("name"), "value")
    kind = F.schema_of_variant("value")
    digits = F.try_variant_get("value", "$.__decimal__", "string")
    scale = F.length(F.regexp_extract(digits, r"\.(\d+)$", 1))
    whole = F.length(F.regexp_replace(F.regexp_replace(digits, r"\.\d+$", ""), r"^-?0*", ""))
    return exploded.groupBy("table", "name").agg(F.min("pos").alias("place"), F.array_sort(F.collect_set(F.when(kind != "VOID", kind))).alias("kinds"), F.coalesce(F.max(whole), F.lit(0)).alias("whole"), F.coalesce(F.max(scale), F.lit(0)).alias("scale"))


def _type(name: str, kinds: list[str], whole: int, scale: int) -> str:
    if not kinds:
        return "string"  # nothing but nulls
    if kinds == ["OBJECT<__decimal__: STRING>"]:
        if whole + scale > 38:
            raise ValueError(f"column {name!r} needs {whole + scale} digits")
        return f"decimal({min(38, max(18, whole + scale))},{scale})"
    if kinds == ["OBJECT<__date__: STRING>"]:
        return "date"
    plain = {"BOOLEAN": "boolean", "STRING": "string", "BIGINT": "bigint"}
    if len(kinds) == 1 and kinds[0] in plain:
        return plain[kinds[0]]
    if all(k in ("BIGINT", "DOUBLE") or k.startswith("DECIMAL(") for k in kinds):
        return "double"
    if all(k.startswith("ARRAY<") for k in kinds):
        return "array<string>"
    raise ValueError(f"column {name!r} holds {kinds}")


def schemas(found: DataFrame) -> dict[str, StructType]:
    """Each table's schema; what comes to the driver is one row for each column."""
    by: dict[str, list] = {}
    for r in columns(found).collect():
        by.setdefault(r.table, []).append(r)
    return {t: StructType.fromDDL(", ".join(f"`{r.name}` {_type(r.name, r.kinds, r.whole, r.scale)}" for r in sorted(rows, key=lambda r: (r.place, r.name)))) for t, rows in sorted(by.items())}


def table_rows(found: DataFrame, table: str, schema: StructType) -> DataFrame:
    """One table's rows with their types back; lines that are no object are left out."""
    raw = found.where((F.col("table") == table) & F.startswith(F.schema_of_variant(F.try_parse_json("value")), F.lit("OBJECT")))
    row = raw.select(F.from_json("value", tagged_schema(schema)).alias("r"))
    return row.select(*(F.col(f"r.`{f.name}`.`{t}`").cast(f.dataType).alias(f.name) if (t := tag_of(f.dataType)) else F.col(f"r.`{f.name}`").alias(f.name) for f in schema))


def export_run(spark: SparkSession, run_id: str, root: str, sink: Sink, prefix: str | None = None, damaged: str = "refuse") -> dict[str, int]:
    """Write every table found in a run's shards to ``sink`` and register them; rows by table, none for an unknown run.

    ``damaged``: "refuse" raises if a shard is damaged, "skip" leaves damaged lines and what is cut off out.
    """
    found = lines(spark, root, run_id, prefix)
    if found is None:
        return {}
    if damaged == "refuse":
        bad = [r.shard for r in shard_report(spark, root, run_id, prefix).where("error is not null").orderBy("shard").limit(3).collect()]
        if bad:
            raise ValueError(f"damaged shards, such as {bad}")
    counts = {}
    for table, schema in schemas(found).items():
        rows = table_rows(found, table, schema)
        target = sink.write(table, rows if "run_id" in schema.names else rows.withColumn("run_id", F.lit(run_id)))
        counts[table] = spark.read.parquet(target).where(F.col("run_id") == run_id).count()
    if sink.named:
        sink.register()
    return counts


# -- totals and damage ----------------------------------------------------------


def _lines_of(content: bytes) -> Iterator[bytes]:
    """Lines of a gzip file, a chunk at a time; a file that breaks off raises after what can be read."""
    raw, rest, at = zlib.decompressobj(31), b"", 0
    while at < len(content) or raw.unconsumed_tail:
        data = raw.unconsumed_tail or content[at : at + CHUNK]
        at += 0 if raw.unconsumed_tail else CHUNK
        *whole, rest = (rest + raw.decompress(data, CHUNK)).split(b"\n")
        yield from whole
        if raw.eof and raw.unused_data:
            raw, content, at = zlib.decompressobj(31), raw.unused_data + content[at:], 0
    if not raw.eof:
        raise EOFError("the file breaks off")
    if rest:
        yield rest


def shard_report(spark: SparkSession, root: str, run_id: str, prefix: str | None = None) -> DataFrame:
    """(table, shard, rows, bad_rows, error) of every shard file: rows that are JSON objects, lines that aren't, and what is
    wrong with the shard, if anything.  A file is one row, which bounds it by 2 GB; units are far smaller."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(golden_folder(root, run_id, prefix)).select("path", "content")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard, good, bad, error = path.split("/golden/", 1)[1], 0, 0, None
                try:
                    for line in _lines_of(content.as_py()):
                        try:
                            good += isinstance(json.loads(line), dict) or 0
                            bad += not line.lstrip().startswith(b"{")
                        except ValueError:
                            bad += 1
                except (EOFError, zlib.error) as e:
                    error = str(e)
                if bad and error is None:
                    error = f"{bad} lines are no objects"
                yield pa.RecordBatch.from_arrays([pa.array([x]) if x is not None else pa.nulls(1, pa.string()) for x in (shard.split("/")[0], shard, good, bad, error)], names=["table", "shard", "rows", "bad_rows", "error"])

    return files.mapInArrow(check, "table string, shard string, rows long, bad_rows long, error string")


def build_totals(report: DataFrame) -> DataFrame:
    """By table: shards, damaged ones with their names, rows that can be read."""
    damaged = F.col("error").isNotNull()
    return report.groupBy("table").agg(F.count("*").alias("shards"), F.count(F.when(damaged, 1)).alias("damaged"), F.sum("rows").alias("rows"), F.array_sort(F.collect_list(F.when(damaged, F.col("shard")))).alias("damaged_shards"))
