"""Run manifests: a part for each unit, a tree of digests above the parts, and a root that is written last.

A part's digest covers its unit's entries, documents before shards; the digests of ``FAN`` neighbouring nodes make the
digest of the node above them, up to one root.  So no list of units or documents is ever gathered: the root file holds totals
and one digest, and a check works from the leaves up, unit by unit.

Layout below a run's folder: ``manifest/entries`` and ``manifest/parts`` (Parquet), ``manifest/tree`` (Parquet), and
``manifest.json``, whose presence says that the run is complete.  Writing the same run twice gives the same bytes.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import delete, exists, put_text, read_text

VERSION, FAN = 1, 64
NODE = "level int, node long, children long, documents long, bytes long, sha string"


def _digest(order: list[str], text: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("said"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["said"]), ","), 256)


def entries(documents: DataFrame, shards: DataFrame) -> DataFrame:
    """Documents (unit_index, key, sha256, bytes) and shards (also table, rows) as one list of what a run wrote."""
    plain = documents.select(F.col("unit_index").cast("long").alias("unit_index"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("table"), "key", "sha256", F.col("bytes").cast("long").alias("bytes"), F.lit(None).cast("long").alias("rows"))
    return plain.unionByName(shards.select(F.col("unit_index").cast("long").alias("unit_index"), F.lit("shard").alias("kind"), "table", "key", "sha256", F.col("bytes").cast("long").alias("bytes"), F.col("rows").cast("long").alias("rows")))


def parts(listed: DataFrame) -> DataFrame:
    """(unit_index, documents, bytes, sha) of each unit; the digest covers kind, key, size and digest of every entry."""
    said = F.concat_ws("|", "kind", "key", F.col("bytes").cast("string"), "sha256")
    documents = F.count(F.when(F.col("kind") == "document", 1))
    return listed.groupBy("unit_index").agg(documents.alias("documents"), F.sum("bytes").alias("bytes"), _digest(["kind", "key"], said).alias("sha"))


def _above(nodes: DataFrame, level: int, fan: int) -> DataFrame:
    up = nodes.groupBy(F.expr(f"node div {fan}").alias("above")).agg(F.count("*").alias("children"), F.sum("documents").alias("documents"), F.sum("bytes").alias("bytes"), _digest(["node"], F.col("sha")).alias("sha"))
    return up.select(F.lit(level).alias("level"), F.col("above").alias("node"), "children", "documents", "bytes", "sha")


def tree(unit_parts: DataFrame, total_units: int, fan: int = FAN) -> list[DataFrame]:
    """Levels of the tree from the parts (level 0) to the root, (level, node, children, documents, bytes, sha) each."""
    levels = [unit_parts.select(F.lit(0).alias("level"), F.col("unit_index").alias("node"), F.lit(0).cast("long").alias("children"), "documents", "bytes", "sha")]
    width = total_units
    while width > 1:
        width = -(-width // fan)
        levels.append(_above(levels[-1], len(levels), fan))
    return levels


def missing_units(unit_parts: DataFrame, total_units: int) -> DataFrame:
    spark = unit_parts.sparkSession
    return spark.range(total_units).withColumnRenamed("id", "unit_index").join(unit_parts.select("unit_index"), "unit_index", "left_anti")


def write_manifest(path: str, run_id: str, documents: DataFrame, shards: DataFrame, total_units: int, fan: int = FAN, **about: str) -> dict:
    """Write a run's manifest below its folder and return the root.  Units without a part, or parts of no unit, raise."""
    spark = documents.sparkSession
    base = f"{path.rstrip('/')}/manifest"
    delete(spark, f"{base}.json")  # while parts are replaced, the run is not complete
    entries(documents, shards).write.mode("overwrite").parquet(f"{base}/entries")
    listed = spark.read.parquet(f"{base}/entries")
    parts(listed).write.mode("overwrite").parquet(f"{base}/parts")
    made = spark.read.parquet(f"{base}/parts")
    counted = made.agg(F.count("*"), F.count(F.when(~F.col("unit_index").between(0, total_units - 1) | F.col("unit_index").isNull(), 1))).first()
    lost = [r.unit_index for r in missing_units(made, total_units).orderBy("unit_index").limit(5).collect()]
    if lost or counted[1]:
        raise ValueError(f"run {run_id!r} has parts for {counted[0]} of {total_units} units, missing {lost}, foreign {counted[1]}")
    folder = f"{base}/tree"
    delete(spark, folder)
    nodes = tree(made, total_units, fan)
    for level, rows in enumerate(nodes):
        below = spark.read.schema(NODE).parquet(f"{folder}/part-of={level - 1}") if level else None
        (rows if below is None else _above(below, level, fan)).write.parquet(f"{folder}/part-of={level}")
    top = spark.read.schema(NODE).parquet(f"{folder}/part-of={len(nodes) - 1}").first()
    rows = {r.table: r.n for r in listed.where("kind = 'shard'").groupBy("table").agg(F.sum("rows").alias("n")).collect()}
    root = {"schema_version": VERSION, "run_id": run_id, "total_units": total_units, "total_documents": top.documents, "total_bytes": top.bytes, "table_rows": rows, "fan": fan, "levels": len(nodes), "digest": top.sha, **about}
    put_text(spark, f"{base}.json", json.dumps(root, indent=2, sort_keys=True))
    return root


def read_manifest(spark: SparkSession, path: str) -> dict:
    """The root of a complete run; of any other there is none, and one of a later version is refused."""
    where = f"{path.rstrip('/')}/manifest.json"
    if not exists(spark, where):
        raise FileNotFoundError(f"no run manifest at {where}: the run is incomplete or does not exist")
    root = json.loads(read_text(spark, where))
    if root["schema_version"] > VERSION:
        raise ValueError(f"manifest version {root['schema_version']}, known up to {VERSION}")
    return root


def is_complete(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path.rstrip('/')}/manifest.json")


def _stored(spark: SparkSession, path: str, what: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/manifest/{what}")


def document_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the run's documents, from the manifest alone."""
    read_manifest(spark, path)
    return _stored(spark, path, "entries").where("kind = 'document'").select("unit_index", "key")


def part_problems(listed: DataFrame, recorded: DataFrame) -> DataFrame:
    """(unit_index, problem) of parts that are missing, altered or of no recorded unit."""
    now = parts(listed).select("unit_index", F.col("sha").alias("actual"))
    both = recorded.select("unit_index", "sha").join(now, "unit_index", "full")
    problem = F.when(F.col("actual").isNull(), "missing part").when(F.col("sha").isNull(), "foreign part").when(F.col("sha") != F.col("actual"), "altered part")
    return both.select("unit_index", problem.alias("problem")).where("problem is not null")


def blob_problems(listed: DataFrame, blobs: DataFrame) -> DataFrame:
    """(unit_index, key, problem) of listed blobs that are missing or altered; blobs: (key, content)."""
    now = blobs.select("key", F.sha2("content", 256).alias("actual"))
    both = listed.select("unit_index", "key", "sha256").join(now, "key", "left")
    problem = F.when(F.col("actual").isNull(), "missing blob").when(F.col("sha256") != F.col("actual"), "altered blob")
    return both.select("unit_index", "key", problem.alias("problem")).where("problem is not null")


def verify(spark: SparkSession, path: str, blobs: DataFrame | None = None) -> dict:
    """Check a run: entries against parts and parts against the root; with ``blobs`` every blob's content too.

    The report has counts and, by part and blob, frames of problems; ``ok`` says that there are none.
    """
    root, listed, recorded = read_manifest(spark, path), _stored(spark, path, "entries"), _stored(spark, path, "parts")
    found = part_problems(listed, recorded)
    top = tree(parts(listed), root["total_units"], root["fan"])[-1].select("sha").first()
    report = {"parts_checked": recorded.count(), "digest_matches": top is not None and top.sha == root["digest"], "part_problems": found, "blobs_checked": 0, "blob_problems": None}
    bad = not found.isEmpty() or not report["digest_matches"]
    if blobs is not None:
        report["blob_problems"], report["blobs_checked"] = blob_problems(listed, blobs), listed.count()
        bad |= not report["blob_problems"].isEmpty()
    return report | {"ok": not bad}
