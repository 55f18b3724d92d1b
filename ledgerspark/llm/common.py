"""What the operators share: column access, the shared folder, Arrow plumbing."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent (a local session, as in tests) a folder below the system's temporary one is used and
    set as checkpoint folder; on a cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._saved_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Delete tables that ``saved`` wrote, once all that was made of them is written itself."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: A key is hot if it has more than this share of the rows, so there are fewer hot keys than one over it, and more than
#: this many rows.
HOT_SHARE, HOT_LEAST = 1e-3, 100


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str = "n", total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, which has one row for each key and the number of the key's rows.

    Hot keys' groups, fewer than 1 / ``HOT_SHARE``, are broadcast, so that their rows stay where they are; the others are
    joined as usual.  Both sides are told apart by the hot keys' hashes, which come to the driver; a key that shares its
    hash with a hot one goes along with it on both sides.  Keys are not null.  The count is dropped.  ``total``: the rows,
    or a bound of them, if known.
    """
    if total is None:
        total = groups.agg(F.coalesce(F.sum(count_col), F.lit(0))).first()[0]
    of_key = F.xxhash64(*keys)
    found = groups.where(F.col(count_col) > max(HOT_LEAST, int(total * HOT_SHARE))).select(of_key.alias("h")).distinct().collect() if total > HOT_LEAST else []
    groups = groups.drop(count_col)
    if not found:
        return rows.join(groups, keys)
    hot = of_key.isin([r.h for r in found])
    return rows.where(hot).join(F.broadcast(groups.where(hot)), keys).unionByName(rows.where(~hot).join(groups.where(~hot), keys))


def text_bytes(column: str | Column = "text") -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("binary"), F.lit(b""))


def release() -> None:
    """Give memory that a task has freed back to the system: workers outlive their tasks, and the next may need more."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


#: Rows that a function of batches is given at once.
SLICE = 1_024


def map_batches(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """Apply a function of Arrow batches; it may return one batch or several.

    It is given slices of ``SLICE`` rows, and what they took is given back after each batch, so that a worker's memory is that
    of a slice and not of ten thousand texts as Python values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out = rows(batch.slice(start, SLICE))
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out
            release()

    return df.mapInArrow(run, schema)


def crc_bucket(column: str, parts: int) -> Column:
    """crc32 of a column's text modulo ``parts`` (the folds of held-out rows); null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))
