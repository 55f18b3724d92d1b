"""Small files beside tables, through the file systems that Spark knows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file as a whole: it is moved into place when it is complete."""
    fs, where = _at(spark, path)
    _, aside = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(text.encode())
    out.close()
    fs.delete(where, False)
    fs.rename(aside, where)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first().value


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session without
    it the system's temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
