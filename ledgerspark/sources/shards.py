"""Golden shards and sinks: tagged JSON lines with exact types, Parquet that can be written twice, SQL registration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DecimalType, StringType, StructField, StructType, TimestampType


def tag_of(kind: DataType) -> str | None:
    if isinstance(kind, DecimalType):
        return "__decimal__"
    if isinstance(kind, DateType | TimestampType):
        return "__date__"
    return None


def tagged_schema(schema: StructType) -> StructType:
    """The schema of a shard's JSON: decimals and dates are objects that hold their text."""
    return StructType([StructField(f.name, StructType([StructField(t, StringType())]) if (t := tag_of(f.dataType)) else f.dataType) for f in schema])


def encoded_row(df: DataFrame) -> Column:
    """The column that holds a row as a tagged JSON line, nulls included."""

    def one(f: StructField) -> Column:
        tag = tag_of(f.dataType)
        c = F.col(f"`{f.name}`")
        return F.when(c.isNotNull(), F.struct(c.cast("string").alias(tag))).alias(f.name) if tag else c

    return F.to_json(F.struct(*map(one, df.schema)), {"ignoreNullFields": "false"})


def encode(df: DataFrame) -> DataFrame:
    """Rows as tagged JSON lines."""
    return df.select(encoded_row(df).alias("value"))


def write_shards(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Gzipped JSON lines."""
    encode(df).write.mode(mode).option("compression", "gzip").text(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Shards with their declared types back; an unknown shape fails."""
    raw = spark.read.schema(tagged_schema(schema)).option("mode", "FAILFAST").json(path)
    back = [F.col(f"`{f.name}`.`{t}`").cast(f.dataType).alias(f.name) if (t := tag_of(f.dataType)) else F.col(f"`{f.name}`") for f in schema]
    return raw.select(*back)


def write_run(df: DataFrame, path: str, by: tuple[str, ...] = ("run_id",)) -> None:
    """Parquet partitioned by run; writing a run again replaces it and leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


class Sink:
    """Where golden tables go: ``parquet:PATH`` or a bare path for files, ``view:PATH`` to query them by name as well."""

    def __init__(self, spark: SparkSession, uri: str):
        scheme, _, rest = uri.partition(":") if uri.startswith(("parquet:", "view:")) else ("parquet", "", uri)
        if not rest:
            raise ValueError(f"no path in {uri!r}")
        self.spark, self.path, self.named, self.tables = spark, rest.rstrip("/"), scheme == "view", []

    def write(self, table: str, rows: DataFrame) -> str:
        target = f"{self.path}/{table}"
        write_run(rows, target)
        self.tables.append(table)
        return target

    def register(self) -> None:
        for t in dict.fromkeys(self.tables):
            self.spark.read.parquet(f"{self.path}/{t}").createOrReplaceTempView(quoted(t))

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)


def quoted(name: str) -> str:
    return name if name.isidentifier() else "`" + name.replace("`", "``") + "`"


def rows_to_frame(spark: SparkSession, rows: list[dict], schema: StructType) -> DataFrame:
    """Dictionaries under a declared schema; a missing key raises."""
    names = schema.fieldNames()
    for r in rows:
        if set(r) != set(names):
            raise KeyError(f"row has {sorted(r)}, the table {sorted(names)}")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def list_of_strings(column: str) -> Column:
    """A list column as the tables hold it: sorted, distinct strings."""
    return F.array_sort(F.array_distinct(F.col(column).cast(ArrayType(StringType()))))
