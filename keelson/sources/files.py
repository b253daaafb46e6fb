"""Readers and writers of the tables a run leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from keelson.functions.columns import no_nan
from keelson.schema import RAW, SCORES_CSV
from keelson.sources.versions import Versions


def read_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Parquet, CSV or JSON by the end of the name; no inference; NaN becomes NULL."""
    kind = next((k for k in ("csv", "json") if path.rstrip("/").endswith(k)), "parquet")
    reader = spark.read.schema(schema)
    df = reader.csv(path, header=True) if kind == "csv" else reader.json(path, multiLine=True) if kind == "json" else reader.parquet(path)
    return df.select(*[no_nan(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, RAW).where("value IS NOT NULL")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, SCORES_CSV)


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """A checkpoint: one Parquet table per name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """Nested rows as JSON lines, with the fields that are null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def freeze(df: DataFrame, path: str) -> DataFrame:
    """A snapshot that is written once: later calls read the first. Only a committed one counts, so a write that died is no baseline."""
    return Versions(df.sparkSession, path).frozen(df).select(*df.columns)


def missing_notes(entities: DataFrame, notes: DataFrame, key: str = "entity") -> DataFrame:
    """Entities that have no note yet: the stubs to create."""
    return entities.join(notes.select(key), key, "left_anti")


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON lines under a schema; a line that isn't a document of it is a row with nothing but its text in ``corrupt``."""
    return spark.read.schema(StructType([*schema.fields, StructField("corrupt", StringType())])).option("columnNameOfCorruptRecord", "corrupt").json(path)


def write_ordered(df: DataFrame, path: str, *keys: Column | str) -> None:
    """Rows in order of ``keys``: sampled splitters part them into files whose names are in order, and each file is sorted."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def read_ordered(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of ``write_ordered`` with ``position``, 1 for the first: the rows of the files before, one number a file, and the place in its own."""
    rows = spark.read.schema(schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before, offset = 0, {}
    for name, n in sorted((r[0], r[1]) for r in rows.groupBy("_file").count().collect()):
        offset[name], before = before, before + n
    start = spark.createDataFrame(list(offset.items()), "_file string, _before long")
    return rows.join(F.broadcast(start), "_file").withColumn("position", F.col("_before") + F.col("_at") + 1).select(*schema.names, "position")
