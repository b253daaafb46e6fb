"""What all operators of this subpackage share: written tables, batches, the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.sources.tables import kept as materialise

__all__ = ["documents", "materialise", "short_batches"]

#: Rows a Python worker gets at once; texts may be long, so batches are short.
BATCH_ROWS = 256


def short_batches(spark: SparkSession) -> None:
    """Bounds the texts that a Python worker holds at a time.

    Spark reads the setting when a plan starts to run, which is after an operator has returned it, so it stays set.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
