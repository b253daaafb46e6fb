"""Tables that cut lineage: written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset and all runs on one machine, a folder of our own is chosen and set."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            # Executors would write to their own disks, and the driver would read back a part.
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="keelson-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession) -> str:
    """A path for a table of this application; its tables are removed when the application ends."""
    folder = f"{shared_dir(spark)}/keelson/{spark.sparkContext.applicationId}"
    if folder not in _leaving:
        _leaving.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{folder}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    What several readers follow is computed once, survives lost executors, and plans above it stay short.
    """
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
