"""Observations as a stream. An extension: the batch pipeline this library follows has none.

Event rows arrive in files. Sums by window are handed on once, when the watermark has passed the window's end: their state is
given back then, and later rows of it are dropped. The latest value of a series has no such end: its state is a
row for each series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.tables import new_path


def read_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # The source is a folder; a glob lets one file or one table stand for it.
    events = spark.readStream.schema(schema).parquet(f"{path}*")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_sums(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum per type and time window. In mode "append" a window's row comes when the latest time seen, less ``late``, is past its end;
    rows of a window that is out are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
    )


def run_windows(sums: DataFrame, out: str, state: str) -> None:
    """Takes in what is there now and adds the windows that closed to ``out``: a folder for each batch, so one that is run again replaces its own."""
    q = (
        sums.writeStream.outputMode("append")
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def latest_values(events: DataFrame) -> DataFrame:
    """The latest value of each user and type seen so far."""
    return events.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value"))["value"].alias("latest"))


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream that has no end of its state over all that is there now; each batch's whole result replaces the last."""
    spark = stream.sparkSession
    out = new_path(spark)
    schema = stream.schema
    q = (
        stream.writeStream.outputMode("complete")
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/result"))
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/result")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums, path = windowed_sums(read_stream(spark, sf_dir)), new_path(spark)
    run_windows(sums, f"{path}/out", f"{path}/state")
    out = spark.read.schema(sums.schema).parquet(f"{path}/out/*")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 5).alias("total"))


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(latest_values(read_stream(spark, sf_dir))).withColumn("latest", F.round("latest", 5))


QUERIES = {"x_stream_windows": _windows, "x_stream_latest": _latest}
ORACLE_SQL = {
    "x_stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 5) AS total FROM events "
    "GROUP BY 1, 2, date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM events)",
    "x_stream_latest": "SELECT user_id, event_type, round(arg_max(value, (ts, event_id)), 5) AS latest FROM events GROUP BY 1, 2",
}
