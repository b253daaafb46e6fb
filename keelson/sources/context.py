"""Context of entities: facts, history and notes. What is missing is an empty table, so pages show defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.files import read_table
from keelson.sources.panel import read

FACTS = "entity long, segment string, balance double"
HISTORY = "entity long, first_year int, last_year int, n_years int"
NOTES = "entity long, overview string, strengths array<string>, challenges array<string>"
METHOD_WEIGHTS = "method string, pillar string, w double"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def present(spark: SparkSession, folder: str, names: list[str]) -> dict[str, bool]:
    """Which of the expected tables or files of a folder are there."""
    return {n: exists(spark, f"{folder.rstrip('/')}/{n}") for n in names}


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of Parquet, CSV or JSON; an empty one where there is no such file."""
    return read_table(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_method_weights(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    """Stored weights as method -> pillar -> weight: a few rows for each method."""
    out: dict[str, dict[str, float]] = {}
    for r in read_or_empty(spark, path, METHOD_WEIGHTS).collect():
        out.setdefault(r["method"], {})[r["pillar"]] = r["w"]
    return out


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).cast("int").alias("n_years")
    )


def group_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_nationkey").alias("grp"), F.col("r_name").alias("region"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last order of each customer as dates, and the days between."""
    day = F.to_date("o_orderdate")
    x = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.min(day).alias("first"), F.max(day).alias("last"))
    return x.select("entity", F.date_format("first", "yyyy-MM-dd").alias("first_day"), F.date_format("last", "yyyy-MM-dd").alias("last_day"), F.date_diff("last", "first").alias("days"))
