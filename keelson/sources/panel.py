"""Observations: the long table (entity, grp, variable_name, year, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.columns import no_nan

ORDER_SERIES = ("order_value", "order_count", "urgent_value", "urgent_pending", "final_value", "low_prio_share")
LINE_SERIES = ("discount_rate", "returned_qty", "item_volume", "tax_rate", "mean_qty", "open_share", "supplier_span")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def melt(wide: DataFrame, ids: list[str], series: list[str]) -> DataFrame:
    """Wide to long, without the cells that hold nothing."""
    return wide.select(*ids, *[F.col(s).cast("double").alias(s) for s in series]).unpivot(ids, list(series), "variable_name", "value").where("value IS NOT NULL")


def year_columns_to_long(wide: DataFrame, ids: list[str]) -> DataFrame:
    """One column per year ("YR2015", "2015", "2015.0") to (ids, year, value); other columns go."""
    import re

    years = {c: int(m[1]) for c in wide.columns if c not in ids and (m := re.fullmatch(r"(?:YR)?(\d{4})(?:\.0)?", c))}
    named = wide.select(*ids, *[F.expr(f"try_cast(`{c}` AS double)").alias(str(y)) for c, y in years.items()])
    long = named.unpivot(ids, [str(y) for y in years.values()], "year", "value")
    return long.select(*ids, F.col("year").cast("int").alias("year"), no_nan("value").alias("value")).where("value IS NOT NULL")


def exact(amount: str) -> Column:
    return F.col(amount).cast("decimal(18,2)")


def mean(amount: Column) -> Column:
    return F.try_divide(F.sum(amount).cast("double"), F.count(amount))


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity: customer; group: nation; year: of the order. A cell is there only if a row qualifies.

    Orders and their lines are reduced per (customer, year) before they are turned into rows. Amounts have
    two places and are summed as decimals, so that a value doesn't depend on the order of its rows.
    """
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("year")
    )
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    price = exact("o_totalprice")
    of_orders = orders.groupBy("o_custkey", "year").agg(
        F.sum(price).cast("double").alias("order_value"),
        F.count(F.lit(1)).alias("order_count"),
        mean(F.when(urgent, price)).alias("urgent_value"),
        F.sum(F.when(urgent & (F.col("o_orderstatus") == "P"), price)).cast("double").alias("urgent_pending"),
        F.sum(F.when(F.col("o_orderstatus") == "F", price)).cast("double").alias("final_value"),
        F.avg(low.cast("int")).alias("low_prio_share"),
    )
    lines = read(spark, sf_dir, "lineitem").join(orders.select("o_orderkey", "o_custkey", "year"), F.col("l_orderkey") == F.col("o_orderkey"))
    of_lines = lines.groupBy("o_custkey", "year").agg(
        mean(exact("l_discount")).alias("discount_rate"),
        F.sum(F.when(F.col("l_returnflag") == "R", exact("l_quantity"))).cast("double").alias("returned_qty"),
        F.sum(exact("l_quantity")).cast("double").alias("item_volume"),
        mean(exact("l_tax")).alias("tax_rate"),
        mean(exact("l_quantity")).alias("mean_qty"),
        F.avg((F.col("l_linestatus") == "O").cast("int")).alias("open_share"),
        F.count_distinct("l_suppkey").alias("supplier_span"),
    )
    who = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("grp"))
    # Customers are met before cells are turned into rows: that is a row a year that travels, not one for each series.
    long = lambda wide, series: melt(wide.join(who, F.col("o_custkey") == F.col("entity")), ["entity", "grp", "year"], list(series))
    return long(of_orders, ORDER_SERIES).unionByName(long(of_lines, LINE_SERIES)).select("entity", "grp", "variable_name", "year", "value")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity dimension (entity, grp, name)."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("grp"), F.col("c_name").alias("name"))
