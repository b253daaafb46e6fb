"""Indicators on one scale of 0 to 100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import log1p_clipped, min_max
from keelson.schema import DEFAULT, Params


def transformed(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Scoring cells with log1p where the registry asks for it."""
    r = registry.where("role = 'scoring'").select("variable_name", "polarity", "log_transform")
    return cells.join(F.broadcast(r), "variable_name").withColumn(
        "value", F.when(F.col("log_transform"), log1p_clipped("value")).otherwise(F.col("value"))
    )


def bounds(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Sample minimum and maximum after the log, and counts, per scoring indicator."""
    b = transformed(cells, registry).groupBy("variable_name", "polarity", "log_transform").agg(
        F.min("value").alias("raw_min"), F.max("value").alias("raw_max"), F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("n_total")
    )
    log = lambda c: F.when(F.col("log_transform"), F.col(c))
    return b.select(
        "variable_name", "polarity", "log_transform", "raw_min", "raw_max", log("raw_min").alias("log_min"), log("raw_max").alias("log_max"), "n_valid", "n_total",
        (F.col("n_valid") / F.col("n_total")).alias("pct_valid"),
    )


def normalised(cells: DataFrame, registry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(entity, grp, variable_name, norm_score), rounded as the parameters say. Bounds are a row per indicator."""
    t = transformed(cells, registry)
    b = bounds(cells, registry).select("variable_name", "raw_min", "raw_max")
    s = min_max("value", "raw_min", "raw_max", "polarity")
    s = s if p.norm_digits is None else F.round(s, p.norm_digits)
    return t.join(F.broadcast(b), "variable_name").select("entity", "grp", "variable_name", s.alias("norm_score"))


def out_of_range(norm: DataFrame) -> DataFrame:
    return norm.where(~F.col("norm_score").between(0, 100))
