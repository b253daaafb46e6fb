"""Comparisons of two versions of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import side_status, tolerance_status
from keelson.functions.ranking import ranks_desc


def outer(left: DataFrame, right: DataFrame, keys: list[str], value: str = "value", tol: float = 1e-9) -> DataFrame:
    """Full outer join on null-safe keys: both values, their difference, and left_only, right_only, changed or both."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l"))
    b = right.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    j = a.join(b, cond, "full_outer")
    shown = [F.when(F.col("_l").isNotNull(), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise(side_status("left_value", "right_value", tol))
    return j.select(*shown, "left_value", "right_value", F.abs(F.col("left_value") - F.col("right_value")).alias("diff"), status.alias("status"))


def summary(compared: DataFrame, ok: float, warn: float) -> DataFrame:
    """Counts by status, largest and mean difference, and PASS, WARN or FAIL for the largest."""
    s = compared.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("left_only", "right_only", "changed")],
        F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"),
    )
    bad = (F.col("n_left_only") + F.col("n_right_only")) > 0
    return s.withColumn("result", F.when(bad, "FAIL").otherwise(tolerance_status("max_diff", ok, warn)))


def worst(compared: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The rows furthest apart; those with a missing side first."""
    return compared.where("status <> 'both'").orderBy(F.col("diff").desc_nulls_first(), *keys).limit(n)


def key_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with the side; their number is the size of the symmetric difference."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right_only")))


def shared_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def rank_flips(a: DataFrame, b: DataFrame, rank: str, key: str = "entity") -> DataFrame:
    """How many entities two runs rank differently."""
    j = a.select(key, F.col(rank).alias("_a")).join(b.select(key, F.col(rank).alias("_b")), key)
    return j.agg(F.count_if(F.col("_a") != F.col("_b")).alias("n_flips"), F.count(F.lit(1)).alias("n"))


def solvers(first: DataFrame, second: DataFrame, digits: int = 8) -> DataFrame:
    """(entity, first, second, gap, first_rank, second_rank, flipped): scores of two solvers of one problem, and whether their ranks part.

    ``gap`` is how far the second is above the first: of a primal and a dual, the first's distance from the optimum. Ranks are of
    scores to ``digits`` places, as ranks are elsewhere; equal ones share a rank.
    """
    both = first.select("entity", F.col("score").alias("first")).join(second.select("entity", F.col("score").alias("second")), "entity")
    x = ranks_desc(both.select("*", F.round("first", digits).alias("_a"), F.round("second", digits).alias("_b")), {"first_rank": "_a", "second_rank": "_b"})
    return x.select("entity", "first", "second", (F.col("second") - F.col("first")).alias("gap"), "first_rank", "second_rank", (F.col("first_rank") != F.col("second_rank")).alias("flipped"))


def solver_summary(compared: DataFrame, tol: float = 1e-6) -> DataFrame:
    """(n, n_flips, n_off, max_gap, status): FAIL where a gap is above ``tol`` either way."""
    gap = F.abs("gap")
    s = compared.agg(F.count(F.lit(1)).alias("n"), F.count_if("flipped").alias("n_flips"), F.count_if(gap > tol).alias("n_off"), F.coalesce(F.max(gap), F.lit(0.0)).alias("max_gap"))
    return s.withColumn("status", F.when(F.col("n_off") > 0, "FAIL").when(F.col("n_flips") > 0, "WARN").otherwise("PASS"))
