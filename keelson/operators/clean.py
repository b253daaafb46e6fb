"""From observations to one value per entity and indicator: windows, fills, ratios, fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.columns import clipped, coverage_flag, ratio, steady_mean
from keelson.functions.ranking import quantiles
from keelson.schema import DEFAULT, Params
from keelson.sources.tables import kept


def windowed(obs: DataFrame, registry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Observations inside an indicator's window (tag "w") or in the years before it (tag "l")."""
    r = registry.select("variable_name", "k", "year_start", "year_end")
    inside = F.col("year").between(F.col("year_start"), F.col("year_end"))
    before = (F.col("year") >= F.col("year_start") - p.lookback_years) & (F.col("year") < F.col("year_start"))
    # The registry is a short list of definitions.
    return (
        obs.where("value IS NOT NULL")
        .join(F.broadcast(r), "variable_name")
        .where(inside | before)
        .withColumn("tag", F.when(inside, "w").otherwise("l"))
    )


def aggregate(obs: DataFrame, registry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(entity, variable_name, value, fill_year): all four aggregations and the lookback in one pass.

    The mean of the last k values there are, k = 1 for most_recent; the lookback is used only where
    the window has none. ``fill_year`` is the last year of the lookback used, else NULL.
    """
    recent = Window.partitionBy("entity", "variable_name", "tag").orderBy(F.col("year").desc())
    # Dealt by what both the window and the grouping part by, so that rows travel once.
    rows = windowed(obs, registry, p).select("entity", "variable_name", "year", "value", "k", "tag").repartition("entity", "variable_name")
    kept = rows.withColumn("rn", F.row_number().over(recent)).where("rn <= k")
    # Window rows come first in tag order "w" > "l": one grouping holds both.
    both = kept.groupBy("entity", "variable_name").agg(
        F.avg(F.when(F.col("tag") == "w", F.col("value"))).alias("w"),
        F.avg(F.when(F.col("tag") == "l", F.col("value"))).alias("l"),
        F.max(F.when(F.col("tag") == "l", F.col("year"))).alias("l_year"),
    )
    return both.select(
        "entity", "variable_name", F.coalesce("w", "l").alias("value"), F.when(F.col("w").isNull(), F.col("l_year")).alias("fill_year")
    )


def derive_ratios(values: DataFrame, registry: DataFrame) -> DataFrame:
    """Ratio indicators over their denominators; ``fill_value`` keeps the value before."""
    d = registry.where("denominator IS NOT NULL").select("variable_name", "denominator")
    need = values.join(F.broadcast(d), "variable_name", "left")
    bottom = values.join(F.broadcast(d.select(F.col("denominator").alias("_d")).distinct()), F.col("variable_name") == F.col("_d"), "left_semi").select(
        F.col("entity").alias("_e"), F.col("variable_name").alias("_v"), F.col("value").alias("_den")
    )
    both = need.join(bottom, (F.col("entity") == F.col("_e")) & (F.col("denominator") == F.col("_v")), "left")
    new = F.when(F.col("denominator").isNull(), F.col("value")).otherwise(ratio("value", "_den"))
    return both.select("entity", "variable_name", new.alias("value"), "fill_year", F.col("value").alias("fill_value"))


def grid(entities: DataFrame, registry: DataFrame, values: DataFrame) -> DataFrame:
    """Every entity with every indicator, so that gaps are rows. The registry is a short list."""
    spine = entities.select("entity", "grp").crossJoin(F.broadcast(registry.select("variable_name", "role")))
    return spine.join(values, ["entity", "variable_name"], "left")


def regional_fill(cells: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Gaps take the mean of their group, where at least ``min_peers`` members have a value. Adds ``regional``.

    The means, a row for each indicator and group, are written first: Spark then knows their size, and cells don't travel to meet them.
    So are the cells, which are followed twice.
    """
    cells = kept(cells)
    mean = cells.groupBy("variable_name", "grp").agg(steady_mean("value").alias("_m"), F.count("value").alias("_n")).where(F.col("_n") >= p.min_peers)
    mean = kept(mean)
    filled = cells.join(mean, ["variable_name", "grp"], "left")
    hit = F.col("value").isNull() & F.col("_m").isNotNull()
    return filled.withColumn("regional", hit).withColumn("value", F.coalesce("value", "_m")).drop("_m", "_n")


def fill_log(cells: DataFrame) -> DataFrame:
    """Which cells were filled, how, with what: a cell may be in both stages."""
    one = cells.where("fill_year IS NOT NULL").select(
        "variable_name", "entity", F.lit("stage1_extended").alias("fill_stage"), "fill_year", F.col("fill_value")
    )
    two = cells.where("regional").select(
        "variable_name", "entity", F.lit("stage2_regional").alias("fill_stage"), F.lit(None).cast("int").alias("fill_year"), F.col("value").alias("fill_value")
    )
    return one.unionByName(two)


def fences(cells: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Quartiles by linear interpolation and the outlier fences of each scoring indicator."""
    q = quantiles(cells.where("role = 'scoring'"), "value", "variable_name", {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select("variable_name", "q1", "q3", iqr.alias("iqr"), (F.col("q1") - p.iqr_multiplier * iqr).alias("lower_bound"), (F.col("q3") + p.iqr_multiplier * iqr).alias("upper_bound"))


def winsorised(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Scoring values clipped to their fences; ``capped`` is -1, 0 or 1. One row of fences an indicator."""
    both = cells.join(F.broadcast(bounds.select("variable_name", "lower_bound", "upper_bound")), "variable_name", "left")
    v, lo, hi = F.col("value"), F.col("lower_bound"), F.col("upper_bound")
    capped = F.when(v < lo, -1).when(v > hi, 1).otherwise(0)
    return both.withColumn("capped", capped).withColumn("value", F.when(lo.isNull(), v).otherwise(clipped(v, lo, hi))).drop("lower_bound", "upper_bound")


def winsor_report(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    n = winsorised(cells, bounds).where("role = 'scoring'").groupBy("variable_name").agg(
        F.count_if(F.col("capped") == -1).alias("n_capped_low"), F.count_if(F.col("capped") == 1).alias("n_capped_high")
    )
    return bounds.join(n, "variable_name")


def raw_coverage(obs: DataFrame, registry: DataFrame, n_entities: DataFrame) -> DataFrame:
    """Per indicator, also those without data: entities, observations, years and a flag."""
    got = obs.where("value IS NOT NULL").groupBy("variable_name").agg(
        F.count_distinct("entity").alias("n_entities"), F.count(F.lit(1)).alias("n_obs_total"), F.min("year").alias("year_min"), F.max("year").alias("year_max")
    )
    out = registry.select("variable_name").join(got, "variable_name", "left").crossJoin(F.broadcast(n_entities))
    pct = F.coalesce("n_entities", F.lit(0)) / F.col("n_total")
    return out.select(
        "variable_name", F.coalesce("n_entities", F.lit(0)).alias("n_entities"), F.coalesce("n_obs_total", F.lit(0)).alias("n_obs_total"), "year_min", "year_max",
        pct.alias("pct_coverage"), coverage_flag(pct).alias("flag"),
    )


def post_coverage(cells: DataFrame) -> DataFrame:
    n = cells.groupBy("variable_name").agg(F.count("value").alias("n_valid"), F.count(F.lit(1)).alias("n_total"))
    pct = F.col("n_valid") / F.col("n_total")
    return n.withColumn("pct_coverage", pct).withColumn("flag", coverage_flag(pct))


def pillar_null_rate(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Share of entities that have no value in any indicator of a pillar."""
    of = registry.where("role = 'scoring'").select("variable_name", F.explode("pillars").alias("pillar"))
    per = cells.join(F.broadcast(of), "variable_name").groupBy("pillar", "entity").agg(F.count("value").alias("n"))
    return per.groupBy("pillar").agg((F.count_if(F.col("n") == 0) / F.count(F.lit(1))).alias("null_rate"))


class CoverageError(ValueError):
    """A pillar has too few entities with data."""


def gate(rates: DataFrame, p: Params = DEFAULT) -> None:
    """Stops the run if a pillar's null rate is above the limit: one row a pillar comes to the driver."""
    if bad := rates.where(F.col("null_rate") > p.max_pillar_null_rate).collect():
        raise CoverageError(", ".join(f"{r.pillar}: {r.null_rate:.0%}" for r in bad))
