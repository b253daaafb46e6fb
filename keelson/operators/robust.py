"""How far ranks depend on the choices made."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.columns import confidence_half, correlation, rank_range_verdict, rho_verdict, shift_verdict, shown
from keelson.functions.ranking import rank_desc, ranks_desc, ranks_of_means
from keelson.operators import score
from keelson.operators.diagnose import spearman
from keelson.schema import DEFAULT, Params
from keelson.sources.tables import kept


def rank_correlations(ranks: DataFrame, methods: list[str]) -> DataFrame:
    """(a, b, n, rho) between the ranks of methods, over the entities that all of them rank."""
    cols = [f"{m}_rank" for m in methods]
    full = ranks.dropna(subset=methods)
    return spearman(full.unpivot("entity", cols, "method", "r"), "method", "r")


def rank_sensitivity(ranks: DataFrame, methods: list[str]) -> DataFrame:
    cols = [F.col(f"{m}_rank") for m in methods]
    out = ranks.select("entity", F.least(*cols).alias("rank_min"), F.greatest(*cols).alias("rank_max"))
    r = F.col("rank_max") - F.col("rank_min")
    return out.withColumn("rank_range", r).withColumn("verdict", rank_range_verdict(r))


def weight_vectors(p: Params = DEFAULT, n: int = 1000, seed: int = 42) -> list[list[float]]:
    """The corners (one pillar at the maximum) and those of ``n`` seeded Dirichlet draws that keep the bounds."""
    k = len(p.pillars)
    rest = (1 - p.weight_max) / (k - 1)
    corners = [[p.weight_max if i == j else rest for j in range(k)] for i in range(k)]
    draws = np.random.default_rng(seed).dirichlet(np.ones(k), n)
    return corners + [list(map(float, d)) for d in draws if (d >= p.weight_min).all() and (d <= p.weight_max).all()]


def max_shift(pillars: DataFrame, p: Params = DEFAULT, vectors: list[list[float]] | None = None) -> DataFrame:
    """(weight_id, rho, mean_shift, max_shift) against equal weights, for each weight vector.

    Where pillars are missing, the weights of those an entity has are scaled up; an entity without any is left out. The
    vectors are a short literal list; each entity is exploded over them and everything else is grouped by the vector's number.
    """
    vectors = weight_vectors(p) if vectors is None else vectors
    w = pillars.sparkSession.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "weight_id int, w array<double>")
    x = score.wide(pillars, p)
    top = sum((F.coalesce(F.col(c), F.lit(0.0)) * F.col("w")[i] for i, c in enumerate(p.pillars)), F.lit(0.0))
    have = sum((F.when(F.col(c).isNotNull(), F.col("w")[i]).otherwise(0.0) for i, c in enumerate(p.pillars)), F.lit(0.0))
    # Sums in another order must not part what is tied.
    base = score.equal(pillars, p).where("score IS NOT NULL").select("entity", F.round("score", 9).alias("equal"))
    base = rank_desc(base, "equal", "base_rank", ties="average").select("entity", "base_rank")
    each = x.join(base, "entity").crossJoin(F.broadcast(w)).select("weight_id", "entity", "base_rank", F.round(F.try_divide(top, have), 9).alias("s"))
    r = rank_desc(each.where("s IS NOT NULL"), "s", "r", ["weight_id"], "average")
    d = F.abs(F.col("r") - F.col("base_rank"))
    return r.groupBy("weight_id").agg(correlation("r", "base_rank").alias("rho"), F.avg(d).alias("mean_shift"), F.max(d).alias("max_shift"))


def worst_weights(shifts: DataFrame) -> DataFrame:
    """The vector of the lowest correlation, the smallest number first, with a verdict."""
    worst = shifts.agg(F.min(F.struct("rho", "weight_id", "mean_shift", "max_shift")).alias("w"), F.count(F.lit(1)).alias("n_vectors")).select("w.*", "n_vectors")
    return worst.withColumn("verdict", rho_verdict("rho"))


def without_fills(norm: DataFrame, fill_log: DataFrame, registry: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Ranks of the equal score when every filled cell is taken out again, and how far they move."""
    hit = fill_log.select("entity", "variable_name").distinct().withColumn("_hit", F.lit(True))
    masked = norm.join(hit, ["entity", "variable_name"], "left").withColumn("norm_score", F.when(F.col("_hit").isNull(), F.col("norm_score"))).drop("_hit")
    base = score.equal(score.pillar_scores(norm, registry), p).withColumnRenamed("score", "base")
    pure = score.equal(score.pillar_scores(masked, registry), p).withColumnRenamed("score", "pure")
    both = ranks_of_means(base.join(pure, "entity"), {"rank_base": "base", "rank_pure": "pure"})
    shift = F.when(F.col("pure").isNotNull(), F.abs(F.col("rank_pure") - F.col("rank_base")))
    return both.select("entity", "rank_base", F.when(F.col("pure").isNotNull(), F.col("rank_pure")).alias("rank_pure"), shift.alias("shift"), shift_verdict(shift).alias("verdict"))


def tight_bounds(pillars: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Benefit of the doubt under its own and under tighter bounds: scores, ranks, shift."""
    a = score.bod(pillars, p).withColumnRenamed("score", "bod")
    b = score.bod_tight(pillars, p).withColumnRenamed("score", "bod_tight")
    return ranks_desc(a.join(b, "entity"), {"rank_bod": "bod", "rank_tight": "bod_tight"}).withColumn("shift", F.abs(F.col("rank_tight") - F.col("rank_bod")))


def fill_counts(fill_log: DataFrame, entities: DataFrame, n_indicators: int) -> DataFrame:
    """Per entity, also those never filled: the distinct filled indicators, sorted, and their share of all."""
    f = fill_log.groupBy("entity").agg(F.array_sort(F.collect_set("variable_name")).alias("filled"))
    out = entities.select("entity").join(f, "entity", "left").withColumn("filled", F.coalesce("filled", F.array().cast("array<string>")))
    return out.withColumn("n_filled", F.size("filled")).withColumn("pct_filled", F.col("n_filled") / float(n_indicators))


def bands(scores: DataFrame, quality: DataFrame, method: str = "equal") -> DataFrame:
    """A band around each score that is wider the more was filled, within 0 to 100, one decimal."""
    half = confidence_half("pct_filled")
    at = lambda x: shown(F.least(F.greatest(x, F.lit(0.0)), F.lit(100.0)), 1)
    s = F.col(method)
    return scores.select("entity", method).where(s.isNotNull()).join(quality, "entity").select(
        "entity", at(s - half).alias("low"), at(s + half).alias("high"), shown(2 * half, 1).alias("width")
    )


def peers(scores: DataFrame, entities: DataFrame, method: str = "equal") -> DataFrame:
    """Place in the group by score to nine places, 1 first; equal scores in order of the entity."""
    x = scores.join(entities.select("entity", "grp"), "entity").where(F.col(method).isNotNull())
    out = ranks_of_means(x, {"peer_rank": method}, ["grp"], "entity")
    n = kept(x.groupBy("grp").agg(F.count(F.lit(1)).alias("n_peers")))  # of known size: Spark sends it to the rows
    return out.join(n, "grp").select("entity", "grp", method, "peer_rank", "n_peers")
