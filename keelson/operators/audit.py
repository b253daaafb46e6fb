"""Checks of stored tables: each value is computed again from the tables before it and compared."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import log1p_clipped, min_max, tolerance_status
from keelson.functions.ranking import rank_desc
from keelson.operators import score
from keelson.schema import DEFAULT, Params
from keelson.sources.tables import kept


def compared(section: str, stored: DataFrame, again: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """(section, n, n_missing, n_off, max_diff, status) of two versions of a value by key; a NULL on both sides agrees."""
    a = stored.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a"))
    b = again.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(value).alias("_b"), F.lit(True).alias("_in_b"))
    j = a.join(b, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "full_outer")
    one_sided = F.col("_in_a").isNull() | F.col("_in_b").isNull() | (F.col("_a").isNull() != F.col("_b").isNull())
    d = F.abs(F.col("_a") - F.col("_b"))
    s = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(one_sided).alias("n_missing"), F.count_if(d > tol).alias("n_off"), F.round(F.coalesce(F.max(d), F.lit(0.0)), 6).alias("max_diff"))
    status = F.when(F.col("n_missing") > 0, "FAIL").otherwise(tolerance_status("max_diff", tol, 10 * tol))
    return s.select(F.lit(section).alias("section"), "n", "n_missing", "n_off", "max_diff", status.alias("status"))


def normalisation(cells: DataFrame, bounds: DataFrame, norm: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Normalised scores from the stored bounds, one row an indicator."""
    x = cells.where("role = 'scoring'").join(F.broadcast(bounds.select("variable_name", "polarity", "log_transform", "raw_min", "raw_max")), "variable_name")
    x = x.withColumn("_v", F.when(F.col("log_transform"), log1p_clipped("value")).otherwise(F.col("value")))
    again = x.select("entity", "variable_name", min_max("_v", "raw_min", "raw_max", "polarity").alias("norm_score"))
    half = 10.0**-p.norm_digits if p.norm_digits is not None else 1e-9
    return compared("normalisation", norm, again, ["entity", "variable_name"], "norm_score", half)


def pillar_means(norm: DataFrame, registry: DataFrame, pillars: DataFrame) -> DataFrame:
    """Pillar scores as sums over counts of normalised scores."""
    of = registry.where("role = 'scoring'").select("variable_name", F.explode("pillars").alias("pillar"))
    again = norm.join(F.broadcast(of), "variable_name").groupBy("entity", "pillar").agg(F.try_divide(F.sum("norm_score"), F.count("norm_score")).alias("score"))
    return compared("pillars", pillars, again, ["entity", "pillar"], "score", 1e-6)


def _of_wide(wide: DataFrame, f, p: Params) -> DataFrame:
    have = F.filter(F.array(*p.pillars), lambda x: x.isNotNull())
    return wide.select("entity", F.when(F.size(have) > 0, f(have)).alias("score"))


def equal_scores(wide: DataFrame, scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The equal score, from pillars side by side."""
    mean = lambda have: F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)
    return compared("equal", scores.select("entity", F.col("equal").alias("score")), _of_wide(wide, mean, p), ["entity"], "score", 1e-6)


def geometric_scores(wide: DataFrame, scores: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The geometric score as a root of a product."""
    root = lambda have: F.pow(F.aggregate(have, F.lit(1.0), lambda a, x: a * F.greatest(x, F.lit(p.floor))), 1 / F.size(have))
    return compared("geometric", scores.select("entity", F.col("geometric").alias("score")), _of_wide(wide, root, p), ["entity"], "score", 1e-6)


def band_widths(bands: DataFrame, quality: DataFrame) -> DataFrame:
    """Widths of confidence bands from the shares of filled values."""
    again = bands.select("entity").join(quality, "entity").select("entity", F.round(F.round(2 * (2 + 26.7 * F.col("pct_filled")), 9), 1).alias("width"))
    return compared("bands", bands, again, ["entity"], "width", 1e-6)


def peer_counts(peers: DataFrame, entities: DataFrame, scores: DataFrame, method: str = "equal") -> DataFrame:
    """The number of peers of each entity, from the entity table."""
    scored = scores.where(F.col(method).isNotNull()).select("entity").join(entities.select("entity", "grp"), "entity")
    n = scored.groupBy("grp").agg(F.count(F.lit(1)).alias("n_peers"))
    return compared("peers", peers, scored.join(n, "grp"), ["entity"], "n_peers", 0.5)


def not_below(scores: DataFrame, upper: str = "bod", lower: str = "equal", tol: float = 1e-6) -> DataFrame:
    """Benefit of the doubt is never below equal weights: how often it is, and the least and mean gap."""
    gap = F.col(upper) - F.col(lower)
    s = scores.agg(F.count(gap).alias("n"), F.count_if(gap < -tol).alias("n_below"), F.min(gap).alias("min_gap"), F.avg(gap).alias("mean_gap"))
    return s.withColumn("status", F.when(F.col("n_below") > 0, "FAIL").otherwise("PASS"))


def low_alpha(alphas: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Internal consistency with a status: WARN below the minimum, INFO where it can't be computed."""
    return alphas.withColumn("status", F.when(F.col("alpha").isNull(), "INFO").when(F.col("alpha") < p.min_alpha, "WARN").otherwise("PASS"))


def within_range(distribution: DataFrame, low: float = 0.0, high: float = 100.0, least_std: float = 1.0) -> DataFrame:
    """Scores by method with a status: FAIL outside the scale, WARN where they hardly differ."""
    outside = (F.col("min") < low) | (F.col("max") > high)
    return distribution.withColumn("status", F.when(outside, "FAIL").when(F.col("std") < least_std, "WARN").otherwise("PASS"))


def spot_checks(obs: DataFrame, checks: list[tuple]) -> DataFrame:
    """Known values (variable_name, entity, year, low, high): PASS, FAIL outside the bounds, MISSING. The checks are a short list."""
    c = obs.sparkSession.createDataFrame(checks, "variable_name string, entity long, year int, low double, high double")
    keys = ["variable_name", "entity", "year"]
    got = obs.select(*keys, "value").join(F.broadcast(c.select(*keys)), keys, "left_semi")
    ok: Column = F.col("value").between(F.col("low"), F.col("high"))
    return c.join(got, keys, "left").withColumn("status", F.when(F.col("value").isNull(), "MISSING").when(ok, "PASS").otherwise("FAIL"))


#: Tolerances of a stored document: two decimals, one decimal of bands, whole numbers.
SHOWN, BAND, EXACT = 0.005 + 1e-6, 0.05 + 1e-6, 1e-9


def _named(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(entity, what, value): a row for each named number of an entity."""
    pairs = F.array(*[F.struct(F.lit(k).alias("what"), v.cast("double").alias("value")) for k, v in values.items()])
    return df.select("entity", F.explode(pairs).alias("x")).select("entity", "x.*")


def stored_numbers(docs: DataFrame, methods: list[str]) -> dict[str, DataFrame]:
    """The numbers of documents as (entity, what, value), by section."""
    entries = lambda c, v: docs.select("entity", F.explode(c).alias("what", "x")).select("entity", "what", v.cast("double").alias("value"))
    return {
        "scores": _named(docs, {m: F.col(f"scores.{m}") for m in methods}),
        "ranks": _named(docs, {m: F.col(f"ranks.{m}") for m in methods}),
        "pillars": entries("pillars", F.col("x")),
        "indicators": entries("indicators", F.col("x.score")),
        "quality": _named(docs, {"n_filled": F.col("data_quality.n_filled")}),
        "bands": _named(docs.where("band IS NOT NULL"), {k: F.col(f"band.{k}") for k in ("low", "high")}),
        "peers": _named(docs.where("peers IS NOT NULL"), {k: F.col(f"peers.{k}") for k in ("peer_rank", "n_peers")}),
    }


def recomputed_numbers(pillars: DataFrame, norm: DataFrame, fill_log: DataFrame, entities: DataFrame, scores: DataFrame, n_indicators: int, methods: list[str], p: Params = DEFAULT) -> dict[str, DataFrame]:
    """The same numbers from the tables, where there is one by another way than they were made: means and roots from pillars side by
    side, benefit of the doubt by its dual, bands and peers from their definitions."""
    side = score.wide(pillars, p)
    mean = lambda have: F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / F.size(have)
    root = lambda have: F.pow(F.aggregate(have, F.lit(1.0), lambda a, x: a * F.greatest(x, F.lit(p.floor))), 1 / F.size(have))
    other = {"equal": lambda: _of_wide(side, mean, p), "geometric": lambda: _of_wide(side, root, p), "bod": lambda: score.bod_dual(pillars, p)}
    again = scores.select("entity", *[m for m in methods if m not in other])
    for m in methods:
        if m in other:
            again = again.join(other[m]().withColumnRenamed("score", m), "entity", "left")
    filled = entities.select("entity").join(fill_log.groupBy("entity").agg(F.count_distinct("variable_name").alias("n_filled")), "entity", "left").fillna(0, ["n_filled"])
    half = 2 + 26.7 * F.col("n_filled") / n_indicators
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))
    of = scores.select("entity", F.col(methods[0]).alias("s")).where("s IS NOT NULL").join(entities.select("entity", "grp"), "entity")
    n = kept(of.groupBy("grp").agg(F.count(F.lit(1)).alias("n_peers")))
    peers = rank_desc(of, "s", "peer_rank", ["grp"], "entity").join(n, "grp")
    return {
        "scores": _named(again, {m: F.col(m) for m in methods}),
        "ranks": _named(score.ranked(scores, methods), {m: F.col(f"{m}_rank") for m in methods}),
        "pillars": pillars.where("score IS NOT NULL").select("entity", F.col("pillar").alias("what"), F.col("score").alias("value")),
        "indicators": norm.select("entity", F.col("variable_name").alias("what"), F.col("norm_score").alias("value")),
        "quality": _named(filled, {"n_filled": F.col("n_filled")}),
        "bands": _named(of.join(filled, "entity"), {"low": at(F.col("s") - half), "high": at(F.col("s") + half)}),
        "peers": _named(peers, {"peer_rank": F.col("peer_rank"), "n_peers": F.col("n_peers")}),
    }


def of_documents(docs: DataFrame, again: dict[str, DataFrame], methods: list[str]) -> DataFrame:
    """(section, n, n_missing, n_off, max_diff, status) of documents as ``read_documents`` gives them, against numbers from the tables.

    What is missing on either side fails, and so does a line that is no document (section "documents").
    """
    whole = docs.where("corrupt IS NULL AND entity IS NOT NULL")
    tol = {"scores": SHOWN, "pillars": SHOWN, "indicators": SHOWN, "bands": BAND}
    parts = [compared(k, x, again[k], ["entity", "what"], "value", tol.get(k, EXACT)) for k, x in stored_numbers(whole, methods).items()]
    bad = F.count_if(F.col("corrupt").isNotNull() | F.col("entity").isNull())
    lines = docs.agg(F.count(F.lit(1)).alias("n"), bad.alias("n_missing"))
    lines = lines.select(F.lit("documents").alias("section"), "n", "n_missing", F.lit(0).cast("long").alias("n_off"), F.lit(0.0).alias("max_diff"), F.when(F.col("n_missing") > 0, "FAIL").otherwise("PASS").alias("status"))
    return reduce(DataFrame.unionByName, [*parts, lines])


def report_document(sections: DataFrame) -> DataFrame:
    """(document): an audit as one JSON text, counts by status first, then each section with its numbers; one row a section is gathered."""
    row = F.struct("section", "n", "n_missing", "n_off", "max_diff", "status")
    n = lambda s: F.count_if(F.col("status") == s)
    a = sections.agg(n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail"), F.array_sort(F.collect_list(row)).alias("sections"))
    return a.select(F.to_json(F.struct("n_pass", "n_warn", "n_fail", "sections")).alias("document"))
