"""Internal consistency, correlations and design checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.columns import correlation
from keelson.functions.ranking import ranks_desc
from keelson.sources.tables import kept


def cronbach(norm: DataFrame, registry: DataFrame) -> DataFrame:
    """(pillar, n_indicators, n_complete, alpha): over entities that have all indicators; NULL below 2 or 3 of them."""
    of = registry.where("role = 'scoring'").select("variable_name", F.explode("pillars").alias("pillar"))
    size = of.groupBy("pillar").agg(F.count(F.lit(1)).alias("k"))
    x = norm.join(F.broadcast(of), "variable_name").where("norm_score IS NOT NULL")
    rows = x.groupBy("pillar", "entity").agg(F.sum("norm_score").alias("total"), F.count(F.lit(1)).alias("n")).join(F.broadcast(size), "pillar").where("n = k")
    total = rows.groupBy("pillar").agg(F.var_samp("total").alias("v_total"), F.count(F.lit(1)).alias("n_complete"))
    item = x.join(rows.select("pillar", "entity"), ["pillar", "entity"], "left_semi").groupBy("pillar", "variable_name").agg(F.var_samp("norm_score").alias("v"))
    items = item.groupBy("pillar").agg(F.sum("v").alias("v_items"))
    k = F.col("k").cast("double")
    alpha = F.when((F.col("k") >= 2) & (F.col("n_complete") >= 3) & (F.col("v_total") > 0), k / (k - 1) * (1 - F.col("v_items") / F.col("v_total")))
    return size.join(total, "pillar", "left").join(items, "pillar", "left").select(
        "pillar", F.col("k").alias("n_indicators"), F.coalesce("n_complete", F.lit(0)).alias("n_complete"), alpha.alias("alpha")
    )


#: Correlations that one aggregate holds; more are taken by several.
PAIRS = 200


def spearman(long: DataFrame, name: str, value: str, entity: str = "entity", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(a, b, n, rho) for each pair a < b of ``name`` (or of ``pairs``), over the entities that have both; ranks have average ties.

    Names are few, as indicators and methods are: how many values each has comes to the driver. Those that every entity has are ranked
    once, and all their pairs are sums in one pass, merged before anything is shuffled. Only pairs with gaps are ranked pair by
    pair, over the entities that have both.
    """
    x = kept(long.where(F.col(value).isNotNull()).select(F.col(entity).alias("e"), F.col(name).alias("v"), F.col(value).cast("double").alias("x")))
    counts = {r["v"]: r["n"] for r in x.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect() if r["v"] is not None}
    names, n_all = sorted(counts), x.select("e").distinct().count()
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]] if pairs is None else sorted({(a, b) for a, b in pairs if a in counts and b in counts})
    whole = [(a, b) for a, b in pairs if counts[a] == counts[b] == n_all]
    gaps = [p for p in pairs if p not in set(whole)]
    out = x.sparkSession.createDataFrame([], "a string, b string, n long, rho double")
    if whole:
        used = sorted({v for p in whole for v in p})
        ranks = ranks_desc(x.where(F.col("v").isin(used)), {"r": "x"}, ["v"], "average")
        side = ranks.groupBy("e").pivot("v", used).agg(F.first("r")).toDF("e", *[f"_{i}" for i in range(len(used))])
        at = {v: f"_{i}" for i, v in enumerate(used)}
        side = kept(side) if len(whole) > PAIRS else side
        for i in range(0, len(whole), PAIRS):
            part = whole[i : i + PAIRS]
            sums = side.agg(F.count(F.lit(1)).alias("n"), *[correlation(at[a], at[b]).alias(f"rho_{k}") for k, (a, b) in enumerate(part)])
            rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("n"), F.col(f"rho_{k}").alias("rho")) for k, (a, b) in enumerate(part)])
            out = out.unionByName(sums.select(F.explode(rows).alias("p")).select("p.*"))
    if gaps:
        which = x.sparkSession.createDataFrame(gaps, "a string, b string")
        left = x.join(F.broadcast(which), F.col("v") == F.col("a")).select("a", "b", "e", "x")
        both = left.join(x.select(F.col("e"), F.col("v").alias("b"), F.col("x").alias("y")), ["e", "b"])
        ranked = ranks_desc(both.select("a", "b", "x", "y"), {"rx": "x", "ry": "y"}, ["a", "b"], "average")
        out = out.unionByName(ranked.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("rho")))
    return out


def pillar_spearman(norm: DataFrame, registry: DataFrame) -> DataFrame:
    """(pillar, a, b, n, rho) of the indicators of each pillar; a pair that two pillars share is taken once. The registry is a short list."""
    of = registry.where("role = 'scoring'").select("variable_name", F.explode("pillars").alias("pillar"))
    rows = of.alias("p").join(of.alias("q"), (F.col("p.pillar") == F.col("q.pillar")) & (F.col("p.variable_name") < F.col("q.variable_name"))).select(
        F.col("p.pillar").alias("pillar"), F.col("p.variable_name").alias("a"), F.col("q.variable_name").alias("b")
    )
    found = spearman(norm, "variable_name", "norm_score", pairs=[(r["a"], r["b"]) for r in rows.collect()])
    return rows.join(F.broadcast(found), ["a", "b"]).select("pillar", "a", "b", "n", "rho")


def collinear(pairs: DataFrame, limit: float = 0.80, least: int = 5) -> DataFrame:
    return pairs.where((F.abs("rho") > limit) & (F.col("n") >= least))


def effective_weights(registry: DataFrame, norm: DataFrame, n_pillars: int = 7) -> DataFrame:
    """(variable_name, effective_weight, realised_weight, n_pillars): what share of an equal score an indicator has, summed over its pillars.

    By design each pillar counts alike and so does each of its indicators. What is realised depends on the gaps of an entity: a
    missing indicator hands its share to the others of its pillar, a missing pillar to the other pillars. Its mean over all entities that have a score.
    """
    of = registry.where("role = 'scoring'").select("variable_name", F.explode("pillars").alias("pillar"))
    size = of.groupBy("pillar").agg(F.count(F.lit(1)).alias("k"))
    designed = of.join(size, "pillar").groupBy("variable_name").agg(F.sum(1 / (n_pillars * F.col("k"))).alias("effective_weight"), F.count(F.lit(1)).alias("n_pillars"))
    have = norm.where("norm_score IS NOT NULL").join(F.broadcast(of), "variable_name").select("entity", "pillar", "variable_name")
    # An entity's indicators are as many as the registry has: its own shares need no further shuffle.
    per = have.groupBy("entity").agg(F.collect_list(F.struct("pillar", "variable_name")).alias("x"), F.count_distinct("pillar").alias("m"))
    n_in = lambda x: F.size(F.filter("x", lambda y: y["pillar"] == x["pillar"]))
    shares = per.select("entity", F.explode(F.transform("x", lambda x: F.struct(x["variable_name"].alias("variable_name"), (1 / (F.col("m") * n_in(x))).alias("w")))).alias("s"))
    total = per.agg(F.count(F.lit(1)).alias("_all"))
    real = shares.groupBy("s.variable_name").agg(F.sum("s.w").alias("_w")).crossJoin(F.broadcast(total))  # one row
    real = real.select("variable_name", (F.col("_w") / F.col("_all")).alias("realised_weight"))
    return designed.join(real, "variable_name", "left").select("variable_name", "effective_weight", F.coalesce("realised_weight", F.lit(0.0)).alias("realised_weight"), "n_pillars")


def design(registry: DataFrame, obs: DataFrame) -> DataFrame:
    """Per pillar: scoring indicators, cross-listed ones, those that take the log, the years they ask for; and the observations, entities and years there are in these."""
    of = registry.where("role = 'scoring'").select("*", F.explode("pillars").alias("pillar"))
    asked = of.groupBy("pillar").agg(
        F.count(F.lit(1)).alias("n_indicators"), F.count_if(F.size("pillars") > 1).alias("n_cross_listed"), F.count_if("log_transform").alias("n_log"),
        F.min("year_start").alias("year_min"), F.max("year_end").alias("year_max"),
    )
    inside = obs.join(F.broadcast(of.select("variable_name", "pillar", "year_start", "year_end")), "variable_name").where("value IS NOT NULL AND year BETWEEN year_start AND year_end")
    got = inside.groupBy("pillar").agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("entity").alias("n_entities"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return asked.join(got, "pillar", "left").fillna(0, ["n_obs", "n_entities"])


def distribution(scores: DataFrame, methods: list[str]) -> DataFrame:
    """(method, mean, min, max, std, lowest, highest): the entities at the ends are the smallest of equal ones."""
    long = scores.unpivot("entity", methods, "method", "score").where("score IS NOT NULL")
    return long.groupBy("method").agg(
        F.avg("score").alias("mean"), F.min("score").alias("min"), F.max("score").alias("max"), F.stddev_pop("score").alias("std"),
        F.min(F.struct("score", "entity"))["entity"].alias("lowest"), F.max(F.struct("score", -F.col("entity")))["col2"].alias("highest"),
    ).withColumn("highest", -F.col("highest"))


def last_k(obs: DataFrame, k: int) -> DataFrame:
    """The k latest observations of each series."""
    w = Window.partitionBy("entity", "variable_name").orderBy(F.col("year").desc())
    return obs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def latest(obs: DataFrame) -> DataFrame:
    """The latest value of each series and its year."""
    return obs.groupBy("entity", "variable_name").agg(F.max("year").alias("year"), F.max_by("value", "year").alias("value"))
