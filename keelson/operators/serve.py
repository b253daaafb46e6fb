"""The queries behind the views: overview, profile, pillar and indicator detail, tables, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.columns import fill_flag, log1p_clipped, min_max, shown, steady, tiered_number, traffic_light
from keelson.functions.ranking import rank_desc
from keelson.operators.diagnose import spearman
from keelson.schema import DEFAULT, Params


def overview(scores: DataFrame, method: str = "equal") -> DataFrame:
    s = F.col(method)
    return scores.agg(F.avg(s).alias("mean_score"), F.count_if(s >= 65).alias("n_stable"), F.count_if(s < 35).alias("n_fragile"), F.count(s).alias("n_scored"))


def ends(ranks: DataFrame, method: str = "equal", n: int = 5) -> DataFrame:
    """The n best and the n worst; equal ranks in order of the entity."""
    r, cols = f"{method}_rank", ["entity", method, f"{method}_rank"]
    valid = ranks.where(F.col(method).isNotNull()).select(*cols)
    top = valid.orderBy(r, "entity").limit(n).withColumn("part", F.lit("top"))
    low = valid.orderBy(F.col(r).desc(), "entity").limit(n).withColumn("part", F.lit("bottom"))
    return top.unionByName(low)


def rankings(ranks: DataFrame, entities: DataFrame, method: str = "equal", without=None) -> DataFrame:
    """Rows of the rankings table; leaving out entities (an SQL condition) doesn't rank the others anew."""
    out = ranks.join(entities, "entity").select("entity", "grp", shown(method).alias("score"), F.col(f"{method}_rank").alias("rank"), traffic_light(method).alias("light"))
    return out if without is None else out.where(~F.expr(without))


def goodness(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """Rank of raw values per indicator, the better first by polarity, with the number ranked.

    Values that differ by less than a billionth are ties: means depend on the order of their sum.
    """
    x = cells.where("value IS NOT NULL").join(F.broadcast(registry.select("variable_name", "polarity")), "variable_name")
    x = x.withColumn("_good", F.when(F.col("polarity") == "negative", -F.round("value", 9)).otherwise(F.round("value", 9)))
    out = rank_desc(x, "_good", "goodness_rank", ["variable_name"])
    n = x.groupBy("variable_name").agg(F.count(F.lit(1)).alias("n_ranked"))
    return out.join(F.broadcast(n), "variable_name").select("entity", "variable_name", "value", "goodness_rank", "n_ranked")


def pillar_detail(cells: DataFrame, norm: DataFrame, registry: DataFrame, pillar: str | None = None) -> DataFrame:
    """All indicators of each pillar (or of one), the descriptive too: raw value, text, rank, normalised score, filled or not."""
    of = registry.select("variable_name", "role", F.explode("pillars").alias("pillar"))
    of = of if pillar is None else of.where(F.col("pillar") == pillar)
    shown_here = cells.join(F.broadcast(of.select("variable_name").distinct()), "variable_name", "left_semi")
    g = goodness(shown_here, registry).drop("value")
    base = shown_here.select("entity", "variable_name", "value", (F.col("fill_year").isNotNull() | F.col("regional")).alias("filled"))
    out = base.join(g, ["entity", "variable_name"], "left").join(norm.select("entity", "variable_name", "norm_score"), ["entity", "variable_name"], "left")
    return out.join(F.broadcast(of), "variable_name").withColumn("value_text", tiered_number(steady("value")))


def walkthrough(cells: DataFrame, bounds: DataFrame, name: str | None = None, p: Params = DEFAULT) -> DataFrame:
    """Each scoring indicator (or one) step by step, from stored bounds: raw, after the log, normalised. For a chart, see report.sorted_series."""
    x = cells.join(F.broadcast(bounds if name is None else bounds.where(F.col("variable_name") == name)), "variable_name")  # a row an indicator
    logged = F.when(F.col("log_transform"), log1p_clipped("value")).otherwise(F.col("value"))
    s = min_max("after_log", "raw_min", "raw_max", "polarity")
    return x.withColumn("after_log", logged).select("entity", "variable_name", "value", "after_log", (s if p.norm_digits is None else F.round(s, p.norm_digits)).alias("norm_score"))


def heatmap(pillars: DataFrame, digits: int = 2) -> DataFrame:
    """Lower triangle of the pillars' rank correlations, from two-decimal scores."""
    x = pillars.withColumn("score", shown("score"))
    return spearman(x, "pillar", "score").select(F.col("b").alias("row"), F.col("a").alias("col"), F.round("rho", digits).alias("rho"))


def method_bars(scores: DataFrame, methods: list[str]) -> DataFrame:
    return scores.unpivot("entity", methods, "method", "score")


def radar(pillars: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Pillar scores times weight times the number of pillars: 1 is an average weight."""
    w = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v) * len(weights))])[F.col("pillar")]
    return pillars.select("entity", "pillar", (F.col("score") * w).alias("scaled"))


def pillar_averages(pillars: DataFrame) -> DataFrame:
    return pillars.groupBy("pillar").agg(F.avg("score").alias("mean_score"))


def table_view(df: DataFrame, contains: dict[str, str] | None = None, sort: list[tuple[str, bool]] | None = None) -> DataFrame:
    """What a table with column filters shows: rows whose text contains the words, sorted (column, ascending)."""
    for c, text in (contains or {}).items():
        df = df.where(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())))
    return df.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in sort]) if sort else df


def data_quality(quality: DataFrame) -> DataFrame:
    return quality.withColumn("pct_real", F.round(1 - F.col("pct_filled"), 4)).withColumn("flag", fill_flag("pct_filled"))


def bundle(ranks: DataFrame, pillars: DataFrame, norm: DataFrame, log: DataFrame, quality: DataFrame, band: DataFrame, peer: DataFrame, methods: list[str]) -> DataFrame:
    """One nested row per entity: scores and ranks, pillars and indicators to two decimals, quality, band, peers.

    Best equal score first once it is sorted by ``sort_key``; each part is gathered per entity only.
    """
    filled = log.select("entity", "variable_name").distinct().withColumn("f", F.lit(True))
    ind = norm.join(filled, ["entity", "variable_name"], "left").groupBy("entity").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("variable_name", F.struct(shown("norm_score").alias("score"), F.coalesce("f", F.lit(False)).alias("filled")))))
        ).alias("indicators")
    )
    pil = pillars.where("score IS NOT NULL").groupBy("entity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pillar", shown("score"))))).alias("pillars")
    )
    s = ranks.select(
        "entity", F.struct(*[shown(m).alias(m) for m in methods]).alias("scores"), F.struct(*[F.col(f"{m}_rank").alias(m) for m in methods]).alias("ranks"),
        F.coalesce(F.col(methods[0]), F.lit(0.0)).alias("sort_key"),
    )
    out = s.join(pil, "entity", "left").join(ind, "entity", "left")
    q = data_quality(quality).select("entity", F.struct("n_filled", "pct_real", "flag", "filled").alias("data_quality"))
    default = F.struct(F.lit(0).alias("n_filled"), F.lit(1.0).alias("pct_real"), F.lit("Excellent").alias("flag"), F.array().cast("array<string>").alias("filled"))
    out = out.join(q, "entity", "left").withColumn("data_quality", F.coalesce("data_quality", default))
    out = out.join(band.select("entity", F.struct("low", "high", "width").alias("band")), "entity", "left")
    return out.join(peer.select("entity", F.struct("peer_rank", "n_peers").alias("peers")), "entity", "left")


def documents(nested: DataFrame) -> DataFrame:
    """(entity, document): the nested row as JSON, its nulls written out."""
    return nested.select("entity", F.to_json(F.struct(*[c for c in nested.columns]), {"ignoreNullFields": "false"}).alias("document"))
