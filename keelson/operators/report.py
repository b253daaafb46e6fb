"""What the report tables show: labels, columns in order, display positions. Sorts are range sorts over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.ranking import rank_desc
from keelson.operators.serve import documents
from keelson.schema import DEFAULT, Params
from keelson.sources.files import read_ordered, write_ordered


def label(name: str | Column, default: str | Column) -> Column:
    """A name, or the key as text where there is none."""
    name, default = (F.col(x) if isinstance(x, str) else x for x in (name, default))
    return F.coalesce(name, default.cast("string"))


def labelled(df: DataFrame, entities: DataFrame) -> DataFrame:
    return df.join(entities.select("entity", F.col("name").alias("_name")), "entity", "left").withColumn("label", label("_name", "entity")).drop("_name")


def placed(df: DataFrame, by: str, then: str = "entity") -> DataFrame:
    """Adds ``position``, 1 for the largest ``by``; missing values last, equal ones in order of ``then``."""
    return rank_desc(df, by, "position", ties=then)


def overall(ranks: DataFrame, entities: DataFrame, methods: list[str], by: str = "equal") -> DataFrame:
    """Position, entity and label, then score and rank of each method side by side; best first."""
    pairs = [c for m in methods for c in (m, f"{m}_rank")]
    return placed(labelled(ranks, entities), by).select("position", "entity", "label", *pairs).orderBy("position")


def pillar_table(wide: DataFrame, scores: DataFrame, entities: DataFrame, by: str = "equal", p: Params = DEFAULT) -> DataFrame:
    """Pillars side by side with the composite score, best composite first."""
    x = labelled(wide.drop("grp").join(scores.select("entity", by), "entity", "left"), entities)
    return placed(x, by).select("position", "entity", "label", *p.pillars, F.col(by).alias("composite")).orderBy("position")


def first_pillar(registry: DataFrame) -> DataFrame:
    """(variable_name, pillar): where a cross-listed indicator is shown, its first pillar."""
    return registry.select("variable_name", F.element_at("pillars", 1).alias("pillar"))


def indicator_table(cells: DataFrame, norm: DataFrame, registry: DataFrame, entities: DataFrame) -> DataFrame:
    """Every cell under its indicator's first pillar, by pillar, indicator and entity. The registry is a short list."""
    x = cells.join(F.broadcast(first_pillar(registry)), "variable_name").join(norm.select("entity", "variable_name", "norm_score"), ["entity", "variable_name"], "left")
    return labelled(x, entities).select("pillar", "variable_name", "entity", "label", "value", "norm_score").orderBy("pillar", "variable_name", "entity")


def coverage_table(coverage: DataFrame) -> DataFrame:
    """Sparsest first, then by name; one row an indicator."""
    x = coverage.withColumn("_gap", -F.col("pct_coverage"))
    return placed(x, "_gap", "variable_name").drop("_gap").orderBy("position")


def most_sensitive(sensitivity: DataFrame, n: int = 10) -> DataFrame:
    """The n entities whose rank moves most between methods; equal ranges in order of the entity."""
    return sensitivity.orderBy(F.col("rank_range").desc(), "entity").limit(n)


def by_shift(moved: DataFrame) -> DataFrame:
    """Largest shift first, entities without one last."""
    return placed(moved, "shift").orderBy("position")


def sorted_series(pillars: DataFrame, pillar: str | None = None) -> DataFrame:
    """Scores of a pillar (or of each) over entities, highest first, as a chart shows them."""
    x = pillars if pillar is None else pillars.where(F.col("pillar") == pillar)
    return rank_desc(x, "score", "position", ["pillar"], "entity").orderBy("pillar", "position")


def scores_file(ranks: DataFrame, wide: DataFrame, methods: list[str], p: Params = DEFAULT) -> DataFrame:
    """Scores, ranks and pillars of each entity: the columns of the scores file."""
    return ranks.select("entity", *methods, *[f"{m}_rank" for m in methods]).join(wide.select("entity", *p.pillars), "entity", "left")


def sorted_bundle(nested: DataFrame, path: str) -> DataFrame:
    """Documents written in order, best score first and a missing one as 0, equal ones by entity; read back with their position."""
    docs = documents(nested.drop("sort_key")).join(nested.select("entity", "sort_key"), "entity").select((-F.col("sort_key")).alias("down"), "entity", "document")
    write_ordered(docs, path, "down", "entity")
    return read_ordered(docs.sparkSession, path, docs.schema).select("position", "entity", (-F.col("down")).alias("score"), "document")


def overlap(ranks: DataFrame, top: list, bottom: list, method: str = "equal", n: int = 10) -> DataFrame:
    """(part, n_found, n_listed, found): members of outside lists among the n best and the n worst."""
    r = f"{method}_rank"
    valid = ranks.where(F.col(method).isNotNull())
    ends = {"top": (valid.orderBy(r, "entity").limit(n), top), "bottom": (valid.orderBy(F.col(r).desc(), "entity").limit(n), bottom)}
    parts = []
    for name, (df, listed) in ends.items():
        own = F.array_sort(F.array_intersect(F.collect_list("entity"), F.array(*[F.lit(x).cast("long") for x in listed])))
        parts.append(df.agg(own.alias("_f")).select(F.lit(name).alias("part"), F.size("_f").alias("n_found"), F.lit(len(listed)).alias("n_listed"), F.array_join(F.transform("_f", lambda x: x.cast("string")), ",").alias("found")))
    return parts[0].unionByName(parts[1])


def page(entities: DataFrame, pillars: DataFrame, facts: DataFrame, history: DataFrame, notes: DataFrame) -> DataFrame:
    """An entity's page beside its scores: facts, history and notes, each with a default where there is none.

    Strengths and challenges that no note lists are the pillars at the ends of the traffic light.
    """
    ends = pillars.groupBy("entity").agg(
        F.array_sort(F.collect_set(F.when(F.col("score") >= 65, F.col("pillar")))).alias("_strong"),
        F.array_sort(F.collect_set(F.when(F.col("score") < 35, F.col("pillar")))).alias("_weak"),
    )
    x = entities.join(facts, "entity", "left").join(history, "entity", "left").join(notes, "entity", "left").join(ends, "entity", "left")
    none = F.array().cast("array<string>")
    return x.select(
        "entity", label("name", "entity").alias("label"), F.coalesce("segment", F.lit("")).alias("segment"), "balance", "first_year", "last_year",
        F.coalesce("n_years", F.lit(0)).alias("n_years"), F.coalesce("overview", F.lit("")).alias("overview"),
        F.coalesce("strengths", "_strong", none).alias("strengths"), F.coalesce("challenges", "_weak", none).alias("challenges"),
    )


def map_rows(ranks: DataFrame, entities: DataFrame, regions: DataFrame, light: Column, method: str = "equal") -> DataFrame:
    """What a map colours: every entity, those without a score too."""
    x = labelled(entities.select("entity", "grp"), entities).join(F.broadcast(regions), "grp", "left")  # one row a group
    return x.join(ranks.select("entity", method, f"{method}_rank"), "entity", "left").select(
        "entity", "label", "region", F.col(method).alias("score"), F.col(f"{method}_rank").alias("rank"), F.coalesce(light, F.lit("No data")).alias("light")
    )


def sources_table(registry: DataFrame, obs: DataFrame) -> DataFrame:
    """Where each indicator comes from: its years and pillars as text, and what the source gave: observations, entities, years."""
    got = obs.where("value IS NOT NULL").groupBy("variable_name").agg(F.count(F.lit(1)).alias("n_obs"), F.count_distinct("entity").alias("n_entities"), F.concat_ws("-", F.min("year"), F.max("year")).alias("observed"))
    shown = registry.select("variable_name", "display_name", "source", "database", F.array_join("pillars", ", ").alias("pillars"), F.concat_ws("-", "year_start", "year_end").alias("years"))
    return shown.join(got, "variable_name", "left").fillna(0, ["n_obs", "n_entities"]).fillna("", ["observed"])


def origins(cells: DataFrame) -> DataFrame:
    """(variable_name, origin, n, share): how many cells of an indicator were observed in its years, extended from the years before, filled from the group, or are missing."""
    origin = F.when(F.col("value").isNull(), "missing").when(F.col("regional"), "group").when(F.col("fill_year").isNotNull(), "extended").otherwise("observed")
    n = cells.groupBy("variable_name", origin.alias("origin")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable_name")))  # four rows an indicator


def weight_maps(weights: DataFrame) -> DataFrame:
    """(method, weights): a map of pillars from the long weight table."""
    return weights.groupBy("method").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pillar", "w")))).alias("weights"))
