"""The registered queries over the customer panel.

Means are taken in any order, so floats are rounded: scores, shares and raw values to nine places (a mean of four-place
scores can end in a 5 at the seventh), raw values of 1000 and above, which have fewer places to spare, to five.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.columns import coverage_flag, overall_verdict, steady, traffic_light
from keelson.functions.ranking import ranks_of_means
from keelson.operators import audit, clean, compare, diagnose, normalize, report, robust, score, serve
from keelson.plans.run import Run
from keelson.registry import WEIGHT_PRESETS
from keelson.sources import context, files, series
from keelson.sources.tables import kept, new_path
from keelson.sources.versions import Versions

METHODS = ["equal", "pca", "bod", "entropy", "geometric"]
CUSTOM = {"A": 0.4, "B": 0.1, "C": 0.0, "D": 0.2}
#: The set that can be left out of views: customers of one nation.
LEFT_OUT = "grp = 3"


RAW_COLUMNS = {
    "value", "fill_value", "left_value", "right_value", "diff", "max_diff", "mean_diff", "q1", "q3", "iqr", "lower_bound", "upper_bound",
    "raw_min", "raw_max", "log_min", "log_max", "after_log",
}


def rounded(df: DataFrame, digits: int | None = None) -> DataFrame:
    def of(c: str):
        if c in RAW_COLUMNS and not digits:
            return steady(c).alias(c)
        return F.round(c, digits or 9).alias(c)

    return df.select(*[of(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def _run(f: Callable[[Run], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(f(Run.customers(spark, sf_dir)))


def _of_aggregation(kind: str):
    def f(r: Run) -> DataFrame:
        names = [i.variable_name for i in r.definitions.indicators if i.aggregation == kind]
        return r.aggregated.where(F.col("variable_name").isin(names)).select("entity", "variable_name", "value", F.coalesce("fill_year", F.lit(0)).alias("fill_year"))

    return f


def _later(r: Run) -> DataFrame:
    """The panel as a later pull might bring it: a year is missing, some values moved, some are new."""
    moved = r.obs.where("year <> 1995").withColumn("value", F.when(F.col("entity") % 7 == 0, F.col("value") + 1).otherwise(F.col("value")))
    new = r.obs.where("year = 2001 AND entity % 11 = 0").withColumn("year", F.lit(2002))
    return moved.unionByName(new)


KEYS = ["entity", "variable_name", "year"]


def _compared(r: Run) -> DataFrame:
    return compare.outer(r.obs, _later(r), KEYS)


def _long(df: DataFrame) -> DataFrame:
    return df.select("entity", "score")


def _equal_rank(r: Run) -> DataFrame:
    return ranks_of_means(score.equal(r.pillars), {"rank": "score"})


def _bundle(r: Run) -> DataFrame:
    ranks = r.ranks(METHODS)
    band = robust.bands(ranks, r.quality)
    return serve.bundle(ranks, r.pillars, r.norm, r.fill_log, r.quality, band, robust.peers(ranks, r.entities), METHODS)


def _bundle_rows(r: Run) -> DataFrame:
    """Every number of every document: maps as sorted text, so that all pillars and indicators are compared."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    entries = lambda m, f: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), f(e["value"]))), ";")
    return _bundle(r).select(
        "entity", *[F.col(f"scores.{m}").alias(m) for m in METHODS], *[F.col(f"ranks.{m}").alias(f"{m}_rank") for m in METHODS], F.coalesce(entries("pillars", text), F.lit("")).alias("pillars"),
        entries("indicators", lambda v: F.concat(text(v["score"]), F.when(v["filled"], "*").otherwise(""))).alias("indicators"),
        F.col("data_quality.n_filled").alias("n_filled"), F.col("data_quality.pct_real").alias("pct_real"), F.col("data_quality.flag").alias("flag"), F.array_join("data_quality.filled", ",").alias("filled"),
        *[F.col(f"band.{k}").alias(k) for k in ("low", "high", "width")], F.coalesce("peers.peer_rank", F.lit(-1)).alias("peer_rank"), F.coalesce("peers.n_peers", F.lit(-1)).alias("n_peers"),
    )


def _sorted_bundle(r: Run) -> DataFrame:
    return report.sorted_bundle(_bundle(r), new_path(r.spark)).select("position", "entity", "score")


def _stored(r: Run, damaged: bool = False) -> DataFrame:
    """The bundle written as lines of JSON and read again; ``damaged``: some scores, bands and peer ranks off, some lines cut."""
    nested = _bundle(r).drop("sort_key")
    if damaged:
        hit = lambda n: F.col("entity") % n == 0
        nested = nested.withColumn("scores", F.col("scores").withField("equal", F.col("scores.equal") + F.when(hit(97), 1.0).otherwise(0.0)))
        nested = nested.withColumn("band", F.col("band").withField("low", F.col("band.low") - F.when(hit(89), 5.0).otherwise(0.0)))
        nested = nested.withColumn("peers", F.col("peers").withField("peer_rank", F.col("peers.peer_rank") + F.when(hit(79), 1).otherwise(0)))
    lines, path = serve.documents(nested), new_path(r.spark)
    cut = F.when((F.col("entity") % 83 == 0) & F.lit(damaged), F.expr("left(document, length(document) - 9)")).otherwise(F.col("document"))
    lines.select(cut.alias("value")).write.text(path)
    return files.read_documents(r.spark, path, nested.schema)


def _audited(r: Run, damaged: bool = False) -> DataFrame:
    again = audit.recomputed_numbers(r.pillars, r.norm, r.fill_log, r.entities, r.scores(METHODS), len(r.definitions.indicators), METHODS)
    return audit.of_documents(_stored(r, damaged), again, METHODS)


def _eigen(r: Run) -> DataFrame:
    x = score.eigen(r.pillars)
    return x.select("component", *[F.round(c, 6).alias(c) for c in ("eigenvalue", "gap", "share")], "n", (F.col("gap") < r.params.min_eigengap).alias("unstable"))


def _solvers(r: Run) -> DataFrame:
    """The gap to six places: what is left below is the order of a sum."""
    return compare.solvers(score.bod(r.pillars), score.bod_dual(r.pillars)).withColumn("gap", F.abs(F.round("gap", 6)))


#: Series beside the indicators: one whose years are before all orders, and one whose values are no numbers.
OLD, TEXTS = "old_orders", "segment"


def _service(r: Run, without: tuple[str, ...] = ()) -> str:
    """The panel as a service answers: each series a folder of JSON lines, values as text; ``without``: series it doesn't know yet."""
    root = new_path(r.spark)
    rows = r.obs.select("variable_name", F.col("entity").cast("string").alias("key"), "year", F.col("value").cast("string").alias("value"))
    old = rows.where("variable_name = 'order_count'").withColumn("variable_name", F.lit(OLD))
    text = rows.where("variable_name = 'order_count'").select(F.lit(TEXTS).alias("variable_name"), "key", "year", F.concat(F.lit("segment of "), "key").alias("value"))
    series.export(rows.where(~F.col("variable_name").isin(*without)).unionByName(old).unionByName(text), root)
    return root


def _wanted(r: Run) -> list[series.Series]:
    return [*series.of_registry(r.definitions), series.Series(OLD, OLD, 1890, 1899), series.Series(TEXTS, TEXTS, 1993, 2001)]


LATE = ("tax_rate", "mean_qty")


def _pulled(r: Run) -> Versions:
    """Two pulls: the service lacks two series at first, and the second pull asks for what failed only."""
    store, fetch = Versions(r.spark, new_path(r.spark)), "keelson.sources.series:from_folder"
    for root in (_service(r, LATE), _service(r)):
        series.pull(r.spark, _wanted(r), fetch, store, root=root, firstwait=0)
    return store


def _scanned(r: Run) -> DataFrame:
    """Two series over three years, as the service gives them: names and years are filters that the source takes."""
    rows = series.scan(r.spark, series.of_registry(r.definitions), "keelson.sources.series:from_folder", root=_service(r))
    return rows.where("year BETWEEN 1998 AND 2000").select(F.col("key").cast("long").alias("entity"), "variable_name", "year", "value")


def _drift(r: Run) -> DataFrame:
    """What parts two stored versions of the panel."""
    store = Versions(r.spark, new_path(r.spark))
    first, second = store.commit(r.obs, "as pulled"), store.commit(_later(r), "as pulled later")
    return compare.outer(store.read(first), store.read(second), KEYS).where("status <> 'both'")


def _verdict(r: Run) -> DataFrame:
    ranks = r.ranks(METHODS)
    rho = robust.rank_correlations(ranks, METHODS).agg(F.min("rho").alias("min_rho"))
    n = robust.rank_sensitivity(ranks, METHODS).agg(F.count_if(F.col("verdict") == "Stable").alias("n_stable"), F.count_if(F.col("verdict") == "Sensitive").alias("n_sensitive"))
    return rho.crossJoin(F.broadcast(n)).withColumn("verdict", overall_verdict("min_rho", "n_sensitive"))


def _profile(r: Run) -> DataFrame:
    """Every entity's page: its pillars with the averages of all and of its group. A page is the rows of one entity."""
    all_mean = serve.pillar_averages(r.pillars)
    grp_mean = kept(r.pillars.groupBy("grp", "pillar").agg(F.avg("score").alias("group_score")))  # of known size
    return r.pillars.join(F.broadcast(all_mean), "pillar").join(grp_mean, ["grp", "pillar"]).select("entity", "pillar", "score", "mean_score", "group_score", traffic_light("score").alias("light"))


#: Lists from outside to hold ranks against, and known values with their bounds.
OUTSIDE = {"top": [1, 2, 3, 10, 26, 46, 120, 146], "bottom": [5, 31, 77, 99, 140]}
KNOWN = [("order_count", 1, 2000, 1.0, 9.0), ("order_count", 7, 1999, 50.0, 60.0), ("tax_rate", 2, 1890, 0.0, 1.0)]


def _page(r: Run, spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = context.read_or_empty(spark, f"{sf_dir}/notes.json", context.NOTES)
    out = report.page(r.entities, r.pillars, context.customer_facts(spark, sf_dir), context.customer_history(spark, sf_dir), notes)
    return out.withColumns({c: F.array_join(c, ",") for c in ("strengths", "challenges")})


def _document(r: Run) -> DataFrame:
    """Each entity's scores and ranks as one JSON text, nulls written out."""
    x = r.ranks(METHODS)
    scores = F.struct(*[F.round(F.round(m, 9), 2).alias(m) for m in METHODS])
    nested = x.select("entity", scores.alias("scores"), F.struct(*[F.col(f"{m}_rank").alias(m) for m in METHODS]).alias("ranks"))
    return serve.documents(nested)


def _robustness_document(r: Run) -> DataFrame:
    """The summary of robustness as JSON: the least correlation, counts, the ten most sensitive entities, the worst weights and the verdicts."""
    sens = robust.rank_sensitivity(r.ranks(METHODS), METHODS)
    ten = report.most_sensitive(sens).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("rank_range")).alias("k"), "entity"))), lambda x: x["entity"]).alias("most_sensitive"))
    n = sens.agg(F.count_if(F.col("verdict") == "Stable").alias("n_stable"), F.count_if(F.col("verdict") == "Sensitive").alias("n_sensitive"))
    rho = robust.rank_correlations(r.ranks(METHODS), METHODS).agg(F.round(F.min("rho"), 6).alias("min_rho"))
    worst = robust.worst_weights(robust.max_shift(r.pillars)).select(F.struct("weight_id", F.round("rho", 6).alias("rho"), "verdict").alias("worst_weights"))
    one = n.crossJoin(F.broadcast(ten)).crossJoin(F.broadcast(rho)).crossJoin(F.broadcast(worst))  # one row each
    return one.select(F.to_json(F.struct("min_rho", "n_stable", "n_sensitive", overall_verdict("min_rho", "n_sensitive").alias("verdict"), "most_sensitive", "worst_weights")).alias("document"))


def _audit(r: Run) -> DataFrame:
    """All recomputations: a row for each section."""
    scores, wide = r.scores(["equal", "geometric"]), score.wide(r.pillars)
    band = robust.bands(scores, r.quality)
    parts = [
        audit.normalisation(r.cells, normalize.bounds(r.cells, r.registry), r.norm), audit.pillar_means(r.norm, r.registry, r.pillars), audit.equal_scores(wide, scores),
        audit.geometric_scores(wide, scores), audit.band_widths(band, r.quality), audit.peer_counts(robust.peers(scores, r.entities), r.entities, scores),
    ]
    return reduce(DataFrame.unionByName, parts)


def _weights(r: Run) -> DataFrame:
    maps = report.weight_maps(score.method_weights(r.pillars))
    return maps.select("method", *[F.round(F.col("weights")[p], 6).alias(p) for p in r.params.pillars])


def _with_source(f: Callable[[Run, SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(f(Run.customers(spark, sf_dir), spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q_panel": _run(lambda r: r.obs),
    "q_most_recent": _run(_of_aggregation("most_recent")),
    "q_average": _run(_of_aggregation("average")),
    "q_average_recent_3": _run(_of_aggregation("average_recent_3")),
    "q_average_recent_5": _run(_of_aggregation("average_recent_5")),
    "q_last_k": _run(lambda r: diagnose.last_k(r.obs, 2).select("entity", "variable_name", "year", "value", "rn")),
    "q_stage1_fill": _run(lambda r: r.aggregated.where("fill_year IS NOT NULL")),
    "q_ratio_derive": _run(lambda r: r.derived.where(F.col("variable_name") == "returned_qty").select("entity", "value", "fill_value")),
    "q_dense_grid": _run(lambda r: r.grid.groupBy("variable_name").agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("value").isNull()).alias("n_gaps"))),
    "q_regional_fill": _run(lambda r: r.filled.select("entity", "variable_name", "value", "regional")),
    "q_fill_log": _run(lambda r: r.fill_log.withColumn("fill_year", F.coalesce("fill_year", F.lit(0)))),
    "q_coverage_raw": _run(lambda r: clean.raw_coverage(r.obs, r.registry, r.entities.agg(F.count(F.lit(1)).alias("n_total")))),
    "q_coverage_post": _run(lambda r: clean.post_coverage(r.filled)),
    "q_fences": _run(lambda r: r.fences),
    "q_winsor_report": _run(lambda r: clean.winsor_report(r.filled, r.fences)),
    "q_winsorised": _run(lambda r: r.cells.where("role = 'scoring'").select("entity", "variable_name", "value", "capped")),
    "q_norm_bounds": _run(lambda r: normalize.bounds(r.cells, r.registry)),
    "q_normalize": _run(lambda r: r.norm.select("entity", "variable_name", "norm_score")),
    "q_out_of_range": _run(lambda r: normalize.out_of_range(r.norm).agg(F.count(F.lit(1)).alias("n"))),
    "q_pillar_scores": _run(lambda r: r.pillars.select("entity", "pillar", "score")),
    "q_pillar_null_rate": _run(lambda r: clean.pillar_null_rate(r.cells, r.registry)),
    "q_pivot": _run(lambda r: score.wide(r.pillars).drop("grp")),
    "q_equal": _run(lambda r: _long(score.equal(r.pillars))),
    "q_equal_rank": _run(_equal_rank),
    "q_preset": _run(lambda r: _long(score.weighted(r.pillars, WEIGHT_PRESETS["security_focus"]))),
    "q_custom": _run(lambda r: _long(score.custom(r.pillars, CUSTOM))),
    "q_geometric": _run(lambda r: _long(score.geometric(r.pillars))),
    "q_entropy_weights": _run(lambda r: score.entropy_weights(r.pillars).withColumn("w", F.round("w", 8))),
    "q_entropy": _run(lambda r: _long(r.scores(["entropy"]).withColumnRenamed("entropy", "score"))),
    "q_bod": _run(lambda r: _long(score.bod(r.pillars))),
    "q_bod_tight": _run(lambda r: _long(score.bod_tight(r.pillars))),
    "q_pca": lambda spark, sf_dir: rounded(score.pca(Run.customers(spark, sf_dir).pillars), 6),
    "q_method_weights": lambda spark, sf_dir: rounded(score.method_weights(Run.customers(spark, sf_dir).pillars), 6),
    "q_ranks": _run(lambda r: r.ranks(METHODS)),
    "q_method_bars": _run(lambda r: serve.method_bars(r.scores(METHODS), METHODS)),
    "q_cronbach": _run(lambda r: diagnose.cronbach(r.norm, r.registry)),
    "q_spearman_pillars": _run(lambda r: diagnose.pillar_spearman(r.norm, r.registry)),
    "q_collinear": _run(lambda r: diagnose.collinear(diagnose.pillar_spearman(r.norm, r.registry), 0.2)),
    "q_effective_weights": _run(lambda r: diagnose.effective_weights(r.registry, r.norm)),
    "q_design": _run(lambda r: diagnose.design(r.registry, r.obs)),
    "q_distribution": _run(lambda r: diagnose.distribution(r.scores(METHODS), METHODS)),
    "q_rank_correlations": _run(lambda r: robust.rank_correlations(r.ranks(METHODS), METHODS)),
    "q_rank_sensitivity": _run(lambda r: robust.rank_sensitivity(r.ranks(METHODS), METHODS)),
    "q_robustness_summary": _run(_verdict),
    "q_max_shift": _run(lambda r: robust.max_shift(r.pillars)),
    "q_worst_weights": _run(lambda r: robust.worst_weights(robust.max_shift(r.pillars))),
    "q_fill_exclusion": _run(lambda r: robust.without_fills(r.norm, r.fill_log, r.registry).fillna(-1)),
    "q_tight_bounds": _run(lambda r: robust.tight_bounds(r.pillars)),
    "q_confidence_band": _run(lambda r: robust.bands(score.equal(r.pillars).withColumnRenamed("score", "equal"), r.quality)),
    "q_data_quality": _run(lambda r: serve.data_quality(r.quality).withColumn("filled", F.array_join("filled", ","))),
    "q_flag_counts": _run(lambda r: serve.data_quality(r.quality).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))),
    "q_peer_rank": _run(lambda r: robust.peers(score.equal(r.pillars).withColumnRenamed("score", "equal"), r.entities)),
    "q_goodness_rank": _run(lambda r: serve.goodness(r.cells, r.registry)),
    "q_overview": _run(lambda r: serve.overview(score.equal(r.pillars).withColumnRenamed("score", "equal"))),
    "q_top_bottom": _run(lambda r: serve.ends(r.ranks(["equal"]))),
    "q_rankings_without": _run(lambda r: serve.rankings(r.ranks(["equal"]), r.entities, without=LEFT_OUT)),
    "q_profile": _run(_profile),
    "q_pillar_detail": _run(lambda r: serve.pillar_detail(r.cells, r.norm, r.registry).fillna({"value_text": "-"}).fillna(-1, ["goodness_rank", "n_ranked"])),
    "q_walkthrough": _run(lambda r: serve.walkthrough(r.cells, normalize.bounds(r.cells, r.registry))),
    "q_heatmap": _run(lambda r: serve.heatmap(r.pillars, 9)),
    "q_radar": _run(lambda r: serve.radar(r.pillars, WEIGHT_PRESETS["security_focus"])),
    "q_pillar_averages": _run(lambda r: serve.pillar_averages(r.pillars)),
    "q_table_filter": _run(lambda r: serve.table_view(report.labelled(r.ranks(["equal"]), r.entities), {"label": "CUSTOMER#", "equal_rank": "7"}, [("equal_rank", True), ("entity", False)])),
    "q_outer_compare": _run(_compared),
    "q_compare_summary": _run(lambda r: compare.summary(_compared(r), 1e-9, 1e-2)),
    "q_worst_offenders": _run(lambda r: compare.worst(_compared(r), KEYS)),
    "q_set_difference": _run(lambda r: compare.key_differences(r.obs, _later(r), KEYS)),
    "q_set_intersection": _run(lambda r: compare.shared_keys(r.obs, _later(r), KEYS)),
    "q_rank_flips": _run(lambda r: compare.rank_flips(r.ranks(["equal", "geometric"]).select("entity", F.col("equal_rank").alias("r")), r.ranks(["geometric"]).select("entity", F.col("geometric_rank").alias("r")), "r")),
    "q_bundle": _run(_bundle_rows),
    "q_bundle_sorted": _run(_sorted_bundle),
    "q_audit_documents": _run(_audited),
    "q_audit_damaged": _run(lambda r: _audited(r, damaged=True)),
    "q_audit_report": _run(lambda r: audit.report_document(_audited(r, damaged=True))),
    "q_bod_dual": _run(_solvers),
    "q_solver_summary": _run(lambda r: compare.solver_summary(_solvers(r))),
    "q_eigen": _run(_eigen),
    "q_series_scan": _run(_scanned),
    "q_pull_values": _run(lambda r: series.observations(_pulled(r)).select(F.col("key").cast("long").alias("entity"), "variable_name", "year", "value")),
    "q_drift": _run(_drift),
    "q_report_coverage": _run(lambda r: report.coverage_table(clean.post_coverage(r.filled))),
    "q_report_overall": _run(lambda r: report.overall(r.ranks(METHODS), r.entities, METHODS)),
    "q_report_pillars": _run(lambda r: report.pillar_table(score.wide(r.pillars), r.scores(["equal"]), r.entities)),
    "q_report_indicators": _run(lambda r: report.indicator_table(r.cells, r.norm, r.registry, r.entities)),
    "q_most_sensitive": _run(lambda r: report.most_sensitive(robust.rank_sensitivity(r.ranks(METHODS), METHODS))),
    "q_report_shift": _run(lambda r: report.by_shift(robust.without_fills(r.norm, r.fill_log, r.registry)).fillna(-1)),
    "q_sorted_series": _run(lambda r: report.sorted_series(r.pillars.select("entity", "pillar", F.round("score", 9).alias("score")))),
    "q_scores_file": _run(lambda r: report.scores_file(r.ranks(METHODS), score.wide(r.pillars), METHODS)),
    "q_documents": _run(_document),
    "q_robustness_document": _run(_robustness_document),
    "q_overlap": _run(lambda r: report.overlap(r.ranks(["equal"]), OUTSIDE["top"], OUTSIDE["bottom"])),
    "q_profile_page": _with_source(_page),
    "q_map_rows": _with_source(lambda r, spark, sf_dir: report.map_rows(r.ranks(["equal"]), r.entities, context.group_regions(spark, sf_dir), traffic_light("equal"))),
    "q_latest": _run(lambda r: diagnose.latest(r.obs)),
    "q_sources": _run(lambda r: report.sources_table(r.registry, r.obs)),
    "q_source_share": _run(lambda r: report.origins(r.filled)),
    "q_method_weight_maps": lambda spark, sf_dir: _weights(Run.customers(spark, sf_dir)),
    "q_audit": _run(_audit),
    "q_bod_property": _run(lambda r: audit.not_below(r.scores(["equal", "bod"]))),
    "q_alpha_status": _run(lambda r: audit.low_alpha(diagnose.cronbach(r.norm, r.registry))),
    "q_distribution_audit": _run(lambda r: audit.within_range(diagnose.distribution(r.scores(METHODS), METHODS))),
    "q_spot_checks": _run(lambda r: audit.spot_checks(r.obs, KNOWN).fillna(-1.0, ["value"])),
    "q_pull_log": _run(lambda r: series.latest(series.log_of(_pulled(r))).select("variable_name", "attempt", "status", "n_obs", "n_entities", "n_attempts")),
    "q_pull_summary": _run(lambda r: series.summary(series.log_of(_pulled(r)))),
    "q_order_dates": lambda spark, sf_dir: context.order_dates(spark, sf_dir),
}
