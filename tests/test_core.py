"""Hand-built panels for the rules that are easy to get wrong."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import columns as c
from keelson.functions.ranking import quantiles, rank_desc
from keelson.operators import clean, compare, diagnose, normalize, robust, score
from keelson.plans.run import Run
from keelson.registry import CUSTOMERS, WEIGHT_PRESETS, Indicator, Registry
from keelson.schema import OBSERVATIONS, Params
from keelson.sources import files
from keelson.sources.panel import year_columns_to_long


def indicator(name, aggregation="most_recent", y0=2010, y1=2020, **k):
    return Indicator(name, k.pop("pillars", ("A",)), aggregation, y0, y1, **k)


def run(spark, obs, indicators, entities=None):
    ids = entities or sorted({(o[0], o[1]) for o in obs})
    return Run(spark.createDataFrame(obs, OBSERVATIONS), spark.createDataFrame(ids, "entity long, grp int"), Registry(tuple(indicators)))


def values(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_recent_means_available_not_calendar_years(spark):
    obs = [(1, 0, "x", y, v) for y, v in ((2010, 1.0), (2012, 2.0), (2015, 3.0), (2016, 4.0), (2020, 8.0))]
    for kind, expected in (("average_recent_3", 5.0), ("average_recent_5", 3.6), ("average", 3.6), ("most_recent", 8.0)):
        assert run(spark, obs, [indicator("x", kind)]).aggregated.first()["value"] == pytest.approx(expected)


def test_lookback_bounds_and_fill_year(spark):
    obs = [(1, 0, "x", 2005, 5.0), (2, 0, "x", 2004, 4.0), (3, 0, "x", 2006, 1.0), (3, 0, "x", 2009, 2.0), (4, 0, "x", 2010, 7.0), (4, 0, "x", 2009, 9.0)]
    got = values(run(spark, obs, [indicator("x", "average")]).aggregated, "entity")
    assert 2 not in got and (got[1]["value"], got[1]["fill_year"]) == (5.0, 2005)
    assert (got[3]["value"], got[3]["fill_year"]) == (1.5, 2009) and (got[4]["value"], got[4]["fill_year"]) == (7.0, None)


def test_ratio_and_double_log(spark):
    ind = [indicator("n", denominator="d"), indicator("d", role="descriptive")]
    obs = [(e, 0, "d", 2015, d) for e, d in ((1, 50.0), (2, 0.0), (3, -1.0), (5, 10.0), (6, 20.0))]
    obs += [(e, 0, "n", 2015, 5.0) for e in (1, 3, 4, 5, 6)] + [(2, 0, "n", 2008, 5.0)]
    r = run(spark, obs, ind)
    got = values(r.derived.where("variable_name = 'n'"), "entity")
    assert got[1]["value"] == 100 and all(got[e]["value"] is None for e in (2, 3, 4)) and got[2]["fill_value"] == 5.0
    log = [x for x in r.fill_log.where("entity = 2 AND variable_name = 'n'").collect()]
    assert sorted((x["fill_stage"], x["fill_year"]) for x in log) == [("stage1_extended", 2008), ("stage2_regional", None)]


def test_regional_fill_needs_three_peers(spark):
    obs = [(e, 0, "x", 2015, float(e)) for e in (1, 2, 3)] + [(e, 1, "x", 2015, 1.0) for e in (5, 6)]
    r = run(spark, obs, [indicator("x")], [(e, 0) for e in (1, 2, 3, 4)] + [(e, 1) for e in (5, 6, 7)])
    got = values(r.filled, "entity")
    assert got[4]["value"] == 2.0 and got[4]["regional"] and got[7]["value"] is None and not got[7]["regional"]


def test_fences_are_strict_and_iqr_zero_gives_a_constant(spark):
    obs = [(e, 0, "x", 2015, v) for e, v in enumerate([0.0, 1.0, 2.0, 3.0, 4.0, 100.0])]
    r = run(spark, obs, [indicator("x")])
    q1, q3 = np.quantile([0, 1, 2, 3, 4, 100], [0.25, 0.75])
    rep = clean.winsor_report(r.filled, r.fences).first()
    assert (rep["q1"], rep["q3"], rep["upper_bound"]) == pytest.approx((q1, q3, q3 + 2 * (q3 - q1))) and (rep["n_capped_low"], rep["n_capped_high"]) == (0, 1)
    flat = run(spark, [(e, 0, "x", 2015, v) for e, v in enumerate([1.0] * 6 + [9.0])], [indicator("x")])
    assert {x["norm_score"] for x in flat.norm.collect()} == {50.0}


def test_normalisation(spark):
    obs = [(e, 0, "x", 2015, v) for e, v in enumerate([-5.0, 0.0, math.e - 1])] + [(e, 0, "y", 2015, float(e)) for e in range(3)]
    r = run(spark, obs, [indicator("x", log_transform=True), indicator("y", polarity="negative"), indicator("z")])
    got = values(r.norm, "entity", "variable_name")
    assert [got[e, "x"]["norm_score"] for e in range(3)] == [0, 0, 100] and [got[e, "y"]["norm_score"] for e in range(3)] == [100, 50, 0]
    assert all(got[e, "z"]["norm_score"] is None for e in range(3))
    b = values(normalize.bounds(r.cells, r.registry), "variable_name")
    assert b["x"]["raw_max"] == pytest.approx(1) and b["x"]["log_max"] == b["x"]["raw_max"] and b["y"]["log_max"] is None


def pillars(spark, rows):
    return spark.createDataFrame([(e, 0, p, s) for e, own in rows.items() for p, s in zip("ABCDEFG", own)], "entity long, grp int, pillar string, score double")


SCORES = {
    1: [80.0, 60.0, 70.0, 90.0, 40.0, 55.0, 65.0], 2: [10.0, None, 30.0, 20.0, None, 50.0, 40.0], 3: [None] * 7,
    4: [None, None, 33.0, None, None, None, None], 5: [50.0, 51.0, 52.0, None, None, None, None], 6: [5.0, 95.0, 15.0, 85.0, 25.0, 75.0, 35.0],
    7: [0.0, 100.0, 20.0, 40.0, 60.0, 10.0, 30.0], 8: [44.0, 12.0, 67.0, 23.0, 89.0, 31.0, 76.0],
}


def test_missing_pillars_scale_the_other_weights(spark):
    got = values(score.weighted(pillars(spark, SCORES), WEIGHT_PRESETS["security_focus"]), "entity")
    w = WEIGHT_PRESETS["security_focus"]
    for e, own in SCORES.items():
        have = [(w[p], s) for p, s in zip("ABCDEFG", own) if s is not None]
        assert got[e]["score"] == (pytest.approx(sum(a * s for a, s in have) / sum(a for a, _ in have)) if have else None)
    zero = values(score.custom(pillars(spark, SCORES), {p: 0 for p in "ABCDEFG"}), "entity")
    assert zero[5]["score"] == pytest.approx(51)


def best_mean(s, low, high):
    """The knapsack by brute force over which pillars are full, which one takes the rest."""
    w, left = [low] * len(s), 1 - low * len(s)
    for i in sorted(range(len(s)), key=lambda i: -s[i]):
        take = min(high - low, max(0, left))
        w[i] += take
        left -= take
    return sum(a * b for a, b in zip(w, s))


def test_benefit_of_the_doubt(spark):
    p, x = Params(), pillars(spark, SCORES)
    got, tight = values(score.bod(x), "entity"), values(score.bod_tight(x), "entity")
    for e, own in SCORES.items():
        s = [v for v in own if v is not None]
        if not s:
            assert got[e]["score"] is None and tight[e]["score"] is None
            continue
        assert got[e]["score"] == pytest.approx(np.mean(s) if len(s) * 0.25 < 1 else best_mean(s, p.weight_min, p.weight_max))
        assert tight[e]["score"] == pytest.approx(best_mean([v or 0.0 for v in own], p.tight_min, p.tight_max))


def test_entropy_geometric_pca(spark):
    x = pillars(spark, SCORES)
    m = np.array([[np.nan if v is None else v for v in own] for own in SCORES.values()])
    f = np.where(np.isnan(m), np.nanmean(m, axis=0), m)
    f = np.where(f.min(axis=0) <= 0, f - f.min(axis=0) + 1e-8, f)
    q = np.maximum(f / f.sum(axis=0), 1e-8)
    d = 1 + (q * np.log(q)).sum(axis=0) / np.log(len(f))
    w = values(score.entropy_weights(x), "pillar")
    assert [w[k]["w"] for k in "ABCDEFG"] == pytest.approx(list(d / d.sum()))
    g = values(score.geometric(x), "entity")
    for e, own in SCORES.items():
        have = [max(v, 1e-8) for v in own if v is not None]
        assert g[e]["score"] == (pytest.approx(np.exp(np.mean(np.log(have)))) if have else None)
    full = m[~np.isnan(m).any(axis=1)]
    values_, vectors = np.linalg.eigh(np.corrcoef(full.T))
    load = vectors[:, -1] if (vectors[:, -1] < 0).sum() <= 3 else -vectors[:, -1]
    load = np.maximum(load, 0)
    weights, gap = score.pca_weights(x)
    assert [weights[k] for k in "ABCDEFG"] == pytest.approx(list(load / load.sum()), abs=1e-6) and gap == pytest.approx(values_[-1] - values_[-2])
    got = [r["score"] for r in score.pca(x).where("score IS NOT NULL").collect()]
    assert min(got) == 0 and max(got) == 100
    assert score.all_scores(pillars(spark, {1: [1.0] + [None] * 6}), methods={"pca": score.pca}).first()["pca"] is None


def test_ranks(spark):
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate([5.0, 7.0, 5.0, None, 1.0, 7.0, None, 9.0])], "e int, x double, g int")
    for rows in (2, 1 << 20):
        got = values(rank_desc(df, "x", "r", window_rows=rows), "e")
        assert [got[i]["r"] for i in range(8)] == [4, 2, 4, 7, 6, 2, 7, 1]
        avg = values(rank_desc(df.where("x IS NOT NULL"), "x", "r", ties="average", window_rows=rows), "e")
        assert [avg[i]["r"] for i in (0, 1, 2, 4, 5, 7)] == [4.5, 2.5, 4.5, 6, 2.5, 1]
        row = values(rank_desc(df, "x", "r", ["g"], "e", rows), "e")
        assert [row[i]["r"] for i in range(8)] == [1, 2, 2, 4, 4 - 1, 3, 4, 1] or sorted(row[i]["r"] for i in (0, 2, 4, 6)) == [1, 2, 3, 4]


def test_ranks_of_large_groups(spark):
    """By distinct values, with one value in most rows and NULL groups: as a plain window ranks them."""
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 17 == 0 else float(rng.integers(0, 40)) if i % 2 else 7.0, [None, 1, 2][i % 3]) for i in range(600)]
    df = spark.createDataFrame(rows, "e int, x double, g int")
    for within in ([], ["g"]):
        for ties in ("min", "average", "e"):
            x = df if ties != "average" else df.where("x IS NOT NULL")
            one, two = (values(rank_desc(x, "x", "r", within, ties, n), "e") for n in (1 << 20, 20))
            assert {e: r["r"] for e, r in one.items()} == {e: r["r"] for e, r in two.items()}
    plain = values(quantiles(df, "x", "g", {"q1": 0.25, "q3": 0.75}), "g")
    large = values(quantiles(df, "x", "g", {"q1": 0.25, "q3": 0.75}, 20), "g")
    assert [(k, r["q1"], r["q3"]) for k, r in plain.items() if k] == [(k, r["q1"], r["q3"]) for k, r in large.items() if k]


def test_worst_weights_scale_over_the_pillars_there_are(spark):
    x = pillars(spark, {1: [90.0] + [None] * 6, 2: [50.0] * 7, 3: [10.0] * 7, 4: [None] * 7})
    got = robust.max_shift(x, vectors=[[0.25] + [0.125] * 6]).first()
    # Entity 1 has 90 under any weights; unscaled it would fall to 22.5, behind the second.
    assert got["rho"] == pytest.approx(1) and got["max_shift"] == 0
    equal = score.entropy_weights(pillars(spark, {e: [5.0] * 7 for e in (1, 2, 3)})).collect()
    assert [r["w"] for r in equal] == pytest.approx([1 / 7] * 7)


def test_alpha_and_spearman(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(12, 3)).round(1)
    rows = [(e, 0, v, float(m[e, k])) for e in range(12) for k, v in enumerate("xyz") if not (e == 3 and v == "z")]
    norm = spark.createDataFrame(rows, "entity long, grp int, variable_name string, norm_score double")
    reg = Registry(tuple(indicator(v) for v in "xyz")).table(spark)
    full = np.delete(m, 3, axis=0)
    alpha = 3 / 2 * (1 - full.var(axis=0, ddof=1).sum() / full.sum(axis=1).var(ddof=1))
    got = diagnose.cronbach(norm, reg).first()
    assert got["alpha"] == pytest.approx(alpha) and got["n_complete"] == 11
    import pandas as pd

    frame = pd.DataFrame(m, columns=list("xyz"))
    frame.loc[3, "z"] = None
    rho = frame.rank().corr() if False else frame.corr(method=lambda a, b: np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1])
    for r in diagnose.pillar_spearman(norm, reg).collect():
        assert r["rho"] == pytest.approx(rho.loc[r["a"], r["b"]])


def test_coverage_gate(spark):
    r = run(spark, [(1, 0, "x", 2015, 1.0)], [indicator("x")], [(1, 0), (2, 0), (3, 0)])
    with pytest.raises(clean.CoverageError):
        r.check()


def test_fill_exclusion_and_bands(spark):
    obs = [(e, 0, "x", 2015, float(e)) for e in range(1, 5)] + [(e, 0, "y", 2015, float(-e)) for e in range(1, 5)]
    r = run(spark, obs, [indicator("x"), indicator("y", pillars=("B",))], [(e, 0) for e in range(1, 6)])
    got = values(robust.without_fills(r.norm, r.fill_log, r.registry), "entity")
    assert got[5]["rank_pure"] is None and got[5]["verdict"] == "Data-sensitive"
    band = values(robust.bands(score.equal(r.pillars).withColumnRenamed("score", "equal"), r.quality), "entity")
    assert band[1]["width"] == 4.0 and band[5]["width"] == pytest.approx(57.4)


def test_weight_vectors_keep_their_bounds():
    v = robust.weight_vectors()
    assert len(v) == 34 and all(abs(sum(x) - 1) < 1e-9 and min(x) >= 0.05 and max(x) <= 0.25 + 1e-12 for x in v)


def test_registry_rules():
    bad = Registry((indicator("x", "median", pillars=("Q",)), indicator("x", y0=2020, y1=2010, source="wb_api", series_code="abc")))
    what = " ".join(w for _, w in bad.errors())
    for part in ("aggregation", "unknown pillar", "year_start", "no dot", "database", "duplicate"):
        assert part in what
    assert CUSTOMERS.remove("tax_rate").edit("mean_qty", year_end=2000).pull_window()[""] == (1993, 2001)
    with pytest.raises(ValueError):
        CUSTOMERS.add(CUSTOMERS.indicators[0])
    with pytest.raises(ValueError):
        CUSTOMERS.with_pillars({**CUSTOMERS.pillars, "A": 0.9})
    assert all(abs(sum(w.values()) - 1) < 1e-9 for w in WEIGHT_PRESETS.values())


def test_compare_and_columns(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (None, 4.0)], "k int, value double")
    b = spark.createDataFrame([(1, 1.0), (2, 2.5), (4, 4.0), (None, 4.0)], "k int, value double")
    got = {r["k"]: r["status"] for r in compare.outer(a, b, ["k"]).collect()}
    assert got == {1: "both", 2: "changed", 3: "left_only", 4: "right_only", None: "both"}
    assert compare.key_differences(a, b, ["k"]).count() == 2 and compare.shared_keys(a, b, ["k"]).count() == 3
    x = spark.createDataFrame([(float("nan"), 12345.6), (-3.0, 0.5), (1.0, None)], "v double, w double")
    rows = x.select(c.no_nan("v").alias("n"), c.log1p_clipped(c.no_nan("v")).alias("l"), c.tiered_number("w").alias("t"), c.clipped("w", F.lit(0), F.lit(1)).alias("k")).collect()
    assert rows[0]["n"] is None and rows[0]["l"] is None and rows[1]["l"] == 0 and [r["t"] for r in rows] == ["12,346", "0.5000", None] and rows[2]["k"] is None


def test_sources(spark, tmp_path):
    wide = spark.createDataFrame([("AAA", 1.0, float("nan"), "3.5")], "iso3 string, YR2015 double, `2016` double, `2017.0` string")
    assert {(r["year"], r["value"]) for r in year_columns_to_long(wide, ["iso3"]).collect()} == {(2015, 1.0), (2017, 3.5)}
    df = spark.createDataFrame([("AAA", "x", 2015, 1.5)], "iso3 string, variable_name string, year int, value double")
    files.write_csv(df, f"{tmp_path}/raw.csv")
    assert files.read_table(spark, f"{tmp_path}/raw.csv", df.schema).collect() == df.collect()
    first = files.freeze(df, f"{tmp_path}/frozen")
    assert files.freeze(df.withColumn("value", F.lit(9.0)), f"{tmp_path}/frozen").collect() == first.collect() == df.collect()


def test_observations_travel_once_to_be_aggregated(spark):
    """The window of the latest years and the grouping after it share one exchange."""
    r = run(spark, [(1, 0, "x", 2015, 1.0), (2, 0, "x", 2016, 2.0)], [indicator("x")])
    plan = clean.aggregate(r.obs, r.registry)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(entity") == 1
