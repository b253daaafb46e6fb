"""Ranks, rounding, rank correlations, eigenvalues, solvers and audits against plain Python and numpy."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions import columns as c
from keelson.functions.ranking import ranks_desc, ranks_of_means
from keelson.operators import audit, compare, diagnose, robust, score, serve
from keelson.plans.run import Run, forget, stamp
from keelson.registry import CUSTOMERS
from keelson.sources import files

DATA, METHODS = "/root/testdata/sf0.001", ["equal", "pca", "bod", "entropy", "geometric"]


def test_means_do_not_depend_on_the_order(spark):
    """16 amounts in cents whose mean ends in a 5 at the sixth place; also small, huge and no values."""
    rnd = random.Random(5)
    cents = [rnd.randrange(10**5, 10**8) for _ in range(15)]
    cents.append(16 * 20_000_000 + 15 - sum(cents))
    groups = {"cents": [x / 100 for x in cents], "mixed": [0.1, 0.2, 7.3, None], "small": [0.1, 0.2, 0.3], "huge": [1e20, 3e20], "none": [None, None]}
    seen = set()
    for parts in (1, 3, 7):
        rows = [(g, x) for g, xs in groups.items() for x in xs]
        rnd.shuffle(rows)
        got = spark.createDataFrame(rows, "g string, x double").repartition(parts).groupBy("g").agg(c.steady_mean("x").alias("m"))
        m = {r["g"]: r["m"] for r in got.collect()}
        seen.add((m["cents"], m["mixed"]))
        assert m["small"] == pytest.approx(0.2) and m["huge"] == pytest.approx(2e20) and m["none"] is None
    assert seen == {(sum(cents) / 1600, 7.6 / 3)}


def test_entropy_weights_do_not_depend_on_the_order(spark):
    rnd = random.Random(11)
    rows = [(e, 0, p, None if rnd.random() < 0.05 else rnd.uniform(40, 42)) for e in range(1000) for p in "ABCDEFG"]
    seen = set()
    for parts in (1, 3, 7):
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "entity long, grp int, pillar string, score double").repartition(parts)
        seen.add(tuple((r["pillar"], r["w"]) for r in score.entropy_weights(df).orderBy("pillar").collect()))
    assert len(seen) == 1
    # what fits no decimal is summed as doubles
    far = spark.createDataFrame([(1e30,), (2e30,), (None,)], "x double").agg(c.steady_sum("x", 18).alias("s")).first()["s"]
    assert far == pytest.approx(3e30)


def test_geometric_means_do_not_depend_on_the_order(spark):
    """The same seven scores, dealt to the pillars in other orders, are one mean to the last bit; none or one score too."""
    rnd = random.Random(21)
    sets = [[round(rnd.uniform(1, 100), 4) for _ in range(7)] for _ in range(20)]
    rows = [(100 * k + e, 0, p, x) for k, same in enumerate(sets) for e in range(20) for p, x in zip("ABCDEFG", rnd.sample(same, 7))]
    rows += [(9000, 0, p, None) for p in "ABCDEFG"] + [(9001, 0, "A", 0.0), (9001, 0, "B", None)]
    got = {r["entity"]: r["score"] for r in score.geometric(spark.createDataFrame(rows, "entity long, grp int, pillar string, score double")).collect()}
    assert got[9000] is None and got[9001] == pytest.approx(1e-8)
    for k, same in enumerate(sets):
        found = {got[100 * k + e] for e in range(20)}
        assert len(found) == 1 and found.pop() == pytest.approx(math.exp(sum(map(math.log, same)) / 7), rel=1e-14)


# -- ranks: the plan may change with the size, results may not -------------------
@pytest.mark.parametrize("within", [[], ["g"]])
@pytest.mark.parametrize("ties", ["min", "average", "k"])
def test_ranks_are_the_same_by_window_and_by_parts(spark, within, ties):
    rnd = random.Random(1)
    rows = [(rnd.randrange(3), rnd.choice([5.0, 5.0, 5.0, 1.0, 2.5, None, -1.0]), rnd.randrange(4)) for _ in range(400)]
    rows += [(0, 5.0, 1)] * 60 + [(None, 5.0, 1)] * 3 + [(None, None, None)] * 3  # rows that are equal in all
    df = spark.createDataFrame(rows, "g int, x double, k int")
    a, b = (ranks_desc(df, {"r": "x"}, within, ties, window_rows=w) for w in (1 << 20, 1))
    key = lambda df: sorted(map(tuple, df.select("g", "x", "k", "r").collect()), key=str)
    if ties == "k":
        # which of equal rows has which place is open: places are what counts
        assert sorted(r[3] for r in key(a)) == sorted(r[3] for r in key(b))
        for df_ in (a, b):
            got = sorted(df_.collect(), key=lambda r: (str(r["g"]) if within else "", r["r"]))
            for p, q in zip(got, got[1:]):
                if not within or p["g"] == q["g"]:
                    assert q["r"] == p["r"] + 1 and (q["x"] is None or p["x"] is not None and (p["x"], -(p["k"] or 0)) >= (q["x"], -(q["k"] or 0)))
    assert key(a) == key(b)


@pytest.mark.parametrize("window_rows", [1 << 20, 1])
def test_sums_in_another_order_stay_tied(spark, window_rows):
    """0.1 + 0.2 isn't 0.3 in the last bit, but as means they are tied."""
    rows = [(1, 0.3, 0), (2, 0.1 + 0.2, 0), (3, 0.2, 0), (4, None, 0)]
    df = spark.createDataFrame(rows, "entity long, equal double, grp int")
    got = ranks_of_means(df, {"r": "equal"}, window_rows=window_rows)
    assert got.columns == [*df.columns, "r"] and [r["r"] for r in got.orderBy("entity").collect()] == [1, 1, 3, 4]
    peers = robust.peers(df.select("entity", "equal"), df.select("entity", "grp"))
    assert sorted((r["entity"], r["peer_rank"]) for r in peers.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_entities_of_the_same_scores_share_a_rank_without_fills(spark):
    """The same seven scores, dealt to the pillars in other orders: one rank, with fills and without."""
    rnd = random.Random(3)
    registry = CUSTOMERS.table(spark).where("role = 'scoring'").limit(0).unionByName(
        spark.createDataFrame([(i, p, p, "scoring", "positive", "average", 9, 2000, 2001, False, [p], None, "", "") for i, p in enumerate("ABCDEFG")], CUSTOMERS.table(spark).schema)
    )
    same = [11.1, 22.2, 33.3, 44.4, 55.7, 66.1, 77.9]
    rows = [(e, 0, p, x) for e in range(40) for p, x in zip("ABCDEFG", rnd.sample(same, 7))]
    norm = spark.createDataFrame(rows, "entity long, grp int, variable_name string, norm_score double")
    none = spark.createDataFrame([], "entity long, variable_name string")
    got = robust.without_fills(norm, none, registry).collect()
    assert len(got) == 40 and {(r["rank_base"], r["rank_pure"], r["shift"]) for r in got} == {(1, 1, 0)}


def test_tasks_of_a_large_ranking_hold_few_rows(spark, monkeypatch):
    """However small its rows are in a shuffle, a large group isn't one task's."""
    from keelson.functions import ranking

    assert ranking.WINDOW_ROWS <= ranking.TASK_ROWS < 1 << 20
    monkeypatch.setattr(ranking, "TASK_ROWS", 200)
    got = ranks_desc(spark.range(4000).select("id", F.col("id").cast("double").alias("x")), {"r": "x"}, window_rows=50)
    tasks = [r["n"] for r in got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(tasks) < 1000 and sorted((r["id"], r["r"]) for r in got.collect()) == [(i, 4000 - i) for i in range(4000)]


@pytest.mark.parametrize("ties", ["min", "average"])
def test_ranks_of_many_columns_in_one_pass(spark, ties):
    """A value that holds most rows, constants, all NULL, ties across cuts; several columns at once as each alone."""
    rnd = random.Random(8)
    rows = [(k, None if k % 50 == 0 else k % 3, 7.0 if rnd.random() < 0.6 else rnd.randrange(40) / 4, 1.0, None, rnd.gauss(0, 1)) for k in range(900)]
    df = spark.createDataFrame(rows, "id int, g int, a double, b double, c double, d double")
    outs = {f"r{c}": c for c in "abcd"}
    for within in ([], ["g"]):
        want = {tuple(r) for r in ranks_desc(df, outs, within, ties).collect()}
        for w in (1, 100):
            got = ranks_desc(df, outs, within, ties, window_rows=w)
            assert got.columns == [*df.columns, *outs] and {tuple(r) for r in got.collect()} == want
            assert {(r["id"], r["ra"]) for r in ranks_desc(df, {"ra": "a"}, within, ties, window_rows=w).collect()} == {(r[0], r[6]) for r in want}


def test_four_values_of_two_kinds(spark):
    df = spark.createDataFrame([(5.0, 1), (5.0, 1), (5.0, 1), (1.0, 1)], "x double, k int")
    for w in (1, 1 << 20):
        assert sorted(r["r"] for r in ranks_desc(df, {"r": "x"}, ties="k", window_rows=w).collect()) == [1, 2, 3, 4]
        assert sorted(r["r"] for r in ranks_desc(df, {"r": "x"}, window_rows=w).collect()) == [1, 1, 1, 4]


# -- rounding ----------------------------------------------------------------------
def test_rounding_equals_pythons(spark):
    """A million values: of all sizes, ties that are exact, and numbers that only look like ties."""
    rng = np.random.default_rng(7)
    x = np.concatenate([
        rng.normal(0, 1, 300_000) * 10.0 ** rng.integers(-8, 12, 300_000), rng.integers(-(10**7), 10**7, 300_000) / 1000, (rng.integers(-(10**6), 10**6, 300_000) * 2 + 1) / 2.0 ** rng.integers(1, 8, 300_000),
        rng.integers(-(10**9), 10**9, 99_990) / 10.0**6 + 5e-7, [0.0, -0.0, 2.675, 0.125, 0.375, 1e300, -1e300, 2.0**52, 2.0**53 + 2, 5e-324],
    ])
    assert len(x) == 1_000_000
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    out = df.select("x", *[c.round_even("x", n).alias(f"r{n}") for n in range(7)]).toPandas()
    for n in range(7):
        want = np.array([round(v, n) for v in out["x"].tolist()])
        assert (out[f"r{n}"].to_numpy() == want).all(), n
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double").select(c.round_even("x", 2).alias("r")).collect()
    assert odd[0]["r"] is None and math.isnan(odd[1]["r"]) and (odd[2]["r"], odd[3]["r"]) == (math.inf, -math.inf)


def test_tiered_numbers_are_pythons_formats(spark):
    def text(v, table):
        a = abs(v)
        if a >= 10000:
            return f"{v:,.0f}"
        if a >= 100:
            return f"{v:,.1f}"
        if a >= 1:
            return f"{v:.3f}" if table else f"{v:.2f}"
        return f"{v:.4f}" if a >= 0.001 else "0" if v == 0 else f"{v:.4g}"

    rnd = random.Random(2)
    values = [rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randrange(-7, 8) for _ in range(3000)] + [25.125, 25.135, 0.00005, 1234.25, 1234.35, 10000.5, 10001.5, 99.995, 0.0, 9999.95, 0.00099999, 0.0001, 1.0, -2.5]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", c.tiered_number("v").alias("a"), c.tiered_number("v", True).alias("b")).collect()
    assert [(r["v"], r["a"], r["b"]) for r in rows if (r["a"], r["b"]) != (text(r["v"], False), text(r["v"], True))] == []


# -- rank correlations ----------------------------------------------------------------
def average_ranks(x):
    order = sorted(x, reverse=True)
    return [order.index(v) + 1 + (order.count(v) - 1) / 2 for v in x]


@pytest.mark.parametrize("pairs_at_once", [200, 2])
def test_spearman_with_gaps_and_without(spark, monkeypatch, pairs_at_once):
    monkeypatch.setattr(diagnose, "PAIRS", pairs_at_once)
    rnd = random.Random(4)
    data = {v: {e: rnd.randrange(6) + rnd.random() * (v == "E") for e in range(40) if not (v in ("d", "f") and e % 5 == 0 or v == "f" and e % 3 == 0)} for v in ("e", "E", "b", "c", "d", "f")}
    long = spark.createDataFrame([(e, v, float(x)) for v, m in data.items() for e, x in m.items()] + [(99, "b", None)], "entity long, v string, x double")
    got = {(r["a"], r["b"]): (r["n"], r["rho"]) for r in diagnose.spearman(long, "v", "x").collect()}
    assert len(got) == 15
    for (a, b), (n, rho) in got.items():
        both = [e for e in data[a] if e in data[b]]
        want = np.corrcoef(average_ranks([data[a][e] for e in both]), average_ranks([data[b][e] for e in both]))[0, 1]
        assert n == len(both) and rho == pytest.approx(want, abs=1e-12)
    flat = long.unionByName(spark.createDataFrame([(e, "g", 3.0) for e in range(40)], "entity long, v string, x double"))
    assert {r["rho"] for r in diagnose.spearman(flat, "v", "x").collect() if "g" in (r["a"], r["b"])} == {None}  # a name that doesn't vary
    some = diagnose.spearman(long, "v", "x", pairs=[("b", "c"), ("b", "none")]).collect()
    assert [(r["a"], r["b"]) for r in some] == [("b", "c")]


# -- principal components -------------------------------------------------------------
def pillar_rows(spark, values):
    return spark.createDataFrame([(e, 1, p, None if math.isnan(x) else float(x)) for e, row in enumerate(values) for p, x in zip("ABCDEFG", row)], "entity long, grp int, pillar string, score double")


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_eigenvalues_equal_numpys(spark, seed):
    rng = np.random.default_rng(seed)
    x = 50 + rng.normal(0, 5, (60, 7)) @ rng.normal(0, 1, (7, 7))
    if seed == 2:
        x[:, 3] = 4.0  # a pillar that doesn't vary correlates with none
    m = np.nan_to_num(np.corrcoef(x, rowvar=False)) if seed != 2 else np.array([[1.0 if a == b else 0.0 if 3 in (a, b) else np.corrcoef(x[:, a], x[:, b])[0, 1] for b in range(7)] for a in range(7)])
    holes = np.vstack([x, np.full((3, 7), np.nan)])
    rows = score.eigen(pillar_rows(spark, holes)).orderBy("component").collect()
    values, vectors = np.linalg.eigh(m)
    assert [r["eigenvalue"] for r in rows] == pytest.approx(values[::-1].tolist(), abs=1e-9) and {r["n"] for r in rows} == {60}
    assert [r["gap"] for r in rows[:-1]] == pytest.approx((-np.diff(values[::-1])).tolist(), abs=1e-9) and rows[-1]["gap"] is None
    for k, r in enumerate(rows):
        v = vectors[:, -1 - k]
        assert abs(np.dot(r["loadings"], v)) == pytest.approx(1, abs=1e-7) and sum(z < 0 for z in r["loadings"]) <= 3
    w, gap = score.pca_weights(pillar_rows(spark, holes))
    load = np.maximum(vectors[:, -1] * (1 if (vectors[:, -1] < 0).sum() <= 3 else -1), 0)
    assert list(w.values()) == pytest.approx((load / load.sum()).tolist(), abs=1e-9) and gap == pytest.approx(values[-1] - values[-2], abs=1e-9)


def test_no_components_without_complete_rows(spark):
    one = pillar_rows(spark, [[1, 2, 3, 4, 5, 6, float("nan")]] * 4)
    row = score.eigen(one).collect()
    assert len(row) == 1 and row[0]["eigenvalue"] is None and row[0]["n"] == 0
    assert {r["score"] for r in score.pca(one).collect()} == {None}
    with pytest.raises(ValueError):
        score.pca_weights(one)


# -- benefit of the doubt by two ways ---------------------------------------------------
def test_two_solvers_agree_and_a_wrong_one_shows(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((300, 7)) < 0.25, np.nan, np.round(rng.random((300, 7)) * 100, 1))
    x[:3] = np.nan
    p = pillar_rows(spark, x)
    both = compare.solvers(score.bod(p), score.bod_dual(p))
    rows = both.collect()
    assert len(rows) == 300 and max(abs(r["gap"]) for r in rows if r["gap"] is not None) < 1e-9 and not any(r["flipped"] for r in rows)
    assert compare.solver_summary(both).first()["status"] == "PASS"
    off = score.bod(p).withColumn("score", F.when(F.col("entity") % 50 == 7, F.col("score") - 9).otherwise(F.col("score")))
    s = compare.solver_summary(compare.solvers(off, score.bod_dual(p))).first()
    assert s["status"] == "FAIL" and s["n_off"] == 6 and s["n_flips"] >= 6 and s["max_gap"] == pytest.approx(9)


def test_bound_of_the_dual_holds_for_any_weights(spark):
    """Weak duality, by hand: no weights within the bounds score above the dual."""
    rng = np.random.default_rng(6)
    x = rng.random((20, 7)) * 100
    bound = {r["entity"]: r["score"] for r in score.bod_dual(pillar_rows(spark, x)).collect()}
    w = np.array([v for v in rng.dirichlet(np.ones(7) * 3, 20_000) if v.min() >= 0.05 and v.max() <= 0.25])
    best = (x @ w.T).max(axis=1)
    assert len(w) > 100 and all(best[e] <= b + 1e-9 and best[e] > b - 10 for e, b in bound.items())


# -- methods that fail -------------------------------------------------------------------
def test_any_failure_of_a_method_is_nulls(spark):
    p = pillar_rows(spark, np.random.default_rng(0).random((12, 7)) * 100)

    def at_once(pillars, params):
        raise KeyError("no such thing")

    def when_run(pillars, params):
        return pillars.groupBy("entity").agg(F.max("score").alias("score")).withColumn("score", F.raise_error(F.lit("broke")).cast("double"))

    with pytest.warns(UserWarning, match="KeyError"):
        got = score.all_scores(p, methods={"equal": score.equal, "bad": at_once, "worse": when_run}).collect()
    assert len(got) == 12 and all(r["equal"] is not None and r["bad"] is None and r["worse"] is None for r in got)


def test_a_failure_of_a_built_in_method_is_no_result(spark, monkeypatch):
    """Its NULLs would look like scores that can't be computed, and every rank would follow from them."""
    p = pillar_rows(spark, np.random.default_rng(0).random((12, 7)) * 100)

    def full(df):
        raise OSError("no space left on device")

    monkeypatch.setattr(score, "kept", full)
    with pytest.raises(OSError, match="no space"):
        score.all_scores(p)
    r = Run(p, spark.createDataFrame([(e, 1) for e in range(12)], "entity long, grp int"), CUSTOMERS)
    r.__dict__["pillars"] = p
    with pytest.raises(OSError, match="no space"):
        r.ranks(METHODS)


def test_rows_name_the_methods_that_failed(spark):
    p = pillar_rows(spark, np.random.default_rng(0).random((12, 7)) * 100)

    def bad(pillars, params):
        raise KeyError("no such thing")

    with pytest.warns(UserWarning, match="KeyError"):
        got = score.all_scores(p, methods={"bad": bad, "equal": score.equal}).collect()
    assert len(got) == 12 and all(r["failed"] == ["bad"] and r["bad"] is None and r["equal"] is not None for r in got)
    assert {tuple(r["failed"]) for r in score.all_scores(p, methods={"equal": score.equal}).collect()} == {()}


# -- audits ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def run(spark):
    return Run.customers(spark, DATA)


def stored(run, folder, damage=lambda nested: nested, cut=None):
    ranks = run.ranks(METHODS)
    nested = serve.bundle(ranks, run.pillars, run.norm, run.fill_log, run.quality, robust.bands(ranks, run.quality), robust.peers(ranks, run.entities), METHODS).drop("sort_key")
    lines = serve.documents(damage(nested))
    if cut:
        lines = lines.withColumn("document", F.when(F.col("entity") == cut, F.expr("left(document, 40)")).otherwise(F.col("document")))
    lines.select("document").write.mode("overwrite").text(folder)
    docs = files.read_documents(run.spark, folder, nested.schema)
    again = audit.recomputed_numbers(run.pillars, run.norm, run.fill_log, run.entities, run.scores(METHODS), len(run.definitions.indicators), METHODS)
    return {r["section"]: r for r in audit.of_documents(docs, again, METHODS).collect()}


def test_documents_pass_their_audit(run, tmp_path):
    got = stored(run, f"file://{tmp_path}/d")
    assert set(got) == {"scores", "ranks", "pillars", "indicators", "quality", "bands", "peers", "documents"}
    assert {r["status"] for r in got.values()} == {"PASS"} and all(r["n_off"] == r["n_missing"] == 0 and r["n"] > 0 for r in got.values())
    assert 0 < got["scores"]["max_diff"] <= 0.005 and got["ranks"]["max_diff"] == 0


def test_one_damaged_number_fails_its_section_only(run, tmp_path):
    one = F.col("entity") == 7
    with_ = lambda column, field, change: lambda n: n.withColumn(column, F.when(one, F.col(column).withField(field, change(F.col(f"{column}.{field}")))).otherwise(F.col(column)))
    cases = {
        "scores": with_("scores", "bod", lambda x: x + 0.2), "bands": with_("band", "high", lambda x: x - 3), "peers": with_("peers", "peer_rank", lambda x: x + 1),
        "quality": with_("data_quality", "n_filled", lambda x: x + 1),
        "pillars": lambda n: n.withColumn("pillars", F.when(one, F.map_filter("pillars", lambda k, v: k != "B")).otherwise(F.col("pillars"))),
    }
    for section, damage in cases.items():
        got = stored(run, f"file://{tmp_path}/{section}", damage)
        assert [s for s, r in got.items() if r["status"] != "PASS"] == [section]
        assert got[section]["n_off"] + got[section]["n_missing"] == 1 and got[section]["status"] == "FAIL"


def test_a_cut_line_is_missing_everywhere(run, tmp_path):
    got = stored(run, f"file://{tmp_path}/cut", cut=7)
    assert got["documents"]["status"] == "FAIL" and got["documents"]["n_missing"] == 1
    assert all(r["status"] == "FAIL" and r["n_missing"] > 0 and r["n_off"] == 0 for r in got.values())
    doc = json.loads(audit.report_document(run.spark.createDataFrame(list(got.values()))).first()["document"])
    assert (doc["n_pass"], doc["n_fail"]) == (0, 8) and [s["section"] for s in doc["sections"]] == sorted(got)


# -- shared runs --------------------------------------------------------------------------
def test_a_folder_whose_files_change_is_read_anew(spark, tmp_path):
    import shutil
    import time

    for t in ("orders", "lineitem", "customer"):
        shutil.copy(f"{DATA}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    at = f"file://{tmp_path}"
    first, before = Run.customers(spark, at), stamp(spark, f"{at}/orders.parquet")
    n = first.obs.count()
    assert Run.customers(spark, at) is first
    fewer = spark.read.parquet(f"{DATA}/orders.parquet").where("o_custkey % 2 = 0").toPandas()
    time.sleep(1.1)
    fewer.to_parquet(f"{tmp_path}/orders.parquet", coerce_timestamps="us")
    assert stamp(spark, f"{at}/orders.parquet") != before
    assert Run.customers(spark, at) is not first and Run.customers(spark, at).obs.count() < n
    forget()
    assert Run.customers(spark, at) is not first
