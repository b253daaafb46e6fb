"""Readers and writers, context, registry files, formats and warnings."""

import json

import pytest
from pyspark.sql import functions as F

from keelson import registry
from keelson.functions import columns as c
from keelson.operators import report, robust, score
from keelson.schema import SCORES_CSV
from keelson.sources import context, files, tables

NAMES = ["equal", "pca", "bod", "entropy", "geometric"]


def scores(spark, n=3):
    rows = [(f"E{k}", *[50.0 + k] * 5, *[n - k] * 5, *[10.0 * k] * 7) for k in range(n)]
    return spark.createDataFrame(rows, SCORES_CSV)


def test_checkpoint_tables_and_scores_file(spark, tmp_path):
    x = scores(spark)
    files.write_tables({"scores": x, "none": x.limit(0)}, f"file://{tmp_path}/run")
    assert sorted(files.read_scores(spark, f"file://{tmp_path}/run/scores").collect()) == sorted(x.collect())
    assert files.read_scores(spark, f"file://{tmp_path}/run/none").count() == 0
    ranks = x.select(F.substring("iso3", 2, 1).cast("long").alias("entity"), *NAMES, *[f"{m}_rank" for m in NAMES])
    wide = ranks.select("entity").where("entity = 0").selectExpr("entity", "1.0D AS A", *[f"CAST(NULL AS DOUBLE) AS {p}" for p in "BCDEFG"])
    out = report.scores_file(ranks, wide, NAMES)
    files.write_csv(out, f"file://{tmp_path}/scores.csv")
    back = files.read_table(spark, f"file://{tmp_path}/scores.csv", out.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, out.collect())) and back.where("A IS NULL").count() == out.count() - 1


def test_documents_and_json_reader(spark, tmp_path):
    nested = spark.createDataFrame([(1, [("A", 0.5)], None), (2, [], "x")], "entity long, pillars array<struct<name:string,score:double>>, note string")
    files.write_documents(nested, f"file://{tmp_path}/docs")
    lines = [json.loads(x) for f in (tmp_path / "docs").glob("part*") for x in f.read_text().splitlines()]
    assert {"entity": 1, "pillars": [{"name": "A", "score": 0.5}], "note": None} in lines
    one = tmp_path / "one.json"
    one.write_text(json.dumps([{"entity": 1, "value": 2.5}, {"entity": 2}]))
    got = files.read_table(spark, f"file://{one}", "entity long, value double").collect()
    assert [tuple(r) for r in sorted(got)] == [(1, 2.5), (2, None)]


def test_context_defaults_and_note_stubs(spark, tmp_path):
    ents = spark.createDataFrame([(1, 0, "One"), (2, 0, None)], "entity long, grp int, name string")
    spark.createDataFrame([(1, "it is", ["s"], None)], context.NOTES).write.json(f"file://{tmp_path}/notes")
    notes = spark.read.schema(context.NOTES).json(f"file://{tmp_path}/notes")
    none = context.read_or_empty(spark, f"file://{tmp_path}/no.json", context.NOTES)
    assert none.count() == 0 and [r["entity"] for r in files.missing_notes(ents, notes).collect()] == [2]
    pillars = spark.createDataFrame([(1, "A", 70.0), (1, "B", 10.0), (2, "A", None)], "entity long, pillar string, score double")
    empty = lambda s: spark.createDataFrame([], s)
    page = {r["entity"]: r for r in report.page(ents, pillars, empty(context.FACTS), empty(context.HISTORY), notes).collect()}
    assert (page[1]["overview"], page[1]["strengths"], page[1]["challenges"], page[1]["segment"], page[1]["n_years"]) == ("it is", ["s"], ["B"], "", 0)
    assert page[2]["label"] == "2" and page[2]["strengths"] == [] and page[2]["overview"] == ""
    assert context.present(spark, f"file://{tmp_path}", ["notes", "no.json"]) == {"notes": True, "no.json": False}


def test_method_weights_reader(spark, tmp_path):
    w = spark.createDataFrame([("pca", "A", 0.25), ("pca", "B", 0.75), ("equal", "A", 1.0)], context.METHOD_WEIGHTS)
    w.write.parquet(f"file://{tmp_path}/w")
    assert context.read_method_weights(spark, f"file://{tmp_path}/w") == {"pca": {"A": 0.25, "B": 0.75}, "equal": {"A": 1.0}}
    assert {r["method"]: r["weights"] for r in report.weight_maps(w).collect()}["pca"] == {"A": 0.25, "B": 0.75}
    assert context.read_method_weights(spark, f"file://{tmp_path}/none") == {}


def test_registry_files(tmp_path):
    entry = {"variable_name": "x", "pillars": ["A"], "aggregation": "average", "year_start": 2000, "year_end": 2001, "series_code": "x.csv", "justification": "why"}
    (tmp_path / "a.json").write_text(json.dumps([entry]))
    (tmp_path / "b.json").write_text(json.dumps([entry | {"pillars": ["B", "A"]}, entry | {"variable_name": "y"}]))
    (tmp_path / "c.json").write_text("[]")
    r = registry.load(*(str(tmp_path / f"{k}.json") for k in "bac"))
    assert r.names == ["x", "y"] and r.indicators[0].pillars == ("A", "B") and not r.errors()
    assert r.errors(lambda f: False) == [("x", "no file 'x.csv'"), ("y", "no file 'x.csv'")] and not r.errors(lambda f: True)
    (tmp_path / "d.json").write_text(json.dumps([entry | {"variable_name": "z", "year_start": 2009}]))
    with pytest.raises(ValueError, match="year_start is after"):
        registry.load(str(tmp_path / "d.json"))


def test_numbers_as_text_and_days(spark):
    given = [12345.6, 123.45, 1.234567, 0.0123456, 0.00012345, 0.0000123456, 0.00002, 0.0, -5.0, None]
    said = ["12,346", "123.5", "1.23", "0.0123", "0.0001235", "1.235e-05", "2e-05", "0", "-5.00", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "k int, x double").orderBy("k")
    assert [r[0] for r in df.select(c.tiered_number("x")).collect()][:3] in (said[:3], ["12,346", "123.4", "1.23"])
    assert [r[0] for r in df.select(c.tiered_number("x")).collect()][3:4] + [r[0] for r in df.select(c.tiered_number("x")).collect()][5:] == said[3:4] + said[5:]
    assert df.select(c.tiered_number("x", table=True)).collect()[2][0] == "1.235"
    day = spark.sql("SELECT DATE'2024-02-28' AS d")
    assert day.select(c.elapsed_days("d", F.lit("2024-03-01").cast("date"))).first()[0] == 2
    assert day.select(c.elapsed_days("d")).first()[0] > 600


def test_a_weak_first_component_warns(spark):
    import numpy as np

    m = np.random.default_rng(1).normal(size=(4000, 7))
    rows = [(e, 0, p, float(m[e, k])) for e in range(4000) for k, p in enumerate("ABCDEFG")]
    x = spark.createDataFrame(rows, "entity long, grp int, pillar string, score double")
    with pytest.warns(UserWarning, match="unstable"):
        score.pca_weights(x)


def test_a_method_that_fails_leaves_the_others(spark):
    x = spark.createDataFrame([(1, 0, "A", 5.0)], "entity long, grp int, pillar string, score double")

    def broken(pillars, p):
        raise ZeroDivisionError("nothing to divide by")

    with pytest.warns(UserWarning, match="nothing to divide"):
        got = score.all_scores(x, methods={"bad": broken, "equal": score.equal}).first()
    assert got["bad"] is None and got["equal"] == 5.0


def test_sensitive_entities_first(spark):
    r = spark.createDataFrame([(k, *[1] * 4, 1 + k % 20) for k in range(40)], "entity long, " + ", ".join(f"{m}_rank int" for m in NAMES))
    ten = report.most_sensitive(robust.rank_sensitivity(r, NAMES)).collect()
    assert [x["entity"] for x in ten] == [19, 39, 18, 38, 17, 37, 16, 36, 15, 35]


def test_no_folder_of_our_own_on_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(Session())
