"""The series source, pulls that go on, versions of tables, ordered files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from keelson.operators import compare
from keelson.registry import CUSTOMERS
from keelson.sources import files, series
from keelson.sources.series import Series
from keelson.sources.versions import Versions
from keelson.streaming import revisions


def answers(options, code, y0, y1):
    """A service for tests: what it is asked is left in a folder, one file a call."""
    if options.get("log"):
        n = len(os.listdir(options["log"]))
        with open(f"{options['log']}/{code}-{os.getpid()}-{n}", "w") as f:
            json.dump([code, y0, y1], f)
    if code in options.get("down", "").split(","):
        raise OSError("404 not found")
    if code == "none":
        return []
    return [("AAA", y, float(y)) for y in range(y0, y1 + 1)] + [("BBB", y1, None)]


FETCH = "tests.test_sources:answers"
ASK = [Series("x", "a.x", 2000, 2009), Series("y", "a.y", 2005, 2007), Series("z", "none", 2000, 2001)]


def asked(folder):
    return sorted(json.load(open(f"{folder}/{n}")) for n in os.listdir(folder))


def test_years_and_names_are_pushed_to_the_source(spark, tmp_path):
    os.mkdir(tmp_path / "log")
    df = series.scan(spark, ASK, FETCH, log=str(tmp_path / "log"))
    narrow = df.where("year >= 2006 AND year < 2008 AND variable_name IN ('x', 'y')")
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.replace("PushedFilters", "") or "year" not in plan.split("Filter", 1)[1].split("\n")[0]
    assert sorted((r["variable_name"], r["key"], r["year"]) for r in narrow.collect()) == [("x", "AAA", 2006), ("x", "AAA", 2007), ("x", "BBB", 2007), ("y", "AAA", 2006), ("y", "AAA", 2007), ("y", "BBB", 2007)]
    # one partition a series, and the service was asked for these years only
    assert asked(tmp_path / "log") == [["a.x", 2006, 2007], ["a.y", 2006, 2007]]
    assert narrow.rdd.getNumPartitions() == 2
    assert df.where("year = 2001").count() == 2 and df.where("year > 2009").count() == 0
    assert {(r["variable_name"], r["status"]) for r in df.collect()} == {("x", "OK"), ("y", "OK"), ("z", "EMPTY")}
    assert df.count() == 16 and df.where("year > 2009").count() == 0 and df.count() == 16  # what one query pushed is not the next one's
    assert df.where("key = 'BBB' AND value IS NULL").count() == 2 and df.where("year = 2005 AND value > 2004").count() == 2


def test_reader_gives_back_what_it_does_not_take(spark):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, StringStartsWith

    r = series.SeriesReader({"series": json.dumps([vars(s) for s in ASK]), "fetch": FETCH})
    left = [EqualTo(("key",), "AAA"), StringStartsWith(("variable_name",), "x"), IsNotNull(("value",)), EqualTo(("year",), "text")]
    taken = [GreaterThan(("year",), 2003), LessThanOrEqual(("year",), 2006), In(("variable_name",), ("x", "z")), EqualTo(("variable_name",), "x"), IsNotNull(("year",)), IsNotNull(("variable_name",))]
    assert list(r.pushFilters([*left, *taken])) == left
    assert [(p.series.variable_name, p.series.y0, p.series.y1) for p in r.partitions()] == [("x", 2004, 2006)]


def test_failures_stop_a_scan_or_are_rows(spark):
    with pytest.raises(Exception, match="404"):
        series.scan(spark, ASK, FETCH, down="a.x").count()
    rows = series.scan(spark, ASK, FETCH, down="a.x", failures="rows").where("status = 'FAILED'").collect()
    assert [(r["variable_name"], r["error"], r["value"]) for r in rows] == [("x", "OSError: 404 not found", None)]


def test_a_second_pull_asks_for_what_failed_and_what_is_new(spark, tmp_path):
    store, logs = Versions(spark, f"file://{tmp_path}/store"), [tmp_path / f"log{k}" for k in range(4)]
    for d in logs:
        os.mkdir(d)
    first = series.pull(spark, ASK, FETCH, store, log=str(logs[0]), down="a.x,a.y", firstwait=0)
    assert {(r["variable_name"], r["status"], r["n_obs"]) for r in first.collect()} == {("x", "FAILED", 0), ("y", "FAILED", 0), ("z", "EMPTY", 0)}
    assert series.summary(first).first().asDict() == {"n": 3, "n_ok": 0, "n_empty": 1, "n_failed": 2, "n_obs": 0, "n_attempts": 3}
    series.pull(spark, ASK, FETCH, store, log=str(logs[1]), down="a.y")
    assert asked(logs[1]) == [["a.x", 2000, 2009], ["a.y", 2005, 2007]]
    more = [*ASK, Series("w", "a.w", 2001, 2001)]
    third = series.pull(spark, more, FETCH, store, log=str(logs[2]))
    assert asked(logs[2]) == [["a.w", 2001, 2001], ["a.y", 2005, 2007]]
    assert series.pull(spark, more, FETCH, store, log=str(logs[3])).count() == third.count() == 7 and asked(logs[3]) == []
    assert len(store.entries()) == 3
    last = {r["variable_name"]: (r["attempt"], r["status"], r["n_attempts"]) for r in series.latest(third).collect()}
    assert last == {"x": (2, "OK", 2), "y": (3, "OK", 3), "z": (1, "EMPTY", 1), "w": (3, "OK", 1)}
    assert series.observations(store).count() == 10 + 3 + 1
    # another code under the same name is another series
    assert [r["series_code"] for r in series.pending(spark.createDataFrame([("x", "b.x")], "variable_name string, series_code string"), series.log_of(store)).collect()] == ["b.x"]


def test_retries(spark):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("502 bad gateway")
        return [1]

    assert series.with_retries(flaky, sleep=waits.append) == [1] and waits == [15.0, 30.0]
    with pytest.raises(OSError):
        series.with_retries(lambda: (_ for _ in ()).throw(OSError("404")), sleep=waits.append)
    with pytest.raises(OSError):
        series.with_retries(lambda: (_ for _ in ()).throw(OSError("timed out")), tries=2, sleep=waits.append)
    assert waits == [15.0, 30.0, 15.0, 30.0]
    window = CUSTOMERS.pull_window()[""]
    assert {(s.y0, s.y1) for s in series.of_registry(CUSTOMERS)} == {window} and len(series.of_registry(CUSTOMERS)) == len(CUSTOMERS.names)


def test_a_service_of_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", 2000, "1.5"), ("a", "2", 2001, None), ("b", "1", 2000, "no number"), ("a", "3", 1990, "2")], "variable_name string, key string, year int, value string")
    series.export(rows, f"file://{tmp_path}/s")
    got = series.scan(spark, [Series(n, n, 1999, 2005) for n in ("a", "b", "c")], "keelson.sources.series:from_folder", root=f"file://{tmp_path}/s", failures="rows").collect()
    assert sorted((r["variable_name"], r["key"], r["year"], r["value"], r["status"]) for r in got if r["status"] == "OK") == [("a", "1", 2000, 1.5, "OK"), ("a", "2", 2001, None, "OK")]
    assert sorted((r["variable_name"], r["error"].split(":")[0]) for r in got if r["status"] == "FAILED") == [("b", "ValueError"), ("c", "FileNotFoundError")]


def many(options, code, y0, y1):
    """A long answer, row by row; a service that dies in the middle of one, or sends what is no number."""
    for i in range(int(options["rows"])):
        if code == "dies" and i == 15000:
            raise OSError("connection reset")
        yield f"key {i:06d}", y0, "words" if code == "words" and i == 15000 else i


def test_a_long_answer_is_whole_but_never_in_memory_at_once(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(series, "HELD_BYTES", 1 << 19)

    def read(code, n):
        r = series.SeriesReader({"series": "[]", "fetch": "tests.test_sources:many", "rows": str(n), "failures": "rows"})
        return r.read(series.SeriesPartition(Series("x", code, 2000, 2001)))

    peaks = []
    for n in (100_000, 300_000):
        tracemalloc.start()
        rows = read("long", n)
        assert sum(r[4] for r in rows) == n * (n - 1) / 2
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]
    # no row of an answer that isn't whole is handed on
    for code, error in (("dies", "OSError"), ("words", "ValueError")):
        assert [(r[2], r[5], r[6].split(":")[0]) for r in read(code, 40_000)] == [(None, "FAILED", error)]


def test_pages_are_read_line_by_line(tmp_path):
    """A page as large as a task's memory is no list; what only Python takes for a line's end stays in its line."""
    import tracemalloc

    peaks = []
    for n in (50_000, 200_000):
        os.makedirs(tmp_path / str(n) / "variable_name=a")
        with open(tmp_path / str(n) / "variable_name=a" / "part-0.json", "w", encoding="utf-8") as f:
            for i in range(n):
                f.write(json.dumps({"key": f"k\u2028{i}", "year": 2000, "value": "1.5"}, ensure_ascii=False) + "\n")
        tracemalloc.start()
        assert sum(1 for k, y, v in series.from_folder({"root": f"file://{tmp_path}/{n}"}, "a", 2000, 2000) if k.startswith("k\u2028") and v == "1.5") == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


# -- versions -----------------------------------------------------------------
def test_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    with pytest.raises(LookupError):
        v.read()
    a, b = spark.range(3).withColumn("x", F.lit("a")), spark.range(5).withColumn("y", F.lit(1.5))
    assert (v.commit(a, "first"), v.commit(b)) == (1, 2)
    assert v.read(1).columns == ["id", "x"] and v.read().count() == 5 and [(e["version"], e["n_rows"], e["note"]) for e in v.entries()] == [(1, 3, "first"), (2, 5, "")]
    with pytest.raises(LookupError):
        v.read(3)
    assert sorted(v.frozen(b).collect()) == sorted(a.collect())


def test_a_write_that_died_is_no_version(spark, tmp_path):
    """Data without a manifest, a manifest cut in the middle, an empty one, and one of nobody's: none of them is read, and their numbers stay taken."""
    v = Versions(spark, f"file://{tmp_path}/v")
    os.makedirs(tmp_path / "v" / "data" / "dead" / "_temporary")
    os.makedirs(tmp_path / "v" / "manifest")
    spark.range(9).write.parquet(f"file://{tmp_path}/v/data/orphan")
    (tmp_path / "v" / "manifest" / "00000001.json").write_text('{"version": 1, "path": "data/orphan", "sch')
    (tmp_path / "v" / "manifest" / "00000002.json").write_text("")
    assert v.entries() == []
    assert v.commit(spark.range(4)) == 3 and v.read().count() == 4
    # of two writers with one number the second takes the next
    assert v._create(3, {"path": "x", "schema": "", "n_rows": 0, "note": ""}) is False
    v._numbers = lambda: [2]
    assert v.commit(spark.range(6)) == 4 and v.read(3).count() == 4 and v.read(4).count() == 6


def test_a_baseline_is_the_first_whole_one(spark, tmp_path):
    df = spark.range(7).withColumn("v", F.lit(1.0))
    os.makedirs(tmp_path / "base" / "_temporary")
    first = files.freeze(df, f"file://{tmp_path}/base")
    assert first.count() == 7 and files.freeze(df.limit(2), f"file://{tmp_path}/base").count() == 7


def test_drift_between_versions(spark, tmp_path):
    v = Versions(spark, f"file://{tmp_path}/v")
    rows = lambda x: spark.createDataFrame(x, "k long, value double")
    a, b = v.commit(rows([(1, 1.0), (2, 2.0), (3, None)])), v.commit(rows([(1, 1.0), (2, 2.5), (4, 4.0)]))
    drift = compare.outer(v.read(a), v.read(b), ["k"]).where("status <> 'both'")
    assert {(r["k"], r["status"]) for r in drift.collect()} == {(2, "changed"), (3, "left_only"), (4, "right_only")}


# -- ordered files ------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 5000])
def test_ordered_files_keep_their_order(spark, tmp_path, n):
    df = spark.range(n).selectExpr("id", "CAST(pmod(hash(id), 97) AS double) AS s").repartition(5)
    files.write_ordered(df, f"file://{tmp_path}/o{n}", F.col("s").desc(), "id")
    got = files.read_ordered(spark, f"file://{tmp_path}/o{n}", df.schema).orderBy("position").collect()
    want = sorted(((-r["s"], r["id"]) for r in df.collect()))
    assert [(-r["s"], r["id"]) for r in got] == want and [r["position"] for r in got] == list(range(1, n + 1))


# -- streams ------------------------------------------------------------------
def test_late_rows_are_dropped_and_closed_windows_handed_on_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    batch = lambda k, rows: spark.createDataFrame([(i, t, 1, "a", v) for i, t, v in rows], "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "CAST(t AS timestamp) AS ts", "user_id", "event_type", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b{k}")
    out, state = f"{tmp_path}/out", f"{tmp_path}/state"
    got = lambda: sorted((str(r["window_start"])[:10], r["n"], r["total"]) for r in spark.read.parquet(f"{out}/*").collect())
    run = lambda: revisions.run_windows(revisions.windowed_sums(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")), out, state)
    batch(0, [(1, "2024-01-01 10:00:00", 1.0), (2, "2024-01-01 11:00:00", 2.0), (3, "2024-01-05 09:00:00", 4.0)])
    run()
    assert got() == [("2024-01-01", 2, 3.0)]  # the watermark is at the 3rd: the 1st is closed, the 5th is open
    batch(1, [(4, "2024-01-01 12:00:00", 8.0), (5, "2024-01-05 10:00:00", 16.0), (6, "2024-01-09 00:00:00", 32.0)])
    run()
    assert got() == [("2024-01-01", 2, 3.0), ("2024-01-05", 2, 20.0)]  # the late row changes nothing
