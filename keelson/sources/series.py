"""Series behind a service as a Spark data source, and pulls that go on where the last one ended.

One partition is one series, so tasks fetch side by side and a lost executor repeats its own series only. The years a
query asks for are pushed down as a filter: they narrow what each series is asked for, and names of series prune
partitions. What talks to the service is a function named by an option, ``module:function``, called as
``fetch(options, series_code, y0, y1)``; it gives (key, year, value) rows, values as numbers or text.
"""

from __future__ import annotations

import importlib
import io
import json
import pickle
import tempfile
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from typing import IO

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from keelson.functions.columns import no_nan
from keelson.registry import Registry
from keelson.sources.versions import Versions

FORMAT = "keelson_series"
#: Server answers worth another try.
RETRY_ON = ("502", "504", "524", "timed out", "timeout")
OK, EMPTY, FAILED = "OK", "EMPTY", "FAILED"
#: Rows of an answer that a task holds at a time, and the bytes that it holds before they go to its disk.
CHUNK, HELD_BYTES = 5000, 8 << 20
ROWS = "variable_name string, series_code string, key string, year int, value double, status string, error string, seconds double"


@dataclass(frozen=True)
class Series:
    """What is asked for: a series under the name it gets, and its years."""

    variable_name: str
    series_code: str
    y0: int
    y1: int


def with_retries(fetch: Callable, tries: int = 3, first_wait: float = 15.0, sleep: Callable[[float], None] = time.sleep):
    """``fetch()``; again after 15, 30, 60 seconds for server errors that pass."""
    for n in range(tries + 1):
        try:
            return fetch()
        except Exception as e:  # noqa: BLE001
            if n == tries or not any(x in str(e).lower() for x in RETRY_ON):
                raise
            sleep(first_wait * 2**n)
    return []


def chunks(held: IO[bytes]) -> Iterator[list]:
    """Lists of rows, as they were written one after another."""
    while True:
        try:
            yield pickle.load(held)
        except EOFError:
            return


def named(function: str) -> Callable:
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


@dataclass
class SeriesPartition(InputPartition):
    series: Series

    def __init__(self, series: Series):
        super().__init__(series.series_code)
        self.series = series


class SeriesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.series = [Series(**s) for s in json.loads(options["series"])]
        self.low, self.high, self.names, self.only_values = -(1 << 31), (1 << 31) - 1, None, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of ``year`` and names of series are dealt with here and exactly; the rest goes back to Spark."""
        for f in filters:
            column, value = f.attribute, getattr(f, "value", None)
            if column == ("year",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and isinstance(value, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value - isinstance(f, LessThan))
                self.only_values = True
            elif column in (("year",), ("value",), ("key",)) and isinstance(f, IsNotNull):
                # Rows of values have a year; whether one has a key or a number is for Spark to see.
                self.only_values = True
                if column != ("year",):
                    yield f
            elif column == ("variable_name",) and isinstance(f, (EqualTo, In)):
                these = {value} if isinstance(f, EqualTo) else set(value)
                self.names = these if self.names is None else self.names & these
            elif column == ("variable_name",) and isinstance(f, IsNotNull):
                continue
            else:
                yield f

    def partitions(self) -> list[SeriesPartition]:
        asked = [Series(s.variable_name, s.series_code, max(s.y0, self.low), min(s.y1, self.high)) for s in self.series if self.names is None or s.variable_name in self.names]
        # Where only values are asked for, a series without years to fetch has none.
        return [SeriesPartition(s) for s in asked if s.y0 <= s.y1 or not self.only_values]

    def read(self, partition: SeriesPartition | None) -> Iterator[tuple]:
        if partition is None:  # Spark asks once where there are no partitions
            return
        s, began = partition.series, time.time()
        keep = self.options.get("failures", "raise") == "rows"
        try:
            held, bad = with_retries(lambda: self._held(s), int(self.options.get("tries", 3)), float(self.options.get("firstwait", 15)))
            if bad:
                held.close()
                raise bad
        except Exception as e:  # noqa: BLE001
            if not keep:
                raise
            yield s.variable_name, s.series_code, None, None, None, FAILED, f"{type(e).__name__}: {e}"[:200], time.time() - began
            return
        took, empty = time.time() - began, True
        with held:
            for rows in chunks(held):
                empty = False
                for k, y, v in rows:
                    yield s.variable_name, s.series_code, k, y, v, OK, None, took
        if empty and not self.only_values:
            yield s.variable_name, s.series_code, None, None, None, EMPTY, None, took

    def _held(self, s: Series) -> tuple[IO[bytes], Exception | None]:
        """The rows of a series in a file of this task, and what is no row, if anything is.

        An answer counts once it is whole, so no row is handed on before the last one came; but only a chunk of it is in memory.
        """
        held = tempfile.SpooledTemporaryFile(HELD_BYTES)
        try:
            rows = []
            for answer in named(self.options["fetch"])(self.options, s.series_code, s.y0, s.y1):
                try:
                    k, y, v = answer
                    y, v = int(y), None if v is None else float(v)
                except (TypeError, ValueError) as bad:
                    return held, bad
                if s.y0 <= y <= s.y1:
                    rows.append((k, y, v))
                if len(rows) == CHUNK:
                    pickle.dump(rows, held)
                    rows = []
            if rows:
                pickle.dump(rows, held)
        except BaseException:
            held.close()
            raise
        held.seek(0)
        return held, None


class SeriesSource(DataSource):
    """Options: ``series`` (JSON of Series), ``fetch``, ``tries``, ``firstwait`` seconds, ``failures``: "raise", or "rows" that say what failed; others are for ``fetch``.

    A series without rows is one row with status EMPTY, unless the query asks for values.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> SeriesReader:
        return SeriesReader(self.options)


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("keelson_series")`` known to a session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SeriesSource)


def scan(spark: SparkSession, series: list[Series], fetch: str, **options) -> DataFrame:
    """Rows of ``ROWS``, lazily: a filter on ``year`` or ``variable_name`` reaches the service."""
    register(spark)
    reader = spark.read.format(FORMAT).option("series", json.dumps([asdict(s) for s in series])).option("fetch", fetch)
    for k, v in options.items():
        reader = reader.option(k, v)
    # Spark keeps what the last query pushed into a loaded table, and a query that pushes nothing would read under it. Every
    # row has a name, so this filter drops none; it makes each query push filters of its own.
    return reader.load().where("variable_name IS NOT NULL")


def of_registry(registry: Registry) -> list[Series]:
    """A series for every indicator, over the years its database is asked for: the earliest start less the lookback, to the latest end."""
    window = registry.pull_window()
    return [Series(i.variable_name, i.series_code or i.variable_name, *window[i.database]) for i in registry.indicators]


# -- pulls that go on ---------------------------------------------------------
def log_of(store: Versions) -> DataFrame:
    """(variable_name, series_code, attempt, status, error, n_obs, n_entities, seconds): every attempt at every series, of committed pulls."""
    rows = store.read_all("attempt", ROWS)
    return rows.groupBy("variable_name", "series_code", "attempt").agg(
        F.max("status").alias("status"), F.max("error").alias("error"), F.count("value").alias("n_obs"), F.count_distinct("key").alias("n_entities"), F.max("seconds").alias("seconds")
    )


def latest(log: DataFrame) -> DataFrame:
    """The last attempt at each series."""
    last = F.max_by(F.struct("series_code", "attempt", "status", "error", "n_obs", "n_entities"), "attempt")
    return log.groupBy("variable_name").agg(last.alias("x"), F.count(F.lit(1)).alias("n_attempts")).select("variable_name", "x.*", "n_attempts")


def pending(series: DataFrame, log: DataFrame) -> DataFrame:
    """Series to ask for: those never answered, by name and code. What failed last is asked for again, what was empty isn't."""
    done = latest(log).where(F.col("status") != FAILED).select("variable_name", "series_code")
    return series.join(done, ["variable_name", "series_code"], "left_anti")


def pull(spark: SparkSession, series: list[Series], fetch: str, store: Versions, **options) -> DataFrame:
    """One attempt at all that is pending; returns the log. The definitions of series are a short list, and so are those that are pending.

    What a pull brought is committed as one version, its failures with it: a pull that dies leaves nothing, and the next asks anew.
    """
    table = spark.createDataFrame([tuple(asdict(s).values()) for s in series], "variable_name string, series_code string, y0 int, y1 int")
    ask = [Series(**r.asDict()) for r in pending(table, log_of(store)).collect()]
    if ask:
        rows = scan(spark, ask, fetch, **{"failures": "rows"} | options)
        store.commit(rows.withColumn("value", no_nan("value")), note=f"{len(ask)} series")
    return log_of(store)


def observations(store: Versions) -> DataFrame:
    """(key, variable_name, year, value) of the last attempt that succeeded, for each series."""
    rows = store.read_all("attempt", ROWS).where(f"status = '{OK}' AND value IS NOT NULL")
    newest = Window.partitionBy("variable_name", "key", "year").orderBy(F.col("attempt").desc())
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("key", "variable_name", "year", "value")


def summary(log: DataFrame) -> DataFrame:
    """Counts of the last attempts by status."""
    status = lambda s: F.count_if(F.col("status") == s)
    return latest(log).agg(
        F.count(F.lit(1)).alias("n"), status(OK).alias("n_ok"), status(EMPTY).alias("n_empty"), status(FAILED).alias("n_failed"), F.coalesce(F.sum("n_obs"), F.lit(0)).alias("n_obs"),
        F.coalesce(F.sum("n_attempts"), F.lit(0)).alias("n_attempts"),
    )


# -- a service of files -------------------------------------------------------
def export(long: DataFrame, root: str) -> None:
    """Writes (variable_name, key, year, value) as the answers that ``from_folder`` reads: a folder of JSON lines for each series."""
    long.select("variable_name", "key", "year", "value").write.mode("overwrite").partitionBy("variable_name").option("ignoreNullFields", False).json(root)


def from_folder(options: dict, series_code: str, y0: int, y1: int) -> Iterator[tuple[str, int, float | str]]:
    """Answers out of a folder, page by page and line by line; a series without one is not known there."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(options["root"])
    folder = f"{path.rstrip('/')}/variable_name={series_code}"
    for page in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.path):
        if page.base_name.startswith("part-"):
            with store.open_input_stream(page.path, buffer_size=1 << 20) as f:
                for line in io.TextIOWrapper(f, encoding="utf-8", newline="\n"):
                    r = json.loads(line)
                    if y0 <= r["year"] <= y1:
                        yield r["key"], r["year"], r["value"]
