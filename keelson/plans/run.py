"""A scoring run: tables that are computed when first used.

Those with several readers (observations, filled cells, normalised and pillar scores) are written
once; the rest stays lazy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.operators import clean, normalize, robust, score
from keelson.registry import CUSTOMERS, Registry
from keelson.schema import DEFAULT, Params
from keelson.sources import panel
from keelson.sources.tables import kept


#: Places of scores by method, 8 if not said: an eigenvector is found by iteration, and entropies lose places as they are taken from 1.
PLACES = {"pca": 6, "entropy": 6}
_panels: dict[tuple, DataFrame] = {}
_runs: dict[tuple, Run] = {}


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: a table that changes has another."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, out = p.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    return spark.sparkContext.applicationId, sf_dir, *[stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "customer")]


def customer_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel of a folder, written once for all runs of an application over the same files; ``forget`` makes the next run read anew."""
    key = _key(spark, sf_dir)
    if key not in _panels:
        _panels[key] = kept(panel.customer_panel(spark, sf_dir))
    return _panels[key]


def forget() -> None:
    _panels.clear()
    _runs.clear()


class Run:
    """From observations and an entity table to scores. Every property is a DataFrame; what several readers follow is written when it is first used."""

    def __init__(self, obs: DataFrame | Callable[[], DataFrame], entities: DataFrame, registry: Registry, params: Params = DEFAULT):
        """``obs`` may be a function: it is called when observations are first needed."""
        self.spark: SparkSession = entities.sparkSession
        self._obs, self.entities, self.params, self.definitions = obs, entities, params, registry
        self.registry = registry.table(self.spark)
        self._made: dict[tuple, DataFrame] = {}

    @classmethod
    def customers(cls, spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> Run:
        """The run of a folder: its written tables are shared by all queries of an application, while the folder's files are the same."""
        key = (*_key(spark, sf_dir), params)
        if key not in _runs:
            _runs[key] = cls(lambda: customer_panel(spark, sf_dir), panel.customers(spark, sf_dir), CUSTOMERS, params)
        return _runs[key]

    @cached_property
    def obs(self) -> DataFrame:
        return self._obs() if callable(self._obs) else self._obs

    @cached_property
    def aggregated(self) -> DataFrame:
        return clean.aggregate(self.obs, self.registry, self.params)

    @cached_property
    def derived(self) -> DataFrame:
        return clean.derive_ratios(self.aggregated, self.registry)

    @cached_property
    def grid(self) -> DataFrame:
        return clean.grid(self.entities, self.registry, self.derived)

    @cached_property
    def filled(self) -> DataFrame:
        return kept(clean.regional_fill(self.grid, self.params))

    @cached_property
    def fill_log(self) -> DataFrame:
        return clean.fill_log(self.filled)

    @cached_property
    def fences(self) -> DataFrame:
        return clean.fences(self.filled, self.params)

    @cached_property
    def cells(self) -> DataFrame:
        return clean.winsorised(self.filled, self.fences)

    @cached_property
    def norm(self) -> DataFrame:
        return kept(normalize.normalised(self.cells, self.registry, self.params))

    @cached_property
    def pillars(self) -> DataFrame:
        return kept(score.pillar_scores(self.norm, self.registry))

    @cached_property
    def quality(self) -> DataFrame:
        return robust.fill_counts(self.fill_log, self.entities, len(self.definitions.indicators))

    def scores(self, methods: list[str]) -> DataFrame:
        """Scores by method, to PLACES: ranks must not depend on the order of a sum. All of a set of methods are written when first used."""
        if (key := ("scores", *methods)) not in self._made:
            found = score.all_scores(self.pillars, self.params, {m: score.METHODS[m] for m in methods})
            self._made[key] = kept(found.select("entity", *[F.round(m, PLACES.get(m, 8)).alias(m) for m in methods]))
        return self._made[key]

    def ranks(self, methods: list[str]) -> DataFrame:
        if (key := ("ranks", *methods)) not in self._made:
            self._made[key] = kept(score.ranked(self.scores(methods), methods))
        return self._made[key]

    def check(self) -> Run:
        """Stops here if a pillar lacks data."""
        clean.gate(clean.pillar_null_rate(self.cells, self.registry), self.params)
        return self
