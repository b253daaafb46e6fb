"""The indicator registry: declarative entries, their validation, and tables made of them.

A registry is immutable; adding, removing or editing gives a new one, validated as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from keelson.schema import AGGREGATIONS, DATABASES, DEFAULT, POLARITIES, ROLES, SOURCES

#: Weights per pillar; each profile sums to 1.
WEIGHT_PRESETS = {
    "equal": {p: 1 / 7 for p in "ABCDEFG"},
    "security_focus": {"A": 0.20, "B": 0.10, "C": 0.10, "D": 0.10, "E": 0.30, "F": 0.10, "G": 0.10},
    "governance_focus": {"A": 0.25, "B": 0.15, "C": 0.10, "D": 0.10, "E": 0.20, "F": 0.10, "G": 0.10},
    "my_weights": {"A": 0.20, "B": 0.10, "C": 0.15, "D": 0.20, "E": 0.15, "F": 0.10, "G": 0.10},
}


@dataclass(frozen=True)
class Indicator:
    variable_name: str
    pillars: tuple[str, ...]
    aggregation: str
    year_start: int
    year_end: int
    display_name: str = ""
    polarity: str = "positive"
    role: str = "scoring"
    log_transform: bool = False
    source: str = "manual"
    series_code: str = ""
    database: str = ""
    #: A ratio: the value over that of this indicator, times 1000.
    denominator: str | None = None


@dataclass(frozen=True)
class Registry:
    indicators: tuple[Indicator, ...] = ()
    pillars: dict[str, float] = field(default_factory=lambda: dict(WEIGHT_PRESETS["equal"]))

    # -- changes -----------------------------------------------------------
    def add(self, indicator: Indicator) -> Registry:
        return replace(self, indicators=(*self.indicators, indicator)).checked()

    def remove(self, name: str) -> Registry:
        if name not in self.names:
            raise KeyError(name)
        return replace(self, indicators=tuple(i for i in self.indicators if i.variable_name != name)).checked()

    def edit(self, name: str, **changes) -> Registry:
        if name not in self.names:
            raise KeyError(name)
        return replace(self, indicators=tuple(replace(i, **changes) if i.variable_name == name else i for i in self.indicators)).checked()

    def with_pillars(self, weights: dict[str, float]) -> Registry:
        return replace(self, pillars=dict(weights)).checked()

    # -- queries -----------------------------------------------------------
    @property
    def names(self) -> list[str]:
        return [i.variable_name for i in self.indicators]

    def by(self, pillar: str | None = None, role: str | None = None, database: str | None = None) -> list[Indicator]:
        return [
            i
            for i in self.indicators
            if (pillar is None or pillar in i.pillars) and (role is None or i.role == role) and (database is None or i.database == database)
        ]

    def errors(self, has_file: Callable[[str], bool] | None = None) -> list[tuple[str, str]]:
        """(indicator, what is wrong), every rule in one pass; ``has_file`` tells whether the file of a manual source is there."""
        out = []
        for i in self.indicators:
            bad = lambda what, i=i: out.append((i.variable_name, what))
            for name, value, allowed in (
                ("role", i.role, ROLES), ("polarity", i.polarity, POLARITIES), ("aggregation", i.aggregation, AGGREGATIONS), ("source", i.source, SOURCES),
            ):
                if value not in allowed:
                    bad(f"{name} {value!r} is not one of {sorted(allowed)}")
            if not i.variable_name:
                bad("variable_name is empty")
            if not i.pillars:
                bad("pillars is empty")
            for p in i.pillars:
                if p not in self.pillars:
                    bad(f"unknown pillar {p!r}")
            if not all(isinstance(y, int) and not isinstance(y, bool) for y in (i.year_start, i.year_end)):
                bad("years must be integers")
            elif i.year_start > i.year_end:
                bad("year_start is after year_end")
            if not isinstance(i.log_transform, bool):
                bad("log_transform must be a boolean")
            if i.source == "manual" and has_file and not has_file(i.series_code):
                bad(f"no file {i.series_code!r}")
            if i.source != "manual":
                if "." not in i.series_code:
                    bad(f"series code {i.series_code!r} has no dot")
                if i.database not in DATABASES:
                    bad(f"database {i.database!r} is not one of {sorted(DATABASES)}")
            if i.denominator and i.denominator not in self.names:
                bad(f"unknown denominator {i.denominator!r}")
        for name in sorted({n for n in self.names if self.names.count(n) > 1}):
            out.append((name, "duplicate variable_name"))
        if abs(sum(self.pillars.values()) - 1) > 1e-9:
            out.append(("pillars", "weights don't sum to 1"))
        return out

    def checked(self) -> Registry:
        if bad := self.errors():
            raise ValueError("; ".join(f"{n}: {w}" for n, w in bad))
        return self

    def pull_window(self, lookback: int = DEFAULT.lookback_years) -> dict[str, tuple[int, int]]:
        """For each database, the years to fetch: the earliest start less the lookback, to the latest end."""
        out: dict[str, tuple[int, int]] = {}
        for i in self.indicators:
            low, high = out.get(i.database, (9999, 0))
            out[i.database] = (min(low, i.year_start - lookback), max(high, i.year_end))
        return out

    # -- tables ------------------------------------------------------------
    def table(self, spark: SparkSession) -> DataFrame:
        """One row per indicator; ``k`` is how many of the latest values its aggregation averages."""
        rows = [
            (n, i.variable_name, i.display_name or i.variable_name, i.role, i.polarity, i.aggregation, AGGREGATIONS[i.aggregation], i.year_start, i.year_end,
             i.log_transform, list(i.pillars), i.denominator, i.source, i.database)
            for n, i in enumerate(self.indicators)
        ]
        return spark.createDataFrame(
            rows,
            "ord int, variable_name string, display_name string, role string, polarity string, aggregation string, k int, year_start int, year_end int, "
            "log_transform boolean, pillars array<string>, denominator string, source string, database string",
        )


def load(*paths: str) -> Registry:
    """A registry from JSON or YAML files, each a list of entries; an entry of a known name adds its pillars."""
    known = {f.name for f in fields(Indicator)}
    found: dict[str, dict] = {}
    for path in sorted(paths):
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith(".json"):
            entries = json.loads(text)
        else:
            import yaml  # optional

            entries = yaml.safe_load(text)
        for e in entries or []:
            have = found.setdefault(e["variable_name"], {k: v for k, v in e.items() if k in known})
            have["pillars"] = tuple(dict.fromkeys([*have.get("pillars", ()), *e.get("pillars", ())]))
    return Registry(tuple(Indicator(**e) for e in found.values())).checked()


def _i(name, pillars, aggregation, y0, y1, polarity="positive", log=False, role="scoring", denominator=None) -> Indicator:
    return Indicator(name, tuple(pillars), aggregation, y0, y1, name.replace("_", " ").title(), polarity, role, log, denominator=denominator)


#: Indicators of customers by the year of their orders, over the driver's tables.
CUSTOMERS = Registry(
    (
        _i("order_value", "A", "average_recent_3", 1998, 2001, log=True),
        _i("order_count", "AB", "average", 1998, 2001),
        _i("urgent_value", "B", "most_recent", 2000, 2001),
        _i("urgent_pending", "C", "most_recent", 2000, 2001, "negative", True),
        _i("discount_rate", "C", "average_recent_5", 1998, 2001, "negative"),
        _i("returned_qty", "D", "most_recent", 2000, 2001, "negative", True, denominator="item_volume"),
        _i("item_volume", "D", "most_recent", 2000, 2001, role="descriptive"),
        _i("tax_rate", "D", "average", 1998, 2001, "negative"),
        _i("mean_qty", "E", "average_recent_3", 1998, 2001),
        _i("open_share", "E", "most_recent", 2000, 2001, "negative"),
        _i("final_value", "F", "most_recent", 2001, 2001, log=True),
        _i("low_prio_share", "F", "average", 1998, 2001, "negative"),
        _i("supplier_span", "G", "most_recent", 2000, 2001),
    )
).checked()
