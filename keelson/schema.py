"""Table schemas, enumerations and parameters. Missing is NULL everywhere, never NaN."""

from __future__ import annotations

from dataclasses import dataclass

#: Enumerations and, in Params, thresholds that results depend on.
ROLES = ("scoring", "descriptive")
POLARITIES = ("positive", "negative")
AGGREGATIONS = {"most_recent": 1, "average_recent_3": 3, "average_recent_5": 5, "average": 1 << 30}
SOURCES = ("wb_api", "wb_api_wgi", "manual")
DATABASES = ("wdi", "wgi")
METHODS = ("equal", "pca", "bod", "entropy", "geometric")

OBSERVATIONS = "entity long, grp int, variable_name string, year int, value double"
RAW = "iso3 string, variable_name string, year int, value double"
SCORES_CSV = (
    "iso3 string, equal double, pca double, bod double, entropy double, geometric double, equal_rank int, pca_rank int, "
    "bod_rank int, entropy_rank int, geometric_rank int, A double, B double, C double, D double, E double, F double, G double"
)


@dataclass(frozen=True)
class Params:
    """Settings of a scoring run."""

    lookback_years: int = 5
    min_peers: int = 3
    iqr_multiplier: float = 2.0
    weight_min: float = 0.05
    weight_max: float = 0.25
    tight_min: float = 0.07
    tight_max: float = 0.20
    floor: float = 1e-8
    min_eigengap: float = 0.1
    min_alpha: float = 0.60
    max_pillar_null_rate: float = 0.30
    sparse_below: float = 0.75
    very_sparse_below: float = 0.50
    norm_digits: int | None = 4  # None: scores stay unrounded
    pillars: tuple[str, ...] = ("A", "B", "C", "D", "E", "F", "G")


DEFAULT = Params()
