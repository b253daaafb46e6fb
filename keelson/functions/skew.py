"""Joins in which one key may hold a third of all rows.

Keys of more than 1 / PIECES of the rows are few, whatever the table: fewer than PIECES. Their rows are dealt to as many
parts as they have such shares, and the other side's rows of these keys are copied to each part, at most 2 * PIECES copies
for a side that has one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = 1000
_PART, _PARTS = "_part", "_parts"


def large_keys(counts: DataFrame, key: list[str], total: int, pieces: int | None = None) -> DataFrame:
    """(*key, _parts) of the keys with more than their share of ``total`` rows, from (*key, n).

    The keys come to the driver, fewer than ``pieces``, and go out again as a small table.
    """
    share = max(1, total // (pieces or PIECES))
    named = counts.select(*key, F.ceil(F.col("n") / F.lit(share)).cast("int").alias(_PARTS)).where(F.col("n") > share)
    return counts.sparkSession.createDataFrame(named.collect(), named.schema)


def dealt(rows: DataFrame, key: list[str], large: DataFrame) -> DataFrame:
    """Adds ``_parts`` (0: not a large key) and ``_part``, in turn: other columns may be null or repeat."""
    both = rows.join(F.broadcast(large), key, "left").withColumn(_PARTS, F.coalesce(_PARTS, F.lit(0)))
    return both.withColumn(_PART, F.pmod(F.monotonically_increasing_id(), F.greatest(_PARTS, F.lit(1))).cast("int"))


def copied(rows: DataFrame, key: list[str], large: DataFrame) -> DataFrame:
    """Adds ``_part``: rows of large keys are there once for each part."""
    both = rows.join(F.broadcast(large), key, "left")
    parts = F.sequence(F.lit(0), F.coalesce(F.col(_PARTS), F.lit(1)) - 1)
    return both.withColumn(_PART, F.explode(parts)).drop(_PARTS)


def join(left: DataFrame, right: DataFrame, key: list[str], large: DataFrame, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, by columns of the same names; ``how``: inner or left."""
    return dealt(left, key, large).drop(_PARTS).join(copied(right, key, large), [*key, _PART], how).drop(_PART)
