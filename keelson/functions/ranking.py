"""Ranks and order statistics over whole tables.

Groups of up to WINDOW_ROWS rows are ranked by a plain window. Larger ones are cut into buckets by approximate quantiles: a
window ranks inside each bucket, and the sizes of the buckets before it are added. Where every row has a place of its own,
rows are sorted by sampled splitters and numbered where they lie. Quantiles count the distinct values of such
groups in the same way. Results are the same either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.sources.tables import kept

WINDOW_ROWS = 1 << 17
#: Rows that a task of several buckets gets at most, about: Spark would merge small buckets by their bytes in a shuffle, and rows take many times that in a sort.
TASK_ROWS = 1 << 19
#: Buckets of distinct values: as many as keep them well below WINDOW_ROWS, within this bound.
MOST_BUCKETS = 4096


def _largest(df: DataFrame, within: list[str]) -> int:
    return (df.groupBy(*within).count().agg(F.max("count")).first()[0] or 0) if within else df.count()


def counted(values: DataFrame, by: str, within: list[str], then: list[str], window_rows: int) -> DataFrame:
    """Distinct values with counts (*within, by, *then, n) get ``before``: the rows of the group with a larger value.

    NULL comes after all values; ``then`` orders equal ones.
    """
    buckets = min(MOST_BUCKETS, max(2, -(-4 * values.count() // window_rows)))
    probs = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    splits = values.groupBy(*within).agg(F.percentile_approx(by, probs, F.lit(10000)).alias("_splits"))
    same = lambda a, b, cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    keyed = values.alias("d").join(splits.alias("s"), same("d", "s", within)).select("d.*", "_splits") if within else values.crossJoin(F.broadcast(splits))  # one row
    above = F.size(F.filter(F.coalesce("_splits", F.array().cast("array<double>")), lambda s: s.cast("double") > F.col(by).cast("double")))
    keyed = keyed.withColumn("_bucket", F.when(F.col(by).isNull(), F.lit(buckets + 1)).otherwise(above)).drop("_splits")
    sizes = keyed.groupBy(*within, "_bucket").agg(F.sum("n").alias("_n"))
    # As many rows a group as there are buckets.
    sizes = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(*within).orderBy("_bucket")) - F.col("_n")).drop("_n")
    both = keyed.alias("k").join(sizes.alias("z"), same("k", "z", [*within, "_bucket"])).select("k.*", "_before")
    inside = Window.partitionBy(*within, "_bucket").orderBy(F.col(by).desc_nulls_last(), *then)
    return both.withColumn("before", F.col("_before") + F.sum("n").over(inside) - F.col("n")).drop("_before", "_bucket")


def _by_parts(df: DataFrame, outs: dict[str, str], within: list[str], ties: str, window_rows: int) -> DataFrame:
    """Ranks of all columns in one shuffle by (group, column, bucket of values).

    Approximate quantiles cut the values of each large group into buckets; a window ranks inside a bucket, and the rows of the
    buckets before it are added. A value that two cuts or more fall on has a bucket of its own: its rows share one rank, which
    is known without sorting, so they stay where they are, however many they are. So do NULLs, the last bucket.
    """
    rows = kept(df.withColumn("_rid", F.monotonically_increasing_id()))
    one, carried = len(outs) == 1, df.columns if len(outs) == 1 else []
    named = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.col(by).cast("double").alias("x")) for o, by in outs.items()])).alias("_v")
    long = rows.select("_rid", F.struct(*within, F.lit(0).alias("_")).alias("_w"), *carried, named)
    long = long.select("_rid", *carried, F.struct("_w", F.col("_v.o").alias("o")).alias("_g"), F.col("_v.x").alias("_x"))
    n = kept(long.groupBy("_g").agg(F.count(F.lit(1)).alias("n")))
    big, most = n.where(F.col("n") > window_rows).select("_g"), n.agg(F.max("n")).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(2, -(-4 * most // window_rows)))
    probs = F.array(*[F.lit(k / buckets) for k in range(1, buckets)])
    large = skew.large_keys(n, ["_g"], n.agg(F.sum("n")).first()[0] or 0)
    cuts = kept(skew.join(long.select("_g", "_x"), big, ["_g"], large).groupBy("_g").agg(F.percentile_approx("_x", probs, F.lit(10000)).alias("_cuts")))
    cut = skew.join(long, cuts, ["_g"], large, "left").withColumn("_cuts", F.coalesce("_cuts", F.array().cast("array<double>")))
    x = F.col("_x")
    above, on = F.size(F.filter("_cuts", lambda v: v > x)), F.size(F.filter("_cuts", lambda v: v == x))
    # Of the values with as many cuts above, the one that cuts fall on is the least.
    cut = cut.withColumn("_b", F.when(x.isNull(), F.lit(2 * MOST_BUCKETS + 1)).otherwise(2 * above + (on >= 2).cast("int"))).drop("_cuts")
    sizes = kept(cut.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("n")))
    # As many rows a group as there are buckets.
    before = (F.sum("n").over(Window.partitionBy("_g").orderBy("_b")) - F.col("n")).alias("_before")
    total = n.agg(F.sum("n")).first()[0] or 0
    both = skew.join(cut, sizes.select("_g", "_b", before, F.col("n").alias("_n")), ["_g", "_b"], skew.large_keys(sizes, ["_g", "_b"], total))
    part, alike = Window.partitionBy("_g", "_b"), F.col("_b") % 2 == 1
    place = {"min": F.col("_before") + 1, "average": F.col("_before") + (F.col("_n") + 1) / 2.0}[ties]
    inside = F.col("_before") + F.rank().over(part.orderBy(x.desc()))
    inside = inside + (F.count(F.lit(1)).over(Window.partitionBy("_g", "_b", "_x")) - 1) / 2.0 if ties == "average" else inside
    kind = "double" if ties == "average" else "int"
    keep = ["_rid", *carried, "_g"]
    others = both.where(~alike).repartition(-(-total // TASK_ROWS) or 1, "_g", "_b")
    ranked = both.where(alike).select(*keep, place.cast(kind).alias("_r")).unionByName(others.withColumn("_r", inside.cast(kind)).select(*keep, "_r"))
    if one:
        return ranked.select(*carried, F.col("_r").alias(next(iter(outs))))
    side = ranked.groupBy("_rid").agg(*[F.max(F.when(F.col("_g.o") == o, F.col("_r"))).alias(o) for o in outs])
    return rows.join(side, "_rid").drop("_rid")


def numbered(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Adds ``_number``, 0, 1, ... in the order of ``keys``, without a task that has all rows.

    Sampled splitters part the rows and each part is sorted; then a part needs the number of rows before it, one number a part.
    """
    sorted_ = kept(df.withColumn("_any", F.monotonically_increasing_id()).orderBy(*keys, "_any").drop("_any").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, offset = 0, {}
    for p, n in sorted((r[0], r[1]) for r in sorted_.groupBy(part.alias("p")).count().collect()):
        offset[p], before = before, before + n
    start = df.sparkSession.createDataFrame(list(offset.items()), "_part long, _before long")
    both = sorted_.withColumn("_part", part).join(F.broadcast(start), "_part")
    return both.withColumn("_number", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


def _by_position(df: DataFrame, by: str, out: str, within: list[str], tie: str) -> DataFrame:
    """A row's own place: its number in the order of all rows, less that of the first of its group."""
    rows = kept(numbered(df, *within, F.col(by).desc_nulls_last(), tie))
    if not within:
        return rows.withColumn(out, (F.col("_number") + 1).cast("int")).drop("_number")
    key = F.struct(*within).alias("_key")
    first = kept(rows.groupBy(key).agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("n")))
    both = skew.join(rows.withColumn("_key", key), first.drop("n"), ["_key"], skew.large_keys(first, ["_key"], df.count()))
    return both.withColumn(out, (F.col("_number") - F.col("_first") + 1).cast("int")).drop("_key", "_number", "_first")


def ranks_desc(df: DataFrame, outs: dict[str, str], within: list[str] | None = None, ties: str = "min", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Adds ranks {name: column}, largest first, NULL after all values, inside each group of the columns ``within``.

    ``ties``: "min" (competition rank; all NULLs share n + 1), "average", or the name of a column that breaks ties: every
    row has a number of its own, also of rows that are equal in both. ``window_rows`` chooses the plan and nothing else.
    The input is written and its groups are counted while the plan is made.
    """
    within, df = within or [], kept(df)
    if _largest(df, within) > window_rows:
        if ties in ("min", "average"):
            return _by_parts(df, outs, within, ties, window_rows)
        for out, by in outs.items():
            df = _by_position(df, by, out, within, ties)
        return df
    group = Window.partitionBy(*within)
    for out, by in outs.items():
        order = [F.col(by).desc_nulls_last(), *([] if ties in ("min", "average") else [ties])]
        place: Column = F.rank().over(group.orderBy(*order)) if ties in ("min", "average") else F.row_number().over(group.orderBy(*order))
        if ties == "average":
            place = place + (F.count(F.lit(1)).over(Window.partitionBy(*within, by)) - 1) / 2.0
        df = df.withColumn(out, place if ties == "average" else place.cast("int"))
    return df


def rank_desc(df: DataFrame, by: str, out: str, within: list[str] | None = None, ties: str = "min", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """One rank: see ``ranks_desc``."""
    return ranks_desc(df, {out: by}, within, ties, window_rows)


def ranks_of_means(df: DataFrame, outs: dict[str, str], within: list[str] | None = None, ties: str = "min", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """``ranks_desc`` of columns to nine places: sums of the same numbers in another order differ in the last bit, which must not part what is tied."""
    near = {out: f"_near_{out}" for out in outs}
    rows = df.select("*", *[F.round(by, 9).alias(near[out]) for out, by in outs.items()])
    return ranks_desc(rows, near, within, ties, window_rows).drop(*near.values())


def quantiles(df: DataFrame, value: str, group: str, probs: dict[str, float], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(group, a column per name): exact quantiles with linear interpolation, over the values there are."""
    if _largest(df.where(F.col(value).isNotNull()), [group]) <= window_rows:
        return df.groupBy(group).agg(*[F.percentile(value, F.lit(p)).alias(c) for c, p in probs.items()])
    values = kept(df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n")))
    total = values.groupBy(group).agg(F.sum("n").alias("_all"))
    at = counted(values, value, [group], [], window_rows).join(total, group)
    # Rows with a smaller value: _all - before - n. A value holds the places from there on.
    low = F.col("_all") - F.col("before") - F.col("n")
    place = {c: (F.col("_all") - 1) * F.lit(p) for c, p in probs.items()}
    holds = lambda k: F.max(F.when((low <= k) & (k < low + F.col("n")), F.col(value)))
    found = at.groupBy(group).agg(
        F.max("_all").alias("_all"), *[holds(F.floor(place[c])).alias(f"_{c}_low") for c in probs], *[holds(F.ceil(place[c])).alias(f"_{c}_high") for c in probs]
    )
    mixed = lambda c: F.col(f"_{c}_low") * (F.floor(place[c]) + 1 - place[c]) + F.col(f"_{c}_high") * (place[c] - F.floor(place[c]))
    return df.select(group).distinct().join(found.select(group, *[mixed(c).alias(c) for c in probs]), group, "left")
