"""Sharding by minimax contiguous partition.

Documents with equal texts form a group that is never cut. Groups are put in the
order of their digests; the smallest shard capacity that lets a greedy walk finish
in the given number of shards is found by binary search. One large group alone may
set that capacity, so the order is not cut where the walk cuts: of all cuts that keep
to the capacity, those with the least sum of squared shard sizes are taken, by a
dynamic programme.

The search needs running sums only. Digests are uniform, so their first digits deal
the groups into buckets of like size; a bucket's running sum is a window inside the
bucket and the buckets' own sums are few. What the driver searches is a list of
units: runs of neighbouring groups of one bucket. Taken as whole they give a capacity
that is feasible, taken as divisible at will one that is not too large. While the two differ, the units
that a cut may fall into are asked for again, in finer units, until they are single groups
or the two capacities meet: the capacity is exact, and about UNITS numbers come to the driver
at a time, whatever the input.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.staging import documents, materialise

SHARDS = 40
OVERHEAD = 16
UNITS = 65536
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets
SALTS = 64


def walk(ends: np.ndarray, single: np.ndarray, capacity: int, shards: int, divide: bool) -> tuple[bool, list[int]]:
    """A greedy walk over running sums: whether it gets to the end, and where it stops on the way.

    With ``divide``, a stop may lie inside a unit that is not a single group.
    """
    stops, at, total = [], 0, int(ends[-1])
    for _ in range(shards):
        target = at + capacity
        if target >= total:
            return True, stops
        k = int(np.searchsorted(ends, target, side="right"))
        stop = target if divide and not single[k] else int(ends[k - 1]) if k else 0
        if stop <= at:
            return False, stops
        at = stop
        stops.append(at)
    return False, stops


def smallest(ends: np.ndarray, single: np.ndarray, low: int, shards: int, divide: bool) -> int:
    """The smallest capacity, from ``low``, that the walk gets to the end with."""
    high = int(ends[-1])
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if walk(ends, single, mid, shards, divide)[0] else (mid + 1, high)
    return low


def between(ends: np.ndarray, single: np.ndarray, largest: int, shards: int) -> tuple[int, int]:
    """Bounds of the smallest capacity for groups of which units are known; ``largest`` is the largest group."""
    low = smallest(ends, single, max(largest, -(-int(ends[-1]) // shards)), shards, divide=True)
    return low, smallest(ends, single, low, shards, divide=False)


def undecided(ends: np.ndarray, single: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Indices of the units inside which a stop of the walk may lie, for a capacity from ``low`` to ``high``."""
    first, last = walk(ends, single, low, shards, divide=False)[1], walk(ends, single, high, shards, divide=True)[1]
    hit = np.zeros(len(ends), dtype=bool)
    for k, end in enumerate(last):
        # A walk of whole units that is stuck stays where it is.
        begin = first[min(k, len(first) - 1)] if first else 0
        hit[np.searchsorted(ends, begin, side="right") : np.searchsorted(ends, end) + 1] = True
    return np.flatnonzero(hit & ~single)


def layer(best: np.ndarray, at: int, ends: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row i: the least best[j - at] + (ends[i] - ends[j])^2 over first <= j <= last, and the first such j.

    Rows, first and last rise. The best j rises with i, so the rows between two known ones look
    between these two's only.
    """
    cost, choice = np.empty(len(rows)), np.empty(len(rows), dtype=np.int64)
    step = 1 << len(rows).bit_length() >> 1
    while step:
        r = np.arange(step - 1, len(rows), 2 * step)
        a, b = first[r], last[r]
        has_left, has_right = r >= step, r + step < len(rows)
        a[has_left] = np.maximum(a[has_left], choice[r[has_left] - step])
        b[has_right] = np.minimum(b[has_right], choice[r[has_right] + step])
        n = b - a + 1
        begin = np.cumsum(n) - n
        j = np.arange(int(n.sum())) - np.repeat(begin - a, n)
        value = best[j - at] + (np.repeat(ends[rows[r]], n) - ends[j]).astype(np.float64) ** 2
        least = np.minimum.reduceat(value, begin)
        hit = np.flatnonzero(value == np.repeat(least, n))
        cost[r], choice[r] = least, j[hit[np.searchsorted(hit, begin)]]
        step >>= 1
    return cost, choice


def even_cuts(sizes: np.ndarray, shards: int, capacity: int) -> list[int]:
    """Running sums to cut at: no shard above ``capacity``, and the least sum of squares of shard sizes.

    The capacity must be feasible. As many shards are used as there are groups for.
    """
    ends = np.concatenate(([0], np.cumsum(sizes)))
    n, shards = len(sizes), min(shards, len(sizes))
    # Cut k lies where k shards can reach from the front, and the others from the end.
    reach, back = [0], [n]
    for _ in range(shards):
        reach.append(int(np.searchsorted(ends, ends[reach[-1]] + capacity, side="right")) - 1)
        back.append(int(np.searchsorted(ends, ends[back[-1]] - capacity)))
    low = [max(k, back[shards - k]) for k in range(shards + 1)]
    high = [min(n - (shards - k), reach[k]) for k in range(shards + 1)]
    low[0] = high[0] = 0
    best, choices = np.zeros(1), []
    for k in range(1, shards + 1):
        rows = np.arange(low[k], high[k] + 1)
        first = np.maximum(np.searchsorted(ends, ends[rows] - capacity), low[k - 1])
        best, choice = layer(best, low[k - 1], ends, rows, first, np.minimum(rows - 1, high[k - 1]))
        choices.append(choice)
    at, cuts = n, []
    for k in range(shards, 1, -1):
        at = int(choices[k - 1][at - low[k]])
        cuts.append(int(ends[at]))
    return cuts[::-1]


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity for contiguous shards, and the running sums to cut at."""
    if not len(sizes):
        return 0, []
    single = np.ones(len(sizes), dtype=bool)
    capacity = between(np.cumsum(sizes), single, int(sizes.max()), shards)[1]
    return capacity, even_cuts(sizes, shards, capacity)


#: Units as rows: bucket, running sum in the bucket before and after, rows, running rows after, groups.
_UNIT = ["_bucket", "b0", "b1", "rows", "n1", "groups"]


def in_units(groups: DataFrame) -> DataFrame:
    """Runs of neighbouring groups inside the stretch of a bucket that begins ``_from``, cut where their running sum passes a multiple of ``_width``.

    The first group of a stretch is a unit of its own, so each stretch of several groups is parted, whatever their sizes. Units
    of two stretches are never one, though their numbers may be the same.
    """
    begin = F.col("_b_end") - F.col("_group_b")
    unit = F.when(begin == F.col("_from"), -1).otherwise(F.floor((F.col("_b_end") - 1) / F.col("_width"))).cast("long")
    return groups.groupBy("_bucket", "_from", unit.alias("_u")).agg(
        F.min(F.col("_b_end") - F.col("_group_b")).alias("b0"), F.max("_b_end").alias("b1"), F.sum("_group_n").alias("rows"),
        F.max("_n_end").alias("n1"), F.count(F.lit(1)).alias("groups"),
    )


def units_of(groups: DataFrame, shards: int, units: int) -> tuple[int, list[tuple]]:
    """The smallest feasible capacity, and the units that it is known by."""
    total, largest = groups.agg(F.sum("_group_b"), F.max("_group_b")).first()
    if not total:
        return 0, []
    whole = groups.withColumns({"_from": F.lit(0).cast("long"), "_width": F.lit(max(1, total // units)).cast("long")})
    rows = sorted(tuple(r) for r in in_units(whole).select(*_UNIT).collect())
    while True:
        ends = np.cumsum([r[2] - r[1] for r in rows])
        single = np.array([r[5] == 1 for r in rows])
        low, high = between(ends, single, largest, shards)
        if low == high:
            return high, rows
        # Finer, and not more rows at once than the first time; at least in halves.
        open_ = undecided(ends, single, low, high, shards)
        parts = max(2, units // len(open_))
        finer = [(rows[k][0], rows[k][1], rows[k][2], max(1, (rows[k][2] - rows[k][1]) // parts)) for k in open_]
        asked = groups.sparkSession.createDataFrame(finer, "_bucket int, _from long, _to long, _width long")
        inside = groups.join(F.broadcast(asked), "_bucket").where("_b_end > _from AND _b_end <= _to")
        known = set(open_.tolist())
        rows = sorted([r for k, r in enumerate(rows) if k not in known] + [tuple(r) for r in in_units(inside).select(*_UNIT).collect()])


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, units: int = UNITS) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    Null texts count as empty ones: size 16, one group. Slots are gapless in a shard,
    by digest and identifier; rows that repeat an identifier get slots of their own.
    Null identifiers come first. Fewer groups than shards leave shards empty. An empty table gives an empty one.
    Texts may be of any length. Other columns are ignored. ``units``: about how many numbers the driver searches at a time.
    """
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = materialise(
        docs.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.sha2(body, 256).alias("_digest"),
        ).withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    )
    # A large group is counted in SALTS parts, so no task gets all its rows.
    cells = rows.groupBy("_digest", "_salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    by_group = Window.partitionBy("_digest")
    cells = cells.withColumn("_in_group", F.sum("n").over(by_group.orderBy("_salt")) - F.col("n"))
    cells = cells.withColumn("_group_n", F.sum("n").over(by_group)).withColumn("_group_b", F.sum("b").over(by_group))
    first = F.col("_in_group") == 0
    bucket = F.conv(F.substring("_digest", 1, BUCKET_DIGITS), 16, 10).cast("int")
    run = Window.partitionBy("_bucket").orderBy("_digest", "_salt")
    cells = materialise(
        cells.withColumn("_bucket", bucket)
        .withColumn("_b_end", F.sum(F.when(first, F.col("_group_b")).otherwise(0)).over(run))
        .withColumn("_n_end", F.sum(F.when(first, F.col("_group_n")).otherwise(0)).over(run))
        .select("_digest", "_salt", "_bucket", "_in_group", "_group_n", "_group_b", "_b_end", "_n_end")
    )
    groups = cells.where(first)
    capacity, known = units_of(groups.select("_bucket", "_b_end", "_group_b", "_group_n", "_n_end"), shards, units)
    sizes, counts = np.array([r[2] - r[1] for r in known], dtype=np.int64), np.array([r[3] for r in known], dtype=np.int64)
    cuts = even_cuts(sizes, shards, capacity) if known else []
    ends, rows_to = np.cumsum(sizes), np.cumsum(counts)
    n_before = [0] + [int(rows_to[np.searchsorted(ends, c)]) for c in cuts]
    offsets = {}
    for (b, *_), e, s, n, m in zip(known, ends, sizes, rows_to, counts):
        offsets.setdefault(b, (int(e - s), int(n - m)))
    at = docs.sparkSession.createDataFrame([(b, *o) for b, o in offsets.items()], "_bucket int, _b_off long, _n_off long")
    placed = cells.join(F.broadcast(at), "_bucket")  # 4096 rows at most
    end = F.col("_b_end") + F.col("_b_off")
    no = F.lit(0)
    for c in cuts:
        no = no + (end > F.lit(c)).cast("int")
    placed = placed.withColumn("shard", no.cast("int"))
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in n_before]), F.col("shard") + 1)
    placed = placed.withColumn("_first_slot", F.col("_n_off") + F.col("_n_end") - F.col("_group_n") - base + F.col("_in_group"))
    out = rows.join(placed.select("_digest", "_salt", "shard", "_first_slot"), ["_digest", "_salt"])
    nth = F.row_number().over(Window.partitionBy("_digest", "_salt").orderBy("_id")) - 1
    return out.withColumn("slot", (F.col("_first_slot") + nth).cast("long")).select(F.col("_id").alias(id_col), "size", "text_crc32", "shard", "slot")


def op7_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
