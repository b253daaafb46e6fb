"""Mixing sources to target weights.

Word counts are summed per source, targets are set by weight and capped, and each
document is taken floor(rate) times plus one more copy with probability equal to
the fraction, decided by a hash of seed, identifier and text: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.llm.quality import words
from keelson.llm.staging import documents, materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix"


def ranked(df: DataFrame, *keys) -> DataFrame:
    """``df`` with ``_rank`` 0, 1, ... by ``keys``, without a one-task window.

    The sorted rows are written; each partition then needs only the number of rows
    in those before it, one number a partition.
    """
    placed = materialise(df.orderBy(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), 33)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    before, offset = 0, {}
    for p, n in counts:
        offset[p], before = before, before + n
    if not offset:
        return placed.withColumn("_rank", F.lit(0).cast("long")).drop("_at")
    shift = F.create_map(*[F.lit(x).cast("long") for kv in offset.items() for x in kv])[part]
    return placed.withColumn("_rank", shift + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Adds ``target`` to a table (source, source_size).

    Weights repeat over sources by code point, null last. A source stops at
    ``max_repeat`` times its size; the excess is shared by weight among the others
    until none is above. Each round of that is one small aggregate.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = ranked(sources, F.col("source").asc_nulls_last()).withColumn("_w", w)
    top = F.col("source_size") * max_repeat
    budget = table.agg(F.sum("source_size")).first()[0] or 0
    budget, full, open_w, level = share * budget, 0, None, None
    while True:
        # Sources whose share at the present level is above their cap are full.
        is_full = F.lit(False) if level is None else F.col("_w") * level[0] >= top * level[1]
        got = table.agg(F.sum(F.when(is_full, top)), F.sum(F.when(~is_full, F.col("_w"))), F.sum(is_full.cast("long"))).first()
        if level is not None and got[2] == full:
            break
        full, open_w = got[2] or 0, got[1]
        if not open_w:
            return table.withColumn("target", top.cast("double")).drop("_w", "_rank")
        level = (budget - float(got[0] or 0), open_w)
    at_cap = F.col("_w") * level[0] >= top * level[1]
    return table.withColumn("target", F.when(at_cap, top.cast("double")).otherwise(F.col("_w") * level[0] / level[1])).drop("_w", "_rank")


def coin(id_col: Column, text_md5: Column, place: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed, identifier, text and place among equal rows."""
    told = F.concat_ws(":", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), text_md5, place.cast("string"))
    return F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("double") / float(1 << 52)


def placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_place``: 0, 1, ... among rows that are equal in ``keys``, as a rule none.

    Only rows that have an equal are sorted, by sampled splitters, so one key may hold any share of them. Which of
    them has which place is open, not what places there are.
    """
    key = F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], *[F.col(k).isNull().alias(f"_{n}") for n, k in enumerate(keys)])
    keyed = rows.withColumn("_key", F.xxhash64(key))
    more = materialise(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if more.isEmpty():
        return rows.withColumn("_place", F.lit(0).cast("long"))
    marked = keyed.join(more.select("_key", F.lit(True).alias("_again")), "_key", "left")
    many = ranked(marked.where("_again").withColumn("_any", F.monotonically_increasing_id()), "_key", *keys, "_any").drop("_any")
    # Equal rows lie side by side: a place is a rank less that of the first.
    first = materialise(many.groupBy(key.alias("_of")).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("n")))
    many = skew.join(many.withColumn("_of", key), first.select("_of", "_first"), ["_of"], skew.large_keys(first, ["_of"], first.agg(F.sum("n")).first()[0]))
    many = many.withColumn("_place", F.col("_rank") - F.col("_first"))
    alone = marked.where("_again IS NULL").withColumn("_place", F.lit(0).cast("long"))
    return alone.select(*rows.columns, "_place").unionByName(many.select(*rows.columns, "_place"))


def with_copies(rows: DataFrame, goal: DataFrame, max_repeat: int, seed: str) -> DataFrame:
    """Rows (_id, _source, _md5, ...) get source_size, target, rate and copies; ``goal`` has one row a source.

    Spark sends ``goal`` to the rows where its size allows. Where it doesn't, a source that very many rows share is dealt to parts.
    """
    goal = goal.select(F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"), "n", "source_size", "target")
    named = placed(rows, ["_id", "_source", "_md5"]).withColumn("_name", F.coalesce("_source", F.lit(""))).withColumn("_none", F.col("_source").isNull())
    large = skew.large_keys(goal, ["_name", "_none"], goal.agg(F.sum("n")).first()[0] or 0)
    both = skew.join(named, goal.drop("n"), ["_name", "_none"], large).drop("_name", "_none")
    rate = F.least(F.lit(float(max_repeat)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
    both = both.withColumn("rate", rate).withColumn("_coin", coin(F.col("_id"), F.col("_md5"), F.col("_place"), seed))
    return both.withColumn("copies", F.floor("rate") + (F.col("_coin") < F.col("rate") - F.floor("rate")).cast("long")).drop("_coin", "_place")


def goals(sizes: DataFrame, weights, share: float, max_repeat: int) -> DataFrame:
    """(source, n, source_size, target) of rows (_source, size)."""
    return materialise(targets(sizes.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, share, max_repeat))


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    text = F.col(text_col)
    return [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.size(words(text)).cast("long").alias("size"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("_md5")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, rate, copies, taken.

    A null text has no words; a null source is a source of its own, ranked last. Every row has a coin of its own: rows without an
    identifier, or that repeat one, are told apart by their text, and equal rows by their place among each other. Sources of equal
    size or weight are told apart by their names. A source of no words has rate 0. Texts of any length are counted as a whole.
    An empty table gives an empty one; other columns are ignored.
    """
    rows = materialise(docs.select(*described(docs, id_col, text_col, source_col)))
    out = with_copies(rows, goals(rows, weights, share, max_repeat), max_repeat, seed)
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as ``copies`` of ``mix`` says, in its own columns. Texts are read where they are and don't travel."""
    goal = goals(docs.select(*described(docs, id_col, text_col, source_col)), weights, share, max_repeat)
    rows = docs.select(*described(docs, id_col, text_col, source_col), F.struct(*docs.columns).alias("_row"))
    return with_copies(rows, goal, max_repeat, seed).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("_row.*")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS h,
                  row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
r AS (SELECT *, coalesce(sum(2 * source_size) OVER o, 0)::DOUBLE AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
      FROM w WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
-- the level is where the next source is no longer above its cap
lv AS (SELECT budget - capped AS money, rest FROM r WHERE w * (budget - capped) < 2 * source_size * rest ORDER BY source_size / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size,
             CASE WHEN w * money < 2 * source_size * lv.rest THEN w * money / lv.rest ELSE 2.0::DOUBLE * source_size END AS target
      FROM r LEFT JOIN lv ON true),
x AS (SELECT doc_id, size, source_size, target, coalesce(least(2.0::DOUBLE, target / nullif(source_size, 0)), 0) AS rate,
             ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || h || ':' || place::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS coin
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (floor(rate) + (coin < rate - floor(rate))::INT)::BIGINT AS taken FROM x
"""
