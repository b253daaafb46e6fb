"""Importance resampling towards a target distribution.

Documents and targets are bags of hashed word runs. One scan of a document keeps, in a ring, the running zlib CRC states
of the last ``n`` starts: each word extends every state by a blank and its bytes, and starts one of its own, so runs of
1 to n words are hashed without being built. What it emits are the buckets and how often each occurs, written
once; sums over all of them give every bucket's gain, and a document's weight is the sum of its gains. Gumbel noise from a
hash of the identifier turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.mixing import ranked
from keelson.llm.staging import documents, materialise, short_batches
from keelson.llm.text import LOWER

#: Words are runs of bytes that are letters or digits of ASCII or belong to a longer character.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER_TABLE = LOWER.tobytes()
SEED, BUCKETS = "2024", 10000
_SCHEMA = "id long, n_words long, n_features long, buckets array<int>, counts array<int>"


def ring(words: list[bytes], n: int) -> Iterator[int]:
    """CRC-32 of each run of 1 to n consecutive words, joined by one blank: one pass, n states."""
    if n == 1:  # a ring of one start
        yield from map(crc32, words)
        return
    states: list[int] = []
    for w in words:
        longer = b" " + w
        states = [crc32(longer, s) for s in states[max(0, len(states) - n + 1) :]]
        states.append(crc32(w))
        yield from states


def bag(text: bytes, n: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, buckets in order, how often each): of a text in UTF-8."""
    words = WORD.findall(text.translate(LOWER_TABLE))
    found: Counter[int] = Counter()
    for code, c in Counter(ring(words, n)).items():
        found[code % buckets] += c
    keys = np.array(sorted(found), dtype=np.int32)
    counts = np.array([found[k] for k in keys.tolist()], dtype=np.int32)
    return len(words), sum(found.values()), keys, counts


def lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _bags(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [bag(t.as_py() or b"", n, buckets) for t in b.column(1)]
            w, f, k, c = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(w, pa.int64()), pa.array(f, pa.int64()), lists(list(k)), lists(list(c))], names=["id", "n_words", "n_features", "buckets", "counts"]
            )

    return run


def bags(docs: DataFrame, n: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, buckets, counts) of each row; null text has no words. A text's bag is as large as its distinct buckets."""
    short_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(_bags(n, buckets), _SCHEMA)


def totals(bagged: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: ``buckets`` numbers, whatever the table."""
    each = bagged.select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy("x.buckets").agg(F.sum("x.counts").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for b, n in each.collect():
        out[b] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target, smoothed by one feature a bucket."""
    a, b, n = float(source.sum()), float(target.sum()), len(source)
    pairs = zip(source.astype(float).tolist(), target.astype(float).tolist())
    return np.array([math.floor(1000 * math.log((t + 1) * (a + n) / ((s + 1) * (b + n)))) for s, t in pairs], dtype=np.int64)


def _weigh(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, counts = b.column(3), b.column(4)
            ends = keys.offsets.to_numpy()
            parts = gain[keys.flatten().to_numpy()] * counts.flatten().to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(parts)))
            ends = ends - ends[0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return run


def noise(id_col: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from 32 bits of a hash of seed and identifier."""
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.ln(-F.ln(u))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = BUCKETS, least_words: int = 20, seed: str = SEED,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (1, 2, ... of those drawn, else NULL).

    Of the documents with at least ``least_words`` words, floor(percent * N / 100) of the highest scores are drawn, equal
    scores by the smaller identifier, a null one last; rows that are equal in all of these take their places in any
    order. Null and empty texts have no features and weigh 0. Rows that repeat an identifier are rows of their own that share its noise.
    An empty table gives an empty one, an empty target makes rare buckets the likelier. Texts may be long: a task holds a batch
    of them, and a bag has at most ``buckets`` entries. Other columns are ignored.
    """
    have = materialise(bags(docs, n, buckets, id_col, text_col))
    gain = gains(totals(have, buckets), totals(bags(target.select(F.lit(0).alias("_id"), F.col(target_text_col).alias("_text")), n, buckets, "_id", "_text"), buckets))
    weighed = have.mapInArrow(_weigh(gain), "id long, n_words long, n_features long, weight long")
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    can = scored.where(F.col("n_words") >= least_words)
    drawn = can.count() * percent // 100
    # Rows that are equal in all that orders them may be very many: the last key only parts them.
    placed = ranked(can.withColumn("_any", F.monotonically_increasing_id()), F.col("score").desc(), F.col("id").asc_nulls_last(), "n_features", "weight", "_any")
    placed = placed.withColumn("rank", F.when(F.col("_rank") < drawn, F.col("_rank") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    cols = [F.col("id").alias(id_col), "n_features", "weight", "score", "rank"]
    return placed.select(*cols).unionByName(rest.select(*cols))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: SQL has no CRC-32: it is worked out bit by bit, for each distinct word.
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_TABLE = f"""tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, c FROM (WITH RECURSIVE b(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, {_STEP.format("c")} FROM b WHERE k < 8)
                                      SELECT i, c FROM b WHERE k = 8)))"""
ORACLE = f"""
WITH RECURSIVE {_TABLE},
f AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
fw AS (SELECT row, unnest(w) AS word FROM f), fc AS (SELECT row, word, count(*) AS n FROM fw GROUP BY ALL),
gc AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM g) GROUP BY 1),
vocab AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM fc UNION SELECT word FROM gc)),
crc(word, h, i, c) AS (SELECT word, h, 0, 4294967295::BIGINT FROM vocab UNION ALL
    SELECT word, h, i + 1, xor(c >> 8, t[(xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT))::INT + 1]) FROM crc, tab WHERE 2 * i < length(h)),
code AS (SELECT word, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(h)),
s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM fc JOIN code USING (word) GROUP BY 1), t AS (SELECT bucket, sum(n)::DOUBLE AS t FROM gc JOIN code USING (word) GROUP BY 1),
sums AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS all_s, coalesce((SELECT sum(t) FROM t), 0) AS all_t),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (all_s + 10000) / ((coalesce(s, 0) + 1) * (all_t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), sums),
wt AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM fc JOIN code USING (word) JOIN gain USING (bucket) GROUP BY 1),
d AS (SELECT doc_id, row, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
             (('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u FROM f LEFT JOIN wt USING (row)),
x AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score, n_features >= 20 AS can FROM d),
y AS (SELECT *, row_number() OVER (PARTITION BY can ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (can) OVER () * 10 // 100 AS drawn FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN can AND place <= drawn THEN place END AS rank FROM y
"""
