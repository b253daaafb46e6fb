"""Substring dedup by super-k-mers.

Every window of 35 words has a minimiser: of the 8-word pieces in it, the leftmost with
the smallest hash. Consecutive windows with the same minimiser travel as one packed
string to the minimiser's bucket, where sorting the windows counts them exactly.

Two equal windows have their minimisers at the same place in the window, hence at two
places of the corpus. So a minimiser that marks only one super-k-mer can't hold a repeat,
and its string needn't travel: a first pass sends 64-bit minimisers only.

A bucket with very many super-k-mers is not gathered in one task. Equal strings (copies of a text)
are first counted as one, with partial counts in each task. If very many different strings
are left (a line that a third of all documents share, each time in other surroundings), their
windows are counted one by one under their own words. What is found is joined back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.llm.staging import documents, materialise, short_batches
from keelson.llm.text import Words, buffers, shingles

WINDOW = 35
PIECE = 8
#: Above this many super-k-mers, a bucket's equal strings are counted first; above this many
#: different strings, its windows are counted one by one.
HOT, WIDE = 2000, 2000
#: Windows in a super-k-mer, at most: a bit each.
LONGEST = 56
_PLACE = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * have <= width:
        x, have = np.minimum(x[: len(x) - have], x[have:]), 2 * have
    return np.minimum(x[:n], x[width - have : width - have + n])


def super_kmers(texts: list[bytes], window: int, piece: int) -> tuple[np.ndarray, ...]:
    """(text, first word, number of windows, minimiser, places) of each super-k-mer.

    In periodic text neighbouring minimisers are equal pieces: these super-k-mers travel as one, cut
    at LONGEST windows, and count as two places.
    """
    w = Words(texts)
    h = w.hashes()
    g = shingles(h, piece)
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    key = (g & ~_PLACE) | np.arange(len(g), dtype=np.uint64)
    place = (sliding_min(key, window - piece + 1) & _PLACE).astype(np.int64)
    text = w.text_of()
    whole = text[:n] == text[window - 1 :]
    v = np.where(whole, g[place], np.uint64(0))
    new_v = np.concatenate(([True], (v[1:] != v[:-1]) | (whole[1:] != whole[:-1]) | (text[1:n] != text[: n - 1])))
    new_place = new_v | np.concatenate(([True], place[1:] != place[:-1]))
    run_start = np.flatnonzero(new_v)
    run_end = np.append(run_start[1:], n)
    kept = whole[run_start]
    run_places = np.add.reduceat(new_place.astype(np.int64), run_start)[kept]
    run_start, run_end = run_start[kept], run_end[kept]
    parts = -(-(run_end - run_start) // LONGEST)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begins = np.repeat(run_start, parts) + nth * LONGEST
    ends = np.minimum(begins + LONGEST, np.repeat(run_end, parts))
    places = np.minimum(np.repeat(run_places, parts), 2)
    return text[begins], begins - w.first[text[begins]], ends - begins, v[begins], places


def _seeds(window: int, piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sigs = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at, texts in buffers(b.column(2)):
                text, first, n, v, places = super_kmers(texts, window, piece)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (v.view(np.int64), ids[at + text], sigs[at + text], *(y.astype(np.int32) for y in (first, n, places)))],
                    names=["v", "id", "sig", "first", "n", "places"],
                )

    return run


def _pack(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for i, sig, text, marks in zip(*b.columns):
                w, i, sig = text.as_py().split(), i.as_py(), sig.as_py()
                for m in marks.as_py():
                    first, n = m["first"], m["n"]
                    out.append((m["v"], i, sig, first, n, b" ".join(w[first : first + n + window - 1]), m["hot"]))
                    size += len(out[-1][5])
                    if size > 4 << 20:
                        yield _rows(out)
                        out, size = [], 0
            yield _rows(out)

    return run


_PACKED = pa.schema([("v", pa.int64()), ("id", pa.int64()), ("sig", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("packed", pa.binary()), ("hot", pa.bool_())])
_MASKS = pa.schema([("id", pa.int64()), ("sig", pa.int64()), ("first", pa.int32()), ("mask", pa.int64())])


def _rows(rows: list[tuple], schema: pa.Schema = _PACKED) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


_STRINGS = pa.schema([("packed", pa.binary()), ("mask", pa.int64())])
_WINDOWS = pa.schema([("packed", pa.binary()), ("place", pa.int32()), ("win", pa.binary()), ("c", pa.int64())])


def windows(packed: bytes, n: int, window: int) -> list[bytes]:
    at, cut = [0], -1
    while (cut := packed.find(b" ", cut + 1)) >= 0:
        at.append(cut + 1)
    at.append(len(packed) + 1)
    return [packed[at[k] : at[k + window] - 1] for k in range(n)]


def repeats(bucket: list[tuple[int, bytes, int]], window: int) -> list[int]:
    """For each (windows, packed string, copies) of one bucket, a mask: bit k is set if window k is found elsewhere."""
    found = [(x, r, k) for r, (n, packed, _) in enumerate(bucket) for k, x in enumerate(windows(packed, n, window))]
    found.sort()
    mask = [(1 << n) - 1 if copies > 1 else 0 for n, _, copies in bucket]
    for (x, r, k), (y, s, j) in zip(found, found[1:]):
        if x == y:
            mask[r] |= 1 << k
            mask[s] |= 1 << j
    return mask


def _each(batches):
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _count(window: int):
    """Rows (v, n, packed, copies, ...) sorted by v -> (..., mask) where a mask has a bit."""

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _, bucket in groupby(_each(batches), key=lambda r: r[0]):
            bucket = list(bucket)
            out += [(*r[4:], m) for r, m in zip(bucket, repeats([r[1:4] for r in bucket], window)) if m]
            if len(out) > 50_000:
                yield _rows(out, schema)
                out = []
        yield _rows(out, schema)

    return run


def _single(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows([(p, k, x, c) for n, p, c in zip(*(c.to_pylist() for c in b.columns)) for k, x in enumerate(windows(p, n, window))], _WINDOWS)

    return run


def _cut(window: int):
    names = ["id", "n_words", "n_removed", "kept_sha256", "kept_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist()):
                w = (text.as_py() or b"").split()
                drop = bytearray(len(w))
                for m in marks or ():
                    for k in range(m["mask"].bit_length()):
                        if m["mask"] >> k & 1:
                            drop[m["first"] + k : m["first"] + k + window] = b"\1" * window
                kept = b" ".join([x for x, d in zip(w, drop) if not d] if marks else w)
                out.append((i, len(w), drop.count(1), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=names) if out else None

    return lambda batches: (x for x in run(batches) if x)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE, hot: int = HOT, wide: int = WIDE) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window over it is found at any other place, in the same text or in
    another; windows are judged on the input. A null or empty text has no words, and
    a text shorter than a window keeps all. Identifiers are integers or null; rows that
    repeat one are places of their own. An empty table gives an empty one; other columns
    are ignored. A worker holds a few times its longest text.
    """
    short_batches(docs.sparkSession)
    id_ = F.col(id_col).cast("long")
    rows = docs.select(
        id_.alias("own_id"), F.coalesce(id_, F.lit(0)).alias("id"), F.xxhash64(F.col(text_col), id_.isNull()).alias("sig"), F.col(text_col).alias("text")
    )
    key = ["id", "sig"]
    seeds = materialise(
        rows.where("text IS NOT NULL").select(*key, "text").mapInArrow(_seeds(window, piece), "v long, id long, sig long, first int, n int, places int")
    )
    twice = seeds.groupBy("v").agg(F.sum("places").alias("n_places")).where("n_places > 1").select("v", "n_places", (F.col("n_places") > hot).alias("hot"))
    twice = materialise(twice)
    n_seeds = seeds.count()
    large = skew.large_keys(twice.withColumnRenamed("n_places", "n"), ["v"], n_seeds)
    marks = skew.join(seeds, twice.select("v", "hot"), ["v"], large).groupBy(*key).agg(F.collect_set(F.struct("v", "first", "n", "hot")).alias("marks"))
    texts = rows.withColumn("text", F.col("text").cast("binary"))
    packed = materialise(
        texts.join(marks, key)
        .select(*key, "text", "marks")
        .mapInArrow(_pack(window), "v long, id long, sig long, first int, n int, packed binary, hot boolean")
    )
    count = _count(window)
    few = packed.where("NOT hot").select("v", "n", "packed", F.lit(1).alias("copies"), *key, "first")
    masks = few.repartition("v").sortWithinPartitions("v").mapInArrow(lambda it: count(it, _MASKS), "id long, sig long, first int, mask long")
    # Hot buckets: equal strings count as one row with a number of copies.
    many = packed.where("hot")
    strings = materialise(many.groupBy("v", "n", "packed").agg(F.count(F.lit(1)).alias("copies")))
    per_v = strings.groupBy("v").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > wide).alias("wide"))
    per_v = materialise(per_v)
    strings = skew.join(strings, per_v.select("v", "wide"), ["v"], skew.large_keys(per_v, ["v"], n_seeds))
    narrow = strings.where("NOT wide").select("v", "n", "packed", "copies", F.col("packed").alias("own"))
    by_bucket = narrow.repartition("v").sortWithinPartitions("v").mapInArrow(lambda it: count(it, _STRINGS), "packed binary, mask long")
    single = materialise(
        strings.where("wide").select("n", "packed", "copies").mapInArrow(_single(window), "packed binary, place int, win binary, c long")
    )
    often = materialise(single.groupBy("win").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).where("c > 1"))
    by_window = skew.join(single, often.select("win"), ["win"], skew.large_keys(often, ["win"], single.count())).groupBy("packed").agg(F.expr("bit_or(shiftleft(1L, place))").alias("mask"))
    of_string = by_bucket.unionByName(by_window)
    # A string of a hot bucket is in very many texts.
    copies = strings.groupBy("packed").agg(F.sum("copies").alias("n"))
    hot_masks = skew.join(many, of_string, ["packed"], skew.large_keys(copies, ["packed"], n_seeds)).select(*key, "first", "mask")
    masks = masks.unionByName(hot_masks)
    per_text = masks.groupBy(*key).agg(F.collect_set(F.struct("first", "mask")).alias("marks"))
    out = texts.join(per_text, key, "left").select("own_id", "text", "marks")
    out = out.mapInArrow(_cut(window), "id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM g) WHERE n > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT doc_id, list(p) AS gone FROM p GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
             CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda t, i: NOT list_contains(gone, i)) END AS kept
      FROM d LEFT JOIN x USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
