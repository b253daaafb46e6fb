"""Hard negatives by branch and bound in ball trees.

Vectors are dealt to blocks, anchors too; a task holds one block of anchors and reads one block of rows in chunks. Each
chunk becomes ball trees, one a label. An anchor's inner products with a ball lie within q.c - |q|r and q.c + |q|r: a node
is pruned for an anchor when these are outside all its score windows, or strictly beneath the score that is k-th so
far. What is left is scored exactly. Blocks hand on k rows a window at most, and a window over these decides.

The first search gives each anchor's positives (same label, no lower bound), the second the negatives in the window that
each positive's score sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keelson.llm.staging import materialise

LEAF, CHUNK = 128, 16384
#: Anchors in a block: a task holds ANCHORS * windows * k results.
ANCHORS, ROW_BLOCKS = 2048, 12
#: Components end here, so that inner products of up to 2048 components are exact in 64 bits.
MOST = 1 << 26
EXACT = 1 << 53
_LOW = np.iinfo(np.int64).min
_ANY_LOW, _ANY_HIGH = -(1 << 62), 1 << 62


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    rows: np.ndarray
    children: tuple[Node, ...] = ()


def ball(x: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> Node:
    """A ball over ``rows`` of x, halved between two far points until ``leaf`` are left; equal vectors stay together."""
    points = x[rows]
    centre = points.mean(axis=0)
    d = ((points - centre) ** 2).sum(axis=1)
    node = Node(centre, float(np.sqrt(d.max())), rows)
    if len(rows) > leaf and d.max() > 0:
        a = points[d.argmax()]
        b = points[((points - a) ** 2).sum(axis=1).argmax()]
        along = points @ (b - a)
        order = np.argsort(along, kind="stable")
        half = len(rows) // 2
        node.children = (ball(x, rows[order[:half]], leaf), ball(x, rows[order[half:]], leaf))
    return node


class Best:
    """The k first rows (score down, identifier up, a missing one last) of each query's windows; found rows are gathered and cut from time to time."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.n_held, self.limit = k, [], 0, 4 * n * k + 4096
        self.kth_score, self.kth_id = np.full(n, _LOW), np.full(n, np.iinfo(np.int64).max)

    def add(self, window: np.ndarray, score: np.ndarray, ident: np.ndarray, row: np.ndarray) -> None:
        self.held.append((window, score, ident, row))
        self.n_held += len(window)
        if self.n_held > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        w, s, i, r = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((r, i, -s, w))
        w, s, i, r = w[order], s[order], i[order], r[order]
        place = np.arange(len(w)) - np.searchsorted(w, w)
        last = place == self.k - 1
        self.kth_score[w[last]], self.kth_id[w[last]] = s[last], i[last]
        keep = place < self.k
        out = w[keep], s[keep], i[keep], r[keep]
        self.held, self.n_held = [out], int(keep.sum())
        return out


def search(node: Node, x: np.ndarray, ident: np.ndarray, row: np.ndarray, q: np.ndarray, q_norm: np.ndarray, q_row: np.ndarray, active: np.ndarray, low: np.ndarray, high: np.ndarray, best: Best, ints: bool) -> None:
    """Adds to ``best`` the rows under ``node`` that are within (low, high) of an active query's windows; never the query itself."""
    width = low.shape[1]
    todo = [(node, active)]
    while todo:
        node, act = todo.pop()
        middle, reach = q[act] @ node.centre, q_norm[act] * node.radius
        # Centres are means: bounds get the error of their sums.
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-3
        kth = best.kth_score.reshape(-1, width)[act]
        fits = (low[act] <= high[act]) & ((middle - reach - slack)[:, None] <= high[act]) & ((middle + reach + slack)[:, None] >= np.maximum(low[act], kth))
        act = act[fits.any(axis=1)]
        if not len(act):
            continue
        if node.children:
            # The half with the larger mean product goes first: k-th scores rise early.
            todo += [(c, act) for c in sorted(node.children, key=lambda c: float((q[act] @ c.centre).sum()))]
            continue
        at = node.rows
        scores = (q[act].astype(np.int64) @ x[at].astype(np.int64).T) if ints else np.rint(q[act] @ x[at].T).astype(np.int64)
        other = row[at][None, :] != q_row[act][:, None]
        for j in range(width):
            window = act * width + j
            kth, kth_id = best.kth_score[window][:, None], best.kth_id[window][:, None]
            ok = other & (scores >= low[act, j][:, None]) & (scores <= high[act, j][:, None]) & ((scores > kth) | ((scores == kth) & (ident[at][None, :] <= kth_id)))
            a, b = np.nonzero(ok)
            if len(a):
                best.add(window[a], scores[a, b], ident[at][b], row[at][b])


_FOUND = "anchor long, window int, score long, row long"
_KIND_QUERY, _KIND_ROW = 0, 1


def vectors(columns: list[bytes]) -> np.ndarray:
    """Packed components as one matrix; shorter vectors end in zeros."""
    width = max((len(c) for c in columns), default=0)
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in columns), dtype=np.int32).reshape(len(columns), width // 4).astype(np.float64)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _search_block(queries: list[tuple], chunks: Iterator[list[tuple]], k: int, same: bool) -> Iterator[pa.RecordBatch]:
    """Best rows of a block for a block of anchors. A row is (row, id, label, vector, lows, highs), windows for anchors only."""
    if not queries:
        for _ in chunks:
            pass
        return
    q_row, q_label = np.array([r[0] for r in queries]), np.array([r[2] for r in queries])
    width = max(len(r[4]) for r in queries)
    low, high = np.full((len(queries), width), _ANY_HIGH), np.full((len(queries), width), _ANY_LOW)
    for i, r in enumerate(queries):
        low[i, : len(r[4])], high[i, : len(r[5])] = r[4], r[5]
    q, best = vectors([r[3] for r in queries]), Best(len(queries) * width, k)
    q_norm = np.sqrt((q**2).sum(axis=1))
    everyone = np.arange(len(queries))
    for rows in chunks:
        x = vectors([r[3] for r in rows])
        dims = max(q.shape[1], x.shape[1])
        q, x = _padded(q, dims), _padded(x, dims)
        # Doubles hold every partial sum up to 2^53.
        ints = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims >= EXACT
        label, row = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
        ident = np.array([np.iinfo(np.int64).max if r[1] is None else r[1] for r in rows])
        order = np.argsort(label, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            active = everyone[(q_label == label[part[0]]) == same]
            if len(active):
                search(ball(x, part), x, ident, row, q, q_norm, q_row, active, low, high, best, ints)
        best.cut()
    w, s, _, r = best.cut()
    yield pa.RecordBatch.from_arrays([pa.array(q_row[w // width]), pa.array((w % width).astype(np.int32)), pa.array(s), pa.array(r)], names=["anchor", "window", "score", "row"])


def _tasks(k: int, same: bool, chunk: int):
    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by (i, j, kind): the anchors of a task come before its rows.
        for _, task in groupby(rows(batches), key=lambda r: r[:2]):
            queries: list[tuple] = []

            def chunks(task=task, queries=queries):
                held: list[tuple] = []
                for r in task:
                    if r[2] == _KIND_QUERY:
                        queries.append(r[3:])
                        continue
                    held.append(r[3:])
                    if len(held) == chunk:
                        yield held
                        held = []
                if held:
                    yield held

            some = chunks()
            first = next(some, None)
            if first is not None:
                yield from _search_block(queries, _chained(first, some), k, same)

    return run


def _chained(first: list[tuple], rest: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    yield first
    yield from rest


def searched(queries: DataFrame, rows: DataFrame, k: int, same: bool, anchor_blocks: int, row_blocks: int, chunk: int) -> DataFrame:
    """(anchor, window, score, row): of each query's windows the k first rows of each block of rows, of its label (``same``) or of all others.

    ``queries`` are (_row, label, vec, lows, highs), ``rows`` (_row, id, label, vec). Every query meets every row, in blocks; which block
    is that of a row is a hash of its number, so a label or vector that very many rows share doesn't matter.
    """
    none = F.lit(None).cast("array<long>")
    block = lambda n: F.pmod(F.xxhash64("_row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cols = ["i", "j", "kind", "_row", "id", "label", "vec", "lows", "highs"]
    asks = queries.withColumn("i", block(anchor_blocks)).withColumn("j", every(row_blocks)).withColumn("kind", F.lit(_KIND_QUERY)).withColumn("id", F.lit(None).cast("long"))
    gets = rows.withColumn("j", block(row_blocks)).withColumn("i", every(anchor_blocks)).withColumn("kind", F.lit(_KIND_ROW)).withColumn("lows", none).withColumn("highs", none)
    tasks = asks.select(*cols).unionByName(gets.select(*cols)).repartition(anchor_blocks * row_blocks, "i", "j").sortWithinPartitions("i", "j", "kind")
    return tasks.mapInArrow(_tasks(k, same, chunk), _FOUND)


def firsts(found: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k first of each (anchor, window) over all blocks, with ``rank`` and the row's identifier: a window sorts k rows a block."""
    named = found.join(rows.select(F.col("_row").alias("row"), F.col("id")), "row")
    order = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def integers(embedding: str, scale: int = 256):
    """floor(scale * x) of every component, x as double, within MOST either way, packed as 32-bit integers."""
    limit = lambda v: F.least(F.greatest(v, F.lit(float(-MOST))), F.lit(float(MOST)))
    return F.transform(embedding, lambda x: limit(F.floor(x.cast("double") * scale).cast("double")).cast("int"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column(2)
        flat, ends = v.flatten().to_numpy().astype(np.int32), v.offsets.to_numpy()
        ends = ends - ends[0]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([flat[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])], pa.binary())], names=["id", "label", "vec"])


def mine(
    table: DataFrame, anchors: str = "id % 100 = 0", positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", scale: int = 256, anchor_block: int = ANCHORS, row_blocks: int = ROW_BLOCKS, chunk: int = CHUNK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    ``anchors`` is a condition on ``id`` and ``label``. An anchor's positives are its first ``positives`` other rows of the same label; the
    negatives of each are the first ``negatives`` rows of other labels with window[0] * positive_score <= 100 * negative_score <=
    window[1] * positive_score. First is the higher inner product of the components floor(scale * x), then the smaller identifier.
    Rows with a null label or vector, or a null or non-finite component, take no part. Components beyond MOST, which inner products
    of 64 bits have no room for, count as MOST; a vector shorter than another counts as ending in zeros, so one of no components scores 0.
    A null identifier is no anchor and comes last among equal scores; rows that repeat an identifier are rows of their own. A
    negative positive score leaves an empty window, one of 0 the scores of 0. An anchor without positives, or without rows in its
    windows, gives no row; nor does an empty table. Other columns are ignored.
    A task holds ``anchor_block`` anchors with their results and ``chunk`` rows.
    """
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    read = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(good)
    packed = read.select("id", "label", integers("v", scale).alias("v")).mapInArrow(_pack, "id long, label long, vec binary")
    rows = materialise(packed.withColumn("_row", F.monotonically_increasing_id()))
    asks = rows.where(anchors)
    n_blocks = max(1, -(-asks.count() // anchor_block))
    bound = lambda x: F.array(F.lit(x).cast("long"))
    near = searched(asks.select("_row", "label", "vec", bound(_ANY_LOW).alias("lows"), bound(_ANY_HIGH).alias("highs")), rows, positives, True, n_blocks, row_blocks, chunk)
    pos = materialise(firsts(near, rows, positives).select("anchor", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Windows of an anchor in the order of its positives: ceil and floor of whole numbers.
    p = lambda x: x["positive_score"]
    windows = pos.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p")).select(
        F.col("anchor").alias("_row"),
        F.transform("p", lambda x: -F.floor(-(p(x).cast("decimal(20,0)") * window[0]) / 100).cast("long")).alias("lows"),
        F.transform("p", lambda x: F.floor(p(x).cast("decimal(20,0)") * window[1] / 100).cast("long")).alias("highs"),
    )
    asks = materialise(asks.join(windows, "_row").select("_row", "label", "vec", "lows", "highs"))
    far = firsts(searched(asks, rows, negatives, False, n_blocks, row_blocks, chunk), rows, negatives)
    far = far.select("anchor", (F.col("window") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = pos.join(rows.select(F.col("_row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(far, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def relabelled(table: DataFrame) -> DataFrame:
    """The query's labels: where vec_id is divisible by 7, (label + 1) % 10."""
    return table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


ORACLE = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding, row_number() OVER () AS row FROM embeddings),
v AS (SELECT vec_id, label, row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM r
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
s AS (SELECT a.vec_id AS anchor_id, a.row AS anchor, o.vec_id, o.row, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score FROM a, v o WHERE a.row <> o.row),
p AS (SELECT anchor_id, anchor, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM s WHERE same),
n AS (SELECT p.*, s.vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor, place ORDER BY score DESC, vec_id NULLS LAST, row)::INT AS rank
      FROM p JOIN s USING (anchor) WHERE place <= 5 AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
