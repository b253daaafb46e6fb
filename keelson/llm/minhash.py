"""MinHash near-dedup with sequential Bayesian verification.

1. Each text gets its set of five-word shingles, a digest of the set, a MinHash
   signature and band keys. Texts with equal sets are one class from here on, so
   copies cost one row each.
2. Classes that share a band key are compared inside the key's bucket: their signatures
   are read in batches, and a pair is given up as soon as the posterior probability that
   its similarity reaches the threshold is below the chosen miss probability.
   A bucket hands on a spanning forest of its surviving pairs, not the pairs.
3. The forests' components are clusters. Every member of a cluster is verified against its first member on the full
   sets; large clusters are dealt to parts for that. What is not linked to the first member, as a rule few, is then verified against all
   others, most similar ones first, as far as they aren't connected yet. Again a forest of links goes on, and
   its components are the result.

Buckets of more than BLOCK members are dealt out as pairs of blocks, and so are the members that the third step leaves, with
the others of their cluster (blocks of CROSS members and BLOCK_BYTES of text): each task holds two blocks at most, and every pair meets in
one of them. Nothing is capped.
Sets are compared by 64-bit hashes of their shingles; a link that goes on is confirmed on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions import skew
from keelson.llm.graph import components
from keelson.llm.staging import documents, materialise, short_batches
from keelson.llm.text import Words, buffers, mixed, shingles

SHINGLE = 5
#: Bands of ROWS hashes. At similarity 0.85, all bands miss with probability (1 - 0.85^5)^24 < 1e-6.
BANDS, ROWS = 24, 5
BATCH = 24
MISS = 1e-6
BLOCK, BLOCK_BYTES = 2000, 32 << 20
#: Members of a cluster that are compared on full sets, in a block.
CROSS = 500
QUERY_THRESHOLD = (85, 100)
_SEEDS = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; of all its words if there are fewer."""
    w = Words(texts, lower=True)
    h = w.hashes()
    g = shingles(h, k)
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        else:
            out.append(shingles(np.append(h[a:b], np.uint64(b - a)), int(b - a) + 1) if b > a else g[:0])
    return out


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum of the set under each hash function, in pieces that stay in cache."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 1024):
        x = s[None, i : i + 1024] * _SEEDS[:, None]
        x ^= x >> np.uint64(32)
        np.minimum(low, (x * np.uint64(0x94D049BB133111EB)).min(axis=1), out=low)
    return low


@cache
def least_matches(threshold: float, miss: float, batch: int = BATCH, total: int = BANDS * ROWS) -> tuple[tuple[int, int], ...]:
    """(hashes read, fewest matches that keep a pair) after each batch.

    With a uniform prior, m matches of n give the similarity a Beta(m + 1, n - m + 1)
    distribution; its tail above the threshold is a binomial sum. Signatures keep eight bits a hash,
    so unequal ones match once in 256: that only keeps a pair longer.
    """
    out = []
    for n in range(batch, total + 1, batch):
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                out.append((n, m))
                break
    return tuple(out)


def survivors(sig: np.ndarray, i: int, others: np.ndarray, rule) -> tuple[np.ndarray, np.ndarray]:
    """Of ``others``, the rows that may be similar to row i, and their matches."""
    matches, before = np.zeros(len(others), dtype=np.int64), 0
    for n, least in rule:
        matches += (sig[others, before:n] == sig[i, before:n]).sum(axis=1)
        keep = matches >= least
        others, matches, before = others[keep], matches[keep], n
        if not len(others):
            break
    return others, matches


class Forest:
    """Union-find over 0 ... n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def candidate_forest(ids: list[int], sig: np.ndarray, rule) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs of a bucket that survive the signatures."""
    # Tree by tree: what no tree has yet is compared with the tree's members in turn.
    left = np.arange(len(ids))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            found, _ = survivors(sig, i, left, rule)
            for j in found:
                yield ids[i], ids[j]
            if len(found):
                todo += list(found)
                left = np.setdiff1d(left, found, assume_unique=True)


def linked(a: np.ndarray, b: np.ndarray, threshold: tuple[int, int]) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return threshold[1] * both >= threshold[0] * (a.size + b.size - both)


def shingle_texts(text: bytes, k: int) -> set[bytes]:
    """The shingles themselves, one blank between words."""
    w = Words([text], lower=True).words_of(0)
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def confirmed(a: bytes, b: bytes, k: int, threshold: tuple[int, int]) -> bool:
    x, y = shingle_texts(a, k), shingle_texts(b, k)
    both = len(x & y)
    return threshold[1] * both >= threshold[0] * (len(x) + len(y) - both)


def cross_forest(ids: list[int], seeks: np.ndarray, joined: np.ndarray, sets: list[np.ndarray], sig: np.ndarray, threshold: tuple[int, int], rule, confirm) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between rows that seek and rows that don't; ``joined`` rows are connected already.

    A member may be there twice, once in each role. ``confirm`` has the last word.
    """
    forest, size = Forest(len(ids)), np.array([s.size for s in sets])
    same: dict[int, int] = {}
    for i, x in enumerate(ids):
        forest.join(i, same.setdefault(x, i))
    known = np.flatnonzero(joined)
    for i in known[1:].tolist():
        forest.join(int(known[0]), i)
    others, levels = np.flatnonzero(~seeks), {}
    for i in np.flatnonzero(seeks).tolist():
        fits = threshold[1] * np.minimum(size[others], size[i]) >= threshold[0] * np.maximum(size[others], size[i])
        found, matches = survivors(sig, i, others[fits], rule)
        for m in np.unique(matches):
            levels.setdefault(int(m), []).append((i, found[matches == m]))
    for m in sorted(levels, reverse=True):
        for i, js in levels[m]:
            for j in js.tolist():
                if forest.root(i) != forest.root(j) and linked(sets[i], sets[j], threshold) and confirm(i, j):
                    forest.join(i, j)
                    yield ids[i], ids[j]


def _describe(k: int):
    names = ["id", "sig_text", "n_bytes", "n_shingles", "digest", "signature", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sigs = b.column(0), b.column(1)
            for at, texts in buffers(b.column(2)):
                sets = shingle_sets(texts, k)
                full = [signature(s) for s in sets]
                # A band's key also depends on its number, so bands need no column of their own.
                keys = [mixed(shingles_by_row(x) + np.arange(BANDS, dtype=np.uint64)).view(np.int64) if s.size else np.zeros(0, np.int64) for x, s in zip(full, sets)]
                digests = [hashlib.sha256(s.tobytes()).digest()[:16] if s.size else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[at : at + len(texts)],
                        sigs[at : at + len(texts)],
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([s.size for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in full], pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=names,
                )

    return run


def shingles_by_row(x: np.ndarray) -> np.ndarray:
    """One hash for the ROWS values of each band."""
    out = np.zeros(BANDS, dtype=np.uint64)
    for column in x.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0xD6E8FEB86659FD93) + column)
    return out


_EDGES = "a long, b long"


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _candidates(rule):
    def rows(batches):
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        for _, group in groupby(rows(batches), key=lambda r: r[:3]):
            group = [r[3:] for r in group]
            if len(group) > 1:
                sig = np.frombuffer(b"".join(r[1] for r in group), dtype=np.uint8).reshape(len(group), -1)
                out.update(candidate_forest([r[0] for r in group], sig, rule))
            if len(out) > 50_000:
                yield _edge_batch(list(out))
                out = set()
        yield _edge_batch(list(out))

    return run


_STAR = "component long, rep long, linked boolean"


def _star(k: int, threshold: tuple[int, int], rule):
    """Rows (component, part, rep, signature, text) sorted so that a part's first member comes first -> (component, rep, linked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple | None = None
        for b in batches:
            comps, _, reps, sigs = (c.to_pylist() for c in b.columns[:4])
            out = []
            for at, texts in buffers(b.column(4)):
                wanted, firsts = [], []
                for i, text in enumerate(texts, at):
                    sig = np.frombuffer(sigs[i], dtype=np.uint8)
                    if reps[i] == comps[i]:
                        first = (sig, shingle_sets([text], k)[0], text)
                    elif all((sig[:n] == first[0][:n]).sum() >= least for n, least in rule):
                        wanted.append(i)
                        firsts.append(first)
                    else:
                        out.append((comps[i], reps[i], False))
                bodies = [texts[i - at] for i in wanted]
                for i, s, f, text in zip(wanted, shingle_sets(bodies, k), firsts, bodies):
                    out.append((comps[i], reps[i], linked(f[1], s, threshold) and confirmed(f[2], text, k, threshold)))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()))], names=["component", "rep", "linked"])

    return run


def _cross(k: int, threshold: tuple[int, int], rule):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not pdf["seeks"].any():
            return pd.DataFrame(columns=["a", "b"], dtype="int64")
        bodies, sets = pdf["text"].tolist(), []
        for _, texts in buffers(pa.array(bodies, pa.binary())):
            sets += shingle_sets(texts, k)
        sig = np.frombuffer(b"".join(pdf["signature"]), dtype=np.uint8).reshape(len(pdf), -1)
        links = cross_forest(
            pdf["rep"].tolist(), pdf["seeks"].to_numpy(), pdf["linked"].to_numpy(), sets, sig, threshold, rule, lambda i, j: confirmed(bodies[i], bodies[j], k, threshold)
        )
        return pd.DataFrame(list(links), columns=["a", "b"], dtype="int64")

    return run


def verified_links(members: DataFrame, k: int, threshold: tuple[int, int], rule, block: int, block_bytes: int) -> DataFrame:
    """(a, b): a forest of the true links of each cluster, from (component, rep, n_bytes, signature, text)."""
    size = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
    size = materialise(size)
    total = size.agg(F.sum("n")).first()[0] or 0
    large = skew.large_keys(size, ["component"], total)
    is_first, cols = F.col("rep") == F.col("component"), ["component", "_part", "rep", "signature", "text"]
    dealt = skew.dealt(members.where(~is_first), ["component"], large).select(*cols)
    rows = dealt.unionByName(skew.copied(members.where(is_first), ["component"], large).select(*cols))
    star = rows.repartition("component", "_part").sortWithinPartitions("component", "_part", "rep")
    star = materialise(star.mapInArrow(_star(k, threshold, rule), _STAR))
    # What is left, against all others but the first: only in clusters that have such members.
    n_blocks = lambda n, b: F.greatest(F.ceil(F.col(n) / F.lit(block)), F.ceil(F.col(b) / F.lit(block_bytes))).cast("int")
    rest = members.select("rep", "n_bytes").join(star, "rep")
    left = rest.where("NOT linked").groupBy("component").agg(F.count(F.lit(1)).alias("n_left"), F.sum("n_bytes").alias("bytes_left"))
    plan = materialise(left.join(size, "component").select("component", n_blocks("n_left", "bytes_left").alias("bi"), n_blocks("n", "bytes").alias("bj")))
    flagged = members.where(~is_first).join(star.select("rep", "linked"), "rep")
    flagged = skew.join(flagged.select("component", "rep", "linked", "signature", "text"), plan, ["component"], large)
    own = lambda b: F.pmod(F.xxhash64("rep"), F.col(b)).cast("int")
    each = lambda b: F.explode(F.sequence(F.lit(0), F.col(b) - 1))
    cols = ["component", "i", "j", "seeks", "linked", "rep", "signature", "text"]
    seeking = flagged.where("NOT linked").withColumn("i", own("bi")).withColumn("j", each("bj")).withColumn("seeks", F.lit(True)).select(*cols)
    sought = flagged.withColumn("j", own("bj")).withColumn("i", each("bi")).withColumn("seeks", F.lit(False)).select(*cols)
    found = seeking.unionByName(sought).groupBy("component", "i", "j").applyInPandas(_cross(k, threshold, rule), _EDGES)
    return star.where("linked").select(F.col("component").alias("a"), F.col("rep").alias("b")).unionByName(found)


def in_blocks(rows: DataFrame, key: str, member: str, sizes: DataFrame, large: DataFrame) -> DataFrame:
    """Adds (i, j): the pairs of blocks of its group that a row belongs to; (0, 0) in a small group.

    ``sizes`` has (key, blocks). A row goes to each pair that holds its block, so any two rows of the group meet.
    ``large`` are the keys whose rows are dealt out for the join with ``sizes``.
    """
    n = F.col("blocks")
    own = F.pmod(F.xxhash64(member), n).cast("int")
    pairs = F.when(n <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), n - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))
    )
    both = skew.join(rows, sizes.select(key, "blocks"), [key], large)
    return both.withColumn("_p", F.explode(pairs)).select("*", F.col("_p.i").alias("i"), F.col("_p.j").alias("j")).drop("_p", "blocks")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: tuple[int, int] = (80, 100), shingle: int = SHINGLE, miss: float = MISS, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least
    ``threshold`` (a fraction, compared in integers). Texts of fewer words than a shingle are one shingle;
    null texts and texts without words are linked with nothing. Identifiers are integers; rows that repeat
    one and are the smallest of their component are all kept. A null identifier is larger than all: its row gets the
    smallest identifier reachable, and is kept only where there is none. Of equal similarities either makes the same
    component. An empty table gives an empty one; other columns are ignored. Texts may be long: a task holds
    ``block_bytes`` of them for each of two blocks, or a longer one alone.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rule = least_matches(threshold[0] / threshold[1], miss)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("sig_text"), F.col(text_col).cast("binary").alias("text"))
    schema = "id long, sig_text long, n_bytes long, n_shingles long, digest binary, signature binary, bands array<long>"
    # A class is known by the number of a row of it: identifiers may be null.
    seen = materialise(rows.mapInArrow(_describe(shingle), schema).withColumn("row", F.monotonically_increasing_id()))
    full = seen.where("digest IS NOT NULL")
    # Sums of its rows: no class is gathered.
    first = F.min(F.struct("row", "id", "sig_text", "n_bytes", "signature", "bands")).alias("first")
    classes = materialise(full.groupBy("digest").agg(first, F.min("id").alias("low_id"), F.count(F.lit(1)).alias("n")).select("digest", "first.*", "low_id", "n").withColumnRenamed("row", "rep"))
    keys = classes.select("rep", F.explode("bands").alias("key"))
    sizes = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")
    n_classes = classes.count()
    hot = skew.large_keys(sizes, ["key"], n_classes)
    met = in_blocks(keys, "key", "rep", sizes.select("key", blocks), hot).join(classes.select("rep", "signature"), "rep")
    met = met.select("key", "i", "j", "rep", "signature").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    clusters = components(met.mapInArrow(_candidates(rule), _EDGES)).withColumnRenamed("node", "rep")
    # Only what is in a cluster needs its text again: the list of these is written, so that Spark knows its size and can send it to the
    # texts, or filter them by it before they travel.
    clusters = clusters.join(classes.select("rep", "id", "sig_text", "n_bytes", "signature"), "rep")
    clusters = materialise(clusters)
    wanted = clusters.select(F.col("id").alias("_id"), F.col("sig_text").alias("_sig"))
    texts = rows.join(wanted, rows["id"].eqNullSafe(wanted["_id"]) & (rows["sig_text"] == wanted["_sig"]), "left_semi")
    texts = texts.groupBy("id", "sig_text").agg(F.first("text").alias("text")).withColumnsRenamed({"id": "_id", "sig_text": "_sig"})
    members = clusters.join(texts, clusters["id"].eqNullSafe(texts["_id"]) & (clusters["sig_text"] == texts["_sig"]))
    members = materialise(members.select("component", "rep", "n_bytes", "signature", "text"))
    links = verified_links(members, shingle, threshold, rule, min(block, CROSS), block_bytes)
    found = components(links).withColumnsRenamed({"node": "rep"})
    label = materialise(classes.select("digest", "rep", "low_id", "n").join(found, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), "low_id", "n"))
    lowest = label.groupBy("component").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    label_id = skew.join(label.select("digest", "component"), lowest.select("component", "component_id"), ["component"], skew.large_keys(lowest, ["component"], n_classes))
    same = skew.large_keys(label, ["digest"], seen.count())
    some = skew.join(full.select("id", "n_shingles", "digest"), label_id.select("digest", "component_id"), ["digest"], same)
    # Rows without words meet nothing, so they needn't travel.
    none = seen.where("digest IS NULL").select("id", "n_shingles", F.col("id").alias("component_id"))
    out = some.select("id", "n_shingles", "component_id").unionByName(none)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), threshold=QUERY_THRESHOLD)
