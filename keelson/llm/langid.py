"""Language ID by a linear-chain conditional random field over words.

A word's features are its byte n-grams, those at its ends (affixes) told apart by the blank
they include, and the word itself (lexicon), hashed into one table of weights. Transitions
between the labels of neighbouring words are learned too. Forward-backward gives each word's label
probabilities, so text that switches language is labelled by parts; a document's language is the label
with the highest mean probability.

Fitting takes a bounded sample of labelled rows (parameters ``rows``, each of ``chars`` at most, even over the languages)
to the driver. Prediction reads every whole text in Python workers; the model is one table of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keelson.llm.staging import documents, short_batches
from keelson.llm.text import BLANK, Words, buffers

TABLE_BITS = 16
FIT_ROWS = 1200
FIT_CHARS = 20_000
STEP = 32  # words in a block of the chain
#: A longer text is labelled window by window.
WINDOW_BYTES = 4 << 20
BLANK_BYTE, WORD_BYTE = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[^\x20\x09-\x0D]")
UND = "und"


def _slot(code: np.ndarray, order: int) -> np.ndarray:
    """Table row of a feature; row 0 is kept for "no feature"."""
    x = (code + np.uint64(order << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return np.maximum(x >> np.uint64(64 - TABLE_BITS), np.uint64(1)).astype(np.int64)


def features(texts: list[bytes]) -> tuple[Words, np.ndarray, list[np.ndarray]]:
    """Words, the table row of each word itself, and for n = 2, 3, 4 that of the n bytes at each place."""
    w = Words(texts, lower=True)
    d = np.concatenate(([np.uint8(10)], w.data, np.full(4, 10, dtype=np.uint8)))
    blank = BLANK[d]
    code, rows, n = d[: len(w.data)].astype(np.uint64), [], len(w.data)
    for k in (1, 2, 3):
        code = code | d[k : k + n].astype(np.uint64) << np.uint64(8 * k)
        slot = _slot(code, k)
        if k > 1:
            # A blank may stand first or last only: no n-gram spans two words.
            inner = blank[1 : 1 + n].copy()
            for j in range(2, k):
                inner |= blank[j : j + n]
            slot[inner] = 0
        rows.append(slot)
    return w, _slot(w.hashes(), 0), rows


def word_scores(weights: np.ndarray, w: Words, lexicon: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sum of the weights of each word's features, one column per label."""
    sums = np.zeros((len(w.data) + 1, weights.shape[1]))
    per_place = weights[rows[0]] + weights[rows[1]] + weights[rows[2]]
    np.cumsum(per_place, axis=0, out=sums[1:])
    # Place p of ``rows`` begins one byte before byte p of the text.
    return sums[w.end] - sums[w.start] + weights[lexicon]


class Chain:
    """Label probabilities of many sequences at once.

    Sequences are cut into blocks of STEP words. A block is a product of L x L matrices, taken for all
    blocks together; the blocks of a sequence are then linked in order, and each block is walked
    once forward and once backward from its exact start and end.
    """

    def __init__(self, trans: np.ndarray, scores: np.ndarray, counts: np.ndarray, starts: bool = True):
        """Without ``starts``, the first word of each sequence follows another, unseen one."""
        self.a = np.exp(trans - trans.max())
        labels = scores.shape[1]
        blocks = -(-counts // STEP)
        self.first_block = np.concatenate(([0], np.cumsum(blocks)))
        nb = int(self.first_block[-1])
        seq = np.repeat(np.arange(len(counts)), blocks)
        nth = np.arange(nb) - self.first_block[seq]
        self.real = (nth * STEP)[:, None] + np.arange(STEP)[None, :] < counts[seq][:, None]
        e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        own = np.ones((nb, STEP, labels))
        own[self.real] = e
        self.e = np.ascontiguousarray(own.transpose(1, 0, 2))
        self.head = np.flatnonzero(nth == 0) if starts else np.zeros(0, dtype=np.int64)
        #: For each step, the blocks that have ended before it.
        self.past = [np.flatnonzero(~self.real[:, t]) for t in range(STEP)]
        self.blocks, self.nb, self.labels = blocks, nb, labels

    def _step(self, v: np.ndarray, t: int) -> np.ndarray:
        """From before word t to after it: rows times transitions times emissions; a head has no transition."""
        moved = (v.reshape(-1, self.labels) @ self.a).reshape(v.shape)
        if t == 0:
            moved[self.head] = v[self.head]
        moved *= self.e[t] if v.ndim == 2 else self.e[t][:, None]
        past = self.past[t]
        moved[past] = v[past]
        return moved

    def _products(self) -> np.ndarray:
        """Each block as one matrix, up to a factor."""
        m = np.broadcast_to(np.eye(self.labels), (self.nb, self.labels, self.labels)).copy()
        for t in range(STEP):
            m = self._step(m, t)
            if t % 8 == 7:
                m /= m.max(axis=(1, 2), keepdims=True)
        return m

    def product(self) -> np.ndarray:
        """The only sequence as one matrix, up to a factor."""
        out = np.eye(self.labels)
        for m in self._products():
            out = out @ m
            out /= out.max()
        return out

    def marginals(self) -> np.ndarray:
        """Label probabilities of each word."""
        return self.expected()[0]

    def expected(self, pairs: bool = False, entry: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Label probabilities of each word and, with ``pairs``, the expected number of transitions.

        ``entry`` and ``leave`` are what comes in before the first word and from after the last one, if a single sequence
        is a part of a longer one.
        """
        nb, labels = self.nb, self.labels
        m = self._products()
        into, out = np.full((nb, labels), 1.0 / labels), np.ones((nb, labels))
        if entry is not None:
            into[0], out[-1] = entry, leave
        order = np.argsort(-self.blocks, kind="stable")
        longest = int(self.blocks.max()) if len(self.blocks) else 0
        n_with = np.searchsorted(-self.blocks[order], -np.arange(longest), side="left")
        for k in range(1, longest):
            at = self.first_block[order[: n_with[k]]] + k
            x = np.einsum("bi,bij->bj", into[at - 1], m[at - 1])
            into[at] = x / x.sum(axis=1, keepdims=True)
        for k in range(longest - 1, 0, -1):
            at = self.first_block[order[: n_with[k]]] + k
            x = np.einsum("bij,bj->bi", m[at], out[at])
            out[at - 1] = x / x.max(axis=1, keepdims=True)
        alpha, before = np.empty((STEP, nb, labels)), np.empty((STEP if pairs else 0, nb, labels))
        v = into
        for t in range(STEP):
            if pairs:
                before[t] = v
            v = self._step(v, t)
            if t % 8 == 7:
                v /= v.sum(axis=1, keepdims=True)
            alpha[t] = v
        beta, moves = out, np.zeros((labels, labels))
        for t in range(STEP - 1, -1, -1):
            alpha[t] *= beta
            if pairs:
                has = self.real[:, t].copy()
                if t == 0:
                    has[self.head] = False
                # P(label, next label): what came before, the transition, the next word, what comes after it.
                joint = before[t][has][:, :, None] * self.a * (self.e[t] * beta)[has][:, None, :]
                moves += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            # Beyond the last word nothing moves.
            back = (self.e[t] * beta) @ self.a.T
            past = self.past[t]
            back[past] = beta[past]
            if t == 0:
                continue
            beta = back
            if t % 8 == 0:
                beta /= beta.max(axis=1, keepdims=True)
        p = alpha.transpose(1, 0, 2)[self.real]
        return p / p.sum(axis=1, keepdims=True), moves


class Model:
    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << TABLE_BITS, len(labels)), dtype=np.float32)
        self.trans = np.zeros((len(labels), len(labels)))

    def fit(self, texts: list[bytes], langs: list[str], epochs: int = 3, batch: int = 40, rate: float = 0.3, l2: float = 1e-4) -> Model:
        """Maximum likelihood by adaptive gradient steps; the order of rows is given, so refits agree."""
        y = np.array([self.labels.index(x) for x in langs])
        grad2, trans2 = np.full(self.weights.shape, 1e-2, dtype=np.float32), np.full(self.trans.shape, 1.0)
        n_labels = len(self.labels)
        for _ in range(epochs):
            for k in range(0, len(texts), batch):
                w, lexicon, rows = features(texts[k : k + batch])
                counts = w.count
                if not counts.sum():
                    continue
                chain = Chain(self.trans, word_scores(self.weights, w, lexicon, rows), counts)
                p, moves = chain.expected(pairs=True)
                truth = np.repeat(y[k : k + batch], counts)
                g = p.copy()
                g[np.arange(len(g)), truth] -= 1
                per_place = np.zeros((len(w.data) + 1, n_labels))
                np.add.at(per_place, w.start, g)
                np.subtract.at(per_place, w.end, g)
                per_place = np.cumsum(per_place, axis=0)[:-1]
                step = np.zeros(self.weights.shape, dtype=np.float32)
                for c in range(n_labels):
                    for r, v in [(lexicon, g[:, c])] + [(x, per_place[:, c]) for x in rows]:
                        step[:, c] += np.bincount(r, weights=v, minlength=len(step)).astype(np.float32)
                step = step / len(g) + l2 * self.weights
                step[0] = 0
                grad2 += step * step
                self.weights -= rate * step / np.sqrt(grad2)
                seen = np.zeros(self.trans.shape)
                np.add.at(seen, (y[k : k + batch], y[k : k + batch]), np.maximum(counts - 1, 0))
                t = (moves - seen) / len(g) + l2 * self.trans
                trans2 += t * t
                self.trans -= rate * t / np.sqrt(trans2)
        return self

    def _scores(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        w, lexicon, rows = features(texts)
        return w, word_scores(self.weights, w, lexicon, rows)

    def label(self, texts: list[bytes]) -> tuple[Words, np.ndarray]:
        """The words of some texts and their label probabilities."""
        w, scores = self._scores(texts)
        return w, Chain(self.trans, scores, w.count).marginals()

    def means(self, texts: list[bytes], window: int = WINDOW_BYTES) -> tuple[np.ndarray, np.ndarray]:
        """Mean label probabilities of each text (even without words) and the number of its changes of label."""
        if len(texts) == 1 and len(texts[0]) > window:
            return self._means_by_windows(texts[0], window)
        w, p = self.label(texts)
        mean, has = np.full((len(texts), len(self.labels)), 1.0 / len(self.labels)), w.count > 0
        if has.any():
            mean[has] = np.add.reduceat(p, w.first[:-1][has], axis=0) / w.count[has][:, None]
        top, of = p.argmax(axis=1), w.text_of()
        edge = (top[1:] != top[:-1]) & (of[1:] == of[:-1])
        return mean, np.bincount(of[1:][edge], minlength=len(texts))

    def _means_by_windows(self, text: bytes, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long text: the chain's state is carried from window to window, so the result is that of the whole.

        A first pass takes each window as one matrix; the second reads it again between what comes in from both sides.
        """
        parts, n_labels = list(windows(text, window)), len(self.labels)
        chain = lambda k, w, scores: Chain(self.trans, scores, w.count, starts=k == 0)
        matrices = [chain(k, *self._scores([text[a:b]])).product() for k, (a, b) in enumerate(parts)]
        entry, leave = [np.full(n_labels, 1.0 / n_labels)], [np.ones(n_labels)]
        for m in matrices[:-1]:
            entry.append(entry[-1] @ m / (entry[-1] @ m).sum())
        for m in matrices[:0:-1]:
            leave.append(m @ leave[-1] / (m @ leave[-1]).max())
        total, words, changes, last = np.zeros(n_labels), 0, 0, None
        for k, (a, b) in enumerate(parts):
            w, scores = self._scores([text[a:b]])
            p = chain(k, w, scores).expected(entry=entry[k], leave=leave[-1 - k])[0]
            top = p.argmax(axis=1)
            changes += int((top[1:] != top[:-1]).sum()) + int(last is not None and last != top[0])
            total, words, last = total + p.sum(axis=0), words + len(p), top[-1]
        mean = total / words if words else np.full(n_labels, 1.0 / n_labels)
        return mean[None], np.array([changes])


def windows(text: bytes, window: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole words, with at least one, of about ``window`` bytes; each but the ends has the blank on either side."""
    at, n = 0, len(text)
    while m := WORD_BYTE.search(text, at):
        cut = BLANK_BYTE.search(text, max(at + window, m.start()))
        end = cut.start() if cut else n
        yield at, min(end + 1, n)
        at = end


def fit_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, chars: int) -> tuple[list[bytes], list[str]]:
    """``rows`` labelled rows at most, those of the smallest hashes of identifier and text, as many of each language as can be; repeated rows count once."""
    usable = docs.select(
        F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"), F.col(text_col).alias("_t"), F.col(lang_col).alias("_l")
    ).where(F.col("_l").isNotNull() & F.col("_t").isNotNull() & (F.length("_t") <= chars))
    # Copies are one row, whatever their number. Hashes are dealt evenly: of each of 64 parts of a language, four times its
    # share is enough to choose from. Spark keeps no more of them in each task before they are shuffled.
    nth = lambda *by: F.row_number().over(Window.partitionBy("_l", *by).orderBy("_h"))
    once = usable.select("_h", "_l").distinct().withColumn("_p", F.pmod("_h", F.lit(64)))
    some = once.withColumn("_n", nth("_p")).where(F.col("_n") <= rows // 16 + 16)
    ranked = some.select("_h", "_l").withColumn("_n", nth()).where(F.col("_n") <= rows)
    chosen = ranked.orderBy("_n", "_l", "_h").limit(rows).select("_h", "_l")
    # ``chosen`` has ``rows`` rows at most, and of each one text comes back.
    got = usable.join(F.broadcast(chosen), ["_h", "_l"], "left_semi").groupBy("_h", "_l").agg(F.min("_t").alias("_t")).collect()
    got = sorted(got, key=lambda r: (r["_h"], r["_t"], r["_l"]))
    return [r["_t"].encode() for r in got], [r["_l"] for r in got]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model:
    """A model from labelled rows; labels are the values of ``lang_col`` in the sample, of which there may be ``rows`` at most."""
    texts, langs = fit_sample(docs, id_col, text_col, lang_col, rows, chars)
    return Model(sorted(set(langs))).fit(texts, langs)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def _predict(model: Model, carried: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in buffers(b.column(1)):
                mean, edges = model.means(texts)
                best = mean.argmax(axis=1)
                n = len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0)[at : at + n],
                        b.column(2)[at : at + n],
                        pa.array([model.labels[k] for k in best], pa.string()),
                        pa.array(np.clip(mean[np.arange(n), best], 0, 1)),
                        pa.array(edges.astype(np.int64)),
                        *([b.column(3)[at : at + n]] if carried else []),
                    ],
                    names=["id", "has_letter", "lang_pred", "score", "n_switches", *(["row"] if carried else [])],
                )

    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, lang_pred, score, n_switches (changes of language between words).

    With ``carry``, a last column ``row`` is a struct of the row's own columns, so the verdict stays with it.

    A text that is null or has no letter is "und" with score 0, and so is every text if the model
    has no labels. Of languages with equal scores the first by name is said. Repeated rows get their own result, whatever
    their identifiers; an empty table gives an empty one; other columns are ignored. A text of any length is read as a
    whole, by windows. Nothing but the text enters a prediction.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), has_letter(F.col(text_col)).alias("has_letter"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    also = ["row"] if carry else []
    if not model.labels:
        return rows.select(F.col("id").alias(id_col), F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_switches"), *also)
    schema = StructType.fromDDL("id long, has_letter boolean, lang_pred string, score double, n_switches long")
    if carry:
        schema = schema.add("row", rows.schema["row"].dataType)
    got = rows.mapInArrow(_predict(model, carry), schema)
    return got.select(
        F.col("id").alias(id_col),
        F.when(F.col("has_letter"), F.col("lang_pred")).otherwise(UND).alias("lang_pred"),
        F.when(F.col("has_letter"), F.col("score")).otherwise(0.0).alias("score"),
        "n_switches",
        *also,
    )


def fold(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def op9_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(fold() != 1))
    return predict(docs, model).select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_switches")
