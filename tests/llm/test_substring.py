import hashlib
from collections import Counter

import pytest

from keelson.llm.substring_dedup import sliding_min, substring_dedup
from tests.llm.corpus import TEXTS, frame, words


def brute(texts, window=35):
    docs = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = {}
    for d, w in enumerate(docs):
        gone = {p for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for p in range(i, i + window)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("limits", [{}, {"hot": 2}, {"hot": 2, "wide": 2}])
def test_equals_brute_force(spark, limits):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(frame(spark), **limits).collect()}
    assert got == brute(TEXTS)


def test_repeated_rows_and_null_ids_are_places(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (1, text), (None, "x " * 10), (1, "other")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in substring_dedup(df).collect())
    assert rows == [(-1, 10, 0), (1, 1, 0), (1, 40, 40), (1, 40, 40)]


def test_empty_table(spark):
    assert substring_dedup(frame(spark).limit(0)).count() == 0


def test_sliding_min():
    import numpy as np

    x = np.array([5, 3, 9, 1, 7, 8, 2], dtype=np.uint64)
    for k in range(1, 8):
        assert sliding_min(x, k).tolist() == [min(x[i : i + k]) for i in range(len(x) - k + 1)]
