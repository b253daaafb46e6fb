from collections import Counter

import pytest

from keelson.llm.graph import components
from keelson.llm.minhash import BANDS, ROWS, confirmed, least_matches, near_duplicates, shingle_texts
from tests.llm.corpus import TEXTS, frame, words

TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(texts, num, den):
    sets = []
    for t in texts:
        w = [x.translate(TO_LOWER) for x in words(t)]
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(sets)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and den * both >= num * len(sets[i] | sets[j]) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return {i: (len(s), label[i], label[i] == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("block,block_bytes", [(2000, 1 << 25), (3, 1 << 25), (2000, 1000)])
@pytest.mark.parametrize("threshold", [(85, 100), (80, 100)])
def test_equals_brute_force(spark, threshold, block, block_bytes):
    rows = near_duplicates(frame(spark), threshold=threshold, block=block, block_bytes=block_bytes).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == brute(TEXTS, *threshold)


def test_rare_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (5, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert rows == {(None, 3, False), (3, 3, True), (5, 5, True)}
    long = " ".join(f"w{k}" for k in range(100))
    df = spark.createDataFrame([(None, long), (None, long), (None, long + " x"), (None, "y"), (9, long + " z"), (4, "q"), (None, " ")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=str)
    assert rows == sorted([(None, 9, False)] * 3 + [(None, None, True)] * 2 + [(9, 9, True), (4, 4, True)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_bands_miss_almost_nothing():
    for t in (0.80, 0.85):
        assert (1 - t**ROWS) ** BANDS < 1e-4
    table = least_matches(0.85, 1e-6)
    assert [n for n, _ in table] == list(range(24, BANDS * ROWS + 1, 24))
    assert all(m < 0.85 * n for n, m in table)


def test_components_of_a_long_path(spark):
    stars = [(200, 201 + k) for k in range(50)] + [(300 + k, 399) for k in range(50)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)] + stars, "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100} | {200 + k: 200 for k in range(51)} | {300 + k: 300 for k in range(50)} | {399: 300}
    assert components(edges.limit(0)).count() == 0


def test_a_link_is_confirmed_on_the_shingles():
    a = b"a b c d e f g h i j k"
    assert shingle_texts(b" A\tb  c ", 5) == {b"a b c"} and shingle_texts(b"", 5) == set()
    assert shingle_texts(a, 5) == {b" ".join(a.split()[k : k + 5]) for k in range(7)}
    assert confirmed(a, a + b" l", 5, (7, 8)) and not confirmed(a, a + b" l m", 5, (7, 8))


def linked_pairs(texts, num, den):
    """All links by shared shingles: an inverted index in plain Python, no signatures."""
    sets, where = [], {}
    for i, t in enumerate(texts):
        w = [x.translate(TO_LOWER) for x in words(t)]
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets.append(s)
        for g in s:
            where.setdefault(g, []).append(i)
    shared = Counter((i, j) for rows in where.values() for k, j in enumerate(rows) for i in rows[:k])
    return sets, {(i, j) for (i, j), n in shared.items() if den * n >= num * (len(sets[i]) + len(sets[j]) - n)}


def test_recall_on_the_tables(spark):
    """Every link of the thousand documents of the table is found, and nothing else: a recall of 1 where 0.9 would do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.orderBy("doc_id").collect()
    sets, pairs = linked_pairs([r["text"] for r in rows], 85, 100)
    label = list(range(len(rows)))
    while True:
        before = label[:]
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
        if before == label:
            break
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs, threshold=(85, 100)).collect()}
    found = sum(got[rows[i]["doc_id"]][1] == got[rows[j]["doc_id"]][1] for i, j in pairs)
    assert len(rows) == 1000 and len(pairs) > 50 and found == len(pairs)
    assert got == {r["doc_id"]: (len(sets[i]), rows[label[i]]["doc_id"], label[i] == i) for i, r in enumerate(rows)}


def test_very_long_texts_are_compared_whole(spark):
    """Two texts of 120,000 words that part only behind their first half, one near copy, one copy with other capitals."""
    head = [f"w{k * 7919 % 50021}" for k in range(60_000)]
    base, other = head + [f"a{k}" for k in range(60_000)], head + [f"b{k}" for k in range(60_000)]
    near = base[:100_000] + ["changed"] + base[100_001:]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, " ".join(near)), (4, " ".join(base).upper())], "doc_id long, text string")
    rows = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs, threshold=(85, 100)).collect()}
    assert rows == {1: (1, True), 2: (2, True), 3: (1, False), 4: (1, False)}
