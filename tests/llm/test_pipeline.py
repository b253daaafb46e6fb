import hashlib
import math
from collections import Counter

import corpus_pipeline as c
from keelson.llm import queries
from tests.llm.corpus import TEXTS, frame
from tests.llm.test_minhash import brute


def test_stages_keep_what_they_should(spark):
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars").cache()
    names = [n for n, _ in c.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "mix", "bpe"]
    kept = c.of_ids(docs, docs.where("text IS NOT NULL"))
    assert kept.columns == docs.columns and kept.count() == sum(t is not None for t in TEXTS)
    exact = c.exact(spark, docs, "")
    low = {}
    for i, t in enumerate(TEXTS):
        low["".join(x.lower() if x.isascii() else x for x in t or "")] = i
    assert {r["doc_id"] for r in exact.collect()} == set(low.values()) and exact.columns == docs.columns
    near = c.near(spark, docs, "")
    assert {r["doc_id"] for r in near.collect()} == {i for i, (_, _, k) in brute(TEXTS, 80, 100).items() if k}
    mixed = c.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    assert c.encode(spark, mixed, "").count() == mixed.count()


def test_language_stage_drops_texts_without_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    extra = spark.createDataFrame([(10**6, "12 34 !!", None, "s", 8), (None, "the and of that", None, "s", 15)], docs.schema)
    out = c.language_id(spark, docs.unionByName(extra), "").collect()
    ids = {r["doc_id"] for r in out}
    assert 10**6 not in ids and None in ids and len(out) == 61
    assert next(r["lang"] for r in out if r["doc_id"] is None)


def test_verdicts_are_of_rows_where_identifiers_are_null_or_repeat(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = lambda pairs: spark.createDataFrame([(i, t, None, "s", 1) for i, t in pairs], schema)
    pairs = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)

    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long = known.where("length(text) > 300 AND lang IS NOT NULL")
    german, english = (long.where(long.lang == x).orderBy("doc_id").first()["text"] for x in ("de", "en"))
    extra = [(None, "12 34 !!"), (None, english), (None, german), (10**6, "56 ??"), (10**6, german), (10**6, english)]
    out = c.language_id(spark, known.unionByName(rows(extra)), "").where("doc_id IS NULL OR doc_id = 1000000").collect()
    assert sorted((str(r["doc_id"]), r["lang"]) for r in out) == [("1000000", "de"), ("1000000", "en"), ("None", "de"), ("None", "en")]

    # Null and 7 lose "one" and "two" to larger identifiers, and keep their other text.
    docs = rows([(None, "One"), (None, "other"), (9, "one"), (7, "two"), (7, "three"), (8, "TWO")])
    assert pairs(c.exact(spark, docs, "")) == sorted([(None, "other"), (9, "one"), (7, "three"), (8, "TWO")], key=str)

    base, more = " ".join(f"w{k}" for k in range(200)), " ".join(f"v{k}" for k in range(200))
    docs = rows([(None, base), (None, base + " a"), (None, more), (5, more + " b"), (6, more + " c"), (6, "apart " * 3 + base[:300]), (6, "alone")])
    left = pairs(c.near(spark, docs, ""))
    assert len(left) == 4 and [t in (base, base + " a") for i, t in left if i is None] == [True]
    assert {(5, more + " b"), (6, "apart " * 3 + base[:300]), (6, "alone")} <= set(left)


def brute_run(rows):
    """ids that language ID, exact and near dedup leave, of rows (doc_id, text) with distinct identifiers."""
    left = {i: t for i, t in rows if t and any(ch.isalpha() for ch in t)}
    last = {}
    for i in sorted(left):
        last["".join(x.lower() if x.isascii() else x for x in left[i])] = i
    left = {i: left[i] for i in sorted(last.values())}
    ids = list(left)
    return {ids[k] for k, (_, _, kept) in brute(list(left.values()), 80, 100).items() if kept}


def brute_copies(rows):
    """How often each of some rows (doc_id, text, source), no two alike, is emitted."""
    size, total = {i: len((t or "").encode().split()) for i, t, _ in rows}, {}
    for i, _, s in rows:
        total[s] = total.get(s, 0) + size[i]
    order = sorted(s for s in total if s is not None) + [None] * (None in total)
    w, target, free, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set(order), 1.5 * sum(total.values())
    while over := {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * total[s]}:
        target |= {s: 2.0 * total[s] for s in over}
        free -= over
        left = 1.5 * sum(total.values()) - sum(target.values())
    target |= {s: left * w[s] / sum(w[x] for x in free) for s in free}
    out = {}
    for i, t, s in rows:
        rate = min(2.0, target[s] / total[s]) if total[s] else 0.0
        coin = int(hashlib.md5(f"mix:{i}:{hashlib.md5((t or '').encode()).hexdigest()}:0".encode()).hexdigest()[:13], 16) / 2**52
        out[i] = math.floor(rate) + (coin < rate - math.floor(rate))
    return out


def test_run_over_a_small_table(spark, tmp_path):
    """All stages in a row against brute force; what is left is emitted as often as its source's rate and its coin say."""
    rows = [(i, t, "en" if i % 2 else None, ["s1", "s2", None][i % 3], 1) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/a/documents.parquet")
    out = Counter(r["doc_id"] for r in c.run(spark, f"file://{tmp_path}/a").collect())
    left = brute_run([(i, t) for i, t, *_ in rows])
    want = brute_copies([(i, t, rows[i][3]) for i, t, *_ in rows if i in left])
    assert out == Counter({i: n for i, n in want.items() if n}) and sum(out.values()) > len(left)


def test_run_with_more_columns_whose_names_clash(spark, tmp_path):
    """Columns named like those that stages use inside come through untouched."""
    more = "id long, lang_pred string, _row long, _id string, row string, kept boolean, text_sha256 string, component_id long, copies long, size long, n_tokens string"
    rows = [(i, t, "en", "s", 1, 1, "x", i, "y", "r", i % 2 == 0, "h", 3, 4, 5, "n") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {more}")
    for name, stage in c.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, "")
        assert docs.columns == before.columns and docs.count() > 10, name
    assert {(r["doc_id"], r["_row"], r["_id"], r["row"], r["kept"]) for r in docs.collect()} <= {(r[0], r[7], r[8], r[9], r[10]) for r in rows}


def test_run_without_labels_rows_or_identifiers(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    english = ["the cat sat on the mat and it was good", "of all the things that are in the house", "12 34", None]
    rows = [(i, t, None, "s", 1) for i, t in zip([None, None, 7, 7], english)] + [(7, english[0].upper(), None, "s", 1), (8, "une chose", None, None, 1)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    out = c.run(spark, f"file://{tmp_path}/b").collect()
    assert {r["doc_id"] for r in out} <= {None, 7, 8} and len(out) >= 3
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert c.run(spark, f"file://{tmp_path}/c").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
