"""Exact dedup, mixing, sharding, quality rules and license scans on the small corpus."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import license_scan, license_texts, mixing, quality, sharding
from keelson.llm.exact_dedup import content_sort
from tests.llm.corpus import TEXTS, frame, words


def ascii_lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
def test_content_sort(spark, keep, best):
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[ascii_lower(t)].append(i)
    expected = {i: (best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    rows = content_sort(frame(spark), keep=keep).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == expected
    assert content_sort(frame(spark).limit(0)).count() == 0


def test_mix(spark):
    rows = mixing.mix(frame(spark)).collect()
    size = {i: len(words(t)) for i, t in enumerate(TEXTS)}
    total = defaultdict(int)
    for r in rows:
        assert r["size"] == size[r["doc_id"]]
        total[r["source"]] += r["size"]
    assert len(rows) == len(TEXTS)
    order = sorted((s for s in total if s is not None)) + [None]
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(total.values()), set(order)
    while True:
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
        free -= over
        left = 1.5 * sum(total.values()) - sum(target.values())
    for s in free:
        target[s] = left * w[s] / sum(w[x] for x in free)
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == total[r["source"]]
        rate = r["target"] / r["source_size"]
        assert math.floor(rate) * r["size"] <= r["taken"] <= math.ceil(rate) * r["size"] <= 2 * r["size"]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(frame(spark).repartition(3)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    out = mixing.emit(frame(spark))
    assert out.columns == frame(spark).columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter({r["doc_id"]: r["copies"] for r in rows if r["copies"]})
    assert mixing.mix(frame(spark).limit(0)).count() == 0


def test_mix_comes_near_its_target(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2]) for i in range(4000)], "doc_id long, text string, source string")
    for s, t, got in mixing.mix(df).groupBy("source", "target").sum("taken").collect():
        assert abs(got - t) < 0.05 * t


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards(spark, shards):
    rows = sharding.shard(frame(spark), shards=shards).collect()
    assert len(rows) == len(TEXTS)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        body = (TEXTS[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 16 and r["text_crc32"] == zlib.crc32(body)
        by_text[body].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values()) and all(0 <= s < shards for s in slots)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(frame(spark).limit(0)).count() == 0


def test_smallest_capacity():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes, shards = rng.integers(1, 30, rng.integers(1, 40)), int(rng.integers(1, 8))
        best = [int(x) for x in accumulate(sizes)]  # one shard
        for _ in range(shards - 1):  # the smallest maximum, by dynamic programming
            best = [min([best[i]] + [max(best[j], int(sizes[j + 1 : i + 1].sum())) for j in range(i)]) for i in range(len(sizes))]
        capacity, cuts = sharding.minimax_cuts(sizes.astype(np.int64), shards)
        assert capacity == best[-1] and len(cuts) < shards


def test_capacity_of_the_table_is_exact_however_coarse_the_units(spark):
    """A whole table sharded through 8 units at a time has the largest shard that all its groups at once would give."""
    rng = np.random.default_rng(9)
    texts = ["x" * int(n) + str(k) for k, n in enumerate(rng.integers(0, 3000, 400))] + ["y" * 5000] * 3 + [None, None, ""]
    groups = defaultdict(int)
    for t in texts:
        body = (t or "").encode()
        groups[hashlib.sha256(body).hexdigest()] += len(body) + 16
    sizes = np.array([groups[k] for k in sorted(groups)], dtype=np.int64)
    for shards in (5, 40):
        want, _ = sharding.minimax_cuts(sizes, shards)
        for units in (8, 65536):
            rows = sharding.shard(frame(spark, texts), shards=shards, units=units).collect()
            total, slots = defaultdict(int), defaultdict(list)
            for r in rows:
                total[r["shard"]] += r["size"]
                slots[r["shard"]].append(r["slot"])
            assert max(total.values()) == want and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("units", [64, 1024])
def test_units_of_one_bucket_are_refined_apart(spark, monkeypatch, units):
    """Few buckets, many shards: a bucket has several open units, of unlike width. The capacity is that of all groups at once, after a few rounds."""
    asked, plain = [], sharding.undecided

    def counting(*args):
        asked.append(plain(*args))
        assert len(asked) < 20, "the search doesn't end"
        return asked[-1]

    monkeypatch.setattr(sharding, "undecided", counting)
    rng = np.random.default_rng(units)
    sizes = np.where(rng.random(6000) < 0.02, rng.integers(5000, 20000, 6000), rng.integers(16, 900, 6000))
    bucket = np.sort(rng.integers(0, 3, 6000))
    ends = np.concatenate([np.cumsum(sizes[bucket == b]) for b in range(3)])
    nth = np.concatenate([np.arange(1, (bucket == b).sum() + 1) for b in range(3)])
    rows = list(zip(bucket.tolist(), ends.tolist(), sizes.tolist(), [1] * 6000, nth.tolist()))
    groups = spark.createDataFrame(rows, "_bucket int, _b_end long, _group_b long, _group_n long, _n_end long")
    capacity, known = sharding.units_of(groups, 40, units)
    assert asked and capacity == sharding.minimax_cuts(sizes, 40)[0]
    assert sum(r[2] - r[1] for r in known) == sizes.sum() and sum(r[3] for r in known) == sum(r[5] for r in known) == 6000
    assert all(a[2] == b[1] for a, b in zip(known, known[1:]) if a[0] == b[0])  # no gaps, no overlaps


def test_shards_of_null_and_repeated_identifiers(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (3, "a"), (3, "b"), (3, "b"), (None, None)], "doc_id long, text string")
    rows = sharding.shard(docs, shards=2).collect()
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_text[r["text_crc32"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 6 and all(len(x) == 1 for x in by_text.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_cuts_are_the_most_even_within_the_capacity():
    rng = np.random.default_rng(4)
    for trial in range(60):
        sizes, shards = rng.integers(1, 30, rng.integers(1, 30)), int(rng.integers(1, 8))
        if trial % 2:
            sizes[rng.integers(len(sizes))] = 200
        capacity, cuts = sharding.minimax_cuts(sizes.astype(np.int64), shards)
        ends = [0] + [int(x) for x in accumulate(sizes)]
        square = lambda i, j: (ends[i] - ends[j]) ** 2 if ends[i] - ends[j] <= capacity else math.inf
        best = [0] + [math.inf] * len(sizes)
        for _ in range(shards):
            best = [0] + [min(best[i], min(best[j] + square(i, j) for j in range(i))) for i in range(1, len(ends))]
        parts = np.diff([0, *cuts, ends[-1]])
        assert set(cuts) <= set(ends) and max(parts) <= capacity and int((parts**2).sum()) == best[-1]
        assert len(parts) == min(shards, len(sizes)) and min(parts) > 0


@pytest.mark.parametrize("share", [0.05, 1 / 3])
def test_shards_beside_a_large_group_are_even(spark, share):
    texts = [f"{i} " + "x" * 300 for i in range(3000)]
    copies = int(len(texts) * share / (1 - share))
    rows = sharding.shard(frame(spark, texts + ["y" * 300] * copies)).groupBy("shard").sum("size").collect()
    sizes = sorted(r[1] for r in rows)
    assert len(sizes) == sharding.SHARDS and sizes[-1] < 1.01 * 316 * copies
    mean = sum(sizes[:-1]) / (len(sizes) - 1)
    assert 0.6 * mean < sizes[0] and sizes[-2] < 1.4 * mean


def brute_quality(t):
    t = t or ""
    w = [x.decode() for x in words(t)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality(spark):
    rows = quality.quality_rules(frame(spark)).collect()
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows}
    assert got == {i: brute_quality(t) for i, t in enumerate(TEXTS)}
    assert all(not r["kept"] for r in rows if r["base_failed"])
    assert quality.quality_rules(frame(spark).limit(0)).count() == 0


def test_quality_where_hashes_collide(spark, monkeypatch):
    """With one hash for all windows, equal ones are far apart and still found."""
    from pyspark.sql import functions as F

    monkeypatch.setattr("keelson.llm.quality.window_hash", lambda w, i: F.lit(0).cast("long"))
    texts = [t for t in TEXTS if t is None or len(t) < 2000]
    got = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(frame(spark, texts)).collect()}
    assert got == {i: brute_quality(t)[4] for i, t in enumerate(texts)}


def test_quality_of_a_long_text_filtered(spark):
    """A filter on the verdict doesn't work the words of a long text out anew for each of them."""
    text = " ".join(f"word{k % 12_001} of" for k in range(15_000))
    rows = spark.createDataFrame([(1, text), (2, "short"), (None, None)], "doc_id long, text string")
    kept = quality.quality_rules(rows).where("kept AND n_repeat_words >= 0").collect()
    assert [(r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in kept] == [(1, 30_000, brute_quality(text)[4])]


def test_quality_of_a_language_without_stop_words(spark):
    text = " ".join(f"slowo{k}" for k in range(60))
    rows = spark.createDataFrame([(1, text, "pl"), (1, text, "en"), (None, text, None), (2, "the " + text, "pl")], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["kept"], r["n_stop_words"]) for r in quality.quality_rules(rows, lang_col="lang").collect()), key=str)
    assert got == sorted([(1, True, None), (1, False, 0), (None, False, 0), (2, True, None)], key=str)


def test_license_spans(spark):
    texts = [None, "", "nothing here", "é Released under the MIT License. And Licensed under CC BY-NC 4.0.", (license_texts.MIT_GRANT + ", " + license_texts.MIT_TERMS).replace("free of charge", "at no cost")]
    rows = license_scan.license_scan(frame(spark, texts)).collect()
    found = {(r["doc_id"], r["license"], texts[r["doc_id"]][r["start"] : r["end"]][:12]) for r in rows}
    assert found == {(3, "MIT", "Released und"), (3, "CC-BY-NC-4.0", "Licensed und"), (4, "MIT", "Permission i")}
    part = next(r for r in rows if r["doc_id"] == 4)
    assert 0.9 < part["coverage"] < 1 and part["matched_words"] < part["template_words"]
    assert license_scan.license_scan(frame(spark, texts), templates=[]).count() == 0


_FILE = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License"
_LATER = ", or (at your option) any later version."


@pytest.mark.parametrize(
    "text,license",
    [
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 3.0. 12 files follow", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 3 or later.", "GPL-3.0-or-later"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This work is licensed under the GNU General Public License, version 1.", None),
        ("This work is licensed under the GNU Free Documentation License, version 3.", None),
        ("This program is free software; " + _FILE.format("", "2") + _LATER, "GPL-2.0-or-later"),
        ("This program is free software: " + _FILE.format("", "3") + ".", "GPL-3.0"),
        ("This library is free software; " + _FILE.format("Lesser ", "2.1") + _LATER, "LGPL-2.1-or-later"),
        ("This library is free software; " + _FILE.format("Library ", "2") + _LATER, "LGPL-2.0-or-later"),
        ("This program is free software: " + _FILE.format("Affero ", "3") + _LATER, "AGPL-3.0-or-later"),
        ("Licensed under CC BY 3.0.", "CC-BY-3.0"),
        ("Licensed under CC BY 2.5.", "CC-BY-2.5"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY 4.7.", None),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Licensed under the Apache License, Version 1.1.", None),
        ("Released under the BSD License.", None),
        ("Released under the MIT License.", "MIT"),
    ],
)
def test_license_of_the_right_version_and_variant(text, license):
    index = license_scan.Index(license_scan.TEMPLATES)
    found = [r[1] for r in license_scan.scan(index, [b"some words before", f"We say. {text} And more".encode()], license_scan.MIN_COVERAGE)]
    assert found == ([license] if license else [])


def test_alignment_equals_full_table():
    """In a band as wide as the text, matched words are those of an unbanded dynamic programme."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 15)
        n, first, end, path, score = license_scan.traced(a, b, 0, band=40)
        assert 0 <= first < end <= len(b) and n <= end - first
        full = 0.0
        m = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1, j + 1] = m[i, j] + 1 if x == y else max(0, m[i, j] - 0.3, m[i, j + 1] - 0.2, m[i + 1, j] - 0.2)
                full = max(full, m[i + 1, j + 1])
        assert score == pytest.approx(full) and len(path) == n
        assert all(a[i] == b[j] for i, j in path.items()) and sorted(path.values()) == [path[i] for i in sorted(path)]


def brute_licenses(text):
    """Every template against every text word as start, in full tables: no fingerprints, no band."""
    w = [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", text.lower()) if x]
    codes = {x: k for k, x in enumerate(dict.fromkeys(w))}
    found = []
    for name, template, *_ in license_scan.TEMPLATES:
        t = [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", template.lower()) if x]
        n, a, b, _, _ = license_scan.traced(np.array([codes.get(x, -1) for x in t]), np.array([codes[x] for x in w]), 0, band=len(w) + len(t))
        if n >= license_scan.MIN_COVERAGE * len(t):
            found.append((n, a - b, name))
    return max(found)[2] if found else None


def test_scan_equals_brute_force():
    """Templates with some words changed, left out or put in, between other words: the license and what is matched."""
    rng, index = np.random.default_rng(6), license_scan.Index(license_scan.TEMPLATES)
    some = [t for t in license_scan.TEMPLATES if not t[2]]
    hits = 0
    for trial in range(30):
        words_ = some[trial % len(some)][1].split()
        for _ in range(int(rng.integers(0, max(1, len(words_) // 8)))):
            k = int(rng.integers(len(words_)))
            words_[k : k + 1] = [[], ["other"], [words_[k], "extra"]][trial % 3]
        text = prose_words(rng, 30) + " " + " ".join(words_) + " " + prose_words(rng, 30)
        got = [r[1] for r in license_scan.scan(index, [text.encode()], license_scan.MIN_COVERAGE)]
        want = brute_licenses(text)
        assert got == ([want] if want else []), text
        hits += bool(want)
    assert hits > 15


def prose_words(rng, n):
    return " ".join("w" + str(x) for x in rng.integers(0, 50, n))


def test_content_sort_of_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "A"), (3, "b"), (None, "B"), (None, None), (4, "")], "doc_id long, text string")
    rows = content_sort(docs, keep="largest").collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["kept"]) for r in rows) == [
        ("3", "3", True), ("4", "4", True), ("None", "3", False), ("None", "4", False), ("None", "None", True), ("None", "None", True)
    ]


def test_content_sort_of_long_texts_repeats_and_large_groups(spark, monkeypatch):
    """Texts that differ behind a long common head; one text in most rows, with null and repeated identifiers."""
    head = "x" * 50_000
    texts = [(k, head + str(k % 3)) for k in range(9)] + [(None, "Hot"), (7, "hot"), (7, "HOT")] + [(100 + k, "hot") for k in range(60)] + [(None, "cold"), (None, "Cold")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for pieces in (1000, 4):
        monkeypatch.setattr("keelson.functions.skew.PIECES", pieces)
        rows = content_sort(docs, keep="largest").collect()
        got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
        want = [(k, 6 + k % 3, 3, k >= 6) for k in range(9)] + [(i, 159, 63, i == 159) for i, t in texts[9:-2]] + [(None, None, 2, True)] * 2
        assert got == Counter(want)


def test_mix_of_null_and_repeated_identifiers(spark):
    import duckdb

    rows = [(None, "a b c", "s"), (None, "d", None), (7, "e f", "s"), (7, "g", "t"), (7, "e f", "s"), (8, None, "u"), (9, "h " * 40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((tuple(r) for r in mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert got == sorted(con.execute(mixing.ORACLE).fetchall(), key=str)
    assert mixing.emit(docs).columns == docs.columns


@pytest.mark.parametrize("ids", ["null", "one", "one and equal texts"])
def test_mix_comes_near_its_target_without_identifiers(spark, ids):
    """Rows that share an identifier, or have none, don't share a coin; SQL agrees, and reruns over other partitions."""
    import duckdb

    rows = [(None if ids == "null" else 7, "w " * (1 + i % 9) + ("" if "equal" in ids else str(i)), "abc"[i % 3]) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs)
    for s, t, taken in got.groupBy("source", "target").sum("taken").collect():
        assert abs(taken - t) < 0.05 * t, s
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    want = Counter(map(str, con.sql(f"SELECT {', '.join(cols)} FROM ({mixing.ORACLE})").fetchall()))
    assert Counter(str(tuple(r)) for r in got.select(*cols).collect()) == want == Counter(str(tuple(r)) for r in mixing.mix(docs.repartition(7)).select(*cols).collect())
    emitted = {r["source"]: r["n"] for r in mixing.emit(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert emitted == {r["source"]: r["n"] for r in got.groupBy("source").agg(F.sum("copies").alias("n")).collect()}


def test_whole_licenses_are_told_from_their_neighbours(spark):
    """Wrapped, numbered, with holders, some words changed, in the middle of another text; and parts that two licenses share."""
    from keelson.llm import license_texts as t

    mit, bsd, isc = f"{t.MIT_GRANT}, {t.MIT_TERMS}", t.BSD_TWO.replace("met: ", "met:\n 1. ").replace("disclaimer. R", "disclaimer.\n 2. R"), f"{t.ISC_GRANT}, {t.ISC_TERMS}"
    cases = {
        "MIT": [mit, f"{mit}\n\n{t.MIT_DISCLAIMER}"], "MIT-0": [f"{t.MIT_GRANT}.\n{t.MIT_DISCLAIMER}"], "X11": [f"{mit} {t.MIT_DISCLAIMER} {t.X11_CLAUSE.replace('copyright holders', 'Consortium')}"],
        "BSD-2-Clause": [f"{bsd}\n{t.BSD_DISCLAIMER}"], "BSD-3-Clause": [f"{bsd}\n 3. {t.BSD_THIRD.replace('copyright holder', 'Example Inc.')}\n{t.BSD_DISCLAIMER}", f"{bsd} {t.BSD_THIRD}"], "BSD": [bsd],
        "ISC": [isc, f"{isc}\n{t.ISC_DISCLAIMER}"], "0BSD": [f"{t.ISC_GRANT}.\n{t.ISC_DISCLAIMER}"], "Unlicense": [t.UNLICENSE], "Zlib": [t.ZLIB.replace("The origin", "1. The origin")], "BSL-1.0": [t.BOOST, t.BOOST_NOTICE],
        "PostgreSQL": [t.POSTGRESQL], "CC0-1.0": [t.CC0_NOTICE], "MPL-2.0": [t.MPL_NOTICE], "EPL-2.0": [t.EPL_NOTICE], "EUPL-1.2": [t.EUPL_NOTICE], "OFL-1.1": [t.OFL_NOTICE], "Artistic-2.0": [t.ARTISTIC_NOTICE],
        "Apache-2.0": [t.APACHE_NOTICE],
    }
    want, texts = [], []
    for name, own in cases.items():
        for body in own:
            for text in (body, "Copyright (c) 2020 Some Body\n" + body.replace(". ", ".\n * ") + "\n" + "unlike " * 50, "so " * 400 + body.upper() + " and on " * 400):
                want.append(name)
                texts.append(text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in license_scan.license_scan(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    assert [(want[i], got.get(i)) for i in range(len(want)) if got.get(i) != [want[i]]] == []


def test_license_scan_of_a_very_long_text_and_of_nothing(spark):
    from keelson.llm.license_texts import ZLIB

    long = "word " * 200_000 + ZLIB + " word" * 200_000
    docs = spark.createDataFrame([(1, long), (2, ""), (3, None), (4, "x" * 1_000_000)], "doc_id long, text string")
    rows = license_scan.license_scan(docs).collect()
    assert [(r["doc_id"], r["license"], r["start"], r["end"]) for r in rows] == [(1, "Zlib", 1_000_000, 1_000_000 + len(ZLIB) - 1)]
    assert license_scan.license_scan(docs.limit(0)).count() == 0 and license_scan.license_scan(docs, templates=[]).count() == 0


def test_license_rows_are_reported_each(spark):
    text = "Released under the MIT License."
    docs = spark.createDataFrame([(None, text, 1), (3, text, 2), (3, text, 3), (4, None, 4)], "doc_id long, text string, license long")
    rows = license_scan.license_scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["license"]) for r in rows) == [("3", "MIT"), ("3", "MIT"), ("None", "MIT")]
