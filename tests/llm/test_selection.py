"""URL filter, importance resampling and hard negatives against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import hard_negatives as hn
from keelson.llm import importance, url_filter
from tests.llm.corpus import TEXTS, frame

# -- URL filter -------------------------------------------------------------
LINK, REFRESH = '<LINK class="x" rel="next Canonical" href="{}">', "<meta content='0; URL={}' http-equiv=refresh>"
PAGES = [
    # a chain over a page that isn't crawled ends at a blocked one
    ("http://a.net/start", LINK.format("http://b.net/mid?x=1&amp;y=2#top")),
    ("https://c.net/end", REFRESH.format("//b.net/mid?x=1&y=2")),
    ("http://c.net/end#here", LINK.format("https://example.org/es/blocked")),
    # the same, but an alias is allowed
    ("http://d.net", "<head>" + LINK.format("/only")),
    ("http://d.net/only", REFRESH.format("http://sub.example.org/en/17")),
    ("http://d.net/", LINK.format("http://shop.COM/fr/good")),
    # own rules win over the component
    ("http://x.com/fr/a", LINK.format("http://x.com/de/a")),
    ("http://x.com/de/a", None),
    ("http://Y.net/dir/page?q", LINK.format("other")),
    ("http://y.net/dir/other", LINK.format("?of=x.com")),
    ("http://y.net/dir/other?of=x.com", REFRESH.format("http://z.example.com/de/")),
    # no links: comments, scripts, mail, fragments, nothing, other relations
    ("http://n1.net/", "<!-- " + LINK.format("http://x.com/de/a") + " -->"),
    ("http://n2.net/", "<script>" + LINK.format("http://x.com/de/a")),
    ("http://n3.net/", LINK.format("mailto:canonical@x.com") + LINK.format("#a") + LINK.format("") + "<link rel=canonical>"),
    ("http://n4.net/", '<link rel="canonicals" href="http://x.com/de/a"><meta http-equiv="refresh" content="5"><style>' + LINK.format("http://x.com/de/a") + "</style>"),
    (None, LINK.format("http://x.com/de/a")),
    ("no scheme/de/", LINK.format("http://x.com/de/a")),
    ("http://", LINK.format("http://x.com/de/a")),
    ("http://a.net/start", LINK.format("http://b.net/mid?x=1&y=2")),
    ("ftp://example.org/en/2?a://b", None),
    ("http://notexample.org/es/1", None),
    ("http://example.org", None),
    ("http://" + "l" * 100_000 + ".com/de/" + "p" * 100_000, "y" * 300_000 + "canonical" + "<link " * 50_000),
]
WANT = {
    "http://a.net/start": "block", "https://c.net/end": "block", "http://c.net/end#here": "block", "http://d.net": "allow", "http://d.net/only": "allow", "http://d.net/": "allow",
    "http://x.com/fr/a": "allow", "http://x.com/de/a": "block", "http://Y.net/dir/page?q": "block", "http://y.net/dir/other": "block", "http://y.net/dir/other?of=x.com": "block",
    "http://example.org": "allow", "http://notexample.org/es/1": "allow", "ftp://example.org/en/2?a://b": "allow",
}


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(i, u, h, "x", "y", None) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, node string, rule string")


def test_url_filter(spark):
    rows = url_filter.url_filter(pages(spark)).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        url = PAGES[r["page_id"]][0]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        assert (r["host"], r["path"]) == ((re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", ""))
        fits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (r["host"] == h or r["host"].endswith("." + h)) and r["path"].startswith(p)]
        assert r["rule"] == (max(fits)[2] if fits else None)
        assert r["verdict"] == (max(fits)[1] if fits else WANT.get(url, "allow")), url
        assert r["alias"] == (not fits and r["verdict"] == "block")
    assert {r["verdict"] for r in rows if r["alias"]} == {"block"} and sum(r["alias"] for r in rows) == 7


def test_url_filter_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(i, u, h) for i, (u, h) in enumerate(PAGES)])
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({url_filter.ORACLE})").fetchall()
    assert sorted(tuple(r) for r in url_filter.url_filter(pages(spark)).select(*cols).collect()) == sorted(want)


def test_url_filter_over_redirects_hubs_and_nothing(spark):
    """A third of all URLs redirect to one; a table of redirects counts beside the pages; null and repeated identifiers."""
    many = [(None if i % 2 else 7, f"http://h{i}.net/", LINK.format("http://hub.net/") if i % 3 == 0 else None) for i in range(300)]
    df = spark.createDataFrame(many, "page_id long, url string, html string")
    moved = spark.createDataFrame([("http://hub.net", "http://www.example.org/es/x"), ("http://h1.net/", "http://h2.net/#f"), (None, "http://h4.net/"), ("nothing", "http://h5.net/")], "src string, dst string")
    rows = url_filter.url_filter(df, redirects=moved).collect()
    assert {int(r["host"][1:-4]) for r in rows if r["verdict"] == "block"} == set(range(0, 300, 3)) and len(rows) == 300
    assert all(r["verdict"] == "allow" for r in url_filter.url_filter(df).collect())
    assert url_filter.url_filter(df.limit(0)).count() == 0
    assert [r["rule"] for r in url_filter.url_filter(df.limit(3), rules=[]).collect()] == [None] * 3


# -- importance resampling --------------------------------------------------
def brute_resample(docs, target, percent, n, buckets, least):
    def bag(t):
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c < 91 else c for c in (t or "").encode()))
        runs = [b" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, n + 1) if i + k <= len(w)]
        return len(w), Counter(zlib.crc32(x) % buckets for x in runs)

    have, s, t = [(i, *bag(x)) for i, x in docs], Counter(), Counter()
    for _, _, b in have:
        s.update(b)
    for x in target:
        t.update(bag(x)[1])
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (a + buckets) / ((s[k] + 1) * (b + buckets)))) for k in range(buckets)]
    rows = []
    for i, w, c in have:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] * v for k, v in c.items())
        rows.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, w >= least])
    can = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(can[: len(can) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("n,percent,buckets,least", [(1, 10, 10000, 20), (2, 50, 97, 5), (3, 100, 1000, 0)])
def test_resample(spark, n, percent, buckets, least):
    extra = ["word " * 50_000, "é" * 200_000, "a1B2 c-d_e É\x00f"]
    rows = [(i, t) for i, t in enumerate([*TEXTS, *extra])] + [(None, TEXTS[10]), (None, "x y"), (3, TEXTS[10]), (12, TEXTS[12]), (12, TEXTS[12])]
    docs = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, rank long, score long, id string")
    target = ["alpha beta gamma", None, "", "straße x1 x1"]
    out = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent, n, buckets, least)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_resample(rows, target, percent, n, buckets, least)


def test_resample_of_nothing(spark):
    none = frame(spark).limit(0)
    assert importance.resample(none, none).count() == 0
    out = importance.resample(frame(spark), none).collect()
    assert len(out) == len(TEXTS) and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, sum(1 for r in out if r["rank"]) + 1))


# -- hard negatives ---------------------------------------------------------
def brute_negatives(rows, positives, negatives, low, high):
    ok = [
        (i, y, np.array([max(-hn.MOST, min(hn.MOST, math.floor(256 * x))) for x in v], dtype=object))
        for i, v, y in rows
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (ai, ay, av) in enumerate(ok):
        if ai is None or ai % 100:
            continue
        s = [(sum(x * z for x, z in zip(av, v)), i, y) for b, (i, y, v) in enumerate(ok) if b != a]
        for p, pi, _ in sorted((x for x in s if x[2] == ay), key=key)[:positives]:
            fit = sorted((x for x in s if x[2] != ay and low * p <= 100 * x[0] <= high * p), key=key)[:negatives]
            out += [(ai, pi, k + 1, ni, p, n) for k, (n, ni, _) in enumerate(fit)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "r") for i, v, y in rows], "vec_id long, embedding array<double>, label int, id int, row string")


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives(spark, small, monkeypatch):
    """All pairs by hand; small blocks and chunks give the same rows as large ones."""
    monkeypatch.setattr(hn, "LEAF", 4)
    rnd, rows = random.Random(3), []
    for i in range(700):
        c = rnd.randrange(3)
        rows.append((i, [rnd.gauss(0.2 * (c == k), 0.15) for k in range(6)], rnd.choice([0, 0, 0, 1, 2])))
    # very many equal vectors, ties, repeats, short and long vectors, rows that take no part
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, 0.1, 0.1], i % 2) for i in range(300)]
    rows += [(100, [0.1] * 6, 1), (100, [0.1] * 6, 1), (None, [0.1] * 6, 1), (800, [], 0), (900, [0.3], 2), (1900, [0.2] * 9, 2), (2000, [1e30, -1e30, 1.0], 1), (2100, [-1e30, 1e30], 1)]
    rows += [(2200, None, 1), (2300, [0.1, None], 1), (2400, [float("nan")], 1), (2500, [float("inf")], 0), (2600, [0.1] * 6, None), (2700, [0.3] * 6, 9)]
    size = {"anchor_block": 3, "row_blocks": 5, "chunk": 37} if small else {}
    got = hn.mine(table(spark, rows), **size).collect()
    want = brute_negatives(rows, 5, 10, 30, 90)
    assert sorted((tuple(r) for r in got), key=str) == want and len(want) > 300


def test_hard_negatives_equal_their_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = hn.op13_hard_negatives(spark, "/root/testdata/sf0.01")
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({hn.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
    assert hn.mine(table(spark, [])).count() == 0
    assert hn.mine(table(spark, [(100, [1.0], 1), (1, [1.0], 1)])).count() == 0  # no other label
    assert hn.mine(table(spark, [(100, [1.0], 1), (1, [0.5], 2)])).count() == 0  # no positive


def test_nodes_are_pruned():
    """Branch and bound scores few rows where vectors come in clusters."""
    rng = np.random.default_rng(0)
    x = np.rint(np.concatenate([rng.normal(0, 3, (500, 8)) + c for c in rng.normal(0, 300, (40, 8))]))
    q, seen = x[:1] + 1, []
    tree = hn.ball(x, np.arange(len(x)), 64)

    class Counting(hn.Best):
        def add(self, window, score, ident, row):
            seen.append(len(row))
            super().add(window, score, ident, row)
            self.cut()

    best = Counting(1, 5)
    ident = np.arange(len(x))
    hn.search(tree, x, ident, ident, q, np.sqrt((q**2).sum(axis=1)), np.array([-1]), np.array([0]), np.full((1, 1), hn._ANY_LOW), np.full((1, 1), hn._ANY_HIGH), best, False)
    s = (q @ x.T)[0]
    order = np.lexsort((ident, -s))[:5]
    assert best.cut()[3].tolist() == order.tolist() and sum(seen) < len(x) / 10


def test_columns_of_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    assert importance.op12_importance(spark, sf).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert url_filter.op11_url_filter(spark, sf).columns == ["page_id", "host", "path", "rule", "verdict"]
    assert dict(hn.op13_hard_negatives(spark, sf).dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert importance.op12_importance(spark, sf).agg(F.count("rank")).first()[0] > 0
