"""BPE against the public library, language ID against plain forward-backward, PII against regular expressions."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import bpe, langid, pii
from tests.llm.corpus import TEXTS, frame

HARD = TEXTS + ["<|startoftext|>hi<|endoftext|> there", "İstanbul ΣΑΣ ΌΣΟΣ", "it's I'LL ''s", "日本語 한국어 مرحبا", "aaaa" * 500, "½ Ⅷ ²", "é", "a\x1cb\x85c"]


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    for r in bpe.bpe_encode(frame(spark, HARD), bpe.default_path()).collect():
        ids = t.encode(HARD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.bpe_encode(frame(spark).limit(0), bpe.default_path()).count() == 0


def test_every_code_point_is_encoded_as_the_library_does():
    tokenizers = pytest.importorskip("tokenizers")
    t, b = tokenizers.Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    # All that tables may disagree on, and a part of the rest.
    known = {c for a, z in bpe.UNKNOWN for c in (a, z)} | {c for a, z, _ in bpe.CAPITALS for c in range(a, z + 1)}
    for c in sorted(known) + points[:0x3000] + points[0x3000::97]:
        s = f"a{chr(c)}1 b{chr(c)}"
        assert np.frombuffer(b.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids, hex(c)


def test_bpe_of_repeated_and_null_identifiers(spark):
    docs = spark.createDataFrame([(None, "one two", 1), (7, "one two", 2), (7, "three", 3), (None, None, 4)], "doc_id long, text string, ids long")
    rows = bpe.bpe_encode(docs, bpe.default_path()).collect()
    b = bpe.load(bpe.default_path())
    want = [(i, np.frombuffer(b.encode(t or ""), "<u4").tolist()) for i, t in [(None, "one two"), (7, "one two"), (7, "three"), (None, None)]]
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=str) == sorted(want, key=str)


def test_backtracking_equals_merges():
    b, rng = bpe.load(bpe.default_path()), np.random.default_rng(2)
    for _ in range(300):
        w = "".join(rng.choice(list("abcdetnsior"), rng.integers(1, 25)))
        s = w[:-1] + chr(ord(w[-1]) + b.shift)
        assert [b.text[i] for i in b.encode_word(s)] == b.merged(s)


def test_chain_equals_plain_forward_backward():
    rng = np.random.default_rng(0)
    trans, counts = rng.normal(size=(3, 3)), np.array([5, 0, 70, 32, 1, 100])
    scores = rng.normal(size=(counts.sum(), 3)) * 2
    p, at = langid.Chain(trans, scores, counts).marginals(), 0
    for n in counts:
        s, a = np.exp(scores[at : at + n]), np.exp(trans)
        f, b = [s[0]] if n else [], [np.ones(3)]
        for t in range(1, n):
            f.append((f[-1] @ a) * s[t] / s[t].sum())
        for t in range(n - 1, 0, -1):
            b.append(a @ (s[t] * b[-1]) / s[t].sum())
        if n:
            q = np.array(f) * np.array(b[::-1])
            assert np.allclose(q / q.sum(axis=1, keepdims=True), p[at : at + n])
        at += n


def test_expected_transitions_are_exact():
    """Against the sum over all label sequences, and as the gradient of the log of the partition function."""
    from itertools import product

    rng = np.random.default_rng(7)
    trans, counts = rng.normal(size=(3, 3)), np.array([4, 1, 6])
    scores = rng.normal(size=(counts.sum(), 3))

    def log_z(a):
        total, at = 0.0, 0
        for n in counts:
            s = scores[at : at + n]
            weights = [s[range(n), y].sum() + sum(a[i, j] for i, j in zip(y, y[1:])) for y in product(range(3), repeat=int(n))]
            total, at = total + np.log(np.exp(weights).sum()), at + n
        return total

    _, moves = langid.Chain(trans, scores, counts).expected(pairs=True)
    for i, j in product(range(3), repeat=2):
        d = np.zeros((3, 3))
        d[i, j] = 1e-5
        assert (log_z(trans + d) - log_z(trans - d)) / 2e-5 == pytest.approx(moves[i, j], rel=1e-6)
    long = langid.Chain(trans, rng.normal(size=(300, 3)), np.array([200, 0, 100]))
    assert long.expected(pairs=True)[1].sum() == pytest.approx(298)


def test_windows_give_what_the_whole_text_gives():
    rng, model = np.random.default_rng(8), langid.Model(["a", "b", "c"])
    model.weights = rng.normal(size=model.weights.shape).astype(np.float32) / 4
    model.weights[0] = 0  # no feature
    model.trans = np.eye(3) * 2
    blanks = [" ", "\n", "  ", "\t\n "]
    for text in ["".join(str(rng.integers(10**6)) + blanks[rng.integers(4)] for _ in range(500)), " x" * 300 + " " * 500, "y" * 700 + " z"]:
        whole, cut = model.means([text.encode()]), model.means([text.encode()], window=50)
        assert np.allclose(whole[0], cut[0]) and whole[1] == cut[1]
    assert np.allclose(model.means([b" " * 100], window=50)[0], 1 / 3)


def test_rare_languages_are_in_the_sample(spark):
    rows = [(k, f"text {k}", "en") for k in range(300)] + [(1000 + k, f"wort {k}", "de") for k in range(3)] + [(None, "rien", "fr"), (None, "nada", None)]
    texts, langs = langid.fit_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 20, 100)
    assert len(langs) == 20 and langs.count("de") == 3 and langs.count("fr") == 1


def test_language_of_held_out_and_switched_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(langid.fold() != 1))
    held = langid.predict(docs.where(langid.fold() == 1), model).join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9
    mixed = "the of and to that was with from this " * 5 + "der die und den von das sich mit auf " * 5
    _, p = model.label([mixed.encode()])
    top = [model.labels[k] for k in p.argmax(axis=1)]
    assert top[5] == "en" and top[-5] == "de"
    rare = langid.predict(frame(spark, [None, "", "123 !!", "the and"]), model).collect()
    assert [(r["lang_pred"], r["score"] > 0) for r in sorted(rare, key=lambda r: r["doc_id"])][:3] == [("und", False)] * 3
    assert langid.predict(frame(spark), langid.Model([])).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(frame(spark).limit(0), model).count() == 0


KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PRIVATE = [
    None, "", "a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "001.002.0003.4 256.1.1.1 0000000255.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1111",
    "+1 (555) 123-4567 +12 +1..........2 +1 2345 678 9012 3456 78", "😀 a@b.co 😀 10.0.0.1\n+44 20 7946 0958", "x" * 3000 + "@" + "a." * 3000 + "z",
    "1" * 9000, "a@b..c a@-.-", "@@a@b.c@d.e", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "4242424242424242  4242424242424242", " ".join(map(str, range(500))),
]


def passes(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def test_base_entities(spark):
    for r in pii.find_pii(frame(spark, PRIVATE)).collect():
        t = PRIVATE[r["doc_id"]] or ""
        spans = sorted((m.start(), o, k, m.end()) for o, (k, p) in enumerate(KINDS.items()) for m in re.finditer(p, t) if passes(k, m.group()))
        base = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[2] == k for x in spans) for k in KINDS]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert pii.find_pii(frame(spark).limit(0)).count() == 0


def test_context_finds_what_no_pattern_does(spark):
    """Cards with a wrong check digit, where several true ones stood in the same words."""
    true = ["4111111111111111", "4242424242424242", "4012888888881881", "5555555555554444"]
    texts = [f"please charge card number {c} for the order" for c in true] + ["please charge card number 4111111111111112 for the order", "about 4111111111111113 grains"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, texts)).collect()}
    assert rows[4] == "context:26:42" and rows[5] == "" and rows[0] == "card:26:42"


def test_context_finds_forms_that_no_seed_has(spark):
    cards = ["4111111111111111", "4242424242424242", "4012888888881881", "5555555555554444"]
    phones = ["+1 (555) 123-4567", "+44 20 7946 0958", "+49 30 1234567", "+1 (555) 987-6543"]
    mails = ["ann@example.com", "bob@mail.example.org", "eve@example.net", "joe@example.com"]
    texts = [f"please charge card number {c} for the order" for c in cards]
    texts += [f"reach me by phone at {p} before noon" for p in phones] + [f"my mail address is {m}, write soon" for m in mails]
    unseen = [
        ("please charge card number ", "123456789012", " for the order"),
        ("please charge card number ", "1234 567 8901", " for the order"),
        ("reach me by phone at ", "555.987.1234", " before noon"),
        ("reach me by phone at ", "(030) 123 45-67", " before noon"),
        ("my mail address is ", "root@localhost", ", write soon"),
    ]
    clean = ["in 1999 there were 12345 of them", "about 123456789012 grains", "the host is @home"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, texts + ["".join(u) for u in unseen] + clean)).collect()}
    for k, (left, form, _) in enumerate(unseen, len(texts)):
        assert rows[k] == f"context:{len(left)}:{len(left) + len(form)}", form
    assert [rows[len(texts) + len(unseen) + k] for k in range(len(clean))] == [""] * len(clean)


def test_instances_are_whole_and_have_words_on_both_sides(spark):
    """A phone of several words is one instance; a lead like tel: is context; neighbours with digits are words too."""
    texts = ["dial tel:+1 (555) 123-4567 at 9 oclock.", "room 12b code 123456 then 7x end", "in 1999. 2000 5000 55.66@x.com (a1234)."]
    from pyspark.sql import functions as F

    rows = pii.described(frame(spark, texts).withColumn("_text", F.col("text"))).select("doc_id", F.explode("inst").alias("i")).select("doc_id", "i.*").collect()
    got = {(r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]]): r for r in rows}
    assert set(got) == {(0, "+1 (555) 123-4567"), (1, "123456"), (2, "1999"), (2, "2000 5000"), (2, "55.66@x.com"), (2, "a1234")}
    assert got[0, "+1 (555) 123-4567"]["covered"] and "L:dial tel:~~separated" in got[0, "+1 (555) 123-4567"]["patterns"]
    assert {"L:00b code~000000", "LR:code|then~~digits", "L1:code~~number"} <= set(got[1, "123456"]["patterns"])
    assert got[1, "123456"]["l1"] == "code" and got[2, "1999"]["l1"] == "in"


def test_many_numbers_in_one_text(spark):
    """Long runs of groups do not overflow the stack of the matcher."""
    rows = pii.find_pii(frame(spark, ["12 34-5 " * 40000, "1.2-" * 40000 + "a", "(a" * 40000, "a@ " * 3000])).collect()
    assert len(rows) == 4 and all(r["n_context"] == 0 for r in rows)


def test_discovered_instances_support_further_patterns(spark):
    """Two hops: cards teach "acct no", whose other numbers teach "member id", where no seed stands."""
    cards = ["4111111111111111", "4242424242424242", "4012888888881881", "5555555555554444", "4000056655665556", "5200828282828210", "2223003122003222", "378282246310005"]
    cards += ["6011111111111117", "3056930009020004", "5105105105105100", "6011000990139424", "3566002020360505", "6200000000000005", "4917610000000000", "4462030000000000"]
    members = [f"77-{k}12-90" for k in range(1, 6)]
    texts = [f"pay to acct no {c} today" for c in cards] + [f"pay to acct no {m} today" for m in members]
    texts += [f"ask for member id {m} there" for m in members] + ["ask for member id 55-919-31 there", "ask for room 55-919-31 there"]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_pii(frame(spark, texts)).collect()}
    one_hop, two_hops = range(len(cards), len(cards) + len(members)), len(texts) - 2
    assert all(rows[k] == "context:15:24" for k in one_hop)
    assert rows[two_hops] == "context:18:27" and rows[two_hops + 1] == ""


def test_secrets_teach_their_words_and_common_words_teach_nothing(spark):
    key = [hashlib.sha1(bytes([k])).hexdigest() for k in range(6)]
    texts = [f'so it was. token = "{k}" and so on' for k in key[:5]] + ['so it was. token = "ab12-cd34-ef" and so on', f"built at {key[5]} and done"]
    # An email after "the", which stands before much else.
    texts += [f"the a{k}@example.com" for k in range(5)] + ["the b1234@local"] + ["the cat and the dog " * 30]
    rows = {r["doc_id"]: r for r in pii.find_pii(frame(spark, texts)).collect()}
    assert all(rows[k]["spans"] == "secret:20:60" and rows[k]["n_spans"] == rows[k]["n_secret"] == 1 for k in range(5))
    assert rows[5]["spans"] == "context:20:32" and rows[6]["spans"] == "" and rows[12]["spans"] == ""


def brute_patterns(edges):
    by, score = {}, {t: 1.0 for _, t, seed in edges if seed}
    for p, t, _ in edges:
        by.setdefault(p, set()).add(t)
    while True:
        conf = {p: sum(score.get(t, 0) for t in ts) / (sum(1 if t in score else pii.UNKNOWN for t in ts) + 0.5) for p, ts in by.items() if sum(t in score for t in ts) >= pii.MIN_SEEDS}
        good = {p: c for p, c in conf.items() if c >= pii.MIN_CONFIDENCE}
        new = {}
        for p, c in good.items():
            for t in by[p] - set(score):
                new[t] = max(c, new.get(t, 0))
        if not new:
            return good
        score |= new


def test_pattern_scores_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    for _ in range(3):
        seeds = {int(t) for t in rng.integers(0, 60, 60)}
        edges = sorted({(f"p{p}", f"t{t}", int(t) in seeds) for p in range(25) for t in rng.integers(2 * p, 2 * p + 12, 14)})
        got = {r["pattern"]: r["confidence"] for r in pii.confident_patterns(spark.createDataFrame(edges, "pattern string, token string, seed boolean")).collect()}
        assert got == pytest.approx(brute_patterns(edges)) and got


def test_running_sums(spark):
    from itertools import accumulate

    from pyspark.sql import functions as F

    for n in (1, 63, 64, 65, 5000):
        x = [(k * 7919) % 101 for k in range(n)]
        df = spark.createDataFrame([(x,)], "x array<int>").select(pii.bind(F.col("x"), lambda a: pii.running(a)), pii.bind(F.col("x"), lambda a: pii.running(a, lambda p, q: F.greatest(p, q))))
        assert [list(c) for c in df.first()] == [list(accumulate(x)), list(accumulate(x, max))]


def test_rows_that_repeat_or_lack_an_identifier(spark):
    rows = spark.createDataFrame([(None, "a@b.co"), (None, "c@d.co and e@f.co"), (7, "a@b.co"), (7, "10.0.0.1"), (7, "10.0.0.1"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["spans"]) for r in pii.find_pii(rows).collect()), key=str)
    want = [(None, "email:0:6"), (None, "email:0:6,email:11:17"), (7, "email:0:6"), (7, "ip:0:8"), (7, "ip:0:8"), (None, "")]
    assert got == sorted(want, key=str)


def test_work_on_a_long_text_is_not_quadratic(spark):
    import time

    text = " ".join(f"user{k}@mail{k}.example.com id{k:06d}" for k in range(20000))
    began = time.time()
    rows = pii.find_pii(frame(spark, [text, "x" * 10**6 + " 1" + "2" * 10**6 + " a@b.c"])).collect()
    assert sorted(r["n_email"] for r in rows) == [1, 20000] and time.time() - began < 60


def test_copies_leave_other_languages_in_the_sample(spark):
    """6,000 copies of one row, with one identifier or with many, are one row or few of the sample."""
    known = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    english = known.where("lang = 'en'").first()["text"]
    plain = Counter(langid.fit_sample(known, "doc_id", "text", "lang", 1200, 20_000)[1])
    same = spark.range(6000).selectExpr("CAST(5 AS long) AS doc_id").withColumn("text", F.lit(english)).withColumn("lang", F.lit("en"))
    got = Counter(langid.fit_sample(known.unionByName(same), "doc_id", "text", "lang", 1200, 20_000)[1])
    assert set(got) == set(plain) and got["en"] <= plain["en"] + 1 and all(got[k] == plain[k] for k in plain if k != "en")
    many = same.withColumn("doc_id", F.monotonically_increasing_id() + 10**6)
    got = Counter(langid.fit_sample(known.unionByName(many), "doc_id", "text", "lang", 1200, 20_000)[1])
    assert all(got[k] == plain[k] for k in plain if k != "en") and sum(got.values()) <= 1200


@pytest.mark.parametrize("close", ["###", '"###', "&&", "%%%", "==.", "')", "...", "-_-", "$"])
def test_instances_end_at_a_letter_or_digit(spark, close):
    """Punctuation behind an instance, of whatever kind, is no part of its span; so keys keep their kind."""
    key = "24be90ff01aa47cc8812deadbeef3107ff"
    texts = [f'token = "{key}{k}ab{close} and more' for k in range(4)] + [f"ticket no AB-{k}{k}77-{k}{close} was filed" for k in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    for k in range(4):
        assert rows[k]["spans"] == f"secret:9:{9 + len(key) + 3}" and rows[k]["n_secret"] == 1
    none = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs, secret_names=()).collect()}
    assert set(none.values()) == {""}  # nothing is a seed
    named = {r["doc_id"]: r["spans"] for r in pii.find_pii(docs.selectExpr("doc_id", "replace(text, 'token', 'cookie') AS text"), secret_names=("cookie",)).collect()}
    assert named[0] == f"secret:10:{10 + len(key) + 3}"


def test_forms_that_no_seed_has_are_found_in_the_table(spark):
    """Phones of a form no base pattern has, planted in documents of the table behind a word that known phones stand behind: how many
    are found, with exact ends, and what else is marked."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    ids, planted = list(texts), {}
    for k, i in enumerate(ids[:80]):
        if k < 60:  # known: the word teaches what follows it
            texts[i] += f" Ring our dutydesk +49 30 {1000000 + 7919 * k} whenever."
        else:
            number = f"55{k}-0{100 + k}" if k % 2 else f"({200 + k}) 555 0{100 + k}"
            at = len(texts[i]) + len(" Ring our dutydesk ")
            texts[i] += f" Ring our dutydesk {number} whenever."
            planted[i] = f"context:{at}:{at + len(number)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"].split(",") for r in pii.find_pii(docs).collect()}
    found = sum(planted[i] in got[i] for i in planted)
    wrong = sum(x.startswith("context") and x != planted.get(i) for i, spans in got.items() for x in spans)
    assert found >= 0.9 * len(planted) == 18 and wrong <= 2, (found, wrong)
    plain = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")).collect()}
    assert sum("context" in s for s in plain.values()) == 0
