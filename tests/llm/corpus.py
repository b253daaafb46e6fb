"""A small corpus of hard cases: nulls, blanks, repeats, ties, copies, periodic text, clashing column names."""

import random

rnd = random.Random(5)
VOCAB = ["alpha", "Beta", "gamma", "delta", "épée", "straße", "niño", "the", "of", "la", "der", "que", "x1", "👍"]


def prose(n: int) -> str:
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


PASSAGE = prose(60)
BASE = prose(120)
PERIODIC = "ping pong " * 100


def near(text: str, changes: int) -> str:
    w = text.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = "zz" + str(rnd.randrange(10**6))
    return " ".join(w)


TEXTS = (
    [None, "", "  \t\n", "one", "One", "two words", "a b c d e", "a b c d e", "A B C D E"]
    + [prose(30) + " " + PASSAGE + "\n" + prose(20) for _ in range(4)]
    + [BASE, BASE.upper().lower(), BASE]
    + [near(BASE, 1) for _ in range(8)]
    + [near(BASE, 4) for _ in range(6)]
    + [PERIODIC, PERIODIC + "end", "pong " + PERIODIC]
    + [prose(k) for k in (34, 35, 36, 37, 70)]
    + [prose(4000)]
    + ["line one here\nline one here\nother line\n\nline one here", "!!! ### $$$", "12345"]
    + ["l\x0bm\x0cn\x1co p\x85q　r " + prose(40)]
)


def frame(spark, texts=TEXTS):
    """Rows with columns whose names clash with what operators might use inside."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", "S3", None][i % 4], None if t is None else len(t), "x", i, "v", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, v long, packed string, `_id` long")


def words(t):
    return (t or "").encode().split()
