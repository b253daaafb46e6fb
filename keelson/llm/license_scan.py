"""License scans: winnowed fingerprints, an inverted index and banded alignment.

Templates are cut into words of letters and digits, in lower case. Hashes of three neighbouring
words are winnowed: of each four, the smallest stays (a one-line notice keeps all). The kept hashes form an inverted index
from hash to (template, place). In a text, every three-word hash is looked up; hits of one template
near one diagonal are a candidate, and the template is then aligned word by word with the text in
a band around that diagonal. Words that tell licenses apart (name, version, NC, Lesser, "later") must all be
aligned, and no other such word may stand among them; coverage alone names no license. What is reported: matched words, their share of the template (coverage) and
the span in the text.

The index is as large as the templates; it goes to the workers with the function.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.license_texts import TEXTS
from keelson.llm.staging import documents, short_batches
from keelson.llm.text import Words, buffers, shingles

GRAM = 3
WINNOW = 4
#: A template of so many fingerprints or fewer keeps all of them.
WHOLE = 2 * WINNOW
BAND = 8
MIN_COVERAGE = 0.75
#: Words that make another license of one, beside numbers of one or two digits; a 0 ends a version and changes none.
MARKS = {b"nc", b"sa", b"nd", b"noncommercial", b"sharealike", b"noderivs", b"noderivatives", b"lesser", b"library", b"affero"}


def _gnu() -> list[tuple[str, str, str]]:
    """Notices of the GNU licenses: as one line and as the paragraph for a file, of this version only and of later ones."""
    out = []
    for short, kind, what, version in [
        ("GPL-2.0", "", "program", "2"), ("GPL-3.0", "", "program", "3"), ("AGPL-3.0", "Affero ", "program", "3"),
        ("LGPL-2.0", "Library ", "library", "2"), ("LGPL-2.1", "Lesser ", "library", "2.1"), ("LGPL-3.0", "Lesser ", "library", "3"),
    ]:
        name = f"GNU {kind}General Public License"
        keys = f"gnu {kind}general {version}"
        line = f"This work is licensed under the {name}, version {version}"
        notice = (
            f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published "
            f"by the Free Software Foundation, either version {version} of the License"
        )
        out += [(short, f"{line}.", keys), (f"{short}-or-later", f"{line} or any later version.", f"{keys} later")]
        out += [(short, f"{notice}.", keys), (f"{short}-or-later", f"{notice}, or (at your option) any later version.", f"{keys} later")]
    return out


def _creative_commons() -> list[tuple[str, str, str]]:
    forms = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"]
    return [
        (f"CC-{f}-{v}", f"Licensed under CC {f} {v}.", f"cc {f} {v.removesuffix('.0')}") for v in ("1.0", "2.0", "2.5", "3.0", "4.0") for f in forms
    ]


#: (license, template, words of it that must be aligned, in order). Fixed texts: of licenses as a whole, and the notices that they
#: ask for or are known by.
TEMPLATES = [
    ("MIT", "Released under the MIT License.", "mit"),
    ("MIT", "Licensed under the MIT License.", "mit"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache 2"),
    *_gnu(),
    *_creative_commons(),
    *TEXTS,
]
#: Bytes between words: all ASCII but letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Index:
    """The winnowed fingerprints of the templates."""

    def __init__(self, templates: list[tuple[str, ...]]):
        self.names = [t[0] for t in templates]
        w = Words([t[1].encode() for t in templates], lower=True, between=BETWEEN)
        h = w.hashes()
        g = shingles(h, GRAM)
        self.words = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.keys_of = [places(w.words_of(i), Words([k.encode()], lower=True, between=BETWEEN).words_of(0)) for i, (_, _, k) in enumerate((*t, "")[:3] for t in templates)]
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for t, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
            for p in winnow(g[a : max(a, b - GRAM + 1)], WINNOW):
                self.postings.setdefault(int(g[a + p]), []).append((t, p))
        self.keys = np.array(sorted(self.postings), dtype=np.uint64)


def winnow(g: np.ndarray, width: int, whole: int = WHOLE) -> list[int]:
    """Places of the rightmost smallest hash of each ``width`` neighbours; all places of a template of ``whole`` or less."""
    if len(g) <= whole:
        return list(range(len(g)))
    places: dict[int, None] = {}
    for i in range(max(1, len(g) - width + 1)) if len(g) else ():
        part = g[i : i + width]
        places[i + len(part) - 1 - int(np.argmin(part[::-1]))] = None
    return list(places)


def places(words: list[bytes], keys: list[bytes]) -> list[int]:
    """Where ``keys`` stand in ``words``, in order, each at its first place after the one before."""
    out: list[int] = []
    for k in keys:
        out.append(words.index(k, out[-1] + 1 if out else 0))
    return out


def marks(word: bytes) -> bool:
    return word in MARKS or (word.isdigit() and len(word) <= 2 and word != b"0")


def names_it(keys: list[int], path: dict[int, int], words: list[bytes], follows: bytes) -> bool:
    """Whether all key words are aligned, without others of their sort among them or a version that goes on after them.

    ``path`` maps aligned template words to text words; ``words`` are the text's, ``follows`` is what
    stands between the last key word and the next word.
    """
    if not keys:
        return True
    if any(k not in path for k in keys):
        return False
    first, last = path[keys[0]], path[keys[-1]]
    if any(marks(words[j]) for j in set(range(first, last)) - set(path.values())):
        return False
    goes_on = words[last].isdigit() and follows == b"." and last + 1 < len(words) and marks(words[last + 1])
    return not goes_on


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end) of the best alignment with text word = template word + shift, give or take ``band``."""
    return traced(template, text, shift, band)[:3]


def traced(template: np.ndarray, text: np.ndarray, shift: int, band: int = BAND) -> tuple[int, int, int, dict[int, int], float]:
    """What ``align`` says, the text word of each matched template word, and the score.

    The score is one for a match and a small penalty for what is skipped inside, so that the span
    is as short as the matches allow.
    """
    best = (0.0, 0, 0, 0, None)
    # A row: for each text place in the band, (score, matches, first, chain of matches) of a path that ends there.
    before: dict[int, tuple] = {}
    for i, x in enumerate(template):
        row: dict[int, tuple] = {}
        for j in range(max(0, i + shift - band), min(len(text), i + shift + band + 1)):
            diagonal = before.get(j - 1, (0.0, 0, j, None))
            if x == text[j]:
                first = diagonal[2] if diagonal[1] else j
                cell = (diagonal[0] + 1, diagonal[1] + 1, first, (diagonal[3], i, j))
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1, cell[3])
            else:
                above, left = before.get(j, (0.0, 0, j, None)), row.get(j - 1, (0.0, 0, j, None))
                cell = max((diagonal[0] - 0.3, *diagonal[1:]), (above[0] - 0.2, *above[1:]), (left[0] - 0.2, *left[1:]), key=lambda c: c[:3])
                if cell[0] <= 0:
                    continue
            row[j] = cell
        before = row
    path, chain = {}, best[4]
    while chain:
        chain, i, j = chain
        path[i] = j
    return best[1], best[2], best[3], path, best[0]


def candidates(hits: list[tuple[int, int, int]], slack: int = BAND) -> list[tuple[int, int]]:
    """(template, shift) from hits (template, place in it, place in the text): one for each run of near diagonals."""
    out = []
    last: tuple[int, int] | None = None
    for t, shift in sorted((t, q - p) for t, p, q in hits):
        if last is None or last[0] != t or shift - last[1] > slack:
            out.append((t, shift))
            last = (t, shift)
    return out


def gap_after(w: Words, i: int, path: dict[int, int], keys: list[int]) -> bytes:
    """What stands between the text word of the last key and the next word of text i; empty without one."""
    at = w.first[i] + path[keys[-1]] if keys and keys[-1] in path else w.first[i + 1]
    return w.data[w.end[at] : w.start[at + 1]].tobytes() if at + 1 < w.first[i + 1] else b""


def scan(index: Index, texts: list[bytes], min_coverage: float) -> Iterator[tuple[int, str, int, int, float, int, int]]:
    """(text, license, matched words, template words, coverage, start, end); offsets in code points."""
    w = Words(texts, lower=True, between=BETWEEN)
    h = w.hashes()
    g = shingles(h, GRAM)
    if not len(g):
        return
    at = np.flatnonzero(index.keys[np.minimum(np.searchsorted(index.keys, g), len(index.keys) - 1)] == g)
    of = np.searchsorted(w.first, at, side="right") - 1
    hits: dict[int, list[tuple[int, int, int]]] = {}
    for q, i in zip(at.tolist(), of.tolist()):
        if q + GRAM <= w.first[i + 1]:
            hits.setdefault(i, []).extend((t, p, q - int(w.first[i])) for t, p in index.postings[int(g[q])])
    for i, found in hits.items():
        own, said = h[w.first[i] : w.first[i + 1]], w.words_of(i)
        matches = []
        for t, shift in candidates(found):
            n, a, b, path, _ = traced(index.words[t], own, shift)
            if n >= min_coverage * len(index.words[t]) and names_it(index.keys_of[t], path, said, gap_after(w, i, path, index.keys_of[t])):
                matches.append((n, -(b - a), t, a, b))
        # Longest first; a shorter match that touches one already taken is part of it.
        taken: list[tuple[int, int]] = []
        for n, _, t, a, b in sorted(matches, key=lambda m: (-m[0], m[1], m[3], m[2])):
            k = bisect.bisect(taken, (a, b))
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            taken.insert(k, (a, b))
            first, end = int(w.start[w.first[i] + a] - w.text_start[i]), int(w.end[w.first[i] + b - 1] - w.text_start[i])
            start = len(texts[i][:first].decode("utf-8", "ignore"))
            yield i, index.names[t], n, len(index.words[t]), n / len(index.words[t]), start, start + len(texts[i][first:end].decode("utf-8", "ignore"))


def _scan(index: Index, min_coverage: float):
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "license", "matched_words", "template_words", "coverage", "start", "end", "matched_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for at, texts in buffers(b.column(1)):
                rows = []
                for i, *r in scan(index, texts, min_coverage):
                    body = texts[i].decode("utf-8", "ignore")[r[4] : r[5]]
                    rows.append((ids[at + i], *r, hashlib.sha256(body.encode()).hexdigest()))
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row per match: id, license, matched_words, template_words, coverage, start, end, matched_sha256.

    A text without a match, a null or an empty one, has no row; a text with several has several, which don't
    overlap: of matches that touch, the one with most matched words stays, then the shortest, the
    earliest, the first template. ``templates`` are (license, text) or (license, text, key words of the text that
    must be aligned). Repeated rows are reported each. No templates or an empty table give an
    empty one; other columns are ignored.
    """
    short_batches(docs.sparkSession)
    schema = "id long, license string, matched_words long, template_words long, coverage double, start long, end long, matched_sha256 string"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    known = TEMPLATES if templates is None else templates
    if not known:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    return rows.mapInArrow(_scan(Index(known), min_coverage), schema).withColumnRenamed("id", id_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
