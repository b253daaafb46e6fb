"""BPE encoding by backtracking, decoding by an offset table.

A word is read left to right. An Aho-Corasick automaton over the vocabulary gives the longest
token at each place; a token is taken if it may follow the one before it, else its next shorter
prefix is tried, else the last token is given up and the place marked as a dead end, so each
place is left once at most and a word takes linear time. Two tokens may stand side by side if
merging their joined text by rank gives exactly these two; a sequence whose neighbours
all may stand side by side is the one that the merges give. The pair table is filled
as pairs are met.

The vocabulary file's path is a parameter; each Python worker reads it once.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.staging import documents, short_batches

#: Words whose ids are kept between texts: twice as many at most, the longest unused go first. Longer words are not kept.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: Code points that Unicode 16, the library's version, does not know, and that later versions call letters
#: or numbers.
UNKNOWN = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191),
    (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
#: Capitals newer than Python's own tables, which the library lower-cases: (first, last, distance).
CAPITALS = [
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
]


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
    """
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class Bpe:
    """A vocabulary with byte-level characters, merges by rank and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        # Texts with one of the code points that tables disagree on take their own, slower pattern.
        unknown = "".join(f"{chr(a)}-{chr(b)}" for a, b in UNKNOWN)
        self.disputed = regex.compile("[" + unknown + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in CAPITALS) + "]")
        self.words_less = regex.compile("(?V1)" + pattern.replace(r"\p{L}", rf"[\p{{L}}--[{unknown}]]").replace(r"\p{N}", rf"[\p{{N}}--[{unknown}]]"))
        self.to_lower = {c: c + d for a, b, d in CAPITALS for c in range(a, b + 1)}
        self.chars = byte_chars()
        # The last character of a word is a symbol of its own: its code is moved up by SHIFT.
        self.shift = 1024
        self.to_symbols = {i: c for i, c in enumerate(self.chars)}
        self.text = {i: self._symbols(t) for t, i in vocab.items()}
        self.id_of = {t: i for i, t in self.text.items()}
        self.rank = {}
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank.setdefault((self._symbols(a), self._symbols(b)), r)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int] = {}
        usable = {t: i for t, i in self.id_of.items() if self.merged(t) == [t]}
        for t, i in usable.items():
            self.automaton.add_word(t, (i, len(t)))
            self.shorter[i] = next((usable[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in usable), -1)
        self.automaton.make_automaton()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Decoding: the token texts end to end, each with the blank that follows it, and their offsets.
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        tokens = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.blob = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.offset = np.zeros(len(tokens) + 1, dtype=np.int64)
        np.cumsum([len(t) for t in tokens], out=self.offset[1:])

    def _symbols(self, token: str) -> str:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return body[:-1] + chr(ord(body[-1]) + self.shift)
        return token

    def merged(self, symbols: str) -> list[str]:
        """The merges themselves, lowest rank first: used for tokens and pairs of tokens only."""
        parts = list(symbols)
        while len(parts) > 1:
            best, k = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        got = self.pairs.get((a, b))
        if got is None:
            x, y = self.text[a], self.text[b]
            got = self.pairs[a, b] = self.merged(x + y) == [x, y]
        return got

    def encode_word(self, symbols: str) -> list[int]:
        n = len(symbols)
        longest: list[int] = [-1] * n
        size = [0] * n
        for last, (i, length) in self.automaton.iter(symbols):
            at = last - length + 1
            if length > size[at]:
                longest[at], size[at] = i, length
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + len(self.text[token])
                if not dead[end] and (not out or self.may_follow(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a symbol")
                dead[at] = 1
                token = out.pop()
                at -= len(self.text[token])
        return out

    def word(self, w: str) -> bytes:
        """The ids of one word as little-endian 32-bit integers."""
        got = self.older.get(w)
        if got is None:
            s = w.encode().decode("latin-1").translate(self.to_symbols)
            if self.end:
                s = s[:-1] + chr(ord(s[-1]) + self.shift)
            ids = self.encode_word(s)
            got = struct.pack(f"<{len(ids)}I", *ids)
            if len(self.pairs) >= 4 * CACHE_WORDS:
                self.pairs.clear()
        if len(w) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[w] = got
        return got

    def encode(self, text: str) -> bytes:
        parts = self.split_special.split(text) if self.split_special else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
            elif part:
                # One character at a time: no rule looks at a letter's neighbours.
                low = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                cached, word, words = self.cache.get, self.word, self.words
                if not low.isascii() and self.disputed.search(low):
                    low, words = low.translate(self.to_lower), self.words_less
                out += [cached(w) or word(w) for w in words.findall(low)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Token texts with blanks between, gathered by offsets in runs of 64 Ki tokens."""
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        out = []
        for k in range(0, len(i), 65536):
            part = i[k : k + 65536]
            start, n = self.offset[part], self.offset[part + 1] - self.offset[part]
            ends = np.cumsum(n)
            out.append(self.blob[np.repeat(start - (ends - n), n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _encode(path: str, keep: bool):
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if keep else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = bpe.encode(text.as_py() or "")
                row = (i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest())
                rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32)) if keep else row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Ids are those of the vocabulary's own library without special tokens added; the strings of
    special tokens in a text become those tokens, as there. Null texts count as empty: no tokens.
    Repeated rows are encoded each, whatever their identifiers; an empty table gives an empty one; other columns are ignored.
    A text of any length is encoded as a whole, in time linear in it; a worker holds a few times its longest text.
    ``path`` names a vocabulary file that every executor has.
    """
    short_batches(docs.sparkSession)
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(path, keep_ids), schema).withColumnRenamed("id", id_col)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(documents(spark, sf_dir), default_path(), keep_ids=False)
