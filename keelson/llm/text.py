"""Words of many texts at once, as numpy arrays over one joined buffer of bytes.

Hashes are taken mod 2^64: the hash of a word is a difference of running sums, so no loop over words is needed.
They choose partners, buckets and table rows, and stand for words in sets and alignments that are long; what is decided by
them alone says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are joined up to this many bytes; a longer text is a buffer of its own.
BUFFER_BYTES = 2 << 20
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing of bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) mod 2^64; kept between calls while short."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BUFFER_BYTES + 1024)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        if size <= 4 * BUFFER_BYTES:
            _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of each 64-bit number (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: places in ``data``, hashes, and first[i]:first[i + 1] for text i."""

    def __init__(self, texts: list[bytes], lower: bool = False, between: np.ndarray = BLANK):
        self.buffer = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.buffer, dtype=np.uint8)
        if lower:
            self.data = LOWER[self.data]
        inside = np.concatenate(([False], ~between[self.data]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        text_start = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=text_start[1:])
        self.text_start = text_start
        self.first = np.searchsorted(self.start, text_start)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)

    def words_of(self, i: int) -> list[bytes]:
        """The words of text i."""
        a, b = self.first[i], self.first[i + 1]
        return [self.data[x:y].tobytes() for x, y in zip(self.start[a:b].tolist(), self.end[a:b].tolist())]

    def hashes(self) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.data)), out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * powers(INVERSE, len(self.data) + 1)[self.start])


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word; the last k - 1 words start none."""
    n = max(0, len(h) - k + 1)
    out, factor = np.zeros(n, dtype=np.uint64), 1
    for i in range(k):
        out += h[i : i + n] * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mixed(out)


def buffers(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, texts) in runs of BUFFER_BYTES at most, or one longer text; null is empty."""
    at, held, size = 0, [], 0
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py() or b""
        if held and size + len(t) > BUFFER_BYTES:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield at, held
