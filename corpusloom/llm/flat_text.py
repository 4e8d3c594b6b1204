"""Vectorised word work over a batch of texts held as one array of code points.

All texts of a batch are joined with line feeds, so a word never spans two texts. Words get
64-bit hashes from prefix sums: with P[i] = sum of r(c_j) * B**j for j < i, the word [s, e)
has (P[e] - P[s]) * B**-s, all modulo 2**64, followed by a finalising mix.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = np.uint64(0xD6E8FEB86659FD93)
#: Texts are worked on in pieces of about this many characters, to bound memory.
PIECE_CHARS = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (public-domain splitmix64 constants)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Code point -> base letter without accents (one code point); combining marks -> 0."""
    t = np.arange(0x110000, dtype=np.uint32)
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        d = unicodedata.normalize("NFD", chr(i))
        t[i] = ord(d[0])
    t[0x300:0x370] = 0
    for a, b in (("đ", "d"), ("Đ", "d"), ("ø", "o"), ("ł", "l"), ("ı", "i")):
        t[ord(a)] = ord(b)
    return t


_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        p = np.full(max(n, PIECE_CHARS + 1), base, dtype=np.uint64)
        p[0] = 1
        have = _powers[name] = np.multiply.accumulate(p)
    return have[:n]


def pieces(lengths: np.ndarray):
    """Consecutive (from, to) index ranges of about PIECE_CHARS characters each."""
    at, total = 0, np.cumsum(lengths)
    while at < len(lengths):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + PIECE_CHARS, side="right")))
        yield at, to
        at = to


class Words:
    """Words of some texts: ``doc`` (index of the text), ``start``, ``end`` (code points in
    ``codes``) and ``hash``. ``codes`` is the lower-cased, optionally accent-folded array."""

    def __init__(self, texts: list[str], fold: bool = False):
        low = [t.lower() for t in texts]
        if fold:
            low = [unicodedata.normalize("NFC", t) if not t.isascii() else t for t in low]
        joined = "\n".join(low) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
        if fold:
            codes = fold_table()[codes]
            keep = codes != 0
            if not keep.all():
                kept = np.concatenate(([0], np.cumsum(keep)))
                ends = np.cumsum(lens)
                lens = np.diff(np.concatenate(([0], kept[ends])))
                codes = codes[keep]
        self.codes = codes
        self.text_start = np.concatenate(([0], np.cumsum(lens)))
        w = np.zeros(len(codes) + 2, dtype=np.int8)
        w[1:-1] = _word_table()[codes]
        d = np.diff(w)
        self.start, self.end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        self.doc = np.searchsorted(self.text_start, self.start, side="right") - 1
        n = len(codes)
        acc = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * _power(_B, "b", n), out=acc[1:])
        self.hash = mix((acc[self.end] - acc[self.start]) * _power(_B_INV, "i", n + 1)[self.start])

    def word(self, i: int) -> str:
        return self.codes[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, index of the first word, hash) of each run of k words."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h = h * _C + self.hash[j : j + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return self.doc[at], at, mix(h[at])
