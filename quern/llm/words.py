"""Hashed words of texts, and small hash helpers.

Words are runs of ``\\w`` in the lower-cased text. They are found and hashed in
NumPy over the code points of a whole slice of texts: a word's hash is a
polynomial, modulo 2^64, in random values of its characters, taken from running
sums, so no word becomes a Python object.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

_WORD = re.compile(r"\w+").findall
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
#: 3 modulo 8, so that differences of its powers have few factors of two.
_BASE = 0x9E3779B97F4A7C13
_POINTS = 0x110000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche, element by element."""
    x = x + _C1
    x ^= x >> _S30
    x *= _C2
    x ^= x >> _S27
    x *= _C3
    x ^= x >> _S31
    return x


class _Tables:
    """What a character is and stands for, and powers of the base."""

    def __init__(self):
        self.is_word = np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(_POINTS))), bool, _POINTS)
        self.is_letter = np.fromiter(map(str.isalpha, map(chr, range(_POINTS))), bool, _POINTS)
        self.value = mix(np.arange(_POINTS, dtype=np.uint64))
        self.up = self.down = np.empty(0, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_tables: list[_Tables] = []


def tables() -> _Tables:
    if not _tables:
        _tables.append(_Tables())
    return _tables[0]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a blank after each, and where each
    text begins (with the end of the last)."""
    low = [t.lower() for t in texts.to_pylist()]
    points = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.cumsum([0, *(len(t) + 1 for t in low)])


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of True; the last element is False."""
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
    return edges[::2], edges[1::2]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and the texts' offsets in them."""
    if not len(texts):
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    t = tables()
    points, at = code_points(texts)
    begin, end = runs(t.is_word[points])
    up, down = t.powers(len(points))
    sums = np.cumsum(t.value[points] * up)
    before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
    return mix((sums[end - 1] - before) * down[begin]), np.searchsorted(begin, at)


def hash_word(word: str) -> int:
    return int(word_hashes(pa.array([word], pa.large_string()))[0][0])


def words_of(text: str) -> list[str]:
    """The words that ``word_hashes`` hashes, for tests and small inputs."""
    return _WORD(text.lower())
