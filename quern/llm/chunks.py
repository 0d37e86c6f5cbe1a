"""Columnar text-to-integers mapping shared by the operators that read words.

A text is cut at single spaces inside Arrow, the pieces are dictionary-encoded,
and only pieces not seen before reach Python. Each piece maps to a short run of
integers (token ids, word hashes, n-gram buckets); whole documents are then put
together with NumPy gathers. The table of known pieces is bounded: past the
bound it is emptied, which costs time and never changes a result.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space next to a space: such texts are cut by a callback instead.
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ODD_SPACES = rf" {_WS}|{_WS} |^{_WS}|{_WS}$"


_resident: dict[Hashable, object] = {}


def resident(key: Hashable, make: Callable[[], object]):
    """The one model that a Python worker holds from task to task.

    Workers are reused by later stages. Another operator's model is let go, and
    its memory given back to the system, before a new one is made.
    """
    if key not in _resident:
        if _resident:
            _resident.clear()
            gc.collect()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass
        _resident[key] = make()
    return _resident[key]


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` characters each, one row at least."""
    n = len(texts)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = int(np.searchsorted(ends, base + chars, side="right"))
        stop = min(max(stop, at + 1), n)
        yield at, stop
        at = stop


def text_array(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column with nulls read as empty texts."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


class ChunkPool:
    """Maps space-separated pieces of text to runs of integers."""

    def __init__(self, encode: Callable[[list[str]], Sequence[Sequence[int]]], dtype=np.int32, limit: int = 250_000, pool_limit: int = 6_000_000):
        self.encode, self.dtype, self.limit, self.pool_limit = encode, dtype, limit, pool_limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.empty(1 << 16, self.dtype)
        self.used = 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lens = np.empty(1 << 14, np.int64)

    def _add(self, new: list[str]) -> None:
        self._store(new, self.encode(new))

    def _store(self, new: list[str], runs: Sequence[Sequence[int]]) -> None:
        lens = np.fromiter((len(r) for r in runs), np.int64, len(new))
        flat = np.fromiter((x for r in runs for x in r), self.dtype, int(lens.sum()))
        n0, n1 = len(self.known), len(self.known) + len(new)
        while n1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.empty_like(self.starts)])
            self.lens = np.concatenate([self.lens, np.empty_like(self.lens)])
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.lens[n0:n1] = lens
        self.starts[n0:n1] = self.used + np.cumsum(lens) - lens
        self.used += len(flat)
        for i, w in enumerate(new):
            self.known[w] = n0 + i

    def codes(self, words: list[str]) -> np.ndarray:
        """Index of each (distinct) piece, adding those that are new."""
        if len(self.known) > self.limit or self.used > self.pool_limit:
            self.clear()
        get = self.known.get
        new = [w for w in words if get(w) is None]
        if new:
            collects = gc.isenabled()
            gc.disable()  # many small lists, none of them in a cycle
            try:
                self._add(new)
            finally:
                if collects:
                    gc.enable()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def expand(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the pieces one after the other, and the length of each."""
        lens = self.lens[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[codes] - (ends - lens), lens)
        at += np.arange(total)
        return self.pool[at], lens

    def documents(self, texts: pa.Array, odd: Callable[[str], list[str]] | None = None, first: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Integers of every text of a slice, and offsets of the texts in them.

        With ``odd``, a text with white space beside a space is cut by that
        callback. ``first`` marks the piece that begins a text.
        """
        n = len(texts)
        lists = pc.split_pattern(texts, " ")
        if odd is not None or first:
            return self._marked(texts, lists, odd, first)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        enc = lists.flatten().dictionary_encode()
        codes = self.codes(enc.dictionary.to_pylist())
        flat = codes[enc.indices.to_numpy(zero_copy_only=False)] if len(enc) else np.empty(0, np.int64)
        values, lens = self.expand(flat)
        ends = np.concatenate([[0], np.cumsum(lens)])
        return values, ends[offsets - offsets[0]] if n else np.zeros(1, np.int64)

    def _marked(self, texts: pa.Array, lists: pa.Array, odd, first: str) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        words = lists.flatten()
        special = pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False).astype(bool) if odd is not None else np.zeros(n, bool)
        if special.any():  # their pieces come from the callback
            parts, counts, start = [], np.diff(offsets), 0
            for i in np.flatnonzero(special):
                if i > start:
                    parts.append(words.slice(offsets[start], offsets[i] - offsets[start]))
                own = odd(texts[int(i)].as_py())
                parts.append(pa.array(own, words.type))
                counts[i] = len(own)
                start = int(i) + 1
            parts.append(words.slice(offsets[start], offsets[n] - offsets[start]))
            words = pa.concat_arrays(parts)
            offsets = np.concatenate([[0], np.cumsum(counts)])
        if first and len(words):
            starts = offsets[:-1][(np.diff(offsets) > 0) & ~special]
            heads = words.take(pa.array(starts))
            marked = pc.binary_join_element_wise(pa.scalar(first, words.type), heads, pa.scalar("", words.type))
            mask = np.zeros(len(words), bool)
            mask[starts] = True
            words = pc.replace_with_mask(words, pa.array(mask), marked)
        enc = words.dictionary_encode()
        codes = self.codes(enc.dictionary.to_pylist())
        flat = codes[enc.indices.to_numpy(zero_copy_only=False)] if len(enc) else np.empty(0, np.int64)
        values, lens = self.expand(flat)
        ends = np.concatenate([[0], np.cumsum(lens)])
        return values, ends[offsets]


def segments(offsets: np.ndarray) -> np.ndarray:
    """Document number of each value, from the documents' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
