"""Operator 5: byte-pair encoding by a traversal of the words' prefix trie.

The words that a slice of documents adds are put in order, which is the
depth-first order of their trie. Along the current path a stack keeps, for each
prefix, the last token of that prefix's encoding. A prefix shared by several
words is therefore worked out once. The last token of a prefix is the longest
vocabulary entry ending there that may follow the last token of what precedes
it; whether two tokens may stand side by side is decided by undoing merges
(a pair is stable if no merge across the seam would have come first).
"""

from __future__ import annotations

import base64
import os
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.chunks import ChunkPool, resident, slices, text_array
from quern.session import ship_code

#: Folder of the public vocabularies; every operator takes it as a parameter.
VOCABULARIES = "/opt/tokenizers"
#: How byte-level vocabularies cut a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_FIRST = "\x00"
_ENDS = frozenset(".,;:!?")
_SLICE = 1_000_000


class Merges:
    """A rank file as merge rules, with the word-trie encoder and the decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranked = sorted((int(r), base64.b64decode(b)) for b, r in map(bytes.split, f) if r)
        self.texts = [t for _, t in ranked]
        if [r for r, _ in ranked] != list(range(len(ranked))):
            raise ValueError(f"ranks of {path} are not 0..n-1")
        self.ids = {t: i for i, t in enumerate(self.texts)}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError(f"{path} lacks a single byte, so some texts have no encoding")
        self.lens = [len(t) for t in self.texts]
        self.size = len(self.texts)
        self._derive_merges()
        self._build_matcher()
        self.byte_pool = np.frombuffer(b"".join(self.texts), np.uint8)
        self.len_array = np.array(self.lens, np.int64)
        self.byte_starts = np.cumsum(self.len_array) - self.len_array
        self._cut = regex.compile(PIECES).findall

    def _derive_merges(self) -> None:
        """The two tokens that each token was merged from, in rank order."""
        n = self.size
        self.left, self.right = list(range(n)), list(range(n))
        self.merge: dict[int, int] = {}
        for t, text in enumerate(self.texts):
            for cut in range(len(text) - 1, 0, -1):
                a, b = self.ids.get(text[:cut]), self.ids.get(text[cut:])
                if a is not None and b is not None and a < t and b < t and self._pair_is_stable(a, b):
                    self.left[t], self.right[t] = a, b
                    self.merge[a * n + b] = t
                    break

    def _pair_is_stable(self, a: int, b: int) -> bool:
        bound, n, merge = self.size, self.size, self.merge
        while True:
            joined = merge.get(a * n + b)
            if joined is not None and joined < bound:
                return False
            if a > b:
                bound, inner = a, self.right[a]
                if inner == a:
                    bound, inner = b + 1, self.left[b]
                    if inner == b:
                        return True
                    b = inner
                else:
                    a = inner
            else:
                bound, inner = b + 1, self.left[b]
                if inner == b:
                    bound, inner = a, self.right[a]
                    if inner == a:
                        return True
                    a = inner
                else:
                    b = inner

    def _build_matcher(self) -> None:
        """Suffix automaton of the vocabulary: longest entry ending at a byte."""
        step: list[dict[int, int]] = [{}]
        best = [-1]
        for t, text in enumerate(self.texts):
            at = 0
            for byte in text:
                to = step[at].get(byte)
                if to is None:
                    to = step[at][byte] = len(best)
                    best.append(-1)
                    step.append({})
                at = to
            best[at] = t
        fail = [0] * len(best)
        self.shorter = [-1] * self.size
        queue = deque([0])
        order = []
        while queue:
            at = queue.popleft()
            order.append(at)
            for byte, to in step[at].items():
                back = fail[at]
                if at:
                    while byte not in step[back] and back:
                        back = fail[back]
                    fail[to] = step[back].get(byte, 0)
                own = best[to]
                if own >= 0:
                    self.shorter[own] = best[fail[to]]
                else:
                    best[to] = best[fail[to]]
                queue.append(to)
        self.step, self.best, self.fail = step, best, fail
        self.best_len = [self.lens[t] if t >= 0 else 0 for t in best]
        self.after: list[dict[int, bool]] = [{} for _ in range(self.size)]
        self.checked = 0

    def _advance(self, state: int, byte: int) -> int:
        """A move along failure links, remembered as a move of its own."""
        back = self.fail[state]
        while back and byte not in self.step[back]:
            back = self.fail[back]
        to = self.step[back].get(byte, 0)
        self.step[state][byte] = to
        return to

    def _check(self, left: int, token: int) -> bool:
        self.checked += 1
        ok = self.after[left][token] = self._pair_is_stable(left, token)
        return ok

    def encode_sorted(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of words that are distinct and in ascending order."""
        step, best, best_len, lens, shorter = self.step, self.best, self.best_len, self.lens, self.shorter
        after, check, advance = self.after, self._check, self._advance
        if self.checked > 400_000:
            self.checked = 0
            for known in after:
                known.clear()
        room = max(map(len, words), default=0) + 1
        states, last, before, out = [0] * room, [-1] * room, b"", []
        for word in words:
            common, most = 0, min(len(before), len(word))
            while common < most and before[common] == word[common]:
                common += 1
            state, i = states[common], common
            for byte in word[common:]:
                i += 1
                to = step[state].get(byte)
                state = advance(state, byte) if to is None else to
                token = best[state]
                left = last[i - best_len[state]]
                while left >= 0:
                    ok = after[left].get(token)
                    if check(left, token) if ok is None else ok:
                        break
                    token = shorter[token]
                    left = last[i - lens[token]]
                states[i] = state
                last[i] = token
            ids = []
            while i:
                token = last[i]
                ids.append(token)
                i -= lens[token]
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pieces, by way of their trie."""
        raw = sorted((p.encode(), p) for p in pieces)
        return dict(zip((p for _, p in raw), self.encode_sorted([r for r, _ in raw])))

    def encode(self, text: str) -> list[int]:
        pieces = self._cut(text)
        ids = self.encode_pieces(list(set(pieces)))
        return [t for p in pieces for t in ids[p]]

    def cut(self, text: str) -> list[str]:
        return self._cut(text)

    def cut_odd(self, text: str) -> list[str]:
        """Pieces of a text with unusual white space, each marked as a start."""
        return [_FIRST + p for p in self._cut(text)]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids one after the other, and the length of each."""
        lens = self.len_array[ids]
        ends = np.cumsum(lens)
        at = np.repeat(self.byte_starts[ids] - (ends - lens), lens)
        at += np.arange(len(at))
        return self.byte_pool[at], lens

    def decode(self, ids) -> str:
        return b"".join(self.texts[i] for i in ids).decode("utf-8", "replace")


class TokenPool(ChunkPool):
    """Token runs of chunks. A chunk of letters stands for the piece that has a
    space before it, so other chunks with the same word reuse its run."""

    def __init__(self, merges: Merges, limit: int = 500_000):
        self.merges = merges
        super().__init__(None, np.int32, limit)

    def _add(self, new: list[str]) -> None:
        known, cut, ids = self.known, self.merges.cut, self.merges.ids
        words, ends, rest = [], [], []
        for c in new:
            if c.isalpha():  # exactly the letters of the piece pattern
                words.append(c)
            elif c[-1:] in _ENDS and c[:-1].isalpha():
                ends.append(c)
            else:
                rest.append(c)
        odd = {c: cut(c[1:] if c[:1] == _FIRST else " " + c) for c in rest}
        fresh = set(words)
        fresh.update(w for w in {c[:-1] for c in ends} if w not in known)
        plain, extra = sorted((w.encode(), w) for w in fresh), set()
        for ps in odd.values():
            extra.update(ps)
        runs = self.merges.encode_sorted([b" " + raw for raw, _ in plain])
        self._store([w for _, w in plain], runs)
        del runs
        pool, starts, lens = self.pool, self.starts, self.lens

        def run(word: str) -> list[int]:
            at = known[word]
            return pool[starts[at] : starts[at] + lens[at]].tolist()

        made = [[*run(c[:-1]), ids[c[-1].encode()]] for c in ends]
        own = self.merges.encode_pieces(list(extra))
        made += [[t for p in ps for t in own[p]] for ps in odd.values()]
        self._store([*ends, *odd], made)


def _load(path: str) -> tuple[Merges, ChunkPool]:
    m = Merges(path)
    return m, TokenPool(m)


def model(path: str) -> tuple[Merges, ChunkPool]:
    """The vocabulary at ``path`` and its table of chunks, once per worker."""
    return resident(("merges", path), lambda: _load(path))


def encode_slice(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice and the texts' offsets in them."""
    m, pool = model(path)
    if len(texts) and pa.compute.any(pa.compute.match_substring(texts, _FIRST)).as_py():
        ids = [m.encode(t) for t in texts.to_pylist()]
        return np.array([i for x in ids for i in x], np.int32), np.cumsum([0, *map(len, ids)])
    nonempty = pa.compute.not_equal(texts, "").to_numpy(zero_copy_only=False)
    values, inner = pool.documents(texts.filter(pa.array(nonempty)), m.cut_odd, _FIRST)
    counts = np.zeros(len(texts), np.int64)
    counts[nonempty] = np.diff(inner)
    return values, np.concatenate([[0], np.cumsum(counts)])


def encode_documents(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, decode it again and say whether it came back.

    Returns (id, tokens array<int>, n_tokens, round_trip), one row per input
    row, repeated rows included. A null text has null tokens and n_tokens and
    a null round_trip; an empty text has no tokens and comes back. Further
    columns are left out, so their names can't clash. No shuffle; a text of
    any length is encoded whole.
    """
    ship_code(df.sparkSession)
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _ = model(path)
        for batch in batches:
            whole = text_array(batch, "text")
            for a, b in slices(whole, _SLICE):
                texts = whole.slice(a, b - a)
                null = batch.column("text").slice(a, b - a).is_null()
                ids, offsets = encode_slice(path, texts)
                raw, lens = m.decode_bytes(ids)
                ends = np.concatenate([[0], np.cumsum(lens)])[offsets]
                was = np.concatenate([[0], np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False))])
                source = np.frombuffer(b"".join(t.encode() for t in texts.to_pylist()), np.uint8)
                if len(raw) == len(source) and np.array_equal(ends, was) and np.array_equal(raw, source):
                    same = np.ones(b - a, bool)
                else:
                    same = np.array([np.array_equal(raw[ends[i] : ends[i + 1]], source[was[i] : was[i + 1]]) for i in range(b - a)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()), mask=null if null.null_count == 0 and pa.compute.any(null).as_py() else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), tokens, pa.array(np.diff(offsets), pa.int32(), mask=null.to_numpy(zero_copy_only=False)), pa.array(same, mask=null.to_numpy(zero_copy_only=False))],
                    ["id", "tokens", "n_tokens", "round_trip"],
                )

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(run, f"id {kind}, tokens array<int>, n_tokens int, round_trip boolean").withColumnRenamed("id", id_col)


def decode_documents(df: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Texts of token arrays: (id, text). Null arrays and arrays that hold a
    null or an id outside the vocabulary give a null text."""
    ship_code(df.sparkSession)
    path = os.path.join(folder, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, _ = model(path)
        for batch in batches:
            texts = [None if x is None or any(i is None or not 0 <= i < m.size for i in x) else m.decode(x) for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    out = df.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
