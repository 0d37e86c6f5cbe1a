"""Operator 1: document fingerprints by consistent weighted sampling.

A text is a multiset of words; a word's weight is its count. For sample k each
word has r, c ~ Gamma(2, 1) and b ~ U(0, 1), all derived from hashes of the
word and k. With t = floor(ln w / r + b), the word's draw is
ln a = ln c - r (t - b) - r, and the sample is the (word, t) of least draw. Two
documents agree on a sample with probability sum min(w) / sum max(w), the
generalised Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.chunks import segments, slices, text_array
from quern.llm.words import mix, word_hashes
from quern.session import ship_code

SAMPLES = 64
_SLICE = 1_000_000
_HALF = np.uint64(32)
_LOW = np.uint64(0xFFFFFFFF)
_STEP = np.float32(2.0**-32)


def draws(words: np.ndarray, weights: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """For each weighted word and sample: the draw in the high half, ordered as
    an unsigned number, and 32 bits that stand for (word, t) in the low half."""
    out = np.empty((len(words), samples), np.uint64)
    log_w = np.log(weights.astype(np.float32))
    for k in range(samples):
        base = words + np.uint64((k * 0x9E3779B9 + seed * 0x85EBCA6B + 1) & 0xFFFFFFFFFFFFFFFF)
        h1 = mix(base)
        h2 = mix(h1)
        h3 = mix(h2)
        u1, u2 = ((h1 >> _HALF).astype(np.float32) + 0.5) * _STEP, ((h1 & _LOW).astype(np.float32) + 0.5) * _STEP
        u3, u4 = ((h2 >> _HALF).astype(np.float32) + 0.5) * _STEP, ((h2 & _LOW).astype(np.float32) + 0.5) * _STEP
        b = (h3 >> _HALF).astype(np.float32) * _STEP
        r = -np.log(u1 * u2)
        c = -np.log(u3 * u4)
        r = np.maximum(r, np.float32(1e-6))
        c = np.maximum(c, np.float32(1e-12))
        t = np.floor(log_w / r + b)
        draw = np.log(c) - r * (t - b) - r
        bits = draw.view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000))
        low = mix(words ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) ^ np.uint64(seed)) & _LOW
        out[:, k] = order.astype(np.uint64) << _HALF | low
    return out


def signatures(words: np.ndarray, offsets: np.ndarray, samples: int = SAMPLES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the documents that have words, and every document's count
    of distinct words. ``words`` are hashes, document after document."""
    n = len(offsets) - 1
    distinct, inverse = np.unique(words, return_inverse=True)
    m = max(len(distinct), 1)
    pairs, counts = np.unique(segments(offsets) * m + inverse, return_counts=True)
    docs, codes = pairs // m, pairs % m
    per_doc = np.bincount(docs, minlength=n)
    most = int(counts.max()) + 1 if len(counts) else 1
    weighted, at = np.unique(codes * most + counts, return_inverse=True)
    table = draws(distinct[weighted // most] if len(weighted) else np.empty(0, np.uint64), weighted % most, samples, seed)
    starts = (np.cumsum(per_doc) - per_doc)[per_doc > 0]
    out = np.empty((len(starts), samples), np.int32)
    for k in range(0, samples, 16):
        if len(starts):
            out[:, k : k + 16] = (np.minimum.reduceat(table[:, k : k + 16][at], starts, axis=0) & _LOW).astype(np.uint32).view(np.int32)
    return out, per_doc


def fingerprint_documents(df: DataFrame, samples: int = SAMPLES, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Weighted-sampling signatures: (id, n_words, signature array<int>).

    One row per input row, repeated rows included; equal texts get equal
    signatures. A text without words (null, empty, punctuation only) has
    n_words 0 and a null signature. ``n_words`` counts distinct words. Further
    columns are left out. No shuffle; whole texts of any length are used.
    """
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = text_array(batch, "text")
            for a, b in slices(whole, _SLICE):
                words, offsets = word_hashes(whole.slice(a, b - a))
                sigs, per_doc = signatures(words, offsets, samples, seed)
                ends = np.concatenate([[0], np.cumsum(per_doc > 0) * samples])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(per_doc == 0, False)), pa.array(sigs.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(per_doc, pa.int32()), lists], ["id", "n_words", "signature"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = out.schema["id"].dataType.simpleString()
    return out.mapInArrow(run, f"id {kind}, n_words int, signature array<int>").withColumnRenamed("id", id_col)


def estimated_similarity(a, b):
    """Share of samples on which two signature columns agree; null if either is null."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return same / F.size(a)
