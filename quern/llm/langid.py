"""Operator 2: language identification by nearest centroid.

Letters' 2- and 3-grams of lower-cased words, with word edges, are hashed to
buckets; a text is the unit vector of (1 + ln count) * idf. Each language has
several centroids, found by spherical k-means on a bounded labelled sample. A
text takes the language of the centroid of highest cosine, unless the cosine is
below a limit that depends on the text's length. Every labelled language has a
centroid, but documents of languages that are known from few aren't rejected
for their distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.chunks import slices, text_array
from quern.llm.words import code_points, mix, tables
from quern.session import checked_join, fresh_name, materialize, ship_code

BUCKETS = 8192
#: At most so many labelled documents of each language are fitted to.
SAMPLE = 300
#: Documents of languages with fewer labelled documents aren't rejected for
#: distance: few documents don't tell how far the others may be.
LEAST = 5
CENTROIDS = 4
#: A text is rejected below this share of the usual cosine at its length.
NEAR = 0.6
#: So many languages are known at most: those with most labelled documents.
#: With SAMPLE this bounds what the driver fits to.
LANGUAGES = 200
_SLICE = 2_000_000
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def text_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all texts in order of place (at one place the
    2-gram first), and the texts' offsets in them.

    Whatever isn't a letter is a blank; a gram of two needs a letter, one of
    three a letter in the middle, so words have a blank at either end.
    """
    if not len(texts):
        return np.empty(0, np.int32), np.zeros(1, np.int64)
    points, at = code_points(texts)
    letter = np.zeros(len(points) + 2, bool)
    letter[1:-1] = tables().is_letter[points]
    values = np.full(len(letter), 32, np.uint64)
    values[1:-1][letter[1:-1]] = points[letter[1:-1]]
    two = mix(values[:-2] * _STEPS[0] + values[1:-1] * _STEPS[1])
    three = mix(values[:-2] * _STEPS[0] + values[1:-1] * _STEPS[1] + (values[2:] + np.uint64(1)) * _STEPS[2])
    keep = np.stack([letter[:-2] | letter[1:-1], letter[1:-1]], 1)
    grams = np.stack([two, three], 1)[keep]
    ends = np.concatenate([[0], np.cumsum(keep.sum(1))])
    return (grams % np.uint64(BUCKETS)).astype(np.int32), ends[at]


def gram_bucket(gram: str) -> int:
    """The bucket of one 2- or 3-gram, for tests."""
    total = sum(ord(c) * int(k) for c, k in zip(gram[:2], _STEPS)) + ((ord(gram[2]) + 1) * int(_STEPS[2]) if len(gram) > 2 else 0)
    return int(mix(np.array([total % (1 << 64)], np.uint64))[0] % np.uint64(BUCKETS))


def counts_matrix(values: np.ndarray, offsets: np.ndarray, a: int, b: int) -> np.ndarray:
    n = b - a
    rows = np.repeat(np.arange(n), np.diff(offsets[a : b + 1]))
    own = values[offsets[a] : offsets[b]]
    return np.bincount(rows * BUCKETS + own, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)


def unit_vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros_like(counts)
    some = counts > 0
    out[some] = 1 + np.log(counts[some])
    out *= idf
    norms = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return np.divide(out, norms, out=out, where=norms > 0)


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language number of each centroid
    centroids: np.ndarray  # one column per centroid
    idf: np.ndarray
    usual: np.ndarray  # median cosine by log2 of the number of n-grams
    settled: frozenset[str]  # languages whose documents may be rejected for distance
    blank: bool = False  # fitted to a table without rows: nothing is identified

    def classify(self, texts: pa.Array, near: float = NEAR, declared: Sequence[str | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1 where there is none), cosine, rejected."""
        values, offsets = text_buckets(texts)
        n, sizes = len(texts), np.diff(offsets)
        lang, cosine = np.full(n, -1), np.zeros(n)
        for a in range(0, n, 128):
            b = min(a + 128, n)
            if self.owner.size:
                scores = unit_vectors(counts_matrix(values, offsets, a, b), self.idf) @ self.centroids
                best = scores.argmax(1)
                lang[a:b], cosine[a:b] = self.owner[best], scores[np.arange(b - a), best]
        lang[sizes == 0] = -1
        level = np.minimum(np.log2(np.maximum(sizes, 1)).astype(int), len(self.usual) - 1)
        far = cosine < near * self.usual[level]
        if declared is not None:
            far &= np.array([d is None or d in self.settled for d in declared], bool)
        return lang, cosine, far | (sizes == 0) | self.blank


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids; starts are each farthest from those before."""
    k = min(k, len(x))
    mean = x.mean(0)
    picks = [int((x @ mean).argmax())]
    while len(picks) < k:
        picks.append(int((x @ x[picks].T).max(1).argmin()))
    c = x[picks].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        for j in range(k):
            if (at == j).any():
                m = x[at == j].mean(0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def fit_texts(texts: list[str], labels: list[str], centroids: int = CENTROIDS, least: int = LEAST) -> Model:
    """A model from labelled texts: two thirds of each language make centroids,
    the rest sets the usual cosine of each length, on runs of 2^j n-grams. Of a
    language with fewer than ``least`` texts all make centroids."""
    rows_of: dict[str, list[int]] = {}
    for i, v in enumerate(labels):
        rows_of.setdefault(v, []).append(i)
    languages = sorted(rows_of)
    settled = frozenset(x for x in languages if len(rows_of[x]) >= least)
    values, offsets = text_buckets(pa.array(texts, pa.large_string()))
    df = np.zeros(BUCKETS)
    for a in range(0, len(texts), 256):  # never all texts as dense vectors at once
        df += (counts_matrix(values, offsets, a, min(a + 256, len(texts))) > 0).sum(0)
    idf = (np.log((1 + len(texts)) / (1 + df)) + 1).astype(np.float32)
    own, held = np.zeros(len(texts), int), np.zeros(len(texts), bool)
    parts, owner = [], []
    for j, v in enumerate(languages):
        rows = np.array(rows_of[v])
        own[rows] = j
        if v in settled:
            held[rows[2::3]] = True
        some = rows[np.diff(offsets)[rows] > 0]
        some = some[~held[some]] if (~held[some]).any() else some
        x = np.concatenate([np.zeros((0, BUCKETS), np.float32), *(unit_vectors(counts_matrix(values, offsets, i, i + 1), idf) for i in some.tolist())])
        c = spherical_kmeans(x, centroids) if len(x) else x
        parts.append(c)
        owner += [j] * len(c)
    cent = np.concatenate([np.zeros((0, BUCKETS), np.float32), *parts]).T.astype(np.float32)
    owner = np.array(owner, int)
    usual, last = [], 0.0
    for level in range(20):
        size, found = 1 << level, []
        for i in np.flatnonzero(held):
            total = offsets[i + 1] - offsets[i]
            for start in range(0, total - size + 1, max(size, total // 4 + 1)):
                run = values[offsets[i] + start : offsets[i] + start + size]
                v = unit_vectors(np.bincount(run, minlength=BUCKETS).astype(np.float32)[None], idf)[0]
                mine = cent[:, owner == own[i]]
                if mine.shape[1]:
                    found.append(float((v @ mine).max()))
        last = float(np.median(found)) if len(found) >= 20 else last
        usual.append(last)
    settled = frozenset(x for x in settled if languages.index(x) in set(owner.tolist()))
    return Model(languages, owner, cent, idf, np.array(usual), settled)


def fit(labelled: DataFrame, per_language: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> Model:
    """Fit on at most ``per_language`` labelled documents of each language,
    those whose hashed ids come first, with their whole texts; of more than
    LANGUAGES languages, on those that most documents have. Rows without a
    label, a text or an id aren't used; where there are no others, no document
    is rejected for distance. A model of an empty table rejects everything."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = [r["lang"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).select("lang").collect()]
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = usable.where(F.col("lang").isin(known)).select("id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    wanted = materialize(ids.select(F.col("id").alias("i"), F.col("lang").alias("l")).distinct(), "sample")
    rows = checked_join(usable, wanted, (F.col("id") == F.col("i")) & (F.col("lang") == F.col("l")), "left_semi")
    sample = sorted(rows.dropDuplicates(["id", "lang"]).collect(), key=lambda r: (r["lang"], str(r["id"])))
    model = fit_texts([r["text"] for r in sample], [r["lang"] for r in sample], **settings)
    model.blank = not sample and labelled.isEmpty()
    return model


_OUT = (("predicted", "string"), ("similarity", "double"), ("rejected", "boolean"))


def add_language(df: DataFrame, model: Model, names: tuple[str, str, str], near: float = NEAR, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """All columns of ``df`` and prediction, cosine and verdict under ``names``.
    A table without ``lang_col`` declares no languages."""
    ship_code(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    text_name, lang_name, columns = fresh_name(df, "__quern_text"), fresh_name(df, "__quern_lang"), df.columns
    declared = F.col(lang_col) if lang_col.lower() in {c.lower() for c in columns} else F.lit(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            whole = text_array(batch, text_name)
            for a, b in slices(whole, _SLICE):
                rows = batch.slice(a, b - a)
                lang, cosine, far = m.classify(whole.slice(a, b - a), near, rows.column(lang_name).to_pylist())
                cols = [pa.array([m.languages[i] if i >= 0 else None for i in lang], pa.string()), pa.array(np.round(cosine.astype(np.float64), 4)), pa.array(far)]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *cols], [*columns, *names])

    extended = df.select("*", F.col(text_col).cast("string").alias(text_name), declared.cast("string").alias(lang_name))
    for c, (_, kind) in zip(names, _OUT):
        extended = extended.withColumn(c, F.lit(None).cast(kind))
    return extended.select(*columns, text_name, lang_name).mapInArrow(run, extended.drop(text_name, lang_name).schema)


def identify(df: DataFrame, model: Model, near: float = NEAR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, predicted, similarity, rejected), one row per input row.

    ``lang`` is the declared language. A text without letters (null and empty
    texts too) has a null prediction, cosine 0 and is rejected; one whose
    declared language has under LEAST labelled documents isn't rejected for its
    distance, nor is any where the
    model knows no language (the prediction is null then). Of equal cosines
    the first language by name wins. Further columns are left out. Whole texts
    are used; no shuffle.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    out = add_language(slim, model, tuple(n for n, _ in _OUT), near)
    return out.drop("text").withColumnsRenamed({"id": id_col, "lang": lang_col})


def keep_identified(df: DataFrame, model: Model, near: float = NEAR, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` that ``identify`` doesn't reject, all columns under
    any names. Texts without letters go (null and empty ones too); repeated
    rows stay or go alike; an empty table stays empty."""
    names = tuple(fresh_name(df, f"__quern_{n}") for n, _ in _OUT)
    return add_language(df, model, names, near, text_col, lang_col).where(~F.col(names[2])).select(*(F.col(f"`{c}`") for c in df.columns))
