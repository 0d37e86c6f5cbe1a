"""Operator 3: quality rules on tokeniser fertility.

A public vocabulary with byte fallback tells how a text breaks up: characters
per token, the share of byte tokens, and the entropy of its tokens. Bands are
set per language (or script, where the language is unknown) and per length
class (powers of two of tokens) around the median over all documents. A
document is never judged by another language's band. A band's width is a
multiple of the spread above the median (median to 84th percentile, a standard
deviation of a normal law): junk lowers fertility and entropy and so can't
widen its own band. Bands of few documents are wider, by a factor that falls
steadily with their number.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.bpe import VOCABULARIES
from quern.llm.chunks import ODD_SPACES, ChunkPool, resident, slices, text_array
from quern.session import checked_join, fresh_name, materialize, ship_code

VOCABULARY = "piece_bpe_32k.model"
#: Half-width of a band in robust standard deviations.
WIDTH = 5.0
#: A band of n documents is 1 + SCATTER / sqrt(n) times as wide, so a document
#: that is alone in its band is kept.
SCATTER = 4.0
#: Steps in which characters per token, byte share and entropy are counted.
GRID = (0.005, 0.0005, 0.005)
#: Least robust deviation of characters per token, byte share and entropy.
FLOORS = (0.03, 0.01, 0.1)
_SLICE = 4_000_000


def _load(path: str):
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    is_byte = np.array([sp.is_byte(i) or sp.is_unknown(i) for i in range(sp.get_piece_size())])
    return sp, is_byte, ChunkPool(lambda cs: sp.encode(cs, num_threads=1), limit=400_000)


def script_of(text: str) -> str:
    """The script with most letters: the first word of their Unicode names."""
    counts: dict[str, int] = {}
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    for point, n in zip(*np.unique(points, return_counts=True)):
        ch = chr(point)
        if ch.isalpha():
            name = unicodedata.name(ch, "UNKNOWN").split()[0]
            counts[name] = counts.get(name, 0) + int(n)
    return min(counts, key=lambda k: (-counts[k], k)).lower() if counts else "none"


def measure(path: str, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Tokens, characters, byte tokens and token entropy (bits) of each text."""
    sp, is_byte, pool = resident(("pieces", path), lambda: _load(path))
    n = len(texts)
    # beside plain single spaces a text is one chunk, since blanks form tokens
    odd = pc.match_substring_regex(texts, ODD_SPACES).to_numpy(zero_copy_only=False).astype(bool)
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    plain = ~odd & ~empty
    ids, offsets = pool.documents(texts.filter(pa.array(plain)))
    starts, ends = np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts[plain], ends[plain] = offsets[:-1], offsets[1:]
    if odd.any():
        own = sp.encode(texts.filter(pa.array(odd)).to_pylist(), num_threads=1)
        at = len(ids) + np.cumsum([0, *map(len, own)])
        ids = np.concatenate([ids, np.fromiter((i for x in own for i in x), ids.dtype, int(at[-1] - at[0]))])
        starts[odd], ends[odd] = at[:-1], at[1:]
    tokens, fallback, entropy = ends - starts, np.zeros(n, np.int64), np.zeros(n)
    for i in np.flatnonzero(tokens):
        run = ids[starts[i] : ends[i]]
        if len(run) > 4096:
            counts = np.bincount(run)
            values = np.flatnonzero(counts)
            counts = counts[values]
        else:
            run = np.sort(run)
            cuts = np.flatnonzero(np.diff(run)) + 1
            values = run[np.concatenate([[0], cuts])]
            counts = np.diff(np.concatenate([[0], cuts, [len(run)]]))
        fallback[i] = counts[is_byte[values]].sum()
        entropy[i] = np.log2(len(run)) - (counts * np.log2(counts)).sum() / len(run)
    return tokens, pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), fallback, np.maximum(entropy, 0)


_FEATURES = (("tokens", "bigint"), ("fertility", "double"), ("byte_share", "double"), ("entropy", "double"), ("band", "string"), ("size_class", "int"), ("script", "string"))


def add_features(df: DataFrame, names: tuple[str, ...], vocabulary: str, folder: str, text_col: str, lang_col: str) -> DataFrame:
    """All columns of ``df`` and the seven features under ``names``; ``band`` is
    the language."""
    ship_code(df.sparkSession)
    path = os.path.join(folder, vocabulary)
    text_name, lang_name = fresh_name(df, "__quern_text"), fresh_name(df, "__quern_lang")
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, langs = text_array(batch, text_name), batch.column(lang_name)
            for a, b in slices(whole, _SLICE):
                texts, lang = whole.slice(a, b - a), langs.slice(a, b - a)
                tokens, chars, fallback, entropy = measure(path, texts)
                some = np.maximum(tokens, 1)
                script = [script_of(t) for t in texts.to_pylist()]
                none = tokens == 0
                cols = [pa.array(tokens), pa.array(chars / some, mask=none), pa.array(fallback / some, mask=none), pa.array(entropy, mask=none), lang.cast(pa.string()), pa.array(np.floor(np.log2(some)).astype(np.int32)), pa.array(script, pa.string())]
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *cols], [*columns, *names])

    extended = df.select("*", F.col(text_col).cast("string").alias(text_name), F.col(lang_col).cast("string").alias(lang_name))
    for c, (_, kind) in zip(names, _FEATURES):
        extended = extended.withColumn(c, F.lit(None).cast(kind))
    schema = extended.drop(text_name, lang_name).schema
    return extended.select(*columns, text_name, lang_name).mapInArrow(run, schema)


def bands(features: DataFrame, names: tuple[str, ...], width: float = WIDTH, scatter: float = SCATTER, floors: tuple[float, ...] = FLOORS) -> DataFrame:
    """Limits per (band, size class): low and high fertility, highest byte
    share, lowest entropy. Quantiles are exact over figures rounded to GRID, so
    they don't hang on the order of the rows, and one aggregate gives them all."""
    tokens, fert, byte, ent, band, cls, _ = names
    parts = (("f", fert, GRID[0]), ("b", byte, GRID[1]), ("e", ent, GRID[2]))
    quantiles = [F.percentile(F.round(F.col(c) / grid) * grid, F.array(F.lit(0.5), F.lit(0.84))).alias(k) for k, c, grid in parts]
    centre = features.where(F.col(tokens) > 0).groupBy(F.col(band).alias("band"), F.col(cls).alias("class")).agg(F.count("*").alias("n"), *quantiles)
    # few documents don't tell how far others may be: their band is wider, without a step at any number
    wide = width * (1 + scatter / F.sqrt("n"))
    reach = {k: wide * F.greatest(F.col(k)[1] - F.col(k)[0], F.lit(floor)) for k, floor in zip("fbe", floors)}
    return centre.select("band", "class", (F.col("f")[0] - reach["f"]).alias("fert_low"), (F.col("f")[0] + reach["f"]).alias("fert_high"), (F.col("b")[0] + reach["b"]).alias("byte_high"), (F.col("e")[0] - reach["e"]).alias("ent_low"))


def judge(measured: DataFrame, names: tuple[str, ...], reason: str, **settings) -> DataFrame:
    """``measured`` with column ``reason``: null where the document is kept."""
    tokens, fert, byte, ent, band, cls, script = names
    placed = measured.withColumn(band, F.coalesce(F.col(band), F.concat(F.lit("script:"), F.col(script))))
    limits = materialize(bands(placed, names, **settings), "bands")
    b, c, own = (fresh_name(measured, f"__quern_{x}") for x in ("band_key", "class_key", "limits"))
    at = limits.select(F.col("band").alias(b), F.col("class").alias(c), F.struct("fert_low", "fert_high", "byte_high", "ent_low").alias(own))
    out = checked_join(placed, at, (F.col(band) == F.col(b)) & (F.col(cls) == F.col(c)), "left")
    limit = F.col(own)
    why = (
        F.when(F.col(tokens) == 0, "empty").when(F.col(fert) < limit["fert_low"], "low_fertility").when(F.col(fert) > limit["fert_high"], "high_fertility")
        .when(F.col(byte) > limit["byte_high"], "byte_fallback").when(F.col(ent) < limit["ent_low"], "low_entropy")
    )
    return out.withColumn(reason, why).drop(b, c, own)


def quality_report(df: DataFrame, vocabulary: str = VOCABULARY, folder: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """Figures and verdict of every document: (id, tokens, fertility,
    byte_share, entropy, band, size_class, reason, rejected).

    One row per input row, repeated rows included. Fertility is characters per
    token. A null or empty text has 0 tokens, null figures and is rejected as
    ``empty``. ``band`` is the language, or ``script:`` and the main script
    where the language is null. A value on a limit is kept. The fewer documents
    a band has in a length class, the wider it is; the only one is kept.
    Further columns are left out. Figures are worked out once, over whole
    texts, and written to the
    shared folder; the bands are few rows.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    names = tuple(n for n, _ in _FEATURES)
    measured = materialize(add_features(slim, names, vocabulary, folder, "text", "lang").drop("text", "lang"), "quality")
    out = judge(measured, names, "reason", **settings)
    return out.withColumn("rejected", F.col("reason").isNotNull()).drop("script").withColumnRenamed("id", id_col)


def keep_documents(df: DataFrame, vocabulary: str = VOCABULARY, folder: str = VOCABULARIES, text_col: str = "text", lang_col: str = "lang", **settings) -> DataFrame:
    """The rows of ``df`` that ``quality_report`` doesn't reject, all columns
    under any names. Null and empty texts go; repeated rows stay or go alike;
    an empty table stays empty."""
    names = tuple(fresh_name(df, f"__quern_{n}") for n, _ in _FEATURES)
    reason = fresh_name(df, "__quern_reason")
    measured = materialize(add_features(df, names, vocabulary, folder, text_col, lang_col), "quality")
    return judge(measured, names, reason, **settings).where(F.col(reason).isNull()).select(*(F.col(f"`{c}`") for c in df.columns))
