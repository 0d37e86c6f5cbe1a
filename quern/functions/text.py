"""Text analysis as columns: splitting, cleaning and normalising terms in the JVM.

A configuration says what happens to links, contractions, digits, punctuation,
snake_case and camelCase. Everything but stemming is a built-in expression; the
stemmer runs over Arrow batches and stems each distinct term of a batch once.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from quern.functions.stem import stem

#: Words, for the plain analyser: runs of letters and digits.
SEPARATORS = r"[^\p{L}\p{N}]+"
LINK = r"^(?:https?://\S|www\.\S|[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-])"
CONTRACTION = r"(?<=\w)'(?=\w)"
CAMEL = r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
MARKS = r"[^\p{L}\p{N}_\s]+"
KEPT_MARKS = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: A short general list; a deployment passes its own by ``read_stop_words``.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with")
_PLAIN = {c: d for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1}


@dataclass(frozen=True)
class Analyzer:
    """links, contractions: remove, join or keep; digits: remove, split or keep;
    punctuation: split, keep-split (each mark is a token of its own), remove or keep; snake, camel: split, keep-split or keep."""

    links: str = "remove"
    contractions: str = "join"
    digits: str = "remove"
    punctuation: str = "split"
    snake: str = "split"
    camel: str = "split"
    stop_words: tuple[str, ...] = STOP_WORDS
    stemming: bool = True
    ascii: bool = True
    spell: bool = False  # other alphabets in Latin letters, beside ascii

    def without_stop_words(self) -> Analyzer:
        return replace(self, stop_words=())

    def keep_variables(self) -> Analyzer:
        """The profile that keeps whole variable names beside their parts."""
        return replace(self, snake="keep-split", camel="keep-split")


PLAIN = None  # letters and digits, lower-cased, nothing removed


def read_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Stop words of a white-space separated file."""
    rows = spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("w <> ''").distinct().collect()
    return tuple(sorted(r["w"] for r in rows))


def plain_terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


_words_of: dict[str, object] = {}


def word_characters(spark: SparkSession):
    """Broadcast: for each code point, whether ``SEPARATORS`` leaves it in a
    term. Asked of the JVM once an application, so both say the same."""
    app = spark.sparkContext.applicationId
    if app not in _words_of:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        kept = spark.sparkContext._jvm.java.util.regex.Pattern.compile(SEPARATORS).matcher(every).replaceAll("")
        table = np.zeros(1 << 21, bool)
        table[np.frombuffer(kept.encode("utf-32-le"), np.uint32)] = True
        _words_of.clear()
        _words_of[app] = spark.sparkContext.broadcast(table)
    return _words_of[app]


def plain_tokens(texts: pa.Array, words: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """``plain_terms`` of lower-cased texts, one after the other, and how many
    each has. Works on the bytes of the whole batch."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0]
    if (raw >= 0x80).any():
        try:
            raw.tobytes().decode()
        except UnicodeDecodeError:  # bytes that are no text separate, as in the JVM
            fixed = [t.decode("utf-8", "replace").encode() for t in texts.to_pylist()]
            return plain_tokens(pa.array(fixed, pa.large_binary()), words)
    word = words[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b = np.append(raw, np.zeros(3, np.uint8))
        one, (x, y, z) = b[lead].astype(np.int32), (b[lead + i].astype(np.int32) & 0x3F for i in (1, 2, 3))
        size = 2 + (one >= 0xE0) + (one >= 0xF0)
        point = np.select([size == 2, size == 3], [(one & 0x1F) << 6 | x, (one & 0xF) << 12 | x << 6 | y], (one & 7) << 18 | x << 12 | y << 6 | z)
        good = words[point]
        for i in range(4):
            there = size > i
            word[lead[there] + i] = good[there]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edges = cuts[:-1][cuts[:-1] < len(raw)]
    begins[edges] = word[edges]  # a text ends its last term
    start = np.flatnonzero(begins)
    place = np.cumsum(word, dtype=np.int32)
    ends = np.append(place[start] - 1, place[-1] if len(place) else 0).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(raw[word]))
    return flat, np.diff(np.searchsorted(start, cuts))


def to_ascii(text: Column) -> Column:
    """Latin letters without their accents, combining marks dropped."""
    letters = "".join(_PLAIN)
    return F.regexp_replace(F.translate(text, letters, "".join(_PLAIN.values())), r"\p{Mn}+", "")


#: Letters that stand for one or more Latin ones: ligatures, Greek, Cyrillic.
_SPELLED = {
    "ß": "ss", "Æ": "AE", "æ": "ae", "Ø": "O", "ø": "o", "Œ": "OE", "œ": "oe", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "Th", "þ": "th", "Ł": "L", "ł": "l", "ı": "i", "ﬁ": "fi", "ﬂ": "fl",
    **dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t u ph kh ps o".split())),
    **dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёіїєґ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch ' y ' e iu ia io i i ie g".split())),
    "–": "-", "—": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "...",
}
_SPELLED |= {k.upper(): v.capitalize() for k, v in _SPELLED.items() if len(k.upper()) == 1 and k.upper() not in _SPELLED}
#: Accented Greek and Cyrillic letters are spelled as their base letters, where the table has no entry of their own.
_SPELLED |= {c: _SPELLED[d] for c in map(chr, [*range(0x370, 0x530), *range(0x1F00, 0x2000)]) if c not in _SPELLED and (d := unicodedata.normalize("NFD", c)[0]) in _SPELLED}


def transliterate(text: Column) -> Column:
    """``to_ascii``, and ligatures, Greek, Cyrillic and typographic marks spelled
    in Latin letters. Other scripts stay: their spelling hangs on the language."""
    plain = to_ascii(text)
    pieces = F.split(plain, "")
    spelled = F.create_map(*(F.lit(x) for kv in _SPELLED.items() for x in kv))
    there = plain.rlike("[" + "".join(_SPELLED) + "]")
    return F.when(there, F.array_join(F.transform(pieces, lambda c: F.coalesce(F.try_element_at(spelled, c), c)), "")).otherwise(plain)


def _cut(text: Column, config: Analyzer) -> Column:
    """The text with a blank where its tokens are cut. Patterns run over whole
    texts: on each token alone, Spark would compile those of ``split`` again."""
    text = F.coalesce(text, F.lit(""))
    if config.ascii:
        plain = transliterate(text) if config.spell else to_ascii(text)
        text = F.when(text.rlike(r"[^\x00-\x7F]"), plain).otherwise(text)
    token = lambda own: rf"(?<!\S)(?:{own})\S*"
    if config.links == "remove":
        text = F.regexp_replace(text, token(LINK[1:]), "")
    if config.contractions == "join":
        text = F.regexp_replace(text, CONTRACTION, "")
    elif config.contractions == "remove":
        text = F.regexp_replace(text, token(r"\S*?\w'\w"), "")
    if config.digits == "split":
        text = F.regexp_replace(text, r"(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])", " ")
    elif config.digits == "remove" and config.punctuation != "split":
        text = F.regexp_replace(text, r"[0-9]+", " ")
    if config.punctuation == "split":  # with the digits in one pass
        text = F.regexp_replace(text, r"(?:[0-9]|[^\p{L}\p{N}_\s])+" if config.digits == "remove" else MARKS, " ")
    elif config.punctuation == "keep-split":
        text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " $0 ")
    elif config.punctuation == "remove":
        text = F.regexp_replace(text, MARKS, "")
    if config.snake == "split":
        text = F.regexp_replace(text, "_+", " ")
    if config.camel == "split":
        text = F.regexp_replace(text, CAMEL, " ")
    return text


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _with_parts(tokens: Column, config: Analyzer) -> Column:
    cuts = "|".join([*(["_+"] if config.snake == "keep-split" else []), *([CAMEL] if config.camel == "keep-split" else [])])

    def both(t: Column) -> Column:
        parts = F.transform(F.array(F.filter(F.split(t, cuts), lambda p: p != "")), lambda ps: F.when(F.size(ps) > 1, F.concat(F.array(t), F.transform(ps, lambda p: F.concat(F.lit(" "), p)))).otherwise(F.array(t)))
        return F.when(t.rlike(cuts), parts[0]).otherwise(F.array(t))

    return F.flatten(F.transform(tokens, both))


def raw_tokens(text: Column, config: Analyzer = Analyzer()) -> Column:
    """Tokens in order, before lower-casing and stop words. Kept-and-split
    variables are followed by parts that begin with a blank (see ``terms``)."""
    out = _words(_cut(text, config))
    return _with_parts(out, config) if "keep-split" in (config.snake, config.camel) else out


@lru_cache(maxsize=200_000)
def _known_stem(word: str) -> str:
    return stem(word)


@pandas_udf(T.ArrayType(T.StringType()))
def _stem_all(lists: pd.Series) -> pd.Series:
    return lists.map(lambda ws: None if ws is None else [_known_stem(w) for w in ws])


def terms(text: Column, config: Analyzer | None = Analyzer()) -> Column:
    """array<struct<term, pos>>: terms with positions in the text.

    A position is the token's number among all tokens before stop words go, so
    gaps of phrases are kept; parts of a kept variable have position -1. A null
    or empty text has no terms.
    """
    if config is PLAIN:
        return F.transform(plain_terms(text), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    return raw_terms(raw_tokens(text, config), config)


def raw_terms(raw: Column, config: Analyzer) -> Column:
    """``terms`` of the tokens of ``raw_tokens``."""
    part = lambda t: t.startswith(" ")

    def with_parts(ts: Column) -> Column:
        whole = F.transform(F.filter(ts, lambda t: ~part(t)), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        return F.concat(whole, F.transform(F.filter(ts, part), lambda t: F.struct(F.ltrim(t).alias("term"), F.lit(-1).alias("pos"))))

    if "keep-split" in (config.snake, config.camel):
        out = F.flatten(F.transform(F.array(raw), with_parts))  # a variable: the tokens are made once
    else:
        out = F.transform(raw, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    lower = lambda t: F.lower(t) if config.punctuation in ("split", "remove") else F.btrim(F.lower(t), F.lit("'"))
    out = F.transform(out, lambda x: F.struct(lower(x["term"]).alias("term"), x["pos"].alias("pos")))
    if config.stop_words:
        out = F.filter(out, lambda x: ~x["term"].isin(*config.stop_words))
    if config.punctuation not in ("split", "remove"):
        out = F.filter(out, lambda x: x["term"] != "")
    if config.stemming:
        stems = _stem_all(F.transform(out, lambda x: x["term"]))
        out = F.zip_with(stems, out, lambda s, x: F.struct(s.alias("term"), x["pos"].alias("pos")))
    return out


def text_length(text: Column, config: Analyzer | None = Analyzer()) -> Column:
    """Tokens before stop words go."""
    if config is PLAIN:
        return F.size(plain_terms(text))
    return F.size(F.filter(raw_tokens(text, config), lambda t: ~t.startswith(" ")))


def code_tokens(code: Column, symbols: str = r"(){}\[\];:,.<>=+\-*/%&|!^~?") -> Column:
    """Runs of other characters, and each symbol as a token of its own."""
    return F.regexp_extract_all(code, F.lit(rf"[^\s{symbols}]+|[{symbols}]"), F.lit(0))


def classic_tokens(text: Column) -> Column:
    """Hyphenated words are cut, e-mail addresses and links stay whole."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    return F.flatten(F.transform(words, lambda t: F.when(t.rlike(LINK), F.array(t)).otherwise(F.filter(F.split(t, r"[^\p{L}\p{N}']+"), lambda p: p != ""))))


def pre_tokens(text: Column) -> Column:
    """NFD, accents stripped, lower-cased, cut as a BPE trainer's input."""
    return F.regexp_extract_all(F.lower(to_ascii(F.coalesce(text, F.lit("")))), F.lit(r"[a-z]+|[0-9]|[^\sa-z0-9]"), F.lit(0))


def split_tags(tags: Column) -> Column:
    """Tags of ``|a|b|``, empty parts dropped; null gives an empty array."""
    return F.filter(F.split(F.coalesce(tags, F.lit("")), r"\|"), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(F.lit("|"), F.array_join(tags, "|"), F.lit("|"))).otherwise(F.lit(""))


def snippet(words: Column, limit: int = 30) -> Column:
    """Whole blocks (array of word arrays) while fewer than ``limit`` words
    have been taken; the last one may run over."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("words"))
    step = lambda s, b: F.when(s["n"] < limit, F.struct((s["n"] + F.size(b)).cast("int").alias("n"), F.concat(s["words"], b).alias("words"))).otherwise(s)
    return F.aggregate(words, start, step, lambda s: F.array_join(s["words"], " "))


def corpus_stop_words(terms: DataFrame, documents: int, share: float = 0.2, most: int = 200) -> tuple[str, ...]:
    """A stop list of the corpus itself: terms (term, df) that more than
    ``share`` of the documents have, at most ``most``, the commonest first."""
    rows = terms.where(F.col("df") > share * documents).orderBy(F.desc("df"), "term").limit(most).select("term").collect()
    return tuple(r["term"] for r in rows)
