"""Operator 4: URL filter with a weighted vocabulary.

An Aho-Corasick automaton finds all strict and soft terms of a lower-cased URL
in one pass; a hit counts only if no ASCII letter or digit touches it. A URL is
rejected on one strict term or on ``min_soft`` different soft terms.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import ship_code

#: Terms of which one is enough, with their weights.
STRICT = {"adult": 1.0, "casino": 1.0, "porn": 1.0, "porno": 1.0, "xxx": 1.0, "viagra": 1.0, "escort": 1.0, "escorts": 1.0, "hentai": 1.0, "spam": 1.0, "warez": 1.0, "malware": 1.0, "phishing": 1.0, "webcam": 0.9}
#: Terms of which several different ones are needed.
SOFT = {"bet": 0.4, "bets": 0.4, "betting": 0.5, "bonus": 0.3, "cheap": 0.4, "click": 0.2, "crack": 0.4, "download": 0.2, "farm": 0.2, "free": 0.3, "gambling": 0.5, "jackpot": 0.5, "loan": 0.4, "loans": 0.4, "pharma": 0.4, "pill": 0.5, "pills": 0.5, "poker": 0.5, "sex": 0.5, "sexy": 0.5, "torrent": 0.4, "win": 0.3, "ads": 0.4, "track": 0.3, "tracker": 0.4}
MIN_SOFT = 2

_AROUND = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {i: i + 32 for i in range(65, 91)}


def find_terms(automaton, url: str) -> list[str]:
    """Every bounded occurrence of a term in an already lower-cased URL."""
    hits, size = [], len(url)
    for end, term in automaton.iter(url):
        start = end - len(term)
        if (start < 0 or url[start] not in _AROUND) and (end + 1 >= size or url[end + 1] not in _AROUND):
            hits.append(term)
    return hits


def build_automaton(terms) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    if len(a):
        a.make_automaton()
    return a


def filter_urls(df: DataFrame, strict: Mapping[str, float] = STRICT, soft: Mapping[str, float] = SOFT, min_soft: int = MIN_SOFT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Term counts, weighted score and verdict of every URL.

    Returns (id, url, strict_hits, soft_hits, strict_terms, soft_terms, score,
    rejected): hits count occurrences, terms count different terms, and score
    adds the weights of the different terms found. Repeated rows stay. Only
    ASCII letters are lower-cased and count as touching. A null or empty URL
    has no hits, score 0 and is not rejected. Further columns are left out. A
    term may not be both strict and soft. No shuffle.
    """
    both = set(strict) & set(soft)
    if both:
        raise ValueError(f"terms that are both strict and soft: {sorted(both)}")
    ship_code(df.sparkSession)
    strict, soft = dict(strict), dict(soft)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton([*strict, *soft])
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                hits = find_terms(automaton, url.translate(_LOWER)) if url and len(automaton) else []
                terms = sorted(set(hits))
                n_strict = sum(t in strict for t in terms)
                n_soft = len(terms) - n_strict
                score = round(sum(strict.get(t) or soft.get(t, 0.0) for t in terms), 6)
                rows.append((sum(t in strict for t in hits), sum(t in soft for t in hits), n_strict, n_soft, score, n_strict > 0 or n_soft >= min_soft))
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32()] * 4 + [pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["id", "url", "strict_hits", "soft_hits", "strict_terms", "soft_terms", "score", "rejected"])

    out = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    kind = out.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, strict_hits int, soft_hits int, strict_terms int, soft_terms int, score double, rejected boolean"
    return out.mapInArrow(run, schema).withColumnsRenamed({"id": id_col, "url": url_col})


def oracle(strict: Mapping[str, float] = STRICT, soft: Mapping[str, float] = SOFT, min_soft: int = MIN_SOFT) -> str:
    """The same over table ``pages`` in DuckDB SQL."""
    values = ", ".join(f"('{t}', {str(s).lower()}, {w!r})" for d, s in ((strict, True), (soft, False)) for t, w in d.items())
    return f"""
WITH vocab(term, is_strict, weight) AS (VALUES {values}),
numbered AS (SELECT row_number() OVER () AS rid, page_id, url FROM pages),
prepared AS (SELECT rid, ' ' || regexp_replace(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS u FROM numbered),
hits AS (SELECT rid, term, is_strict, weight, len(regexp_extract_all(u, '[^a-z0-9]' || term || '[^a-z0-9]')) AS n FROM prepared, vocab WHERE contains(u, term)),
totals AS (
  SELECT rid, sum(n) FILTER (is_strict) AS sh, sum(n) FILTER (NOT is_strict) AS oh,
         count(*) FILTER (is_strict) AS st, count(*) FILTER (NOT is_strict) AS ot, round(sum(weight), 6) AS score
  FROM hits WHERE n > 0 GROUP BY rid)
SELECT page_id, url, coalesce(sh, 0)::INTEGER AS strict_hits, coalesce(oh, 0)::INTEGER AS soft_hits,
       coalesce(st, 0)::INTEGER AS strict_terms, coalesce(ot, 0)::INTEGER AS soft_terms,
       coalesce(score, 0)::DOUBLE AS score, coalesce(st > 0 OR ot >= {min_soft}, false) AS rejected
FROM numbered LEFT JOIN totals USING (rid)"""
