"""Query expansion, boosts and spelling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.vectors import cosine
from quern.operators.vectors import embed_texts, nearest_many


def top_terms(terms: DataFrame, share: float = 0.005) -> DataFrame:
    """The share of terms that most documents have: (term, df)."""
    n = int(terms.count() * share)
    return terms.select("term", "df").orderBy(F.desc("df"), "term").limit(n)


def vocabulary_vectors(terms: DataFrame, embed=None, share: float = 0.005) -> DataFrame:
    """(term, embedding) of the commonest terms."""
    return embed_texts(top_terms(terms, share), embed, "term", "term")


def similar_terms(vocab: DataFrame, term: str, k: int = 3) -> DataFrame:
    """(term, similarity) of the k terms nearest to one of the vocabulary."""
    own = vocab.where(F.col("term") == term).select(F.col("embedding").alias("__quern_q")).limit(1)
    pairs = vocab.where(F.col("term") != term).crossJoin(F.broadcast(own))  # one row
    return pairs.select("term", cosine(F.col("embedding"), F.col("__quern_q")).alias("similarity")).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), "term").limit(k)


def expand_query(vocab: DataFrame, words: Sequence[str], k: int = 3, most: int = 10) -> list[str]:
    """The words and their neighbours, each once, at most ``most`` added; words
    outside the vocabulary add none. The order is fixed: words first, then
    neighbours word by word."""
    words = list(dict.fromkeys(words))
    q = vocab.where(F.col("term").isin(words)).select(F.col("term").alias("query_id"), F.col("embedding").alias("query"))
    found = nearest_many(vocab, q, k + 1, "term", "embedding").where("query_id <> term").collect()
    near = {w: [r["term"] for r in sorted((r for r in found if r["query_id"] == w), key=lambda r: r["rank"])][:k] for w in words}
    extra = [t for w in words for t in near[w] if t not in words]
    return words + list(dict.fromkeys(extra))[:most]


def boost(words: Sequence[str], boosted: Sequence[str]) -> list[str]:
    """Boosted words stand twice, which counts in forms that add repeats up."""
    return [*words, *(w for w in words if w in set(boosted))]


def correct_spelling(terms: DataFrame, words: Sequence[str], distance: int = 2) -> DataFrame:
    """(word, corrected): itself if it is a term, else the nearest term within
    ``distance`` edits, of several the one that most documents have; null if
    there is none. Terms of another length class aren't compared."""
    spark = terms.sparkSession
    q = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "word string")
    near = terms.select("term", "df").join(F.broadcast(q), F.abs(F.length("term") - F.length("word")) <= distance)  # the query's words
    near = near.withColumn("d", F.levenshtein("word", "term", distance)).where("d >= 0")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("word").orderBy("d", F.desc("df"), "term"))).where("r = 1")
    return q.join(best.select("word", F.col("term").alias("corrected")), "word", "left")
