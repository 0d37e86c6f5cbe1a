"""Ranking after retrieval: metadata score, fusion, filters and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import split_tags
from quern.functions.vectors import cosine, min_max
from quern.session import checked_join

WEIGHTS = {"viewcount": 1.2, **dict.fromkeys(("userreputation", "creationdate", "score"), 1.5)}
FUSION = (0.0, 0.6, 0.4)
DEPTH = 200


def add_metadata_score(docs: DataFrame, ranges: DataFrame | None = None, weights: Mapping[str, float] = WEIGHTS, ignore_score: bool = False, name: str = "metadata_score") -> DataFrame:
    """Weighted sum of min-max normalised fields. ``ranges`` is one row of
    min_x and max_x (the docs' own by default); a field without a range adds 0.
    ``ignore_score`` puts 0 in the place of the documents' score. Null fields
    count as 0."""
    own = {f: w for f, w in weights.items() if f in docs.columns}
    if ranges is None:
        ranges = docs.agg(*(g(F.coalesce(F.col(f), F.lit(0))).alias(f"{n}_{f}") for f in own for n, g in (("min", F.min), ("max", F.max))))
    ranges = ranges.select(*(F.col(f"{n}_{f}").alias(f"__quern_{n}_{f}") for f in own for n in ("min", "max")))
    total = F.lit(0.0)
    for f, w in own.items():
        value = F.lit(0.0) if ignore_score and f == "score" else F.coalesce(F.col(f), F.lit(0))
        total = total + min_max(value, F.col(f"__quern_min_{f}"), F.col(f"__quern_max_{f}")) * w
    return docs.crossJoin(F.broadcast(ranges)).withColumn(name, total).drop(*ranges.columns)  # ranges is one row


def rerank_metadata(results: DataFrame) -> DataFrame:
    """By metadata score, 1 less where there is no title, highest first."""
    untitled = F.coalesce(F.col("title"), F.lit("")) == ""
    return results.withColumn("metadata_score", F.col("metadata_score") - F.when(untitled, 1.0).otherwise(0.0)).orderBy(F.desc("metadata_score"), "doc_id")


def add_lm_score(results: DataFrame, vectors: DataFrame, query: Sequence[float], ascending: bool = False, drop_missing: bool = False) -> DataFrame:
    """Cosine of documents' vectors (doc_id, embedding) with the query's. A
    document without a vector gets the least score less 0.1, or -1 if no
    document has one; ``drop_missing`` lets it go instead."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scores = vectors.join(results.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", cosine(F.col("embedding"), q).alias("lm_score"))
    out = results.drop("lm_score").join(scores, "doc_id", "inner" if drop_missing else "left")
    least = scores.agg(F.min("lm_score").alias("__quern_least"))  # one row
    out = out.crossJoin(F.broadcast(least)).withColumn("lm_score", F.coalesce("lm_score", F.col("__quern_least") - 0.1, F.lit(-1.0))).drop("__quern_least")
    return out.orderBy(F.asc("lm_score") if ascending else F.desc("lm_score"), "doc_id")


def fuse(results: DataFrame, weights: Sequence[float] = FUSION, by: Sequence[str] = ()) -> DataFrame:
    """Adds final_score: weighted sum of the min-max normalised bm25, lm and
    metadata scores within a query's results; a flat score counts as 0.
    Without ``by`` all rows are one query's results, and their ranges come from
    an aggregate of one row."""
    if not by:
        names = ("bm25_score", "lm_score", "metadata_score")
        ranges = results.agg(*(f(c).alias(f"__quern_{n}_{c}") for c in names for n, f in (("min", F.min), ("max", F.max))))
        total = F.lit(0.0)
        for c, weight in zip(names, weights):
            total = total + min_max(F.col(c), F.col(f"__quern_min_{c}"), F.col(f"__quern_max_{c}")) * float(weight)
        return results.crossJoin(F.broadcast(ranges)).withColumn("final_score", total).drop(*ranges.columns).orderBy(F.desc("final_score"), "doc_id")
    w = Window.partitionBy(*by)
    total = F.lit(0.0)
    for c, weight in zip(("bm25_score", "lm_score", "metadata_score"), weights):
        total = total + min_max(F.col(c), F.min(c).over(w), F.max(c).over(w)) * float(weight)
    return results.withColumn("final_score", total).orderBy(*by, F.desc("final_score"), "doc_id")


def sort_by_date(results: DataFrame, order: str | None) -> DataFrame:
    """``newest`` or ``oldest`` first; anything else leaves the order."""
    if order not in ("newest", "oldest"):
        return results
    return results.orderBy(F.desc_nulls_last("creation_date") if order == "newest" else F.asc_nulls_last("creation_date"), "doc_id")


def parse_clusters(lines: Sequence[str]) -> list[tuple[int, str]]:
    """(cluster, tag) pairs of a cluster file's lines."""
    import re

    out, current = [], None
    for line in lines:
        if m := re.match(r"Cluster\s+(?P<number>[0-9]+)\s.*:$", line.strip()):
            current = int(m["number"])
        elif current is not None and line.strip():
            out += [(current, t.strip()) for t in line.split(",") if t.strip()]
    return out


def add_cluster_tags(results: DataFrame, clusters: DataFrame, tags_col: str = "tags", name: str = "cluster_tags") -> DataFrame:
    """Clusters of each row's tags: of every tag the first cluster that has it,
    each cluster once. ``clusters`` is (cluster_id, cluster, tag)."""
    first = clusters.groupBy("tag").agg(F.min_by("cluster", "cluster_id").alias("cluster"))
    tags = results.select("doc_id", F.explode(split_tags(F.col(tags_col))).alias("tag"))
    found = checked_join(tags, first, "tag").groupBy("doc_id").agg(F.sort_array(F.collect_set("cluster")).alias(name))
    return results.drop(name).join(found, "doc_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def filter_clusters(results: DataFrame, clusters: DataFrame, chosen: Sequence[str], tags_col: str = "tags") -> DataFrame:
    """Rows with a tag in any chosen cluster; no choice keeps all rows."""
    if not chosen:
        return results
    wanted = clusters.where(F.col("cluster").isin(list(chosen))).select("tag").distinct()
    hits = checked_join(results.select("doc_id", F.explode(split_tags(F.col(tags_col))).alias("tag")), wanted, "tag", "left_semi")
    return results.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")


def format_results(ranked: DataFrame, docs: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The 15 result columns of ranked ids; ids without a document go."""
    out = ranked.join(docs.drop("bm25_score", "lm_score"), "doc_id")
    have = set(out.columns)
    pick = lambda name, source, kind: (F.col(source) if source in have else F.lit(None)).cast(kind).alias(name)
    out = out.select(
        "doc_id", pick("bm25_score", "bm25_score", "double"), pick("lm_score", "lm_score", "double"), pick("score", "score", "long"), pick("tags", "tags", "string"),
        pick("ownerdisplayname", "ownerdisplayname", "string"), pick("creation_date", "creationdate", "timestamp"), pick("view_count", "viewcount", "long"), pick("answer_count", "answercount", "long"),
        pick("comment_count", "commentcount", "long"), pick("favorite_count", "favoritecount", "long"), pick("metadata_score", "metadata_score", "double"), pick("title", "title", "string"), pick("body", "body", "string"))
    if clusters is None:
        return out.withColumn("cluster_tags", F.array().cast("array<string>"))
    return add_cluster_tags(out, clusters)


def page(results: DataFrame, number: int, size: int) -> DataFrame:
    """Rows [number * size, (number + 1) * size) of an ordered result."""
    return results.offset(number * size).limit(size)


def ranked_page(results: DataFrame, order: Sequence[Column], number: int, size: int, by: Sequence[str] = ()) -> DataFrame:
    """The same for many queries at once, with the rank as a column."""
    out = results.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return out.where((F.col("rank") >= number * size) & (F.col("rank") < (number + 1) * size))


def backfill(results: DataFrame, more: DataFrame, size: int) -> DataFrame:
    """Fill a short result with rows of ``more`` that it doesn't have."""
    extra = more.join(results.select("doc_id"), "doc_id", "left_anti")
    both = results.withColumn("__quern_o", F.lit(0)).unionByName(extra.withColumn("__quern_o", F.lit(1)), allowMissingColumns=True)
    return both.orderBy("__quern_o", F.desc_nulls_last("bm25_score"), "doc_id").limit(size).drop("__quern_o")


def score_subset(results: DataFrame, today: str, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The offline form: fields are normalised within the retrieved rows, with
    the age in days in the place of the date."""
    weights = weights or {"viewcount": 1.2, **dict.fromkeys(("days_since_creation", "userreputation", "score"), 1.5)}
    aged = results.withColumn("days_since_creation", F.datediff(F.lit(today).cast("date"), F.col("creationdate").cast("date")))
    return add_metadata_score(aged, weights=weights).orderBy(F.desc("metadata_score"), "doc_id")


def rescore(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Document records of merged segments with the metadata score worked out
    again over the ranges of all of them; the score they had goes."""
    out = docs.drop("metadata_score")
    return add_metadata_score(out, weights=weights) if weights is not None else add_metadata_score(out)


def fill(results: DataFrame, docs: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """The k best of a result; a shorter one is filled up with other documents,
    drawn by a seeded hash of the id, so a rerun draws the same."""
    best = results.orderBy(F.desc("bm25_score"), "doc_id").limit(k)
    order = F.xxhash64("doc_id", F.lit(seed))
    others = docs.select("doc_id").join(results.select("doc_id"), "doc_id", "left_anti").withColumn("__quern_h", order).orderBy("__quern_h", "doc_id").limit(k)
    both = best.select("doc_id", "bm25_score", F.lit(0).alias("__quern_o"), F.lit(0).cast("long").alias("__quern_h")).unionByName(others.select("doc_id", F.lit(None).cast("double").alias("bm25_score"), F.lit(1).alias("__quern_o"), "__quern_h"))
    return both.orderBy("__quern_o", F.desc_nulls_last("bm25_score"), "__quern_h", "doc_id").limit(k).drop("__quern_o", "__quern_h")
