"""BM25 retrieval: an index-backed serving form and an offline form."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.operators.index import Index
from quern.plans.query import WORD_LIMIT, FreeText
from quern.session import BROADCAST_ROWS, checked_join, fits_broadcast, materialize, ship_code

K1, B = 1.2, 0.75
KEEP_TERMS = 10
FLOOR = 100


def bm25(tf: Column, length: Column, mean: Column, idf: Column, k1: float = K1, b: float = B) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def plain_idf(n: Column, df: Column) -> Column:
    """Negative for terms that more than half of the documents have."""
    return F.log((n - df + 0.5) / (df + 0.5))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def search(index: Index, query: Sequence[str] | FreeText, limit: int = 100_000, k1: float = K1, b: float = B, keep: int = KEEP_TERMS, floor: int = FLOOR, prune: bool = True) -> DataFrame:
    """(doc_id, bm25_score) of the best documents, highest first, ties by id.

    At most 20 words; repeated words count once. The ``keep`` terms of highest
    idf score; candidates are the documents of the rarest, narrowed by each next
    term only while more than ``floor`` remain. Candidate sets are bit masks: one
    pass gives each document the mask of its terms, and as there are at most
    2^keep masks, which terms narrow is decided on a few counted rows.
    """
    words = query.words if isinstance(query, FreeText) else tuple(query)[:WORD_LIMIT]
    words = list(dict.fromkeys(w for w in words if w))
    spark = index.docs.sparkSession
    empty = index.docs.select("doc_id").limit(0).withColumn("bm25_score", F.lit(0.0))
    stats = index.stats.first()
    if not words or not stats["n_docs"]:
        return empty
    known = {r["term"]: r["df"] for r in index.terms.where(F.col("term").isin(words)).select("term", "df").collect()}
    rows = spark.range(1).select(*(plain_idf(F.lit(float(stats["n_docs"])), F.lit(float(known[w]))).alias(f"i{j}") for j, w in enumerate(words) if w in known)).first() if known else None
    idf = {w: rows[f"i{j}"] for j, w in enumerate(words) if w in known} if rows is not None else {}
    chosen = sorted(idf, key=lambda w: (-idf[w], w))[:keep]
    if not chosen:
        return empty
    value = F.create_map(*(x for w in chosen for x in (F.lit(w), F.lit(idf[w]))))
    bit = F.create_map(*(x for j, w in enumerate(chosen) for x in (F.lit(w), F.lit(1 << j))))
    hits = index.postings_for(chosen).select("doc_id", "term", "tf")
    hits = _with_length(hits, index)
    score = bm25(F.col("tf"), F.col("doc_length"), F.lit(float(stats["avg_length"])), F.element_at(value, F.col("term")), k1, b)
    scored = hits.groupBy("doc_id").agg(F.sum(score).alias("bm25_score"), F.bit_or(F.element_at(bit, F.col("term"))).alias("mask"))
    if prune and len(chosen) > 1:
        scored = materialize(scored, "scored")
        counts = {r["mask"]: r["n"] for r in scored.groupBy("mask").agg(F.count("*").alias("n")).collect()}
        need = F.lit(narrowing(counts, len(chosen), floor))
        scored = scored.where(F.col("mask").bitwiseAND(need) == need)
    elif prune:
        scored = scored.where(F.col("mask").bitwiseAND(F.lit(1)) == 1)
    return scored.select("doc_id", "bm25_score").orderBy(F.desc("bm25_score"), "doc_id").limit(limit)


def _with_length(hits: DataFrame, index: Index) -> DataFrame:
    # the documents' lengths are as many as documents: joined by a shuffle
    return hits.join(index.docs.select("doc_id", "doc_length"), "doc_id")


def narrowing(counts: dict[int, int], terms: int, floor: int = FLOOR) -> int:
    """Mask of the terms (rarest first) that candidates must all have."""
    need = 1
    for j in range(1, terms):
        tried = need | 1 << j
        if sum(n for m, n in counts.items() if m & tried == tried) > floor:
            need = tried
    return need


def search_all(index: Index, query: Sequence[str], limit: int = 50, k1: float = 1.5, b: float = B) -> DataFrame:
    """The offline form: smoothed idf, no pruning, repeated words add up."""
    times: dict[str, int] = {}
    for w in tuple(query)[:WORD_LIMIT]:
        if w:
            times[w] = times.get(w, 0) + 1
    if not times:
        return index.docs.select("doc_id").limit(0).withColumn("bm25_score", F.lit(0.0))
    weight = F.create_map(*(x for w, n in times.items() for x in (F.lit(w), F.lit(n))))
    hits = index.postings_for(list(times)).select("doc_id", "term", "tf")
    df = index.terms.where(F.col("term").isin(list(times))).select("term", "df")
    hits = hits.join(F.broadcast(df), "term")  # at most one row a word of the query
    hits = hits.join(index.docs.select("doc_id", "doc_length"), "doc_id", "left").crossJoin(F.broadcast(index.stats))
    score = bm25(F.col("tf"), F.coalesce("doc_length", F.lit(1)), F.col("avg_length"), smooth_idf(F.col("n_docs"), F.col("df")), k1, b)
    out = hits.groupBy("doc_id").agg(F.sum(score * F.element_at(weight, F.col("term"))).alias("bm25_score"))
    return out.orderBy(F.desc("bm25_score"), "doc_id").limit(limit)


def search_many(index: Index, queries: DataFrame, limit: int = 10, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, bm25_score, rank) for a table (query_id, term): the
    batch form. Scores are rounded to ``digits`` before they are ranked.

    A document's weights meet all queries in a product of matrices (of terms
    that many queries have; the others' are added up one by one), and each
    partition passes on the best of a query only: rows of queries by documents
    are never made. Query tables too large to send to all tasks are joined.

    The index should be a saved or ``stored`` one, since its parts are read
    several times.
    """
    q = queries.where("term <> ''").select("query_id", "term").distinct()
    weighted = checked_join(index.terms, q.select("term").distinct(), "term", "left_semi", BROADCAST_ROWS).crossJoin(F.broadcast(index.stats))
    weighted = weighted.select("term", plain_idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_length")
    if fits_broadcast(q):
        scored = _scored_by_document(index, q, weighted, limit, k1, b, digits)
    else:
        hits = index.postings.select("doc_id", "term", "tf").join(weighted, "term").join(index.docs.select("doc_id", "doc_length"), "doc_id")
        hits = hits.withColumn("s", bm25(F.col("tf"), F.col("doc_length"), F.col("avg_length"), F.col("idf"), k1, b)).select("doc_id", "term", "s")
        scored = hits.join(q, "term").groupBy("query_id", "doc_id").agg((F.sum("s") if digits is None else F.round(F.sum("s"), digits)).alias("bm25_score"))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), "doc_id")))
    return best.where(F.col("rank") <= limit)


def _scored_by_document(index: Index, q: DataFrame, weighted: DataFrame, limit: int, k1: float, b: float, digits: int | None) -> DataFrame:
    """(query_id, doc_id, bm25_score): of each partition of documents the
    ``limit`` best of every query."""
    spark, kind, qkind = index.docs.sparkSession, index.docs.schema["doc_id"].dataType, q.schema["query_id"].dataType
    ship_code(spark)
    known = {r["term"]: (i, r["idf"], r["avg_length"]) for i, r in enumerate(weighted.orderBy("term").collect())}
    wanted: dict = {}
    for r in q.collect():  # measured by the caller
        if r["term"] in known:
            wanted.setdefault(r["query_id"], []).append(known[r["term"]][0])
    names = list(wanted)
    idf = np.array([x[1] for x in known.values()], float)
    mean = next(iter(known.values()))[2] if known else 1.0
    blocks = []  # queries: their number, the matrix of common terms, and the queries of each other term
    for start in range(0, len(names), 1024):
        pairs = np.array(sorted({(t, j) for j, n in enumerate(names[start : start + 1024]) for t in wanted[n]}), np.int64).reshape(-1, 2)
        often = np.bincount(pairs[:, 0], minlength=len(idf))
        common = np.full(len(idf), -1)
        top = np.argsort(-often, kind="stable")[:2048]
        top = top[often[top] >= 8]
        common[top] = np.arange(len(top))
        matrix = np.zeros((len(top), min(1024, len(names) - start)))
        dense = common[pairs[:, 0]] >= 0
        matrix[common[pairs[dense, 0]], pairs[dense, 1]] = 1
        rest = pairs[~dense]
        blocks.append((start, matrix, common, np.searchsorted(rest[:, 0], np.arange(len(idf) + 1)), rest[:, 1]))
    shared = spark.sparkContext.broadcast((idf, blocks, pa.array(names, to_arrow_type(qkind))))
    codes = spark.createDataFrame([(t, x[0]) for t, x in known.items()], "term string, t int")
    hits = index.postings.select("doc_id", "term", "tf").join(F.broadcast(codes), "term").select("doc_id", "t", F.col("tf").cast("long").alias("n"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a fixed number: few bytes, but much work
    lengths = index.docs.select("doc_id", F.lit(-1).alias("t"), F.col("doc_length").cast("long").alias("n"))
    rows = lengths.unionByName(hits).where("doc_id IS NOT NULL").repartition(parts, "doc_id").sortWithinPartitions("doc_id", "t")
    most = 1000  # documents at once
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, blocks, query_ids = shared.value
        best: dict[int, tuple[np.ndarray, pa.Array]] = {}  # by query: scores and ids

        def take(t: pa.Table, cuts: np.ndarray) -> None:
            """Whole documents, at most ``most``, in order of their ids."""
            term, n = t.column("t").to_numpy(), t.column("n").to_numpy()
            ids = t.column("doc_id").combine_chunks().take(pa.array(cuts[:-1]))
            doc = np.repeat(np.arange(len(ids)), np.diff(cuts))
            at = np.flatnonzero(term >= 0)
            sized = np.flatnonzero(term < 0)
            weight, known = np.zeros(len(term)), np.zeros(len(term), bool)
            turn = np.arange(len(sized)) - np.searchsorted(doc[sized], doc[sized])  # an id may stand twice
            for r in range(int(turn.max(initial=-1)) + 1):
                length = np.full(len(ids), np.nan)
                length[doc[sized[turn == r]]] = n[sized[turn == r]]
                on = at[~np.isnan(length[doc[at]])]
                tf = n[on].astype(float)
                weight[on] += idf[term[on]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc[on]] / mean))
                known[on] = True
            at = at[known[at]]
            for start, matrix, common, first, asked in blocks:
                shape = (len(ids), matrix.shape[1])
                on, few = at[common[term[at]] >= 0], at[common[term[at]] < 0]
                cell = doc[on] * max(1, len(matrix)) + common[term[on]]
                area = len(ids) * max(1, len(matrix))
                left = np.bincount(cell, weight[on], area).reshape(len(ids), -1)[:, : len(matrix)]
                there = (np.bincount(cell, minlength=area) > 0).reshape(len(ids), -1)[:, : len(matrix)]
                times = first[term[few] + 1] - first[term[few]]
                which = np.repeat(np.arange(len(few)), times)
                own = asked[np.arange(len(which)) + np.repeat(first[term[few]] - (np.cumsum(times) - times), times)]
                cell = doc[few[which]] * shape[1] + own
                scores = left @ matrix + np.bincount(cell, weight[few[which]], shape[0] * shape[1]).reshape(shape)
                met = (there.astype(np.float32) @ matrix.astype(np.float32) > 0) | (np.bincount(cell, minlength=shape[0] * shape[1]) > 0).reshape(shape)
                if digits is not None:
                    scores = np.round(scores, digits)
                scores = np.where(met, scores, -np.inf)
                for j in range(matrix.shape[1]):
                    s, have = scores[:, j], best.get(start + j)
                    floor = have[0][-1] if have is not None and len(have[0]) >= limit else -np.inf
                    on = np.flatnonzero(s > floor)  # of equal scores the lesser ids came first
                    if len(on) > limit:
                        on = on[s[on] >= np.partition(s[on], -limit)[-limit]]
                    if len(on):
                        own = (s[on], ids.take(pa.array(on))) if have is None else (np.append(have[0], s[on]), pa.concat_arrays([have[1], ids.take(pa.array(on))]))
                        order = np.argsort(-own[0], kind="stable")[:limit]
                        best[start + j] = (own[0][order], own[1].take(pa.array(order)))

        held: list[pa.Table] = []  # rows of documents that wait
        for batch in itertools.chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            if not held or batch is not None and sum(h.num_rows for h in held) < 50_000:
                continue
            t = pa.concat_tables(held).combine_chunks()
            code = t.column("doc_id").combine_chunks().dictionary_encode().indices.to_numpy()
            cuts = np.append(np.flatnonzero(np.append(True, code[1:] != code[:-1])), len(code))
            if batch is not None:
                cuts = cuts[:-1]  # the last document may go on
            for i in range(0, len(cuts) - 1, most):
                own = cuts[i : i + most + 1]
                take(t[int(own[0]) : int(own[-1])], own - own[0])
            held = [t[int(cuts[-1]) :]] if batch is not None else []
        for j, (s, ids) in best.items():
            yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(np.full(len(s), j))), ids.cast(arrow), pa.array(s)], ["query_id", "doc_id", "bm25_score"])

    return rows.mapInArrow(run, f"query_id {qkind.simpleString()}, doc_id {kind.simpleString()}, bm25_score double")


def search_by_shard(index: Index, query: Sequence[str], shard_col: str, limit: int = 100_000, k1: float = K1, b: float = B, keep: int = KEEP_TERMS, floor: int = FLOOR) -> DataFrame:
    """As ``search``, with document frequencies, kept terms and narrowing of
    each shard's own (a column of ``docs``), and global counts and mean length.
    What is collected is a few rows for each shard."""
    words = list(dict.fromkeys(w for w in tuple(query)[:WORD_LIMIT] if w))
    empty = index.docs.select("doc_id").limit(0).withColumn("bm25_score", F.lit(0.0))
    stats = index.stats.first()
    if not words or not stats["n_docs"]:
        return empty
    spark = index.docs.sparkSession
    hits = materialize(index.postings_for(words).select("doc_id", "term", "tf").join(index.docs.select("doc_id", "doc_length", F.col(shard_col).alias("shard")), "doc_id"), "hits")
    by: dict = {}
    for r in hits.groupBy("shard", "term").agg(F.count("*").alias("df")).collect():
        by.setdefault(r["shard"], {})[r["term"]] = math.log((stats["n_docs"] - r["df"] + 0.5) / (r["df"] + 0.5))
    kept = {s: sorted(v, key=lambda w: (-v[w], w))[:keep] for s, v in by.items()}
    if not kept:
        return empty
    kind = hits.schema["shard"].dataType.simpleString()
    rows = [(s, w, by[s][w], 1 << j) for s, ws in kept.items() for j, w in enumerate(ws)]
    weights = spark.createDataFrame(rows, f"s {kind}, t string, idf double, bit int")
    joined = checked_join(hits, weights, F.col("shard").eqNullSafe(F.col("s")) & (F.col("term") == F.col("t")))
    score = bm25(F.col("tf"), F.col("doc_length"), F.lit(float(stats["avg_length"])), F.col("idf"), k1, b)
    scored = materialize(joined.groupBy("shard", "doc_id").agg(F.sum(score).alias("bm25_score"), F.bit_or("bit").alias("mask")), "scored")
    counts: dict = {}
    for r in scored.groupBy("shard", "mask").agg(F.count("*").alias("n")).collect():
        counts.setdefault(r["shard"], {})[r["mask"]] = r["n"]
    need = spark.createDataFrame([(s, narrowing(c, len(kept[s]), floor)) for s, c in counts.items()], f"s {kind}, need int")
    out = checked_join(scored, need, F.col("shard").eqNullSafe(F.col("s"))).where(F.col("mask").bitwiseAND(F.col("need")) == F.col("need"))
    return out.select("doc_id", "bm25_score").orderBy(F.desc("bm25_score"), "doc_id").limit(limit)
