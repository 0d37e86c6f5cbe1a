"""Measures of retrieval without relevance labels, and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.operators.vectors import matrix, row_lists, unit_rows
from quern.session import checked_join, materialize, ship_code

#: Points of a cell of ``density_clusters``: at least and at most, and bytes at most.
SMALL, LARGE, CELL_BYTES = 4096, 65_536, 64_000_000


def clarity(retrieved: DataFrame, corpus: DataFrame, normalised: bool = True, unknown: float = 1e-12) -> DataFrame:
    """(query_id, clarity): KL divergence of the terms retrieved for a query
    from the corpus. ``retrieved`` is (query_id, term, tf), ``corpus`` (term,
    cf). Corpus shares add up to 1 if ``normalised``, else are counts; a term
    that the corpus lacks has share ``unknown`` (over the total, if normalised)."""
    counts = retrieved.groupBy("query_id", "term").agg(F.sum("tf").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("query_id"))
    total = corpus.agg(F.sum("cf").alias("total"))
    joined = counts.withColumn("p", p).join(corpus.select("term", "cf"), "term", "left").crossJoin(F.broadcast(total))
    q = F.coalesce(F.col("cf").cast("double"), F.lit(unknown))
    return joined.groupBy("query_id").agg(F.sum(F.col("p") * F.log(F.col("p") / (q / F.col("total") if normalised else q))).alias("clarity"))


def collection_overlap(query_terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(query_id, overlap): share of a query's tokens that are terms."""
    known = vocabulary.select("term").distinct().withColumn("known", F.lit(1))
    return query_terms.join(known, "term", "left").groupBy("query_id").agg((F.countDistinct(F.when(F.col("known") == 1, F.col("term"))) / F.count("*")).alias("overlap"))


def mean_jaccard(doc_terms: DataFrame) -> DataFrame:
    """(query_id, jaccard): mean over pairs of a query's documents. The table is
    (query_id, doc_id, term); pairs meet only on common terms, and pairs
    without any count as 0."""
    t = doc_terms.select("query_id", "doc_id", "term").distinct()
    sizes = t.groupBy("query_id", "doc_id").agg(F.count("*").alias("size"))
    a, b = t.alias("a"), t.alias("b")
    common = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    common = common.groupBy(F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).agg(F.count("*").alias("n"))
    sx = sizes.select("query_id", F.col("doc_id").alias("x"), F.col("size").alias("sx"))
    sy = sizes.select("query_id", F.col("doc_id").alias("y"), F.col("size").alias("sy"))
    total = common.join(sx, ["query_id", "x"]).join(sy, ["query_id", "y"]).groupBy("query_id").agg(F.sum(F.col("n") / (F.col("sx") + F.col("sy") - F.col("n"))).alias("total"))
    pairs = sizes.groupBy("query_id").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    return pairs.join(total, "query_id", "left").select("query_id", F.when(F.col("pairs") > 0, F.coalesce("total", F.lit(0.0)) / F.col("pairs")).alias("jaccard"))


def mean_cosine(doc_tf: DataFrame, lengths: DataFrame) -> DataFrame:
    """(query_id, cosine): mean over pairs of documents' vectors of length-damped
    frequencies f / (f + 1.5 (0.25 + 0.75 dl / mean)). Tables are (query_id,
    doc_id, term, tf) and (doc_id, doc_length)."""
    joined = doc_tf.join(lengths, "doc_id")
    mean = lengths.agg(F.avg("doc_length").alias("mean"))
    w = joined.crossJoin(F.broadcast(mean)).select("query_id", "doc_id", "term", (F.col("tf") / (F.col("tf") + 1.5 * (0.25 + 0.75 * F.col("doc_length") / F.col("mean")))).alias("w"))
    norms = w.groupBy("query_id", "doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    a, b = w.alias("a"), w.alias("b")
    dots = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    dots = dots.groupBy(F.col("a.query_id").alias("query_id"), F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y")).agg(F.sum(F.col("a.w") * F.col("b.w")).alias("dot"))
    nx = norms.select("query_id", F.col("doc_id").alias("x"), F.col("norm").alias("nx"))
    ny = norms.select("query_id", F.col("doc_id").alias("y"), F.col("norm").alias("ny"))
    total = dots.join(nx, ["query_id", "x"]).join(ny, ["query_id", "y"]).groupBy("query_id").agg(F.sum(F.col("dot") / (F.col("nx") * F.col("ny"))).alias("total"))
    pairs = norms.groupBy("query_id").agg((F.count("*") * (F.count("*") - 1) / 2).alias("pairs"))
    return pairs.join(total, "query_id", "left").select("query_id", F.when(F.col("pairs") > 0, F.coalesce("total", F.lit(0.0)) / F.col("pairs")).alias("cosine"))


def _pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums over all pairs of sign(da) sign(db), sign(da)^2 and sign(db)^2, in
    O(n log^2 n). Missing scores are NaN, and their pairs add nothing."""

    def tied(*keys: np.ndarray) -> int:
        """Pairs that are equal in all keys, which are in lexical order."""
        ends = np.flatnonzero(np.append(np.any([k[1:] != k[:-1] for k in keys], 0), True)) if len(keys[0]) else np.zeros(0, int)
        n = np.diff(np.append(-1, ends))
        return int((n * (n - 1) // 2).sum())

    def apart(x: np.ndarray) -> int:
        x = np.sort(x[~np.isnan(x)])
        return len(x) * (len(x) - 1) // 2 - tied(x)

    both = ~(np.isnan(a) | np.isnan(b))
    x, y = a[both], np.unique(b[both], return_inverse=True)[1]
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    n = len(x)
    agree = n * (n - 1) // 2 - tied(x) - tied(np.sort(y)) + tied(x, y)
    seq = y  # inversions, by each bit of the ranks among those that share the higher bits
    for k in reversed(range(int(y.max()).bit_length() if n else 0)):
        high, bit = seq >> (k + 1), (seq >> k) & 1
        starts = np.flatnonzero(np.append(True, high[1:] != high[:-1]))
        ones = np.cumsum(bit)
        base = np.repeat((ones - bit)[starts], np.diff(np.append(starts, n)))
        agree -= 2 * int((ones - base)[bit == 0].sum())
        seq = seq[np.argsort(seq >> k, kind="stable")]
    return np.array([agree, apart(a), apart(b)], float)


def _correlations(item: pd.Series, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[float | None, float | None]:
    """Kendall's tau-b and Spearman's rho of one query's scores; ``na`` and
    ``nb`` say which are null."""
    kendall = spearman = None
    there = item.notna().to_numpy()
    x, y = np.where(na, np.nan, a)[there], np.where(nb, np.nan, b)[there]
    bad = lambda v, null: bool((np.isnan(v) & ~null[there]).any() or (v == np.inf).sum() > 1 or (v == -np.inf).sum() > 1)
    if len(x) > 1:
        sums = _pair_sums(x, y)
        if item[there].duplicated().any():  # rows of one item are no pair
            for at in pd.Series(np.arange(len(x))).groupby(item[there].to_numpy()).indices.values():
                if len(at) > 1:
                    sums = sums - _pair_sums(x[at], y[at])
        if bad(x, na) or bad(y, nb):
            kendall = np.nan  # as the difference of two such scores
        elif sums[1] > 0 and sums[2] > 0:
            kendall = sums[0] / np.sqrt(sums[1] * sums[2])

    def ranks(v: np.ndarray, null: np.ndarray) -> np.ndarray:
        """Average ranks, null first and NaN last."""
        order = np.lexsort((v, np.where(null, 0, np.where(np.isnan(v), 2, 1))))
        s, z = np.where(null, 0, v)[order], null[order]
        new = np.append(True, (z[1:] != z[:-1]) | ((s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))))
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(s)))
        out = np.empty(len(s))
        out[order] = np.repeat(first + 1 + (size - 1) / 2, size)
        return out

    ra, rb = (r - r.mean() for r in (ranks(np.where(na, 0, a), na), ranks(np.where(nb, 0, b), nb)))
    if (spread := (ra @ ra) * (rb @ rb)) > 0:
        spearman = (ra @ rb) / np.sqrt(spread)
    return kendall, spearman


def rank_correlation(lists: DataFrame) -> DataFrame:
    """(query_id, kendall, spearman) of two scores of the same items: (query_id,
    item, a, b). Kendall's tau-b over all pairs, counted without making them;
    Spearman on average ranks. Null where all scores of one kind are equal.

    A query's rows pass through one task, as arrays of numbers.
    """
    key, kind = lists.schema["query_id"].dataType.simpleString(), "kendall double, spearman double"
    rows = lists.select("query_id", "item", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    out = pa.schema([("query_id", to_arrow_type(lists.schema["query_id"].dataType)), ("kendall", pa.float64()), ("spearman", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the query that has not ended

        def judged(t: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            t = t.combine_chunks()
            item = t.column("item").to_pandas()
            (a, na), (b, nb) = ((c.to_numpy(), c.is_null().to_numpy()) for c in (t.column("a"), t.column("b")))
            found = [_correlations(item[i:j], a[i:j], b[i:j], na[i:j], nb[i:j]) for i, j in zip(cuts, cuts[1:])]
            q = t.column("query_id").take(pa.array(cuts[:-1]))
            k = [None if q[n].as_py() is None else x for n, (x, _) in enumerate(found)]  # null queries have no pairs
            return pa.RecordBatch.from_arrays([pa.concat_arrays(q.chunks).cast(out.field(0).type), pa.array(k, pa.float64()), pa.array([x for _, x in found], pa.float64())], schema=out)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            codes = t.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            ends = (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()
            if held and held[-1].column("query_id")[-1].as_py() != t.column("query_id")[0].as_py():
                whole = pa.concat_tables(held)
                held = []
                yield judged(whole, [0, whole.num_rows])
            if ends:
                whole, before = pa.concat_tables([*held, t[: ends[-1]]]), sum(h.num_rows for h in held)
                yield judged(whole, [0, *(before + e for e in ends)])
                held = [t[ends[-1] :]]
            else:
                held.append(t)
        if held:
            whole = pa.concat_tables(held)
            yield judged(whole, [0, whole.num_rows])

    ship_code(lists.sparkSession)
    return rows.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, f"query_id {key}, {kind}")


def _cells(rows: DataFrame, radius: float, size: int | None, pivots: int = 256) -> tuple[DataFrame, DataFrame, int]:
    """Points (id, v) as unit vectors with their cells, the pairs (i, j) of cells, i <= j, that can hold
    two points within the radius, and the number of these pairs.

    A cell is what lies nearest to one of at most ``pivots`` points of the
    table, cut further by a hash where that is more than ``size`` points. By
    the angles' triangle inequality two pivots' cells can only hold a close pair
    if their angle is at most both cells' widest angles and the radius'.
    """
    spark, n = rows.sparkSession, rows.count()
    if size is None:
        first = rows.select(F.size("v").alias("n")).first()
        size = max(1, min(max(SMALL, n // 12), LARGE, CELL_BYTES // (8 * max(1, first["n"] if first else 1))))
    chosen = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(max(1, min(pivots, n // size))).select("v").collect()  # at most ``pivots`` rows
    centre = unit_rows(np.array([r[0] for r in chosen])) if chosen else np.zeros((0, 1))
    shared = spark.sparkContext.broadcast(centre)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = unit_rows(matrix(b.column("v")))
                s = v @ shared.value.T
                at = s.argmax(1)
                wide = np.arccos(np.clip(s[np.arange(len(s)), at], -1, 1))
                yield pa.RecordBatch.from_arrays([b.column("id"), row_lists(v), pa.array(at.astype(np.int32)), pa.array(wide)], ["id", "v", "pivot", "wide"])

    kind = rows.schema["id"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(place, f"id {kind}, v array<double>, pivot int, wide double"), "placed")
    found = {r["pivot"]: (r["wide"], -(-r["n"] // size)) for r in placed.groupBy("pivot").agg(F.max("wide").alias("wide"), F.count("*").alias("n")).collect()}
    reach = np.arccos(np.clip(1 - radius, -1, 1)) + 1e-6
    close = [(i, j) for i in found for j in found if i <= j and np.arccos(np.clip(centre[i] @ centre[j], -1, 1)) <= found[i][0] + found[j][0] + reach]
    cuts = F.create_map(*(F.lit(x) for p, (_, c) in found.items() for x in (p, c))) if found else F.lit(None).cast("map<int,int>")
    points = placed.withColumn("cell", F.col("pivot").cast("long") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(2)), F.try_element_at(cuts, F.col("pivot")))).select("id", "v", "cell")
    pairs = spark.createDataFrame([(i, j, found[i][1], found[j][1]) for i, j in close], "p int, q int, x int, y int")
    pairs = pairs.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("x") - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("y") - 1)))
    pairs = pairs.select((F.col("p").cast("long") * (1 << 32) + F.col("a")).alias("i"), (F.col("q").cast("long") * (1 << 32) + F.col("b")).alias("j"))
    return points, pairs.where("i <= j"), sum(found[i][1] * found[j][1] for i, j in close)


def _hits(a: np.ndarray, b: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ``a`` and ``b`` within the radius, tile by tile. Products are in
    single precision; those too near to the radius for it are made again."""
    a4, b4 = a.astype(np.float32), b.astype(np.float32)
    least, slack = 1 - radius, (a.shape[1] + 8) * 1.2e-7
    for x in range(0, len(a), 1024):
        for y in range(0, len(b), 1024):
            s = a4[x : x + 1024] @ b4[y : y + 1024].T
            at = np.flatnonzero(s >= np.float32(least - slack))
            r, c, found = at // s.shape[1] + x, at % s.shape[1] + y, s.ravel()[at]
            open_ = np.flatnonzero(found <= np.float32(least + slack))
            if len(open_):
                keep = np.ones(len(at), bool)
                keep[open_] = _distances(a, b, r[open_], c[open_]) <= radius
                r, c = r[keep], c[keep]
            if len(r):
                yield r.astype(np.int32), c.astype(np.int32)


def _distances(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for at in range(0, len(r), 65536):
        out[at : at + 65536] = 1 - np.einsum("ij,ij->i", a[r[at : at + 65536]], b[c[at : at + 65536]])
    return out


def _union(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``root`` names each point's group by its least member; joins those of the
    points ``x`` and ``y``, pair by pair."""
    while True:
        p, q = root[x], root[y]
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return root
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while not np.array_equal(up := root[root], root):
            root = up


def _meet(a: np.ndarray, b: np.ndarray | None, radius: float, least: int, held: int = 4_000_000) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """What two cells (or one, without ``b``) say of their points, numbered
    through both: how many close ones each has here; (x, y, distance) of each x
    that has fewer than ``least``; and groups of the others as (x, member).

    So what a cell pair gives grows with its points, not with its close pairs.
    More than ``held`` close pairs aren't kept but found a second time.
    """
    n, shift, other = len(a) + (0 if b is None else len(b)), 0 if b is None else len(a), a if b is None else b
    count, kept, total = np.zeros(n, np.int64), [], 0
    for r, c in _hits(a, other, radius):
        c = c + np.int32(shift)
        count += np.bincount(r, minlength=n)
        if b is not None:
            count += np.bincount(c, minlength=n)
        total += len(r)
        if total <= held:
            kept.append((r, c))
        else:
            kept.clear()
    few, root, pairs = count < least, np.arange(n), []
    for r, c in kept if total <= held else ((r, c + np.int32(shift)) for r, c in _hits(a, other, radius)):
        for x, y in ((r, c),) if b is None else ((r, c), (c, r)):
            if len(at := np.flatnonzero(few[x])):
                pairs.append((x[at], y[at], _distances(a, other, r[at], c[at] - shift)))
        both = np.flatnonzero(~few[r] & ~few[c])
        root = _union(root, r[both], c[both])
    x, y, d = (np.concatenate(z) for z in zip(*pairs)) if pairs else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    own = np.flatnonzero(root != np.arange(n))
    return count, (x, y, d), (own, root[own])


def _least_labels(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, cluster): the least id that links (a, b) lead to. A label is itself
    a point's id, so each round also takes the label's label, and the rounds
    grow with the logarithm of the longest way."""
    links = materialize(links.union(links.select("b", "a")).distinct(), "links")
    labels = materialize(ids.withColumn("cluster", F.col("id")), "labels")
    while True:
        step = links.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("cluster").alias("m"))
        least = labels.join(step, labels["id"] == step["a"], "left").select("id", F.least("cluster", F.coalesce("m", "cluster")).alias("near"), "cluster")
        up = labels.select(F.col("id").alias("near"), F.col("cluster").alias("far"))
        moved = materialize(least.join(up, "near").select("id", F.least("near", "far").alias("cluster"), (F.least("near", "far") < F.col("cluster")).alias("moved")), "labels")
        labels = moved.select("id", "cluster")
        if moved.where("moved").isEmpty():
            return labels


def density_clusters(points: DataFrame, radius: float = 0.3, least: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", size: int | None = None) -> DataFrame:
    """(id, cluster): DBSCAN by cosine distance; noise is -1, a cluster is named
    by its least core id, a border point joins its nearest core's cluster.

    Points meet in pairs of cells of at most ``size`` points (see ``_cells``),
    each pair a task over packed vectors, so all close pairs are found. Close
    pairs aren't written: a task gives counts, the pairs of points that have few
    there, and groups of the others (see ``_meet``).
    """
    spark = points.sparkSession
    ship_code(spark)
    rows = points.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    placed, pairs, tasks = _cells(rows, radius, size)
    kind = rows.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(rows.schema["id"].dataType)

    def pack(rows: pa.Table) -> pa.Table:
        v, ids, cell = matrix(rows["v"]), rows["id"].combine_chunks(), rows["cell"][0].as_py()
        cuts = list(range(0, len(v), 4096))
        names = pa.ListArray.from_arrays(pa.array([*cuts, len(v)], pa.int32()), ids)
        return pa.table({"cell": [cell] * len(cuts), "ids": names, "v": [v[c : c + 4096].tobytes() for c in cuts], "dim": pa.array([v.shape[1]] * len(cuts), pa.int32())})

    packed = materialize(placed.groupBy("cell").applyInArrow(pack, f"cell long, ids array<{kind}>, v binary, dim int"), "cells")
    ends = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cell"))
    spread = checked_join(packed, ends, "cell")
    found_schema = pa.schema([("a", arrow), ("b", arrow), ("d", pa.float64()), ("n", pa.int64())])

    def meet(rows: pa.Table) -> pa.Table:
        i, j = rows["i"][0].as_py(), rows["j"][0].as_py()
        cells = rows["cell"].to_numpy()
        order = np.concatenate([np.flatnonzero(cells == c) for c in ([i] if i == j else [i, j])])
        vectors = lambda c: np.concatenate([np.frombuffer(rows["v"][k].as_py()).reshape(-1, rows["dim"][k].as_py()) for k in np.flatnonzero(cells == c)] or [np.zeros((0, 1))])
        if not np.any(cells == i) or not np.any(cells == j):
            return found_schema.empty_table()
        ids = pa.concat_arrays([rows["ids"][int(k)].values for k in order]).cast(arrow)
        count, (x, y, d), (own, root) = _meet(vectors(i), None if i == j else vectors(j), radius, least)
        there = np.flatnonzero(count)
        nothing = lambda t, n: pa.nulls(n, t)
        parts = [
            [ids.take(pa.array(there)), nothing(arrow, len(there)), nothing(pa.float64(), len(there)), pa.array(count[there])],
            [ids.take(pa.array(x)), ids.take(pa.array(y)), pa.array(d), nothing(pa.int64(), len(x))],
            [ids.take(pa.array(own)), ids.take(pa.array(root)), nothing(pa.float64(), len(own)), nothing(pa.int64(), len(own))],
        ]
        return pa.concat_tables(pa.Table.from_arrays(p, schema=found_schema) for p in parts)

    # more partitions than pairs, since a hash puts some together
    met = spread.repartition(max(1, min(3 * tasks, 10_000)), "i", "j").groupBy("i", "j").applyInArrow(meet, f"a {kind}, b {kind}, d double, n long")
    near = materialize(met, "neighbours")
    core = materialize(near.where("n IS NOT NULL").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(F.col("a").alias("id")), "core")
    linked = near.where("n IS NULL AND a <> b")
    links = linked.join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")
    labels = _least_labels(core, links)
    border = near.where("d IS NOT NULL").join(core.withColumnRenamed("id", "a"), "a", "left_anti").join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min_by("cluster", F.struct("d", "cluster")).alias("c"))
    out = placed.select("id").join(labels, "id", "left").join(border, F.col("id") == F.col("a"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("cluster", "c", F.lit(-1).cast(kind)).alias("cluster"))


def tag_clusters(vectors: DataFrame, k: int = 5, components: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(id, cluster): k clusters by bisecting k-means after a reduction to
    principal components; it divides from the top as Ward's method joins from
    below, and needs no matrix of all distances."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vec_col).isNotNull()).select(id_col, array_to_vector(F.col(vec_col)).alias("features"))
    size = len(vectors.where(F.col(vec_col).isNotNull()).select(vec_col).first()[0])
    reduced = PCA(k=min(components, size), inputCol="features", outputCol="reduced").fit(rows).transform(rows)
    out = BisectingKMeans(k=k, seed=seed, featuresCol="reduced", predictionCol="cluster").fit(reduced).transform(reduced)
    return out.select(id_col, "cluster")


def silhouette(vectors: DataFrame, clusters: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Mean silhouette with squared distances."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.join(clusters, id_col).select(array_to_vector(F.col(vec_col)).alias("features"), F.col("cluster").cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(rows)


def silhouette_sweep(vectors: DataFrame, ks=range(2, 11), **names) -> list[tuple[int, float]]:
    return [(k, silhouette(vectors, tag_clusters(vectors, k, **names), **names)) for k in ks]


def davies_bouldin(vectors: DataFrame, clusters: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row: mean over clusters of the worst (spread + spread) / distance."""
    rows = vectors.join(clusters, id_col).where("cluster >= 0").select("cluster", F.posexplode(vec_col).alias("i", "x"), id_col)
    centre = rows.groupBy("cluster", "i").agg(F.avg("x").alias("c"))
    far = rows.join(centre, ["cluster", "i"]).groupBy("cluster", id_col).agg(F.sqrt(F.sum((F.col("x") - F.col("c")) * (F.col("x") - F.col("c")))).alias("d"))
    spread = far.groupBy("cluster").agg(F.avg("d").alias("s"))
    a, b = centre.alias("a"), centre.alias("b")
    apart = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.cluster") != F.col("b.cluster"))).groupBy(F.col("a.cluster").alias("x"), F.col("b.cluster").alias("y")).agg(F.sqrt(F.sum((F.col("a.c") - F.col("b.c")) * (F.col("a.c") - F.col("b.c")))).alias("d"))
    sx, sy = spread.select(F.col("cluster").alias("x"), F.col("s").alias("sx")), spread.select(F.col("cluster").alias("y"), F.col("s").alias("sy"))
    worst = apart.join(sx, "x").join(sy, "y").groupBy("x").agg(F.max((F.col("sx") + F.col("sy")) / F.col("d")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


