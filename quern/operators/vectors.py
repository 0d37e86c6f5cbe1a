"""Vector search: exact and filtered nearest neighbours, and an inverted file."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.vectors import dot, norm, squared_distance
from quern.session import materialize, path_exists, ship_code

PROBES, LISTS, TRAIN = 64, 1024, 100_000
#: Vectors and queries of one block.
ROWS, QUERIES = 32_768, 4096


def _literal(v: Sequence[float]):
    return F.array(*(F.lit(float(x)) for x in v))


def matrix(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """One row a list, in double precision."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(lists), -1)


def row_lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows at unit length; zero rows stay as they are."""
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, n, out=rows.astype(np.float64), where=n > 0)


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", metric: str = "ip") -> DataFrame:
    """(id, score) of the k best by inner product, cosine or (least) L2."""
    v = F.col(vec_col)
    if metric == "l2":
        return vectors.select(id_col, squared_distance(v, _literal(query)).alias("score")).where("score IS NOT NULL").orderBy("score", id_col).limit(k)
    s = dot(v, _literal(query))
    if metric == "cosine":
        size = float(np.linalg.norm(np.asarray(query, float)))
        s = F.when(norm(v) * size > 0, s / (norm(v) * size))
    return vectors.select(id_col, s.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id", query_vec: str = "query") -> DataFrame:
    """(query_id, id, score, rank): every query against every vector.

    Both sides are cut into blocks by a hash; every pair of blocks is one task's
    matrix product, and passes on each query's k best of the block. So any
    number of queries is met in one way, nothing is collected, and what is
    shuffled beside the blocks is k rows a query and block. Ties go to the
    lesser id; rows without a vector have no scores.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    qkind = queries.schema[query_id].dataType.simpleString()
    rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    asked = queries.where(F.col(query_vec).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("q"))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n, m = rows.count(), asked.count()
    down, across = max(1, -(-n // ROWS), min(cores, n // 256)), max(1, -(-m // QUERIES))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("id"), F.lit(down).cast("long"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))))
    asked = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(across).cast("long"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))))

    def best(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(block):
            return pd.DataFrame({"query_id": own["query_id"][:0], "id": block["id"][:0], "score": np.zeros(0)})
        block = block.sort_values("id", kind="stable")
        names, matrix, out = block["id"].to_numpy(), np.stack(block["v"].to_numpy()).astype(np.float64), []
        for a in range(0, len(own), 256):
            part = own.iloc[a : a + 256]
            scores = np.stack(part["q"].to_numpy()).astype(np.float64) @ matrix.T
            for qid, s in zip(part["query_id"], scores):
                cut = np.partition(s, -min(k, len(s)))[-min(k, len(s))]
                at = np.flatnonzero(s >= cut)
                at = at[np.argsort(-s[at], kind="stable")][:k]
                out.append(pd.DataFrame({"query_id": [qid] * len(at), "id": names[at], "score": s[at]}))
        return pd.concat(out)

    found = asked.groupBy("i", "j").cogroup(rows.groupBy("i", "j")).applyInPandas(best, f"query_id {qkind}, id {kind}, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).withColumnsRenamed({"query_id": query_id, "id": id_col})


def nearest_of(vectors: DataFrame, allowed: DataFrame, query: Sequence[float], k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Scores of allowed ids only; an allowed id without a vector gets the least
    score less 0.1, or -1 if none has one. The k best."""
    ids = allowed.select(id_col).distinct()
    scored = vectors.join(ids, id_col, "left_semi").select(id_col, dot(F.col(vec_col), _literal(query)).alias("score"))
    least = scored.agg(F.min("score").alias("least"))
    out = ids.join(scored, id_col, "left").crossJoin(F.broadcast(least))
    return out.select(id_col, F.coalesce("score", F.col("least") - 0.1, F.lit(-1.0)).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


@dataclass
class InvertedFile:
    """Vectors by nearest centroid. Centroids are at most some thousand rows."""

    centroids: np.ndarray
    vectors: DataFrame  # id, embedding (unit length), list
    least: np.ndarray | None = None  # least inner product of a list's vectors with its centroid, NaN where it has none

    @staticmethod
    def build(vectors: DataFrame, lists: int = LISTS, train: int = TRAIN, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 7) -> InvertedFile:
        """Coarse centroids by distributed k-means on a bounded sample (about
        ``train`` rows by hash of the id), then every vector goes to its nearest
        list. Placed vectors are written once, as a search reads them thrice."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        spark = vectors.sparkSession
        ship_code(spark)
        rows = vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).alias("embedding"))
        kind = rows.schema["id"].dataType.simpleString()

        def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), row_lists(unit_rows(matrix(b.column("embedding"))))], ["id", "embedding"])

        # a share of the hash's range: in every part of the table, and not sorted into one task
        cut = min(1.0, train / max(1, rows.count()))
        chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) < int(cut * (1 << 40))) if cut < 1 else rows
        sample = materialize(chosen.mapInArrow(unit, f"id {kind}, embedding array<double>").select("id", array_to_vector("embedding").alias("features")), "train")
        c = np.zeros((0, 0))
        if (n := sample.count()):
            model = KMeans(k=max(2, min(lists, n)), seed=seed, maxIter=10, featuresCol="features", distanceMeasure="euclidean").fit(sample)
            c = np.array(model.clusterCenters())
            c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast(c)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    v = unit_rows(matrix(b.column("embedding")))
                    yield pa.RecordBatch.from_arrays([b.column("id"), row_lists(v), pa.array((v @ shared.value.T).argmax(1).astype(np.int32))], ["id", "embedding", "list"])

        return InvertedFile(c, materialize(rows.mapInArrow(place, f"id {kind}, embedding array<double>, list int"), "placed"))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No vector of a list scores higher with the unit vector ``q``: the
        angle to it is at least that to the centroid less the list's widest."""
        if self.least is None:
            ship_code(self.vectors.sparkSession)
            shared = self.vectors.sparkSession.sparkContext.broadcast(self.centroids)

            def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        at = b.column("list").to_numpy()
                        own = np.full(len(shared.value), np.inf)
                        np.minimum.at(own, at, np.einsum("ij,ij->i", matrix(b.column("embedding")), shared.value[at]))
                        there = np.flatnonzero(own < np.inf)
                        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(own[there])], ["list", "own"])

            rows = self.vectors.select("embedding", F.col("list").cast("int").alias("list")).mapInArrow(narrow, "list int, own double").groupBy("list").agg(F.min("own").alias("own")).collect()
            self.least = np.full(len(self.centroids), np.nan)
            for r in rows:
                self.least[r["list"]] = r["own"]
        angle, widest = (np.arccos(np.clip(x, -1, 1)) for x in (self.centroids @ q, self.least))
        bound = np.cos(np.maximum(angle - widest, 0))
        return np.where(np.isnan(self.least), -np.inf, bound) + 1e-6

    def search(self, query: Sequence[float], k: int = 10, probes: int = PROBES) -> DataFrame:
        """(id, score): the k best by cosine, as exact as a search of all lists.

        The ``probes`` lists nearest to the query are read first, and then also
        those whose bound isn't below the k-th score found there. On data
        without clusters that can be all lists.
        """
        q = np.asarray(query, float)
        q = q / max(np.linalg.norm(q), 1e-12)
        near = np.argsort(-(self.centroids @ q), kind="stable")[:probes].tolist()

        def best(lists: list[int]) -> DataFrame:
            rows = self.vectors.where(F.col("list").isin(lists))
            return rows.select("id", dot(F.col("embedding"), _literal(q)).alias("score")).orderBy(F.desc("score"), "id").limit(k)

        first = [r["score"] for r in best(near).collect()]
        kth = min(first) if len(first) == k and k else -math.inf
        more = np.flatnonzero(self.bounds(q) >= kth).tolist() if len(self.centroids) else []
        return best(sorted({*near, *more}))

    def save(self, path: str) -> None:
        spark = self.vectors.sparkSession
        self.vectors.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(self.centroids)], "list int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> InvertedFile:
        c = [r["centroid"] for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()]
        return InvertedFile(np.array(c), spark.read.parquet(f"{path}/vectors"))


def hashing_embedder(dim: int = 64):
    """A stand-in for a trained encoder: hashed term counts, unit length."""
    import zlib

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h & 65536 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)

    return embed


def pooled(tokens: np.ndarray, mask: np.ndarray, how: str = "mean") -> np.ndarray:
    """One vector a text from an encoder's token vectors (texts, tokens, dim):
    the first token's (``cls``), the mean of those that the mask has
    (``mean``), or their sum over the padded length (``padded``)."""
    if how == "cls":
        return tokens[:, 0]
    total = (tokens * mask[:, :, None]).sum(1)
    if how == "padded":
        return total / tokens.shape[1]
    return total / np.maximum(mask.sum(1), 1)[:, None]


def pooling_embedder(encode, how: str = "mean"):
    """An ``embed`` for ``embed_texts`` from an encoder that maps texts to
    (token vectors, mask)."""
    return lambda texts: pooled(*encode(texts), how)


def dump_vectors(df: DataFrame, path: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
    """(id, embedding array<float>) as parquet in order of the id: what array
    files of other tools hold, readable without them."""
    out = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col), F.col(vec_col).cast("array<float>").alias(vec_col))
    out.repartitionByRange(id_col).sortWithinPartitions(id_col).write.mode("overwrite").parquet(path)


def append_vectors(df: DataFrame, path: str, batch: str, id_col: str = "vec_id", vec_col: str = "embedding") -> bool:
    """Add one batch of vectors under its own folder; a replay of a batch that
    is there does nothing, one that was torn is written again."""
    spark = df.sparkSession
    at = f"{path.rstrip('/')}/batch={batch}"
    if path_exists(spark, f"{at}/_SUCCESS"):
        return False
    df.where(F.col(vec_col).isNotNull()).select(F.col(id_col), F.col(vec_col).cast("array<float>").alias(vec_col)).write.mode("overwrite").parquet(at)
    return True


def embed_texts(df: DataFrame, embed=None, id_col: str = "doc_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """(id, embedding) by a batched encoder; null texts embed as empty."""
    f = embed or hashing_embedder()
    kind = df.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(f(part["text"].fillna("").tolist()))})

    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInPandas(run, f"id {kind}, embedding array<double>").withColumnRenamed("id", id_col)


def merge_vectors(left: DataFrame, right: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """All ids of two vector tables; where both have one, the right's counts."""
    r = right.select(id_col, F.col("embedding").alias("__quern_r"))
    return left.join(r, id_col, "full").select(id_col, F.coalesce("__quern_r", "embedding").alias("embedding"))
