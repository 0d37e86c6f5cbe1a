"""Positional inverted index as DataFrames.

``postings`` has one row a (term, document) with frequency and positions in
columns of their own, so that ranking never reads positions. A saved index is
cut by a hash of the term and sorted by (term, doc_id) within each file, so an
equality on terms prunes folders and row groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions import html
from quern.functions.text import PLAIN, Analyzer, plain_terms, plain_tokens, raw_terms, raw_tokens, text_length, terms, word_characters
from quern.session import checked_join, materialize, ship_code

BUCKETS = 64
META = ("score", "viewcount", "creationdate", "userreputation", "answercount", "commentcount", "favoritecount")


def bucket(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def tokens(docs: DataFrame, analyzer: Analyzer | None = PLAIN, id_col: str = "doc_id", text_col: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, term, pos), one row a token. ``only`` keeps these terms, before
    any shuffle. Null ids and null texts give no rows."""
    if analyzer is not PLAIN and analyzer.stemming:
        ship_code(docs.sparkSession)
    found = terms(F.col(text_col), analyzer)
    if only is not None:
        wanted = [str(t) for t in only]
        found = F.filter(found, lambda x: x["term"].isin(wanted))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(found).alias("t"))
    return rows.select("doc_id", "t.term", "t.pos")


def postings_of(token_rows: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions): tf counts all occurrences, positions
    those that have one, in ascending order."""
    return token_rows.groupBy("term", "doc_id").agg(
        F.count("*").alias("tf"), F.sort_array(F.collect_list(F.when(F.col("pos") >= 0, F.col("pos")))).alias("positions"))


def _found(analyzer: Analyzer | None, text_col: str, only: Sequence[str] | None) -> Column:
    """Terms of a text for ``row_runs``; without positions they are numbered.
    A lower-cased text stands for its plain terms, which are cut there."""
    if analyzer is PLAIN and only is None:
        return F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = terms(F.col(text_col), analyzer)
    if only is not None:
        wanted = [str(t) for t in only]
        found = F.filter(found, lambda x: x["term"].isin(wanted))
    return found


def row_runs(docs: DataFrame, found: Column, form: str, id_col: str = "doc_id", first_k: int = 1) -> DataFrame:
    """Each row's own terms, over Arrow batches and without a shuffle. ``form``:
    ``positions`` gives (term, doc_id, tf, positions), ``tf`` (term, doc_id, tf),
    ``forward`` (doc_id, terms), ``counts`` (term, df, cf) of a batch of rows,
    ``prefix`` (term, doc_id) of the ``first_k`` least ids a term and batch."""
    ship_code(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), found.alias("ts"))
    kind = rows.schema["doc_id"].dataType
    letters = word_characters(docs.sparkSession) if isinstance(rows.schema["ts"].dataType, T.StringType) else None
    fields = {"prefix": f"term string, doc_id {kind.simpleString()}", "positions": f"term string, doc_id {kind.simpleString()}, tf bigint, positions array<int>", "tf": f"term string, doc_id {kind.simpleString()}, tf bigint", "forward": f"doc_id {kind.simpleString()}, terms array<struct<term:string,positions:array<int>>>", "counts": "term string, df bigint, cf bigint"}[form]
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ts")
            if letters is not None:
                flat, sizes = plain_tokens(lists, letters.value)
            else:
                flat, sizes = lists.flatten(), np.diff(lists.offsets.to_numpy())
            if not len(flat):
                continue
            doc = np.repeat(np.arange(len(lists)), sizes)
            if pa.types.is_struct(flat.type):
                flat, pos = flat.field("term"), flat.field("pos").to_numpy()
            else:
                pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            words = flat.dictionary_encode()
            if form == "forward":  # codes in order of the terms
                ranks = np.argsort(pc.sort_indices(words.dictionary).to_numpy())
                words = pa.DictionaryArray.from_arrays(pa.array(ranks[words.indices.to_numpy()]), words.dictionary.take(pc.sort_indices(words.dictionary)))
            key = doc * np.int64(len(words.dictionary)) + words.indices.to_numpy()
            if form in ("tf", "counts", "prefix"):
                key = np.sort(key)
            else:  # tokens stand in order of their positions
                bits = len(key).bit_length()
                if int(key[-1] // len(words.dictionary) + 1) * len(words.dictionary) < 1 << (62 - bits):
                    both = np.sort(key << bits | np.arange(len(key)))  # plain sorts are several times as fast as stable ones
                    key, order = both >> bits, both & ((1 << bits) - 1)
                else:
                    order = np.argsort(key, kind="stable")
                    key = key[order]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            tf = np.diff(np.append(first, len(key)))
            code = key[first] % len(words.dictionary)
            if form == "counts":
                n = len(words.dictionary)
                yield pa.RecordBatch.from_arrays([words.dictionary, pa.array(np.bincount(code, minlength=n)), pa.array(np.bincount(code, tf, n).astype(np.int64))], ["term", "df", "cf"])
                continue
            own = key[first] // len(words.dictionary)
            if form == "prefix":
                rank = np.empty(len(lists), np.int64)
                rank[pc.sort_indices(batch.column("doc_id")).to_numpy()] = np.arange(len(lists))
                both = np.sort(code * np.int64(len(lists)) + rank[own])
                code, place = both // len(lists), np.arange(len(both))
                start = np.maximum.accumulate(np.where(np.append(True, code[1:] != code[:-1]), place, 0))
                keep = place - start < first_k
                at = np.argsort(rank)[both[keep] % len(lists)]
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[keep])), batch.column("doc_id").take(pa.array(at)).cast(arrow)], ["term", "doc_id"])
                continue
            if form != "tf":
                pos = pos[order]
                there = pos >= 0
                ends = np.append(0, np.cumsum(there))
                offsets = np.append(ends[first], ends[-1]).astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(pos[there].astype(np.int32)))
            if form == "forward":
                start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                pairs = pa.StructArray.from_arrays([words.dictionary.take(pa.array(code)), places], ["term", "positions"])
                lines = pa.ListArray.from_arrays(pa.array(np.append(start, len(own)).astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(own[start])).cast(arrow), lines], ["doc_id", "terms"])
                continue
            out = [words.dictionary.take(pa.array(code)), batch.column("doc_id").take(pa.array(own)).cast(arrow), pa.array(tf), *([places] if form == "positions" else [])]
            yield pa.RecordBatch.from_arrays(out, ["term", "doc_id", "tf", "positions"][: len(out)])

    return rows.mapInArrow(run, fields)


def sum_terms(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def unique_ids(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether no id stands twice: a count over the ids alone."""
    return docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty()


def doc_postings(docs: DataFrame, analyzer: Analyzer | None = PLAIN, id_col: str = "doc_id", text_col: str = "text", only: Sequence[str] | None = None, positions: bool = True, unique: bool | None = None) -> DataFrame:
    """``postings_of`` the tokens of a table. Where ids are unique, a row's
    postings are made from the row; else those of the same id are added up."""
    if unique if unique is not None else unique_ids(docs, id_col):
        return row_runs(docs, _found(analyzer, text_col, only), "positions" if positions else "tf", id_col)
    return postings_of(tokens(docs, analyzer, id_col, text_col, only)).select("term", "doc_id", "tf", *(["positions"] if positions else []))


def doc_terms(docs: DataFrame, analyzer: Analyzer | None = PLAIN, id_col: str = "doc_id", text_col: str = "text", only: Sequence[str] | None = None, unique: bool | None = None) -> DataFrame:
    """``terms_of`` the postings of a table, counted in each batch first."""
    if unique if unique is not None else unique_ids(docs, id_col):
        return sum_terms(row_runs(docs, _found(analyzer, text_col, only), "counts", id_col))
    return terms_of(postings_of(tokens(docs, analyzer, id_col, text_col, only)))


def posting_prefix(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(term, doc_id): the ``k`` least ids of each plain term. Only the least of
    each batch of rows are passed on, since no other can be among a term's."""
    rows = row_runs(docs, _found(PLAIN, text_col, None), "prefix", id_col, k) if unique_ids(docs, id_col) else doc_postings(docs, PLAIN, id_col, text_col, positions=False, unique=False)
    ranked = rows.select("term", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id")))
    return ranked.where(F.col("n") <= k).select("term", "doc_id")


def doc_lengths(docs: DataFrame, analyzer: Analyzer | None = PLAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc_length): tokens before stop words go."""
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_length(F.col(text_col), analyzer).alias("doc_length"))


def terms_of(postings: DataFrame) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stats_of(docs: DataFrame) -> DataFrame:
    """One row: number of documents, sum and mean of their lengths."""
    return docs.agg(F.count("*").alias("n_docs"), F.sum("doc_length").alias("sum_length"), F.avg("doc_length").alias("avg_length"))


def metadata_ranges(docs: DataFrame, fields: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least and greatest value of each field, over all rows or a group each."""
    return docs.groupBy(*by).agg(*(f(c).alias(f"{n}_{c}") for c in fields for n, f in (("min", F.min), ("max", F.max))))


def clamp(column: Column) -> Column:
    """Stored statistics: null and negative values count as 0."""
    return F.greatest(F.lit(0), F.coalesce(column, F.lit(0)))


@dataclass
class Index:
    docs: DataFrame  # doc_id, doc_length and any metadata
    postings: DataFrame  # term, doc_id, tf, positions
    terms: DataFrame  # term, df, cf
    stats: DataFrame  # n_docs, sum_length, avg_length
    buckets: int = BUCKETS  # folders of a saved index
    lines: DataFrame | None = None  # doc_id, terms: the forward index, where rows give it without a shuffle

    @staticmethod
    def build(docs: DataFrame, analyzer: Analyzer | None = PLAIN, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), only: Sequence[str] | None = None) -> Index:
        """Lazy index of a table; ``keep`` names metadata columns for ``docs``,
        ``only`` limits postings to the terms of a known query."""
        own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), text_length(F.col(text_col), analyzer).alias("doc_length"), *(c for c in keep if c not in ("doc_id", "doc_length")))
        one = unique_ids(docs, id_col)
        posts = doc_postings(docs, analyzer, id_col, text_col, only, unique=one)
        return Index(own, posts, doc_terms(docs, analyzer, id_col, text_col, only, unique=one), stats_of(own), lines=row_runs(docs, _found(analyzer, text_col, only), "forward", id_col) if one else None)

    @staticmethod
    def of_tokens(token_rows: DataFrame, docs: DataFrame) -> Index:
        """Index of analysed tokens (doc_id, term, pos) and any document columns.
        A document's length is its last position and one."""
        rows = materialize(token_rows, "tokens")
        lengths = rows.groupBy("doc_id").agg((F.max("pos") + 1).cast("int").alias("doc_length"))
        own = docs.where(F.col("doc_id").isNotNull()).join(lengths, "doc_id", "left").withColumn("doc_length", F.coalesce("doc_length", F.lit(0)))
        posts = postings_of(rows)
        return Index(own, posts, terms_of(posts), stats_of(own))

    def stored(self) -> Index:
        """The same index with postings, documents and terms written once."""
        posts, docs = materialize(self.postings, "postings"), materialize(self.docs, "docs")
        return Index(docs, posts, materialize(terms_of(posts.select("term", "doc_id", "tf")), "terms"), stats_of(docs))

    def save(self, path: str, buckets: int = BUCKETS) -> None:
        cut = self.postings.withColumn("bucket", bucket(F.col("term"), buckets))
        # a large folder is cut into several tasks and files, small ones share a task
        cut.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        saved = self.docs.sparkSession.read.parquet(f"{path}/postings")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        terms_of(saved.select("term", "doc_id", "tf")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        stats_of(self.docs).withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        stats = read("stats")
        return Index(read("docs"), read("postings"), read("terms"), stats.drop("buckets"), stats.first()["buckets"])

    def postings_for(self, wanted: Sequence[str]) -> DataFrame:
        """Postings of literal terms; on a saved index the folders are pruned."""
        rows = self.postings.where(F.col("term").isin([str(t) for t in wanted]))
        if "bucket" in self.postings.columns:
            spark = self.postings.sparkSession
            at = [r["b"] for r in spark.range(1).select(F.explode(F.array(*(bucket(F.lit(str(t)), self.buckets) for t in wanted))).alias("b")).collect()] if wanted else []
            rows = rows.where(F.col("bucket").isin(at)).drop("bucket")
        return rows

    # lookups
    def term(self, term: str, limit: int = 0) -> DataFrame:
        """Postings of a term; with ``limit`` the first by document id."""
        rows = self.postings_for([term])
        return rows.orderBy("doc_id").limit(limit) if limit > 0 else rows

    def by_prefix(self, prefix: str) -> DataFrame:
        """Postings of all terms that begin with ``prefix``, by document."""
        rows = self.postings.where(F.col("term").startswith(prefix))
        return rows.groupBy("doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.collect_set("term")).alias("terms"))

    def document_frequency(self, term: str) -> int:
        row = self.terms.where(F.col("term") == term).select("df").first()
        return row["df"] if row else 0

    def document(self, doc_id, keys: Sequence[str] | None = None) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id).select(*(keys or self.docs.columns))

    def document_length(self, doc_id) -> int | None:
        row = self.docs.where(F.col("doc_id") == doc_id).select("doc_length").first()
        return row["doc_length"] if row else None

    def term_frequency(self, term: str, doc_id) -> int:
        row = self.postings_for([term]).where(F.col("doc_id") == doc_id).select("tf").first()
        return row["tf"] if row else 0

    def posting(self, term: str, doc_id) -> DataFrame:
        return self.postings_for([term]).where(F.col("doc_id") == doc_id)

    def vocabulary(self, top_p: float = 0.2) -> DataFrame:
        """The share ``top_p`` of terms that most documents have.

        Terms are counted once and written; by the number of terms of each
        frequency, only those that can be among them are sorted.
        """
        rows = materialize(self.terms, "terms")
        sizes = sorted(((r["df"], r["count"]) for r in rows.groupBy("df").count().collect()), reverse=True)  # as many as there are frequencies
        n, least, seen = int(sum(c for _, c in sizes) * top_p), 0, 0
        for df, c in sizes:
            if seen < n:
                least, seen = df, seen + c
        return rows.where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(n)

    def forward(self) -> DataFrame:
        """(doc_id, terms): each document's terms with their positions."""
        if self.lines is not None:
            return self.lines
        return self.postings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "positions"))).alias("terms"))

    def document_count(self) -> int:
        return self.docs.count()

    def term_count(self) -> int:
        return self.terms.count()


# physical forms that other programs want
def delta_encode(postings: DataFrame) -> DataFrame:
    """(term, doc_id, doc_delta, position_deltas): differences from the value
    before, the first from 0."""
    order = Window.partitionBy("term").orderBy("doc_id")
    deltas = F.transform("positions", lambda p, i: p - F.when(i > 0, F.get(F.col("positions"), i - 1)).otherwise(0))
    return postings.select("term", "doc_id", (F.col("doc_id") - F.lag("doc_id", 1, 0).over(order)).alias("doc_delta"), deltas.alias("position_deltas"))


@arrow_udf(T.ArrayType(T.IntegerType()))
def _running_sums(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    ends = np.cumsum(sizes)
    sums = np.append(0, np.cumsum(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))  # over all lists
    own = sums[1:] - np.repeat(sums[ends - sizes], sizes)
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(own.astype(np.int32)), mask=lists.is_null())


def delta_decode(deltas: DataFrame) -> DataFrame:
    """(term, doc_id, positions) again, by running sums in linear time."""
    ship_code(deltas.sparkSession)
    order = Window.partitionBy("term").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("term", F.sum("doc_delta").over(order).alias("doc_id"), _running_sums("position_deltas").alias("positions"))


def merge_segments(segments: Sequence[DataFrame], disjoint: bool = False) -> DataFrame:
    """One posting table of several; a document that more than one segment has
    counts with the sum of its frequencies and all its positions. ``disjoint``
    says that no id is in two segments (see ``unique_ids``) and each has a term
    and document once: then nothing is to be added up, nor shuffled."""
    out = segments[0].select("term", "doc_id", "tf", "positions")
    for s in segments[1:]:
        out = out.unionByName(s.select("term", "doc_id", "tf", "positions"))
    if disjoint:
        return out
    return out.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))


def ranked_ids(ids: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, rank, upto) and one row (total): an id's place in order, from 0, and
    the number of ids that aren't greater.

    Places come from counts per range partition and places inside partitions,
    so no task sees the whole table. Null ids go.
    """
    rows = ids.select(F.col(id_col).alias("id")).where("id IS NOT NULL")
    # written, since adaptive execution may cut two readings of one shuffle differently
    placed = materialize(rows.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("part").orderBy("id")
    ranked = placed.withColumn("r", F.row_number().over(own)).withColumn("u", F.count("*").over(own.rangeBetween(Window.unboundedPreceding, 0)))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"), F.min("id").alias("low"))
    # one row a range partition
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("low", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("low", "size")
    out = checked_join(ranked, materialize(before, "before"), "part")
    return out.select("id", (F.col("r") + F.col("before") - 1).alias("rank"), (F.col("u") + F.col("before")).alias("upto")), sizes.agg(F.sum("size").alias("total"))


def merge_documents(segments: Sequence[DataFrame]) -> DataFrame:
    """Document records of several segments; of a document that more than one
    has, the last segment's record counts. Missing columns are null."""
    out = segments[0].withColumn("__quern_s", F.lit(0))
    for i, s in enumerate(segments[1:], 1):
        out = out.unionByName(s.withColumn("__quern_s", F.lit(i)), allowMissingColumns=True)
    names = [c for c in out.columns if c not in ("doc_id", "__quern_s")]
    merged = out.groupBy("doc_id").agg(F.max_by(F.struct(*names), "__quern_s").alias("__quern_d"))
    return merged.select("doc_id", "__quern_d.*")


def shard_ranges(ids: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """(shard, min_id, max_id, n): equal runs of ids in order. The remainder goes
    to the last shard; of an empty table nothing comes."""
    ranked, total = ranked_ids(ids, id_col)
    every = F.greatest(F.floor(F.col("total") / shards), F.lit(1))
    shard = F.least(F.floor(F.col("rank") / every), F.lit(shards - 1)).cast("int")
    return ranked.crossJoin(F.broadcast(total)).groupBy(shard.alias("shard")).agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("n"))


def shard_of(ids: DataFrame, ranges: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows with the shard whose range has their id; others go."""
    return checked_join(ids, ranges.select("shard", "min_id", "max_id"), F.col(id_col).between(F.col("min_id"), F.col("max_id"))).drop("min_id", "max_id")


def running_shards(ids: DataFrame, every: int, id_col: str = "doc_id") -> DataFrame:
    """(id, shard): a running count of each ``every``-th row in id order, as
    window SQL numbers them; equal ids share the last one's number. Places come
    from ``ranked_ids``, not from one task's window over the table."""
    ranked, _ = ranked_ids(ids, id_col)
    shard = F.floor((F.col("upto") - 1) / every) + 1 if every > 1 else F.lit(0)
    return ranked.select(F.col("id").alias(id_col), shard.cast("long").alias("shard"))


def approximate_count(df: DataFrame, share: float = 0.01, seed: int = 0) -> DataFrame:
    """One row (n): the number of rows from a Bernoulli sample, scaled up. An
    exact count is as cheap on parquet, whose footers have it; this is for
    sources where it isn't."""
    return df.sample(share, seed).agg((F.count("*") / F.lit(share)).cast("long").alias("n"))


def block_tokens(docs: DataFrame, fields: Sequence[str] = ("title", "body"), analyzer: Analyzer | None = PLAIN, id_col: str = "doc_id", raw: Sequence[str] = ("title",)) -> DataFrame:
    """(doc_id, term, pos) of documents whose fields are HTML.

    Each field is parsed to blocks (those in ``raw`` are one plain block each),
    a link block adds its address and alternative text, and every block is
    analysed on its own. Positions run on from block to block and from field to
    field, over tokens before stop words go; parts of kept variables have -1.
    Null fields have no blocks; null ids go.
    """
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))
    for i, f in enumerate(fields):
        if f in raw:
            rows = rows.withColumn(f"b{i}", F.when(F.col(f"f{i}").isNotNull(), html.raw_blocks(F.col(f"f{i}"))))
        else:
            rows = html.with_blocks(rows, f"f{i}", f"b{i}")
    texts = F.flatten(F.array(*(F.transform(F.coalesce(F.col(f"b{i}"), F.array().cast(f"array<{html.BLOCK}>")), html.block_text) for i in range(len(fields)))))
    if analyzer is PLAIN:
        raw = F.flatten(F.transform(texts, plain_terms))
        found = F.transform(raw, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    else:
        found = raw_terms(F.flatten(F.transform(texts, lambda t: raw_tokens(t, analyzer))), analyzer)
    # a page's blocks are one row: positions run on over their joined tokens
    return rows.select("doc_id", F.explode(found).alias("t")).select("doc_id", "t.term", F.col("t.pos").cast("int").alias("pos"))
