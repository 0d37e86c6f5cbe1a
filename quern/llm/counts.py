"""Operator 6: token counts kept up to date by deltas.

A ledger is a folder of committed batches. A batch holds, for each (source,
language, tokenizer version), the signed sums of its events: inserts, deletes
and revised counts. Totals are the sum of all batches. A batch commits once, by
a rename; a replay of a committed batch does nothing.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.bpe import VOCABULARIES, encode_slice
from quern.llm.chunks import slices, text_array
from quern.session import filesystem, materialize, path_exists, scratch_path, ship_code

VOCABULARY = "byte_bpe_50k.tiktoken"
KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens", "chars")
_SCHEMA = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(s, T.LongType()) for s in SUMS])


class Ledger:
    """Batches of deltas under one folder.

    A batch is written to a folder of its own and then renamed to its place,
    which fails if another writer has put a batch of that id there first. So a
    batch is there as a whole or not at all, whoever dies or races.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not batch_id or not all(c.isalnum() or c in "-_" for c in batch_id):
            raise ValueError("a batch id has letters, digits, - and _ only")
        return f"{self.path}/batch={batch_id}"

    def committed(self, batch_id: str) -> bool:
        return path_exists(self.spark, self._batch(batch_id) + "/_SUCCESS") or batch_id in self._folded([batch_id])

    def commit(self, batch_id: str, events: DataFrame) -> bool:
        """Add the events' sums as one batch; False if it is there already.

        ``events`` has the keys and the signed sums; null keys are keys, null
        sums count as 0, and an event table may be empty.
        """
        if self.committed(batch_id):
            return False
        sums = events.groupBy(*(F.col(k).cast("string").alias(k) for k in KEYS)).agg(*(F.coalesce(F.sum(s), F.lit(0)).cast("long").alias(s) for s in SUMS))
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        sums.where(" OR ".join(f"{s} <> 0" for s in SUMS)).write.parquet(draft)
        if not path_exists(self.spark, self._batch(batch_id) + "/_SUCCESS"):  # torn files of a writer that didn't rename
            fs, p = filesystem(self.spark, self._batch(batch_id))
            fs.delete(p, True)
        return self._rename(draft, self._batch(batch_id))

    def _rename(self, source: str, target: str) -> bool:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        fs, p = filesystem(self.spark, source)
        _, q = filesystem(self.spark, target)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(p), fs.makeQualified(q), none)
        except Py4JJavaError:
            fs.delete(p, True)
            if path_exists(self.spark, target + "/_SUCCESS"):
                return False
            raise
        return True

    def _folders(self, kind: str) -> list[str]:
        fs, p = filesystem(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return sorted(n for n in names if n.startswith(kind) and path_exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def _snapshot(self) -> str | None:
        found = self._folders("snapshot=")
        return found[-1] if found else None

    def _folded(self, ids: Sequence[str]) -> set[str]:
        """Those of the given batches that the latest snapshot has in it."""
        snap = self._snapshot()
        if snap is None or not ids:
            return set()
        return {r["batch_id"] for r in self.spark.read.parquet(f"{self.path}/{snap}/batches").where(F.col("batch_id").isin(list(ids))).collect()}

    def _live(self) -> list[str]:
        """Committed batches that aren't in the snapshot: few between two
        compactions, which delete what they fold."""
        names = [n.removeprefix("batch=") for n in self._folders("batch=")]
        folded = self._folded(names)
        return [n for n in names if n not in folded]

    def totals(self) -> DataFrame:
        """Sums over all committed batches; groups that cancelled out go. An
        empty ledger gives no rows; null keys are keys."""
        snap = self._snapshot()
        paths = [self._batch(n) for n in self._live()]
        paths += [f"{self.path}/{snap}/totals"] if snap else []
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(s).alias(s) for s in SUMS)).where(" OR ".join(f"{s} <> 0" for s in SUMS))

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot. The snapshot counts
        only once its marker is there, so a crash leaves the old state; one
        before the folded batches are deleted leaves batches that don't count."""
        snap, live = self._snapshot(), self._live()
        at = f"{self.path}/snapshot={int((snap or 'snapshot=0').removeprefix('snapshot=')) + 1:09d}"
        self.totals().write.mode("overwrite").parquet(f"{at}/totals")
        names = self.spark.createDataFrame([(n,) for n in live], "batch_id string")
        if snap:
            names = names.unionByName(self.spark.read.parquet(f"{self.path}/{snap}/batches"))
        names.write.mode("overwrite").parquet(f"{at}/batches")
        fs, marker = filesystem(self.spark, f"{at}/_SUCCESS")
        fs.create(marker, True).close()
        self.sweep()

    def sweep(self) -> None:
        """Delete batches that the snapshot has in it."""
        folded = self._folded([n.removeprefix("batch=") for n in self._folders("batch=")])
        for n in folded:
            fs, p = filesystem(self.spark, self._batch(n))
            fs.delete(p, True)


def signed(docs: DataFrame, sign: int) -> DataFrame:
    """Events that insert (+1) or delete (-1) documents with their counts."""
    return docs.select(*KEYS, *((F.col(s) * sign).alias(s) for s in SUMS))


def revised(docs: DataFrame, new_tokens: str, old_tokens: str = "tokens") -> DataFrame:
    """Events that replace counts: only the token difference is booked."""
    change = F.coalesce(F.col(new_tokens), F.lit(0)) - F.coalesce(F.col(old_tokens), F.lit(0))
    return docs.select(*KEYS, F.lit(0).alias("docs"), change.alias("tokens"), F.lit(0).alias("chars"))


def count_tokens(df: DataFrame, vocabulary: str = VOCABULARY, folder: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, text_hash, source, lang, version, docs, tokens, chars, estimate).

    Tokens are counted over whole texts; ``estimate`` is a quarter of the
    UTF-8 bytes, rounded up, as booked before a text is tokenised. Null texts
    count 0 tokens.
    """
    ship_code(df.sparkSession)
    path, version = os.path.join(folder, vocabulary), vocabulary.rsplit(".", 1)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = text_array(batch, "text")
            for a, b in slices(whole, 4_000_000):
                _, offsets = encode_slice(path, whole.slice(a, b - a))
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "text_hash", "source", "lang", "chars", "estimate")), pa.array(offsets[1:] - offsets[:-1], pa.int64())], ["id", "text_hash", "source", "lang", "chars", "estimate", "tokens"])

    text = F.col(text_col).cast("string")
    slim = df.select(
        F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("text_hash"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long").alias("estimate"), text.alias("text"),
    )
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, text_hash string, source string, lang string, chars bigint, estimate bigint, tokens bigint")
    return out.select("id", "text_hash", "source", "lang", F.lit(version).alias("version"), F.lit(1).cast("long").alias("docs"), "tokens", "chars", "estimate")


def table_batch(book: DataFrame) -> str:
    """A batch id that stands for the table's rows, whatever their order."""
    row = F.xxhash64(*(F.col(c) for c in ("id", "text_hash", "source", "lang", "version"))).cast("decimal(38,0)")
    found = book.agg(F.count("*").alias("n"), F.sum(row).alias("h")).first()
    return f"{found['n']}_{int(found['h'] or 0) % (1 << 64):016x}"


def maintain_counts(df: DataFrame, vocabulary: str = VOCABULARY, folder: str = VOCABULARIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", path: str | None = None, batch: str | None = None) -> DataFrame:
    """Totals per (source, lang, version) after three batches and two replays.

    ``load`` inserts every row with its estimated tokens, ``recount`` revises
    them to exact counts, ``dedup`` deletes the rows whose text another row of
    smaller id in the table has (of equal ids, one stays). Replaying
    ``recount`` and ``dedup`` changes nothing. The ids of the three batches end
    in ``batch``, by default a hash of the table's rows: into a ledger at
    ``path`` the same table goes once and another one is added. Null sources
    and languages are groups of their own; null texts aren't copies of each
    other; an empty table adds nothing; further columns are left out.
    """
    spark = df.sparkSession
    book = materialize(count_tokens(df, vocabulary, folder, id_col, text_col, source_col, lang_col), "counts")
    ledger = Ledger(spark, path or scratch_path(spark, "ledger"))
    name = batch or table_batch(book)
    # the least row of each text comes from partial aggregates: copies may be a third of all rows
    place = F.struct(F.col("id").isNull().alias("none"), "id", *(F.struct(F.col(k).isNotNull().alias("has"), F.col(k).alias("v")).alias(k) for k in KEYS))
    texts = book.where(F.col("text_hash").isNotNull()).groupBy("text_hash", "tokens", "chars").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    kept = texts.select(*(F.col(f"first.{k}.v").alias(k) for k in KEYS), F.lit(1).alias("docs"), "tokens", "chars")
    copies = book.where(F.col("text_hash").isNotNull()).join(texts.select(F.col("text_hash").alias("t")), F.col("text_hash") == F.col("t"), "left_semi")
    events = {"load": signed(book.withColumn("tokens", F.col("estimate")), 1), "recount": revised(book, "tokens", "estimate"), "dedup": signed(copies, -1).unionByName(signed(kept, 1))}
    for step in ("load", "recount", "dedup", "recount", "dedup"):
        ledger.commit(f"{step}-{name}", events[step])
    return ledger.totals()
