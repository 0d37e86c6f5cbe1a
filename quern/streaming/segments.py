"""Incremental indexing: each micro-batch of documents becomes a segment, and a
job folds segments together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from quern.functions.text import PLAIN, Analyzer
from quern.operators.index import doc_lengths, merge_segments, postings_of, tokens
from quern.session import filesystem, path_exists


class SegmentedIndex:
    """Segments under one folder. A segment counts once its marker is there;
    replaying a micro-batch overwrites its own folder and nothing else."""

    def __init__(self, spark: SparkSession, path: str, analyzer: Analyzer | None = PLAIN):
        self.spark, self.path, self.analyzer = spark, path.rstrip("/"), analyzer

    def add(self, batch: DataFrame, number: int) -> None:
        """Index one micro-batch (doc_id, text); replays of a folded one do nothing."""
        if number in self._folded():
            return
        at = f"{self.path}/segment={number:09d}"
        fs, marker = filesystem(self.spark, f"{at}/_DONE")
        fs.delete(marker, True)  # a replay that dies mustn't leave half a segment that counts
        postings_of(tokens(batch, self.analyzer)).write.mode("overwrite").parquet(f"{at}/postings")
        doc_lengths(batch, self.analyzer).write.mode("overwrite").parquet(f"{at}/docs")
        fs.create(marker, True).close()

    def stream(self, source: DataFrame, checkpoint: str, **trigger):
        """Feed a stream of (doc_id, text) in; returns the running query."""
        writer = source.writeStream.foreachBatch(lambda df, n: self.add(df, n)).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _names(self, kind: str) -> list[str]:
        fs, p = filesystem(self.spark, self.path)
        if not fs.exists(p):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())
        return [n for n in names if n.startswith(kind) and path_exists(self.spark, f"{self.path}/{n}/_DONE")]

    def _folded(self) -> set[int]:
        merged = self._names("merged=")
        return {r["n"] for r in self.spark.read.parquet(f"{self.path}/{merged[-1]}/batches").collect()} if merged else set()

    def _live(self) -> list[str]:
        folded = self._folded()
        return self._names("merged=")[-1:] + [n for n in self._names("segment=") if int(n.removeprefix("segment=")) not in folded]

    def postings(self) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{n}/postings") for n in self._live()]
        return merge_segments(parts) if parts else self.spark.createDataFrame([], "term string, doc_id bigint, tf bigint, positions array<int>")

    def docs(self) -> DataFrame:
        parts = [f"{self.path}/{n}/docs" for n in self._live()]
        return self.spark.read.parquet(*parts) if parts else self.spark.createDataFrame([], "doc_id bigint, doc_length int")

    def compact(self) -> None:
        """Fold all segments into one. Readers see the old ones until its marker
        is written."""
        numbers = {int(n.removeprefix("segment=")) for n in self._names("segment=")} | self._folded()
        last = self._names("merged=")
        at = f"{self.path}/merged={int(last[-1].removeprefix('merged=')) + 1 if last else 1:09d}"
        self.postings().sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{at}/postings")
        self.docs().write.mode("overwrite").parquet(f"{at}/docs")
        self.spark.createDataFrame([(n,) for n in sorted(numbers)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{at}/batches")
        fs, marker = filesystem(self.spark, f"{at}/_DONE")
        fs.create(marker, True).close()
        for n in numbers:
            fs, p = filesystem(self.spark, f"{self.path}/segment={n:09d}")
            fs.delete(p, True)
        for n in last:
            fs, p = filesystem(self.spark, f"{self.path}/{n}")
            fs.delete(p, True)


def read_documents(spark: SparkSession, folder: str, fields: StructType | str, files: int = 10) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(fields).option("maxFilesPerTrigger", files).parquet(folder)
