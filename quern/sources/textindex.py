"""The index as text: ``term:df`` lines, each followed by its postings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.index import Index, stats_of, terms_of


def index_lines(index: Index) -> DataFrame:
    """(term, value): a term's lines in one string, so that files stay whole."""
    posting = F.concat(F.lit("\t"), F.col("doc_id").cast("string"), F.lit(":"), F.array_join(F.transform("positions", lambda p: p.cast("string")), ","))
    rows = index.postings.select("term", F.struct("doc_id", posting.alias("line")).alias("p"))
    grouped = rows.groupBy("term").agg(F.sort_array(F.collect_list("p")).alias("ps"), F.count("*").alias("df"))
    return grouped.select("term", F.concat(F.col("term"), F.lit(":"), F.col("df").cast("string"), F.lit("\n"), F.array_join(F.transform("ps", lambda p: p["line"]), "\n")).alias("value"))


def write_index(index: Index, path: str) -> None:
    """Terms in order under ``index``, metadata as CSV under ``docs``, and each
    document's terms under ``forward``."""
    index_lines(index).orderBy("term").select("value").write.mode("overwrite").text(f"{path}/index")
    index.docs.orderBy("doc_id").write.mode("overwrite").csv(f"{path}/docs", header=True)
    words = index.postings.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list("term")), "\t").alias("t"))
    words.orderBy("doc_id").select(F.concat(F.col("doc_id").cast("string"), F.lit(" : "), F.col("t")).alias("value")).write.mode("overwrite").text(f"{path}/forward")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(term, doc_id, tf, positions) from the text form; bad lines are skipped.

    Files are read by line and cut into splits as any text is. A posting's term
    is that of the last term line before it; where that lies before the split,
    it comes from the last term lines of all splits (one row a split).
    """
    lines = spark.read.option("lineSep", "\n").text(f"{path}/index" if not path.endswith("/index") else path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    heading = (F.col("value") != "") & ~F.col("value").startswith("\t")
    numbered = lines.withColumn("n", F.monotonically_increasing_id()).select("file", "start", F.when(heading, F.struct("n", "value")).alias("h"))
    before: dict[tuple[str, int], str | None] = {}
    last: dict[str, str] = {}
    for r in numbered.groupBy("file", "start").agg(F.max("h")["value"].alias("h")).orderBy("file", "start").collect():
        before[r["file"], r["start"]] = last.get(r["file"])
        if r["h"] is not None:
            last[r["file"]] = r["h"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            value, files, starts = (batch.column(i) for i in range(3))
            posting = pc.starts_with(value, "\t").to_numpy(zero_copy_only=False)
            heads = ~posting & (pc.binary_length(value).to_numpy() > 0)
            where = np.where(heads, np.arange(len(heads)), -1)
            f, s = files.dictionary_encode().indices.to_numpy(), starts.to_numpy()
            cuts = [0, *(np.flatnonzero((f[1:] != f[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), len(heads)]
            for i, j in zip(cuts, cuts[1:]):
                key = (files[i].as_py(), int(s[i]))
                if key != at:
                    at, head = key, before[key]  # a KeyError: the splits of the two readings differ
                own = np.maximum.accumulate(where[i:j])
                known = pa.array(np.where(own < 0, 0, own), mask=own < 0)
                names = value.take(known) if head is None else pc.fill_null(value.take(known), head)
                keep = pa.array(posting[i:j])
                if own[-1] >= 0:
                    head = value[int(own[-1])].as_py()
                yield pa.RecordBatch.from_arrays([names.filter(keep), value.slice(i, j - i).filter(keep)], ["head", "line"])

    found = lines.mapInArrow(follow, "head string, line string").withColumn("term", F.regexp_extract("head", r"^([^\n]*):\d+$", 1))
    good = found.where((F.col("term") != "") & F.col("line").rlike(r"^\t-?\d+:[\d,]*$"))
    positions = F.transform(F.filter(F.split(F.regexp_extract("line", ":(.*)$", 1), ","), lambda p: p != ""), lambda p: p.cast("int"))
    out = good.select("term", F.regexp_extract("line", r"^\t(-?\d+):", 1).cast("long").alias("doc_id"), positions.alias("positions"))
    return out.select("term", "doc_id", F.size("positions").cast("long").alias("tf"), "positions")


def load_index(spark: SparkSession, path: str) -> Index:
    """The whole index back from its text form (see ``write_index``): postings,
    and documents with the types that their values allow."""
    postings = read_index(spark, path)
    docs = spark.read.csv(f"{path}/docs", header=True, inferSchema=True)
    return Index(docs, postings, terms_of(postings), stats_of(docs))
