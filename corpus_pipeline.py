"""A training corpus from table ``documents``: five stages, each written as
Parquet in the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, join, langid, mixing, quality
from quern.session import materialize, scratch_of, spread

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents outside their language's bands of tokeniser fertility go."""
    with scratch_of(spark, f"pipeline {sf_dir}"):
        return quality.keep_documents(docs).select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are far from every language's centroids go."""
    with scratch_of(spark, f"pipeline {sf_dir}"):
        return langid.keep_identified(docs, langid.fit(docs)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    with scratch_of(spark, f"pipeline {sf_dir}"):
        return join.keep_one(docs).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources weigh the same."""
    with scratch_of(spark, f"pipeline {sf_dir}"):
        return mixing.mix_sources(docs, copy_col=None).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, checked by decoding them again."""
    with scratch_of(spark, f"pipeline {sf_dir}"):
        return bpe.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near copies", near_copies),
    ("mixing", mixture),
    ("BPE encoding", encoding),
]

#: Tokenisers and centroids have no SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
