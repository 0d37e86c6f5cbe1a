"""The ten operators as registered queries over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, counts, fingerprints, join, langid, licenses, mixing, quality, sharding, urls
from quern.session import spread


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_documents(spark, sf_dir))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_documents(spark, sf_dir))


def op6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.maintain_counts(_documents(spark, sf_dir))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir))


def op9_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.near_copies(_documents(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_language, op3_quality, op4_urls, op5_bpe, op6_counts, op7_licenses, op8_mixing, op9_near_copies, op10_sharding)}


def oracles() -> dict[str, str]:
    """SQL where it can express the operator; the tests have brute force for the rest."""
    return {"op4_urls": urls.oracle(), "op8_mixing": mixing.oracle(), "op9_near_copies": join.oracle(), "op10_sharding": sharding.oracle()}
