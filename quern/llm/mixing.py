"""Operator 8: mixing sources to target weights by Poisson replication.

A source of weight share s and size z (characters and one per document) out of
a mixture of T characters repeats each of its documents s T / z times on
average. Each document's count is the Poisson quantile of a uniform number
hashed from its id and the seed, so a rerun or a retried task draws the same.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import checked_join, fresh_name, materialize

SEED = 17
#: Copies of one row that are generated at a time.
COPIES = 100_000


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) of 52 bits, hashed from a text key."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_count(rate: Column, u: Column) -> Column:
    """The quantile at ``u`` of a Poisson distribution: how many k have
    P(X <= k) <= u.

    Summed over the k within 12 standard deviations (and 30) of the mean, so the
    work is of the order of the rate's root, where the document's copies are of
    the order of the rate. Nothing is stored but the running sum. What lies
    further below weighs less than the least step of ``u``.
    """
    root = F.sqrt(rate)
    low = F.greatest(F.lit(0), F.floor(rate - 12 * root - 30)).cast("long")
    high = F.ceil(rate + 12 * root + 30).cast("long")
    k0 = low.cast("double")
    # ln P(X = low), by Stirling's series where low isn't 0
    far = k0 * F.log1p((rate - k0) / k0) - (rate - k0) - 0.5 * F.log(F.lit(2 * math.pi) * k0) - 1 / (12 * k0) + 1 / (360 * k0 * k0 * k0)
    first = F.when(low == 0, -rate).otherwise(far)
    start = F.struct(first.alias("lp"), F.exp(first).alias("c"), F.when(F.exp(first) <= u, low + 1).otherwise(low).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        lp = acc["lp"] + F.ln(rate) - F.ln(k.cast("double"))
        c = acc["c"] + F.exp(lp)
        return F.struct(lp.alias("lp"), c.alias("c"), F.when(c <= u, k + 1).otherwise(acc["n"]).alias("n"))

    n = F.aggregate(F.sequence(low + 1, high), start, step, lambda acc: acc["n"])
    return F.when((rate > 0) & (u > 0), n).otherwise(F.lit(0).cast("long"))


def source_rates(df: DataFrame, weights: Mapping[str, float] | None = None, other: float = 1.0, scale: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, size, rate) of every source in the table, null included.

    A source that ``weights`` doesn't list weighs ``other``; the mixture has
    ``scale`` times the table's size.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.coalesce(F.length(F.col(text_col)), F.lit(0)) + 1).alias("size"))
    weight = F.lit(float(other))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, float(w)).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("total"), F.sum("weight").alias("weights"))
    rate = F.when(F.col("weights") > 0, F.col("weight") / F.col("weights") * (F.col("total") * F.lit(float(scale))) / F.col("size")).otherwise(0.0)
    return sizes.crossJoin(F.broadcast(total)).select("source", "size", rate.alias("rate"))


def mix_sources(df: DataFrame, weights: Mapping[str, float] | None = None, other: float = 1.0, scale: float = 1.0, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str | None = "copy") -> DataFrame:
    """Rows repeated by their Poisson counts, in a globally random order.

    Keeps all columns and adds ``copy_col`` (1..count; an input column of that
    name is replaced; None adds nothing). Rows whose count is 0 go. A null
    source is a source of its own; null and empty texts count as one
    character; rows with equal ids draw equal counts, and a null id draws as
    the text ``null``. Extra columns of any name are carried. Rates may be far
    above 1: a row's copies are generated in runs of COPIES. Sizes cover the whole table. Without a positive weight,
    or from an empty table, nothing comes. The rates are few rows and are
    broadcast only after counting; more of them are joined by a shuffle.
    """
    rates = materialize(source_rates(df, weights, other, scale, source_col, text_col).select("source", "rate"), "rates")
    src, rate, n, run, order, copy = (fresh_name(df, f"__quern_{x}") for x in ("src", "rate", "n", "run", "order", "copy"))
    rates = rates.select(F.col("source").alias(src), F.col("rate").alias(rate))
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    out = checked_join(df, rates, F.col(source_col).eqNullSafe(F.col(src)))
    out = out.withColumn(n, poisson_count(F.col(rate), uniform(key, seed))).drop(src, rate).where(F.col(n) > 0)
    out = out.withColumn(run, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / COPIES))))
    out = out.withColumn(copy, F.explode(F.sequence(F.col(run) * COPIES + 1, F.least(F.col(n), (F.col(run) + 1) * COPIES)))).drop(run)
    out = out.withColumn(order, F.xxhash64(key, F.col(copy), F.lit(seed)))
    out = out.repartition(F.col(order)).sortWithinPartitions(order).drop(order, n)
    keep = [c for c in df.columns if copy_col is None or c.lower() != copy_col.lower()]
    return out.select(*(F.col(f"`{c}`") for c in keep), *([F.col(copy).alias(copy_col)] if copy_col else []))


def oracle(seed: int = SEED, table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars", copy: bool = True) -> str:
    """DuckDB SQL for equal weights of all sources."""
    return f"""
WITH sized AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size FROM {table} GROUP BY source),
rates AS (SELECT source, 1.0::DOUBLE / (SELECT count(*) FROM sized)::DOUBLE * (SELECT sum(size) FROM sized) / size AS rate FROM sized),
steps AS (SELECT source, rate, k, CASE WHEN k = 0 THEN 0.0 ELSE ln(rate) - ln(k::DOUBLE) END AS s
          FROM rates, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::INTEGER)) AS k)),
pmf AS (SELECT source, k, exp(-rate + sum(s) OVER (PARTITION BY source ORDER BY k)) AS p FROM steps),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf) GROUP BY source),
drawn AS (
  SELECT d.*, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|{seed}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u, c.cdf
  FROM {table} d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source),
counted AS (SELECT {columns}, len(list_filter(cdf, lambda c: c <= u))::BIGINT AS n FROM drawn)
SELECT {columns}{", unnest(generate_series(1, n))::BIGINT AS copy FROM counted WHERE n > 0" if copy else " FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM counted WHERE n > 0)"}"""
