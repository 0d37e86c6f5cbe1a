"""Reading, writing and sampling dump tables: XML, CSV, parquet and JDBC."""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quern.session import path_exists
from quern.sources.schemas import TABLES, schema


def read_xml(spark: SparkSession, path: str, fields: StructType, key: str | None = "id", row_tag: str = "row") -> DataFrame:
    """Rows of ``<row Attr="..."/>`` with the given schema; attribute names are
    met without regard to case. Rows without a key go."""
    attributes = StructType([StructField("_" + f.name, f.dataType) for f in fields])
    conf = "spark.sql.caseSensitive"
    found = {c.lower(): c for c in spark.read.format("xml").option("rowTag", row_tag).option("samplingRatio", 0.01).option("inferSchema", "false").load(path).columns} if spark.conf.get(conf, "false") != "true" else {}
    typed = StructType([StructField(found.get("_" + f.name.lower(), "_" + f.name), f.dataType) for f in fields]) if found else attributes
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(typed).load(path)
    out = rows.select(*(F.col(f"`{t.name}`").alias(f.name) for t, f in zip(typed, fields)))
    return out.dropna(subset=[key]) if key else out


def infer_xml(spark: SparkSession, path: str, row_tag: str = "row") -> StructType:
    """Types of all attributes, from whole-file inference, names lower-cased."""
    inferred = spark.read.format("xml").option("rowTag", row_tag).load(path).schema
    return StructType([StructField(f.name.lstrip("_").lower(), f.dataType) for f in inferred])


def write_xml(df: DataFrame, path: str, rows: int | None = None, row_tag: str = "row") -> None:
    """Attributes as columns; ``rows`` writes a sample for tests."""
    out = df.limit(rows) if rows is not None else df
    out.select(*(F.col(c).alias("_" + c) for c in out.columns)).write.mode("overwrite").format("xml").option("rowTag", row_tag).option("rootTag", "rows").save(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ("id",)) -> None:
    """A header and rows in order; files follow one another in that order.
    Values keep their blanks, and empty ones are quoted, null ones not."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv(spark: SparkSession, path: str, fields: StructType) -> DataFrame:
    empty = uuid.uuid4().hex  # what a quoted empty value is read as, since Spark takes '' as null
    rows = spark.read.csv(path, header=True, schema=fields, multiLine=True, quote='"', escape='"', emptyValue=empty, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(*(F.when(F.col(f"`{f.name}`") != empty, F.col(f"`{f.name}`")).when(F.col(f"`{f.name}`") == empty, "").alias(f.name) if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`") for f in fields))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, options: Mapping[str, str] | None = None) -> DataFrame:
    """A database table read in ranges of its key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, fetchsize=1000)
    return reader.options(**(options or {})).load()


def import_directory(spark: SparkSession, folder: str, out: str, tables: Sequence[str] = TABLES) -> list[str]:
    """Every table's ``<Table>.xml`` of a folder into parquet; the tables done."""
    have = {f.lower(): f for f in os.listdir(folder)} if "://" not in folder else {f"{t}.xml": f"{t}.xml" for t in tables}
    done = []
    for t in tables:
        if f"{t}.xml" in have:
            upsert(read_xml(spark, f"{folder}/{have[f'{t}.xml']}", schema(t)), f"{out}/{t}", "id")
            done.append(t)
    return done


def new_rows(df: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """The first of each key that the target doesn't have; null keys go."""
    fresh = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    return fresh if existing is None else fresh.join(existing.select(key), key, "left_anti")


def upsert(df: DataFrame, path: str, key: str) -> None:
    """Append rows whose key isn't there yet."""
    spark = df.sparkSession
    existing = spark.read.parquet(path) if path_exists(spark, path) else None
    new_rows(df, existing, key).write.mode("append").parquet(path)


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Distinct values of a foreign key that the parent lacks."""
    return child.where(F.col(column).isNotNull()).select(F.col(column).alias(key)).distinct().join(parent.select(key), key, "left_anti")


def repair_orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """The parent with a row of nulls for each missing key."""
    return parent.unionByName(orphans(child, column, parent, key), allowMissingColumns=True)


def sample_tables(tables: Mapping[str, DataFrame], n: int) -> dict[str, DataFrame]:
    """A consistent sample: the first n questions by id, their answers, the
    users of both, and what hangs on those posts and users."""
    posts = tables["posts"]
    questions = posts.where("posttypeid = 1").orderBy("id").limit(n)
    answers = posts.join(questions.select(F.col("id").alias("parentid")), "parentid", "left_semi").select(*posts.columns)
    chosen = questions.unionByName(answers).dropDuplicates(["id"])
    ids = chosen.select("id")
    users = tables["users"]
    people = chosen.select(F.col("owneruserid").alias("id")).union(chosen.select(F.col("lasteditoruserid").alias("id"))).where("id IS NOT NULL").distinct()
    out = {"posts": chosen, "users": users.join(people, "id", "left_semi")}
    for t in ("comments", "votes", "posthistory"):
        if t in tables:
            out[t] = tables[t].join(ids.withColumnRenamed("id", "postid"), "postid", "left_semi").select(*tables[t].columns)
    if "badges" in tables:
        out["badges"] = tables["badges"].join(people.withColumnRenamed("id", "userid"), "userid", "left_semi").select(*tables["badges"].columns)
    if "postlinks" in tables:
        out["postlinks"] = either_join(tables["postlinks"], ids, ("postid", "relatedpostid"))
    if "tags" in tables:
        out["tags"] = tables["tags"]
    return out


def either_join(df: DataFrame, ids: DataFrame, columns: Sequence[str], key: str = "id") -> DataFrame:
    """Distinct rows of which any column is in ``ids``: a union of equi-joins,
    where OR in one condition would compare all pairs."""
    out = None
    for c in columns:
        hit = df.join(ids.select(F.col(key).alias(c)), c, "left_semi").select(*df.columns)
        out = hit if out is None else out.unionByName(hit)
    return out.distinct()


def questions_with_answers(posts: DataFrame, users: DataFrame) -> DataFrame:
    """Questions of known owners, with their answers as an ordered array."""
    who = users.select(F.col("id").alias("owneruserid"), "reputation")
    owned = posts.join(who, "owneruserid")
    answers = owned.where("posttypeid = 2").groupBy(F.col("parentid").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", "score", "body", "reputation"))).alias("answers"))
    return owned.where("posttypeid = 1").join(answers, "id", "left")


def good_questions(posts: DataFrame, score: int = 5, views: int = 100, limit: int | None = None) -> DataFrame:
    """Questions with a title and body above both bounds."""
    out = posts.where((F.col("posttypeid") == 1) & F.col("title").isNotNull() & F.col("body").isNotNull() & (F.col("score") > score) & (F.col("viewcount") > views))
    return out.limit(limit) if limit is not None else out


def training_text(df: DataFrame, columns: Sequence[str] = ("title", "body"), limit: int | None = None) -> DataFrame:
    """(id, text): non-empty columns joined by a blank; rows whose last column
    is empty go."""
    out = df.where(F.coalesce(F.col(columns[-1]), F.lit("")) != "").select("id", F.concat_ws(" ", *columns).alias("text"))
    return out.limit(limit) if limit is not None else out
