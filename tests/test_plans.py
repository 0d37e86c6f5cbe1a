"""What reaches the scans, and what doesn't shuffle."""

import pytest

from quern.operators import boolean, ranking
from quern.operators.index import Index


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    rows = [(i, f"w{i % 7} common w{i % 11} w{i % 13}") for i in range(200)]
    Index.build(spark.createDataFrame(rows, "doc_id long, text string")).save(path, 8)
    return Index.load(spark, path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ranking_prunes_columns_and_folders(saved):
    text = plan(ranking.search(saved, ["w3", "common"], prune=False))
    scan = next(x for x in text.split("\n") if "postings" in x and "FileScan" in x)
    assert "positions" not in scan.split("ReadSchema")[1] and "In(term" in scan and "PartitionFilters: [" in scan and "bucket" in scan.split("PartitionFilters")[1]


def test_top_k_isnt_a_full_sort(saved):
    assert "TakeOrderedAndProject" in plan(ranking.search(saved, ["w3"], limit=5, prune=False))


def test_boolean_reads_its_terms_once(saved):
    text = plan(boolean.Evaluator(saved).run("w3 AND (common OR NOT w5)"))
    assert text.count("FileScan") == 1 and "positions" not in text.split("ReadSchema")[1]
    assert "positions" in plan(boolean.Evaluator(saved).run('"w3 common"')).split("ReadSchema")[1]


def test_lookups_push_their_keys(saved):
    assert "EqualTo(doc_id,3)" in plan(saved.document(3)) and "EqualTo(doc_id,3)" in plan(saved.posting("w3", 3))


def test_postings_of_unique_documents_are_not_shuffled(spark):
    """Each row gives its own postings; rows that share an id are added up."""
    one = Index.build(spark.createDataFrame([(1, "b a b"), (2, "a"), (3, ""), (None, "a")], "doc_id long, text string"))
    for df in (one.postings, one.forward()):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in one.postings.collect()} == {("a", 1, 1, (1,)), ("b", 1, 2, (0, 2)), ("a", 2, 1, (0,))}
    assert {r["doc_id"]: [(t["term"], t["positions"]) for t in r["terms"]] for r in one.forward().collect()} == {1: [("a", [1]), ("b", [0, 2])], 2: [("a", [0])]}
    assert {tuple(r) for r in one.terms.collect()} == {("a", 2, 2), ("b", 1, 2)}
    two = Index.build(spark.createDataFrame([(1, "b a"), (1, "b")], "doc_id long, text string"))
    assert {(r["term"], r["doc_id"], r["tf"], tuple(r["positions"])) for r in two.postings.collect()} == {("a", 1, 1, (1,)), ("b", 1, 2, (0, 0))}


def test_large_folders_of_a_saved_index_are_cut(spark, tmp_path):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).repartition(8)
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20000")
        Index.build(docs).save(f"{tmp_path}/i", 4)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    assert len(spark.read.parquet(f"{tmp_path}/i/postings").inputFiles()) > 1
    assert Index.load(spark, f"{tmp_path}/i").postings_for(["a"]).count() == 20_000


def test_batch_search_makes_no_rows_of_queries_by_documents(spark):
    """Partitions pass on the best of each query; ties go to the lesser id."""
    from pyspark.sql import functions as F

    from quern.operators import ranking

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b").when(F.col("id") % 3 == 1, "a c").otherwise("d").alias("text"))
    q = spark.createDataFrame([(i, t) for i in range(5) for t in ("b", "c")] + [(9, "b"), (10, "nowhere")], "query_id int, term string")
    found = ranking.search_many(Index.build(docs).stored(), q, 2, digits=6)
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()) == sorted([*((i, d, d + 1) for i in range(5) for d in (0, 1)), (9, 0, 1), (9, 3, 2)])
    twice = Index.build(spark.createDataFrame([(1, "b x"), (1, "b"), (2, "b"), (3, "y"), (4, "z")], "doc_id long, text string"))
    slow = ranking.search_many(twice, q.where("query_id = 9"), 5, digits=6)
    assert {r["doc_id"] for r in slow.collect()} == {1, 2}
