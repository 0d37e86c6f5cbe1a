"""Vectors, clustering, evaluation, sources and streaming."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import evaluate, vectors
from quern.operators.index import Index
from quern.sources import dump, textindex
from quern.sources.schemas import TABLES, schema
from quern.streaming.segments import SegmentedIndex, read_documents


@pytest.fixture(scope="module")
def vecs(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8))
    x = np.concatenate([c + 0.15 * rng.normal(size=(40, 8)) for c in centres])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), i // 40) for i, v in enumerate(x)] + [(900, None, None)], "vec_id long, embedding array<double>, label int").persist()
    return df, x


def test_nearest(spark, vecs):
    df, x = vecs
    q = x[3]
    want = np.argsort(-(x @ q), kind="stable")[:5].tolist()
    for metric in ("ip", "cosine", "l2"):
        assert [r["vec_id"] for r in vectors.nearest(df, q.tolist(), 5, metric=metric).collect()] == want
    many = vectors.nearest_many(df, df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 3).collect()
    s = x @ x.T
    for r in many:
        assert abs(s[r["query_id"], r["vec_id"]] - np.sort(s[r["query_id"]])[-r["rank"]]) < 1e-9
    assert len(many) == 600 and vectors.nearest_many(df.limit(0), df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))).count() == 0
    ties = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(6)], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in vectors.nearest_many(ties, spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query array<double>"), 3).collect()) == [0, 1, 2]


def test_inverted_file_recall(spark, vecs, tmp_path):
    df, x = vecs
    index = vectors.InvertedFile.build(df, 10)
    index.save(f"{tmp_path}/ivf")
    index = vectors.InvertedFile.load(spark, f"{tmp_path}/ivf")
    hits = 0
    for i in range(0, 200, 20):
        want = set(np.argsort(-(x @ x[i]))[:10].tolist())
        hits += len(want & {r["id"] for r in index.search(x[i].tolist(), 10, 4).collect()})
    assert hits >= 0.9 * 100


def test_inverted_file_with_registered_parameters_is_exact(spark):
    """64 lists, 8 probes, 10 best: the registered query and some rows by search,
    and every row as a query by the lists that its search reads."""
    from quern import queries

    sf = "/root/testdata/sf0.01"
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toPandas()
    ids, x = e["vec_id"].to_numpy(), np.stack(e["embedding"].to_numpy()).astype(float)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def exact(q):
        scores = x @ (np.asarray(q) / np.linalg.norm(q))
        return ids[np.lexsort((ids, -np.round(scores, 12)))[:10]].tolist()

    assert [r["id"] for r in queries.QUERIES["v3_inverted_file"](spark, sf).collect()] == exact(queries._Q)
    index = vectors.InvertedFile.build(spark.read.parquet(f"{sf}/embeddings.parquet"), 64)
    for i in range(0, len(ids), len(ids) // 4):
        assert [r["id"] for r in index.search(x[i], 10, 8).collect()] == exact(x[i])
    place = (x @ index.centroids.T).argmax(1)
    for q in x:
        scores = x @ q
        near = np.argsort(-(index.centroids @ q), kind="stable")[:8]
        kth = np.sort(scores[np.isin(place, near)])[-10:].min() if np.isin(place, near).sum() >= 10 else -np.inf
        read = set(near.tolist()) | set(np.flatnonzero(index.bounds(q) >= kth).tolist())
        assert set(place[np.argsort(-scores)[:10]].tolist()) <= read


def test_vector_tables(spark):
    a = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "doc_id long, embedding array<double>")
    b = spark.createDataFrame([(2, [3.0]), (3, [4.0])], "doc_id long, embedding array<double>")
    assert {r["doc_id"]: r["embedding"] for r in vectors.merge_vectors(a, b).collect()} == {1: [1.0], 2: [3.0], 3: [4.0]}
    e = vectors.embed_texts(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect()
    assert abs(np.linalg.norm(e[0]["embedding"]) - 1) < 1e-9 and not any(e[1]["embedding"])


def brute_dbscan(x, radius, least):
    near = 1 - x @ x.T <= radius
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min(label[j] for j in np.flatnonzero(near[i] & core)) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    return label, core


def test_density_clusters(vecs):
    df, x = vecs
    got = {r["vec_id"]: r["cluster"] for r in evaluate.density_clusters(df, 0.05, 4).collect()}
    label, core = brute_dbscan(x, 0.05, 4)
    assert all(got[i] == label[i] for i in range(len(x)) if core[i]) and 900 not in got
    near = 1 - x @ x.T <= 0.05
    assert all((got[i] == -1) == (not (near[i] & core).any()) for i in range(len(x)))


def test_partition_clusters(vecs):
    df, _ = vecs
    c = evaluate.tag_clusters(df, 5, 4)
    assert c.select("cluster").distinct().count() == 5 and evaluate.silhouette(df.where("embedding IS NOT NULL"), c) > 0.4
    assert 0 < evaluate.davies_bouldin(df, c).first()[0] < 1.5


def test_correlations_by_hand(spark):
    rows = [(1, i, a, b) for i, (a, b) in enumerate([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 4.0)])]
    r = evaluate.rank_correlation(spark.createDataFrame(rows, "query_id int, item int, a double, b double")).first()
    assert abs(r["kendall"] - 4 / 6) < 1e-9 and abs(r["spearman"] - 0.8) < 1e-9


def test_dump_round_trips_and_sampling(spark, tmp_path):
    users = spark.createDataFrame([(i, i * 10, None, f"u{i}", None, 'say "hi",\nyou', 1, 2, 3) for i in range(1, 6)], schema("users"))
    posts = spark.createDataFrame([(i, 1 if i < 4 else 2, None, None if i < 4 else i - 3, None, 9 - i, 500, f"body {i}", i if i < 6 else None, None, None, None, None, None, f"t{i}", "|a|", 0, 0, 0, None) for i in range(1, 7)], schema("posts"))
    links = spark.createDataFrame([(1, None, 1, 9, 1), (2, None, 9, 1, 1), (3, None, 8, 9, 1), (4, None, 1, 1, 1)], schema("postlinks"))
    dump.write_xml(users, f"{tmp_path}/users_xml")
    assert sorted(map(str, dump.read_xml(spark, f"{tmp_path}/users_xml", schema("users")).collect())) == sorted(map(str, users.collect()))
    assert dump.infer_xml(spark, f"{tmp_path}/users_xml")["reputation"].dataType.simpleString() == "bigint"
    (tmp_path / "dump").mkdir()
    (tmp_path / "dump" / "Users.xml").write_text('<?xml version="1.0"?><users>\n<row Id="1" DisplayName="A" Reputation="5" />\n<row DisplayName="no key" />\n<row Id="1" DisplayName="again" Reputation="5" />\n</users>')
    assert dump.import_directory(spark, f"{tmp_path}/dump", f"{tmp_path}/out") == ["users"] == dump.import_directory(spark, f"{tmp_path}/dump", f"{tmp_path}/out")
    assert [(r["id"], r["reputation"]) for r in spark.read.parquet(f"{tmp_path}/out/users").collect()] == [(1, 5)]
    dump.write_csv(users, f"{tmp_path}/users_csv")
    assert [r["aboutme"] for r in dump.read_csv(spark, f"{tmp_path}/users_csv", schema("users")).collect()] == ['say "hi",\nyou'] * 5
    got = dump.sample_tables({"posts": posts, "users": users, "postlinks": links}, 2)
    ids = lambda t: sorted(r["id"] for r in got[t].collect())
    assert ids("posts") == [1, 2, 4, 5] and ids("users") == [1, 2, 4, 5] and ids("postlinks") == [1, 2, 4]
    assert [r["id"] for r in dump.orphans(links, "relatedpostid", posts).collect()] == [9]
    assert dump.repair_orphans(links, "relatedpostid", posts).count() == 7
    q = {r["id"]: r["answers"] for r in dump.questions_with_answers(posts, users).collect()}
    assert q[1][0]["id"] == 4 and q[3] is None and dump.good_questions(posts).count() == 3
    assert dump.training_text(posts, limit=2).count() == 2 and len(TABLES) == 8


def test_text_form_of_an_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (-2, "b c"), (3, None)], "doc_id long, text string")
    i = Index.build(docs)
    textindex.write_index(i, f"{tmp_path}/t")
    (tmp_path / "t" / "index" / "bad").write_text("broken line\n\tnot:a,posting\n")
    back = {(r["term"], r["doc_id"], tuple(r["positions"])) for r in textindex.read_index(spark, f"{tmp_path}/t").collect()}
    assert back == {("a", 1, (0, 2)), ("b", 1, (1,)), ("b", -2, (0,)), ("c", -2, (1,))}


def test_incremental_segments(spark, tmp_path):
    for n, rows in enumerate([[(1, "a b"), (2, "b")], [(3, "a a")], [(4, None)]]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index = SegmentedIndex(spark, f"{tmp_path}/index")
        index.stream(read_documents(spark, f"{tmp_path}/in", "doc_id long, text string"), f"{tmp_path}/check").awaitTermination()
        if n == 1:
            index.compact()
    key = lambda df: sorted((r["term"], r["doc_id"], r["tf"]) for r in df.collect())
    want = [("a", 1, 1), ("a", 3, 2), ("b", 1, 1), ("b", 2, 1)]
    assert key(index.postings()) == want and index.docs().count() == 4
    index.add(spark.createDataFrame([(9, "zz")], "doc_id long, text string"), 0)  # a replay
    assert key(index.postings()) == want
    index.compact()
    assert key(index.postings()) == want


def test_blocks_of_queries_and_vectors(spark, monkeypatch):
    """Any cut into blocks gives the same as one product, ties included."""
    import numpy as np

    from quern.operators import vectors as vs

    rng = np.random.default_rng(4)
    data = rng.integers(-2, 3, (300, 4)).astype(float)
    rows = [(i, v.tolist() if i % 50 else None) for i, v in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = df.where("vec_id < 40").select(df["vec_id"].alias("query_id"), df["embedding"].alias("query"))
    want = set()
    for i in range(40):
        if i % 50:
            s = sorted((-float(data[i] @ data[j]), j) for j in range(300) if j % 50)[:5]
            want |= {(i, j, -x) for x, j in s}
    for size, asked in ((32768, 4096), (40, 7)):
        monkeypatch.setattr(vs, "ROWS", size)
        monkeypatch.setattr(vs, "QUERIES", asked)
        assert {(r["query_id"], r["vec_id"], r["score"]) for r in vs.nearest_many(df, q, 5).collect()} == want
    assert vs.nearest_many(df.where("vec_id < 0"), q, 5).count() == 0


def test_density_cells_lose_no_pair(spark):
    import numpy as np

    from quern.operators import evaluate

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    data = np.concatenate([centres[i % 6] + 0.15 * rng.normal(size=8) for i in range(120)] + [rng.normal(size=8) for _ in range(30)]).reshape(150, 8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    one, many = ({r["vec_id"]: r["cluster"] for r in evaluate.density_clusters(df, 0.1, 4, size=s).collect()} for s in (4096, 9))
    assert one == many and len(set(one.values())) > 3


def test_pooling():
    import numpy as np

    from quern.operators import vectors as vs

    tokens, mask = np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]])
    assert vs.pooled(tokens, mask, "cls").tolist() == [[1, 2]] and vs.pooled(tokens, mask).tolist() == [[2, 3]]
    assert np.allclose(vs.pooled(tokens, mask, "padded"), [[4 / 3, 2]])
    assert vs.pooling_embedder(lambda texts: (tokens, mask))(["x"]).tolist() == [[2, 3]]


def test_index_from_its_text_form(spark, tmp_path):
    from quern.operators.index import Index
    from quern.sources import textindex

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "")], "doc_id long, text string")
    own = Index.build(docs)
    textindex.write_index(own, f"{tmp_path}/text")
    back = textindex.load_index(spark, f"{tmp_path}/text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back.docs) == rows(own.docs) and rows(back.terms) == rows(own.terms) and rows(back.stats) == rows(own.stats)
    assert rows(back.postings.select("term", "doc_id", "positions")) == rows(own.postings.select("term", "doc_id", "positions"))


def test_text_index_is_read_in_splits(spark, tmp_path):
    """A posting finds its term where the term's line lies in another split, and
    postings before any term line are bad lines."""
    os.makedirs(f"{tmp_path}/t/index")
    with open(f"{tmp_path}/t/index/part-0", "w") as f:
        f.write("\t9:1\nb:2000\n" + "".join(f"\t{i}:{i % 7}\n" for i in range(2000)) + "c:1\n\t5:1,2\nbad line\n\t6:1\n")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "1000")
        assert spark.read.text(f"{tmp_path}/t/index").rdd.getNumPartitions() > 5
        rows = [tuple(r) for r in textindex.read_index(spark, f"{tmp_path}/t").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(rows) == sorted([("c", 5, 2, [1, 2]), *(("b", i, 1, [i % 7]) for i in range(2000))])


def test_text_index_is_not_read_as_whole_files(spark, tmp_path):
    os.makedirs(f"{tmp_path}/t/index")
    with open(f"{tmp_path}/t/index/part-0", "w") as f:
        f.write("b:1\n\t9:1\n")
    plan = textindex.read_index(spark, f"{tmp_path}/t")._jdf.queryExecution().toString()
    assert "wholetext" not in plan and "file_block_start" in plan


def test_rank_correlation_of_ties_and_nulls(spark):
    """One score's ties leave no correlation; that was a division by zero."""
    rows = [(1, i, 5.0, float(i)) for i in range(3)] + [(2, 1, 1.0, 2.0)] + [(3, i, float(i), 2.0 * i) for i in range(300)] + [(3, 999, None, 1.0)] + [(None, i, float(i), -float(i)) for i in range(3)] + [(4, 7, 1.0, 1.0), (4, 7, 2.0, 2.0), (4, 8, 3.0, 0.0)]
    got = {r[0]: (r[1], r[2]) for r in evaluate.rank_correlation(spark.createDataFrame(rows, "query_id int, item int, a double, b double")).collect()}
    assert got[1] == (None, None) and got[2] == (None, None)
    assert got[3][0] == pytest.approx(44850 / math.sqrt(44850 * 45150)) and got[None] == (None, pytest.approx(-1))
    assert got[4][0] == pytest.approx(-1)  # two rows of one item are no pair


def test_csv_keeps_blanks_and_empty_values(spark, tmp_path):
    odd = [" lead", "trail ", "\ttab", "a\r\nb", "a\r", "\r", "\n", "", None, "null", '"', 'a"', "\\", 'a\\', "\x00", ' "x",\n', " "]
    df = spark.createDataFrame([(i, t, "" if i % 2 else None) for i, t in enumerate(odd)], "id long, text string, lang string")
    dump.write_csv(df, f"{tmp_path}/c")
    back = dump.read_csv(spark, f"{tmp_path}/c", df.schema)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}


def test_normalise_takes_the_norm_once_a_vector(spark):
    """Not once an element: 100 vectors of 4096 elements took minutes."""
    import time

    from quern.functions.vectors import normalise

    rows = spark.range(100).select(F.transform(F.sequence(F.lit(1), F.lit(4096)), lambda x: x + F.col("id")).alias("v")).persist()
    rows.count()
    began = time.time()
    norms = rows.select(F.aggregate(normalise(F.col("v")), F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert time.time() - began < 20 and all(abs(r["n"] - 1) < 1e-9 for r in norms)
    odd = spark.createDataFrame([([0.0, 0.0],), ([],), (None,)], "v array<double>").select(normalise(F.col("v")).alias("v")).collect()
    assert [r["v"] for r in odd] == [[0.0, 0.0], [], None]


def test_density_clusters_write_no_pairs(spark, monkeypatch):
    """Of 1500 points in one place all 2.25 million pairs are close; what is
    written stays in the order of the points. And equal to brute force, whether
    close pairs are held or found again, also for ids that are strings."""
    written = {}
    whole = evaluate.materialize

    def counted(df, name):
        out = whole(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(evaluate, "materialize", counted)
    rng = np.random.default_rng(3)
    one = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(1 + 0.01 * rng.normal(size=(1500, 4)))], "vec_id long, embedding array<double>")
    assert {r["cluster"] for r in evaluate.density_clusters(one, 0.3, 4, size=800).collect()} == {0}
    assert max(written.values()) < 40_000

    x = np.concatenate([c + 0.3 * rng.normal(size=(60, 6)) for c in rng.normal(size=(4, 6))] + [rng.normal(size=(40, 6)), np.zeros((1, 6))])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    label, core = brute_dbscan(x, 0.08, 4)
    far = 1 - x @ x.T
    want = [label[i] if core[i] else min([(far[i, j], label[j]) for j in np.flatnonzero(core & (far[i] <= 0.08))], default=(0, -1))[1] for i in range(len(x))]
    assert {-1} < set(want) and any(w >= 0 and not c for w, c in zip(want, core))
    df = spark.createDataFrame([(f"{i:03d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    for size in (80, None):
        got = {int(r["vec_id"]): int(r["cluster"]) for r in evaluate.density_clusters(df, 0.08, 4, size=size).collect()}
        assert [got[i] for i in range(len(x))] == want
    assert evaluate.density_clusters(df.limit(0), 0.08, 4).count() == 0
    for held in (0, 10**6):
        count, (a, b, d), (own, root) = evaluate._meet(x[:200], x[200:], 0.08, 3, held)
        near = far[:200, 200:] <= 0.08
        assert count.tolist() == [*near.sum(1), *near.sum(0)]
        assert sorted(zip(a.tolist(), b.tolist())) == sorted([(i, j + 200) for i, j in zip(*np.nonzero(near)) if count[i] < 3] + [(j + 200, i) for i, j in zip(*np.nonzero(near)) if count[j + 200] < 3])
        assert np.allclose(d, far[a, b]) and (count[own] >= 3).all() and (count[root] >= 3).all()


def test_inverted_file_places_vectors_once(spark, vecs):
    """Lists are read from what was written, not made again by each step of a
    search; the sample of the centroids is a share of every part of the table."""
    df, x = vecs
    index = vectors.InvertedFile.build(df.repartition(4), 6, train=100)
    assert not {"MapInPandas", "MapInArrow"} & set(index.vectors._jdf.queryExecution().executedPlan().toString().replace("(", " ").split())
    assert index.vectors.count() == 200 and len(index.centroids) == 6
    for i in (3, 150):
        assert [r["id"] for r in index.search(x[i].tolist(), 5, 1).collect()] == np.argsort(-(x @ x[i]), kind="stable")[:5].tolist()
