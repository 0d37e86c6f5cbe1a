"""Queries, Boolean evaluation, ranking and the facade, against plain Python."""

import itertools
import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.operators import boolean, expand, ranking, rerank, vectors
from quern.operators.index import Index, delta_decode, delta_encode, merge_segments, running_shards, shard_of, shard_ranges
from quern.plans.query import And, FreeText, Near, Not, Nothing, Or, Phrase, Term, lex, parse
from quern.search import Options, Search

WORDS = ["red", "green", "blue", "cat", "dog", "sun"]


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "Unique-term, here!")]


ROWS = corpus()
TOKENS = {i: [w for w in re.split(r"[^a-z0-9]+", (t or "").lower()) if w] for i, t in ROWS}


@pytest.fixture(scope="module")
def index(spark):
    i = Index.build(spark.createDataFrame(ROWS, "doc_id long, text string"))
    for name in ("docs", "postings", "terms", "stats"):
        setattr(i, name, getattr(i, name).persist())
    return i


def test_parser():
    a, b, c = Term("a"), Term("b"), Term("c")
    assert parse("NOT #1(sun, cat) AND cat OR sun") == Or(And(Not(Near(1, "sun", "cat")), Term("cat")), Term("sun"))
    assert parse("(a OR b) AND c") == And(Or(a, b), c) and parse("a OR b AND c") == Or(a, And(b, c))
    assert parse("NOT NOT a") == Not(Not(a)) and parse("a b") == And(a, b) and parse('"x y" OR a') == Or(Phrase("x y"), a)
    assert parse("") == parse(None) == Nothing() and parse("AND a") == And(Nothing(), a) and parse("((a") == a and parse("a) b") == And(a, b)
    assert parse("a b OR c d", True) == Or(b, Term("d")) and parse("a b", True) == b
    assert lex("(a OR b)AND c") == ["(", "a", "OR", "b", ")", "AND", "c"] and len(FreeText.of(["x"] * 50).words) == 20


@settings(max_examples=200, deadline=None)
@given(st.text("ab()\"# ANDORT1,", max_size=40))
def test_parser_takes_anything(q):
    parse(q)


def matches(tree, words):
    if isinstance(tree, Not):
        return not matches(tree.of, words)
    if isinstance(tree, And):
        return matches(tree.left, words) and matches(tree.right, words)
    if isinstance(tree, Or):
        return matches(tree.left, words) or matches(tree.right, words)
    if isinstance(tree, Phrase):
        p = tree.text.split()
        return bool(p) and any(words[i : i + len(p)] == p for i in range(len(words) - len(p) + 1))
    if isinstance(tree, Near):
        at = lambda w: [i for i, x in enumerate(words) if x == w]
        return any(abs(x - y) <= tree.distance for x, y in itertools.product(at(tree.left), at(tree.right)))
    return isinstance(tree, Term) and tree.text in words


@pytest.mark.parametrize("q", ["red", "red AND green", "red OR (cat AND NOT dog)", "NOT red", "NOT (red OR green OR blue)", '"red green"', '"red green blue"', "#2(cat, dog)", "#0(cat, cat)", 'NOT "cat dog" AND cat', "red green", "nowhere", "NOT nowhere", "", "NOT NOT cat", '""'])
def test_boolean(index, q):
    got = sorted(r["doc_id"] for r in boolean.Evaluator(index).run(q).collect())
    assert got == sorted(i for i, words in TOKENS.items() if matches(parse(q), words))


def test_set_operators(index):
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    red, both = {i for i, w in TOKENS.items() if "red" in w}, {i for i, w in TOKENS.items() if {"red", "cat"} <= set(w)}
    assert ids(boolean.intersection(index, ["red", "", "cat"])) == both <= red
    assert ids(boolean.union(index, ["red", "cat"])) >= red and ids(boolean.complement(index, boolean.union(index, ["red"]))) == set(TOKENS) - red
    assert ids(boolean.complement(index, boolean.complement(index, index.term("red")))) == red
    assert len(ids(boolean.id_complement(index.term("red"), 0, 202))) == 203 - len(red)
    assert ids(boolean.conditional_intersection([index.term("red"), index.term("cat")], 10**6)) == red
    assert boolean.intersection(index, ["red", "cat"], True).first()["positions"].keys() == {"red", "cat"}


def brute_bm25(words, k1=1.2, floor=100, keep=10):
    n, mean = len(TOKENS), sum(map(len, TOKENS.values())) / len(TOKENS)
    docs = {w: {i for i, t in TOKENS.items() if w in t} for w in set(words)}
    idf = {w: math.log((n - len(d) + 0.5) / (len(d) + 0.5)) for w, d in docs.items() if d}
    order = sorted(idf, key=lambda w: (-idf[w], w))[:keep]
    if not order:
        return {}
    c = docs[order[0]]
    for w in order[1:]:
        c = c & docs[w] if len(c & docs[w]) > floor else c
    score = lambda i: sum(idf[w] * TOKENS[i].count(w) * (k1 + 1) / (TOKENS[i].count(w) + k1 * (0.25 + 0.75 * len(TOKENS[i]) / mean)) for w in order if w in TOKENS[i])
    return {i: score(i) for i in c}


@pytest.mark.parametrize("words, floor", [(["red"], 100), (["red", "cat", "red"], 100), (["red", "cat", "sun"], 10), (["unique", "red"], 0), (["nowhere"], 5), ([], 5), (WORDS, 3)])
def test_bm25(index, words, floor):
    got = [(r["doc_id"], r["bm25_score"]) for r in ranking.search(index, words, floor=floor).collect()]
    want = brute_bm25(words, floor=floor)
    assert {i for i, _ in got} == set(want) and all(abs(want[i] - s) < 1e-9 for i, s in got)
    assert got == sorted(got, key=lambda x: (-x[1], x[0]))


def test_bm25_by_shard(index):
    whole = Index(index.docs.withColumn("shard", F.lit(None).cast("string")), index.postings, index.terms, index.stats)
    got = {r["doc_id"]: r["bm25_score"] for r in ranking.search_by_shard(whole, ["red", "cat", "sun"], "shard", floor=10).collect()}
    want = brute_bm25(["red", "cat", "sun"], floor=10)
    assert got.keys() == want.keys() and all(abs(want[i] - got[i]) < 1e-9 for i in want)
    assert ranking.search_by_shard(whole, ["nowhere"], "shard").count() == 0


def test_bm25_of_no_documents(spark):
    i = Index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert ranking.search(i, ["red"]).count() == 0 and boolean.Evaluator(i).run("red").count() == 0


def test_saved_index_lookups(index, spark, tmp_path):
    index.save(f"{tmp_path}/i", 8)
    i = Index.load(spark, f"{tmp_path}/i")
    assert i.document_count() == len(ROWS) and i.term_count() == len(WORDS) + 3
    doc = next(d for d, w in TOKENS.items() if w.count("red") > 1)
    assert [i.term_frequency("red", doc), i.term_frequency("nowhere", 1), i.document_frequency("nowhere")] == [TOKENS[doc].count("red"), 0, 0]
    assert i.postings_for(["red"]).count() == i.document_frequency("red") and i.document_length(202) == 3 and i.document_length(-1) is None
    assert i.posting("red", doc).first()["positions"] == [p for p, w in enumerate(TOKENS[doc]) if w == "red"]
    plan = i.postings_for(["red"])._jdf.queryExecution().toString()
    assert any("PartitionFilters" in x and "bucket" in x.split("PartitionFilters")[1] for x in plan.split("\n"))
    assert i.vocabulary(0.5).count() == 4 and i.term("red", 3).count() == 3 and i.by_prefix("uni").count() == 1 and i.forward().count() == sum(bool(w) for w in TOKENS.values())


def test_physical_forms(index, spark):
    key = lambda df: sorted((r["term"], r["doc_id"], tuple(r["positions"])) for r in df.collect())
    assert key(delta_decode(delta_encode(index.postings))) == key(index.postings)
    one = index.postings.where("doc_id = 1")
    assert {r["tf"] for r in merge_segments([one, one]).collect()} == {2 * r["tf"] for r in one.collect()}
    ranges = shard_ranges(index.docs, 7)
    rows = sorted(ranges.collect(), key=lambda r: r["shard"])
    assert sum(r["n"] for r in rows) == len(ROWS) and all(a["max_id"] < b["min_id"] for a, b in zip(rows, rows[1:])) and len(rows) == 7
    assert shard_of(index.docs, ranges).count() == len(ROWS) and shard_ranges(index.docs.limit(0), 3).count() == 0 and shard_ranges(index.docs.limit(2), 5).count() == 2
    assert running_shards(index.docs, 50).agg(F.max("shard")).first()[0] == 3


def meta_docs(spark):
    rows = [(i, len(w), i % 7 - 2, 10 * i, f"2020-01-{1 + i % 28:02d} 00:00:00", i % 5, None if i % 9 == 0 else f"t{i}", "b", "|cat|x|" if i % 2 else "|dog|", "o", 1, 0, None) for i, w in TOKENS.items()]
    cols = "doc_id long, doc_length int, score int, viewcount int, creationdate string, userreputation int, title string, body string, tags string, ownerdisplayname string, answercount int, commentcount int, favoritecount int"
    df = spark.createDataFrame(rows, cols).withColumn("creationdate", F.to_timestamp("creationdate"))
    return rerank.add_metadata_score(df.withColumn("epoch", F.unix_timestamp("creationdate")), weights={"epoch": 1.5, "viewcount": 1.2, "score": 1.5, "userreputation": 1.5})


@pytest.fixture(scope="module")
def engine(spark, index):
    embed = vectors.hashing_embedder(16)
    vecs = vectors.embed_texts(spark.createDataFrame(ROWS, "doc_id long, text string").where("doc_id % 3 > 0"), embed)
    clusters = spark.createDataFrame([(c, n, t) for c, n, t in ((0, "animals", "cat"), (0, "animals", "dog"), (1, "x", "x"), (1, "x", "cat"))], "cluster_id int, cluster string, tag string")
    return Search(Index(meta_docs(spark).persist(), index.postings, index.terms, index.stats), None, clusters, vecs.persist(), None, embed, ["red"])


def test_pages(engine):
    best = brute_bm25(["red", "cat"])
    order = sorted(best, key=lambda i: (-best[i], i))
    for page in range(3):
        r = engine.search("red cat", Options(page, 10))
        assert [x["doc_id"] for x in r.rows.collect()] == order[page * 10 : page * 10 + 10] and r.total_results == len(order) and r.has_prev == (page > 0) and r.has_next == ((page + 1) * 10 < len(order))
    assert len(r.rows.columns) == 15 and set(json.loads(r.to_json())) == {"results", "total_results", "has_next", "has_prev", "query"}


def test_reranking(engine):
    rows = engine.search("red", Options(0, 20, rerank_metadata=True)).rows.collect()
    assert [r["metadata_score"] for r in rows] == sorted((r["metadata_score"] for r in rows), reverse=True)
    rows = engine.search("red", Options(0, 20, rerank_lm=True)).rows.collect()
    assert [r["lm_score"] for r in rows] == sorted((r["lm_score"] for r in rows), reverse=True)
    rows = engine.search("red", Options(0, 20, rerank_lm=True, rerank_metadata=True)).rows.collect()
    assert all(-1e-9 <= r["final_score"] <= 1 + 1e-9 for r in rows)
    rows = engine.search("red", Options(0, 5, clusters=["x"], date="newest")).rows.collect()
    assert all("|cat|" in r["tags"] and r["cluster_tags"] == ["animals", "x"] for r in rows) and len(rows) == 5
    assert [r["creation_date"] for r in rows] == sorted((r["creation_date"] for r in rows), reverse=True)


def test_other_entries(engine):
    got = engine.advanced_search("red AND NOT cat", Options(0, 200))
    assert sorted(r["doc_id"] for r in got.rows.collect()) == sorted(i for i, w in TOKENS.items() if "red" in w and "cat" not in w)
    assert engine.search("unique", Options(0, 10)).rows.count() == 10  # filled up
    assert engine.search("red dog", Options(0, 5, use_semantic=True)).rows.count() == 5
    assert engine.search("nowhere", Options(0, 10)).total_results == 0
    q, o = Options.of({"query": "x", "page": "2", "options": {"rerank_lm": "false", "expansion": "true"}, "filters": {"tags": "a, b", "date": "newest"}})
    assert (q, o.page, o.rerank_lm, o.expansion, o.clusters, o.date) == ("x", 2, False, True, ["a", "b"], "newest")


def test_expansion_and_spelling(spark, index):
    vocab = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0])], "term string, embedding array<double>")
    assert [r["term"] for r in expand.similar_terms(vocab, "a", 2).collect()] == ["b", "c"] and expand.similar_terms(vocab, "q").count() == 0
    assert expand.expand_query(vocab, ["a", "q"], 1) == ["a", "q", "b"] and expand.boost(["red", "x"], ["red"]) == ["red", "x", "red"]
    fixed = {r["word"]: r["corrected"] for r in expand.correct_spelling(index.terms, ["gren", "red", "qqqqqq"]).collect()}
    assert fixed == {"gren": "green", "red": "red", "qqqqqq": None}


def test_rerank_details(spark):
    docs = spark.createDataFrame([(1, 5.0, ""), (2, 5.0, "t"), (3, None, "t")], "doc_id long, metadata_score double, title string")
    assert [r["doc_id"] for r in rerank.rerank_metadata(docs.where("doc_id < 3")).collect()] == [2, 1]
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    got = {r["doc_id"]: r["lm_score"] for r in rerank.add_lm_score(docs, vecs, [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: -0.1}
    assert {r["lm_score"] for r in rerank.add_lm_score(docs, vecs.limit(0), [1.0, 0.0]).collect()} == {-1.0}
    assert rerank.add_lm_score(docs, vecs, [1.0, 0.0], drop_missing=True).count() == 2
    assert rerank.parse_clusters(["Cluster 3 (2 tags):", "a, b", "", "c"]) == [(3, "a"), (3, "b"), (3, "c")]
    flat = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "doc_id long, bm25_score double, lm_score double, metadata_score double")
    assert rerank.fuse(flat).first()["final_score"] == 0.0


def test_properties(index):
    ids = lambda q: {r["doc_id"] for r in boolean.Evaluator(index).run(q).collect()}
    assert ids('"red green blue"') <= ids("red AND green AND blue") and ids('"red green"') <= ids("#1(red, green)")
    assert ids("#1(red, sun)") <= ids("#2(red, sun)") <= ids("#5(red, sun)") <= ids("red AND sun")
    assert {r["doc_id"] for r in boolean.Evaluator(index, any_pair=True).run('"red green blue"').collect()} >= ids('"red green blue"')
    df = {r["term"]: r["df"] for r in index.terms.collect()}
    assert df == {r["term"]: r["n"] for r in index.postings.groupBy("term").agg(F.count("*").alias("n")).collect()}
    assert index.postings.where(F.col("tf") != F.size("positions")).count() == 0


def test_positions_run_on_over_blocks_and_fields(spark):
    """Titles are plain, a link adds its address, code and text count alike."""
    from quern.operators import index as ix

    html = '<p>Join two <a href="x.io/doc" >fast tables</a> now</p><pre><code>merge(a)</code></pre><ul><li>end</li></ul>'
    docs = spark.createDataFrame([(1, "Hash <b>join", html), (2, None, "<p>only body</p>"), (3, "only title", None), (None, "x", "<p>y</p>"), (4, None, None)], "doc_id long, title string, body string")
    got = {}
    for r in ix.block_tokens(docs).collect():
        got.setdefault(r["doc_id"], {})[r["pos"]] = r["term"]
    want = "hash b join join two fast tables x io doc now merge a end".split()
    assert [got[1][i] for i in range(len(want))] == want and len(got[1]) == len(want)
    assert got[2] == {0: "only", 1: "body"} and got[3] == {0: "only", 1: "title"} and set(got) == {1, 2, 3}
    index = ix.Index.of_tokens(ix.block_tokens(docs), docs.select("doc_id", "title"))
    assert {(r["doc_id"], r["doc_length"]) for r in index.docs.collect()} == {(1, 14), (2, 2), (3, 2), (4, 0)}
    assert index.postings.where("term = 'join' AND doc_id = 1").first()["positions"] == [2, 3]


def test_filled_results_are_repeatable(spark):
    from quern.operators import rerank

    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    best = spark.createDataFrame([(5, 2.0), (7, 3.0)], "doc_id long, bm25_score double")
    a, b = ([r["doc_id"] for r in rerank.fill(best, docs, 10, seed=s).collect()] for s in (1, 1))
    c = [r["doc_id"] for r in rerank.fill(best, docs, 10, seed=2).collect()]
    assert a == b != c and a[:2] == [7, 5] == c[:2] and len(set(a)) == 10
    assert [r["doc_id"] for r in rerank.fill(best, docs, 1).collect()] == [7]


def test_ranks_of_repeated_ids(spark):
    from quern.operators import index as ix

    df = spark.createDataFrame([(x,) for x in (5, 1, 1, 3, 3, 3, 9, None)], "doc_id int")
    got = sorted((r["doc_id"], r["shard"]) for r in ix.running_shards(df, 2).collect())
    assert got == [(1, 1), (1, 1), (3, 3), (3, 3), (3, 3), (5, 3), (9, 4)]


def test_a_torn_replay_hides_its_segment(spark, tmp_path, monkeypatch):
    from quern.streaming import segments

    index = segments.SegmentedIndex(spark, f"{tmp_path}/index")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    index.add(docs, 0)
    assert index.docs().count() == 1

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(segments, "doc_lengths", dies)
    try:
        index.add(docs, 0)
    except RuntimeError:
        pass
    assert index._live() == []
    monkeypatch.undo()
    index.add(docs, 0)
    assert index.docs().count() == 1 and index.postings().count() == 2


def test_plain_tokens_are_the_jvm_terms(spark):
    """Cut over bytes in Python as by the JVM's regular expression: every code
    point, texts that touch, empty and null ones."""
    from quern.functions.text import plain_terms
    from quern.operators import index as ix

    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["Ab" + "x".join(every[i : i + 997]) + "Cd" for i in range(0, len(every), 997)]
    texts += ["a", "b", "", None, "  ", "ΟΔΟΣ İstanbul ẞ ﬁx", "end", "1st²½", "naïve—café", "日本 語\U0001d400x", "é", "x" * 70000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert "split(" not in str(ix.doc_postings(df, unique=True)._jdf.queryExecution().optimizedPlan().toString())
    whole = ix.postings_of(ix.tokens(df))
    got = ix.doc_postings(df, unique=True)
    assert got.exceptAll(whole.select(got.columns)).isEmpty() and got.count() == whole.count() > 3000
    sizes = {r["doc_id"]: r["n"] for r in df.select("doc_id", F.size(plain_terms(F.col("text"))).alias("n")).collect()}
    sums = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("tf").alias("n")).collect()}
    assert all(sums.get(i, 0) == n for i, n in sizes.items())
    bad = df.limit(1).select(F.lit(1).alias("doc_id"), F.expr("cast(x'61ff62c3' as string)").alias("text"))
    assert {r["term"] for r in ix.doc_postings(bad, unique=True).collect()} == {"a", "b"}


def test_vocabulary_counts_terms_once(spark, monkeypatch):
    from quern.operators import index as ix

    written = []
    whole = ix.materialize
    monkeypatch.setattr(ix, "materialize", lambda df, name: written.append(name) or whole(df, name))
    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(0, 60, 1 + i % 4))) for i in range(20)], "doc_id long, text string")
    index = Index.build(df)
    for share in (0, 0.01, 0.2, 0.5, 1):
        want = index.terms.orderBy(F.desc("df"), "term").limit(int(60 * share)).collect()
        assert index.vocabulary(share).collect() == want and len(want) == int(60 * share)
    assert written == ["terms"] * 5


def test_posting_prefix_passes_on_the_least_ids_of_a_batch(spark):
    from quern.operators import index as ix

    for kind in ("long", "string"):
        df = spark.createDataFrame([((i * 37) % 300, f"all {'even' if i % 2 else 'odd'} w{i}") for i in range(300)], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind)).repartition(2)
        rows = ix.row_runs(df, ix._found(None, "text", None), "prefix", first_k=3)
        assert rows.where("term = 'all'").count() <= 6
        for table in (df, df.union(df)):  # the second has each id twice
            want = sorted(tuple(r) for t, g in ix.postings_of(ix.tokens(table)).toPandas().groupby("term") for r in g.sort_values("doc_id")[["term", "doc_id"]].head(3).values.tolist())
            assert sorted(tuple(r) for r in ix.posting_prefix(table, 3).collect()) == want


def test_disjoint_segments_are_not_shuffled(spark):
    from quern import queries
    from quern.operators import index as ix

    sf = "/root/testdata/sf0.001"
    plan = queries.QUERIES["j20_merge_segments"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan
    df = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "c")], "doc_id long, text string")
    parts = [ix.doc_postings(df.where(w), unique=True) for w in ("doc_id < 2", "doc_id >= 2")]
    one, two = (sorted(tuple(r) for r in merge_segments(parts, disjoint=d).select("term", "doc_id", "tf", "positions").collect()) for d in (True, False))
    assert one == two and len(one) == 4
