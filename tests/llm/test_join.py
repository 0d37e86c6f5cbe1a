"""Operator 9 against brute force."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest_data import ROWS, SCHEMA, edited, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import join
from quern.llm.chunks import slices
from quern.llm.words import words_of

SF = "/root/testdata/sf0.01"


def grams(text, n=join.N):
    w = words_of(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold=join.THRESHOLD):
    """Pairs of row numbers that reach the threshold."""
    sets = [grams(r[1]) for r in rows]
    out = set()
    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and both / (len(sets[i]) + len(sets[j]) - both) >= threshold - 1e-12:
            out.add((i, j))
    return out


def classes(rows, threshold=join.THRESHOLD, pairs=None):
    """(id, class_id, links) of every row with an id, by union-find."""
    rows = [r for r in rows if r[0] is not None]
    par, links = list(range(len(rows))), Counter()

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, j in brute(rows, threshold) if pairs is None else pairs:
        links[i] += 1
        links[j] += 1
        a, b = find(i), find(j)
        par[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], least[find(i)], links[i]) for i, r in enumerate(rows))


def joined(df, **settings):
    return sorted(tuple(r) for r in join.near_copies(df, **settings).collect())


def indexed(rows):
    """Pairs that reach the threshold, met by way of common grams."""
    sets, index = [grams(r[1]) for r in rows], {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    common = Counter(p for v in index.values() for p in combinations(v, 2))
    return {(i, j) for (i, j), c in common.items() if c / (len(sets[i]) + len(sets[j]) - c) >= join.THRESHOLD - 1e-12}


def test_sets_are_n_grams():
    texts = [r[1] or "" for r in ROWS]
    for t, s in zip(texts, join.text_sets(pa.array(texts, pa.large_string()))):
        assert len(s) == len(grams(t)) and (np.diff(s.astype(object)) > 0).all()


def test_small_table_with_all_edges(docs, empty, clashing):
    want = classes(ROWS)
    assert joined(docs) == want == joined(clashing)
    assert joined(empty) == [] and join.keep_one(empty).count() == 0
    assert {(2, 1, 2), (10, 9, 1), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 8, 0)} <= set(want) and want.count((4, 4, 2)) == 2


def tied(common, whole, name):
    """Two texts that share ``common`` of ``whole`` grams."""
    shared = [f"{name}w{i}" for i in range(common + 2)]
    rest = whole - common
    return " ".join(shared + [f"{name}l{i}" for i in range(rest // 2)]), " ".join(shared + [f"{name}r{i}" for i in range(rest - rest // 2)])


def hard_rows():
    """A hot group of which a third are copies, pairs around the threshold that
    no other copy helps to find (bands alone miss some), and ties."""
    rows = [(i, edited(prose(1, 200), i, 0.04 * (i % 5)), "en", "a", 1) for i in range(60)] + [(100 + i, prose(100 + i, 150), "en", "a", 1) for i in range(60)]
    rows += [(200 + i, prose(1, 200), "en", "a", 1) for i in range(60)]
    for i in range(500):
        text = prose(1000 + i, 60 + i % 90, 5000)
        rows += [(1000 + 2 * i, text, "en", "a", 1), (1001 + 2 * i, edited(text, i, 0.05 + 0.2 * (i % 10) / 10), "en", "a", 1)]
    for k, (common, whole) in enumerate([(10, 20), (9, 19), (1, 2), (50, 100), (49, 99)]):
        rows += [(5000 + 2 * k + x, t, "en", "a", 1) for x, t in enumerate(tied(common, whole, f"t{k}"))]
    return rows


@pytest.mark.parametrize("block", [join.BLOCK, 1500])
def test_hot_group_isolated_pairs_and_ties(spark, block):
    rows = hard_rows()
    pairs = indexed(rows)
    want = classes(rows, pairs=pairs)
    assert [x[2] for x in want[-10:]] == [1, 1, 0, 0, 1, 1, 1, 1, 0, 0]
    assert 150 < len([x for x in want if 1000 <= x[0] < 5000 and x[2]]) / 2 < 480
    df = spark.createDataFrame(rows, SCHEMA)
    if block == join.BLOCK:
        assert joined(df) == want
    else:  # in blocks, with all pairs listed
        sets, ids = [grams(r[1]) for r in rows], {}
        for r, s in zip(rows, sets):
            ids.setdefault(frozenset(s), r[0])
        listed = {(*sorted((ids[frozenset(sets[i])], ids[frozenset(sets[j])])), round(len(sets[i] & sets[j]) / len(sets[i] | sets[j]), 6)) for i, j in pairs if sets[i] != sets[j]}
        assert sorted(tuple(r) for r in join.similar_pairs(df, block=block).collect()) == sorted(listed)


def test_no_pair_is_lost_with_useless_bands(spark, monkeypatch):
    """Where sets stand in the tree changes no result: here strangers share a
    cluster and copies are told apart."""
    from pyspark.sql import functions as F

    rows = [(i, edited(prose(i % 4, 90), i, 0.04 * (i % 4)), "en", "a", 1) for i in range(40)]
    monkeypatch.setattr(join, "clusters_of", lambda members, threshold: members.select(F.col("key").alias("node"), (F.col("key") % 3).alias("root")))
    assert joined(spark.createDataFrame(rows, SCHEMA)) == classes(rows)


def test_slices_make_no_difference():
    texts = pa.array([edited(prose(i // 2, 120), i, 0.03) for i in range(12)] + ["x" * 3000, "", "x" * 3000, "a b"], pa.large_string())
    whole, lens = join.flat_sets(texts)
    parts = [join.flat_sets(texts.slice(a, b - a)) for a, b in slices(texts, 100)]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), whole) and np.array_equal(np.concatenate([p[1] for p in parts]), lens)


def test_the_corpus_and_millions_of_characters(spark):
    """Texts longer than a slice, one of a single unbroken word, and sf0.01."""
    long = prose(5, 450_000, 20_000)
    assert len(long) > 2 * join._SLICE
    df = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in df.collect()] + [(10**7 + i, t, "en", "a", 1) for i, t in enumerate((long, long + " tail words here", "y" * 2_500_000, "short"))]
    assert joined(df.unionByName(spark.createDataFrame(rows[-4:], SCHEMA))) == classes(rows, pairs=indexed(rows))


def test_keep_one_leaves_one_of_each_group(docs, clashing):
    kept = sorted((r["doc_id"] for r in join.keep_one(docs).collect()), key=lambda x: (x is None, x or 0))
    assert kept == [1, 4, 5, 6, 7, 8, 9, 11, 12, 14, None]
    assert join.keep_one(clashing).columns == clashing.columns and join.keep_one(clashing).count() == len(kept)
    names = ("__quern_gone", "__quern_key", "__quern_size", "__quern_row", "__quern_text", "key", "n", "node", "root", "at", "r", "k", "first", "a.b")
    from pyspark.sql import functions as F

    for c in names:
        docs = docs.withColumn(c, F.lit("x"))
    assert join.keep_one(docs).count() == len(kept) and joined(docs) == classes(ROWS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=30), st.sampled_from([0.2, 0.5, 0.8, 1.0]), st.integers(0, 30))
def test_traversal_is_exact(sets, threshold, split):
    arrays = [np.array(sorted(s), np.uint64) * np.uint64(4097 * 7) for s in sets]
    jac = lambda a, b: len(a & b) / len(a | b)
    i, j, s = join.dual_traversal(arrays, None, threshold)
    want = {(a, b) for a, b in combinations(range(len(sets)), 2) if jac(sets[a], sets[b]) >= threshold - 1e-12}
    assert set(zip(i.tolist(), j.tolist())) == want
    assert all(abs(jac(sets[a], sets[b]) - x) < 1e-9 for a, b, x in zip(i, j, s))
    if 0 < split < len(sets):
        i, j, _ = join.dual_traversal(arrays, split, threshold)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in want if a < split <= b}


def test_tree_prunes(monkeypatch):
    """Sets of two kinds, sorted together: most leaf pairs are never looked at."""
    kinds = [prose(1, 300), prose(2, 300)]
    sets = join.text_sets(pa.array([edited(kinds[i // 64], i, 0.02) for i in range(128)], pa.large_string()))
    looked = []
    own = join._verify
    monkeypatch.setattr(join, "_verify", lambda s, n, i, j, t: (looked.append(len(i)), own(s, n, i, j, t))[1])
    join.dual_traversal(sets, None, 0.5)
    assert looked[0] <= 2 * 64 * 63 / 2


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in join.components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in touched}
