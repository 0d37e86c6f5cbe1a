"""The pipeline against its stages' brute-force meaning, and what it promises."""

from collections import Counter

import numpy as np
import pytest
from conftest_data import ROWS, edited, prose
from test_filters import brute_buckets, brute_figures
from test_operators import reference_encoding

import corpus_pipeline
from quern.llm import langid, quality

SF = "/root/testdata/sf0.001"


def brute_quality(rows):
    """Documents inside their bands, by figures and limits worked out here."""
    figures, groups, kept = [brute_figures(r[1]) for r in rows], {}, []
    place = lambda r, f: (r[2] or "script:" + quality.script_of(r[1]), int(np.log2(f[0])))
    for r, f in zip(rows, figures):
        if f[0]:
            groups.setdefault(place(r, f), []).append([round(x / g) * g for x, g in zip(f[1:], quality.GRID)])
    for r, f in zip(rows, figures):
        if f[0]:
            own = np.array(groups[place(r, f)])
            mid, high = np.quantile(own, [0.5, 0.84], axis=0)
            reach = quality.WIDTH * (1 + quality.SCATTER / len(own) ** 0.5) * np.maximum(high - mid, quality.FLOORS)
            if abs(f[1] - mid[0]) <= reach[0] and f[2] <= mid[1] + reach[1] and f[3] >= mid[2] - reach[2]:
                kept.append(r)
    return kept


def brute_language(rows, model):
    """Documents near enough to a centroid, by n-grams of one word at a time."""
    kept = []
    for r in rows:
        c = Counter(brute_buckets(r[1]))
        if c:
            v = np.zeros(langid.BUCKETS)
            for b, n in c.items():
                v[b] = (1 + np.log(n)) * model.idf[b]
            limit = langid.NEAR * model.usual[min(int(np.log2(sum(c.values()))), len(model.usual) - 1)]
            if (v / np.linalg.norm(v) @ model.centroids).max() >= limit or (r[2] is not None and r[2] not in model.settled):
                kept.append(r)
    return kept


def test_stages_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == list(corpus_pipeline.COLUMNS)


def test_run_agrees_with_brute_force(spark):
    """Each stage again by its definition: figures and bands, cosines, a plain
    union-find over exact pairs, a Poisson loop and a library's encoding."""
    import hashlib
    import math
    from itertools import combinations

    from test_join import grams

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    kept = brute_quality(rows)
    left = spark.createDataFrame(kept, docs.schema)
    kept = brute_language(kept, langid.fit(left))
    assert 0.5 * len(rows) < len(kept) < len(rows)
    sets, par = [grams(r[1]) for r in kept], list(range(len(kept)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, j in combinations(range(len(kept)), 2):
        both = len(sets[i] & sets[j])
        if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.5:
            a, b = find(i), find(j)
            par[max(a, b)] = min(a, b)
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(find(i), []).append(r)
    kept = [min(g, key=lambda r: r[0]) for g in groups.values()]
    size = Counter()
    for r in kept:
        size[r[3]] += len(r[1]) + 1
    want, enc = Counter(), reference_encoding()
    for r in kept:
        rate = sum(size.values()) / len(size) / size[r[3]]
        u = int(hashlib.md5(f"{r[0]}|17".encode()).hexdigest()[:13], 16) / 2**52
        k, p, c = 0, math.exp(-rate), math.exp(-rate)
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        want[(r[0], tuple(enc.encode_ordinary(r[1])))] += k
    got = Counter((r["doc_id"], tuple(r["tokens"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want


@pytest.mark.parametrize("shape", ["edges", "empty"])
def test_pipeline_takes_any_table(spark, tmp_path, docs, empty, shape):
    (docs if shape == "edges" else empty).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out == [] if shape == "empty" else all(r["round_trip"] for r in out)
    assert edited(prose(1, 3), 1, 0) and ROWS


def test_pipeline_keeps_clean_documents_of_an_unlabelled_table(spark, tmp_path, empty):
    rows = [(i, prose(i, 150), None, "a", 1) for i in range(12)]
    spark.createDataFrame(rows, empty.schema).write.parquet(f"{tmp_path}/documents.parquet")
    from quern.session import materialize

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
    assert {r["doc_id"] for r in docs.collect()} == set(range(12)) and corpus_pipeline.run(spark, str(tmp_path)).count()
