"""Brute-force checks and edge cases of operators 1, 4, 5, 6, 7, 8 and 10."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from conftest_data import ROWS, prose
from quern.llm import bpe, counts, fingerprints, licenses, mixing, sharding, urls
from quern.llm.words import hash_word, mix, word_hashes, words_of

PLAIN = "byte_bpe_50k.tiktoken"


# 1


def test_fingerprint_collisions_follow_weighted_jaccard():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**63, 60).astype(np.uint64)
    a = np.repeat(words, rng.integers(0, 6, 60))
    b = np.repeat(words, rng.integers(0, 6, 60))
    ca, cb = Counter(a.tolist()), Counter(b.tolist())
    true = sum(min(ca[w], cb[w]) for w in ca | cb) / sum(max(ca[w], cb[w]) for w in ca | cb)
    sig, _ = fingerprints.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 4096)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4096)


def test_fingerprint_samples_match_brute_force():
    """Every sample again from its definition, a word at a time."""
    texts = ["a b b c", "née née née x", "word " * 70 + "other", "one"]
    words, offsets = word_hashes(pa.array(texts, pa.large_string()))
    got, _ = fingerprints.signatures(words, offsets, 32)
    one = np.float32(1)
    m64 = (1 << 64) - 1

    def uniform(bits, half):
        return (np.float32(bits >> 32 if half else bits & 0xFFFFFFFF) + np.float32(0.5)) * np.float32(2.0**-32)

    for i, t in enumerate(texts):
        for k in range(32):
            best = None
            for w, n in Counter(words_of(t)).items():
                x = hash_word(w)
                h = [(x + k * 0x9E3779B9 + 0x85EBCA6B + 1) & m64]
                for _ in range(3):
                    h.append(int(mix(np.array([h[-1]], np.uint64))[0]))
                r = np.maximum(-np.log(uniform(h[1], True) * uniform(h[1], False)), np.float32(1e-6))
                c = np.maximum(-np.log(uniform(h[2], True) * uniform(h[2], False)), np.float32(1e-12))
                b = np.float32(h[3] >> 32) * np.float32(2.0**-32)
                step = np.floor(np.log(np.float32(n)) / r + b)
                draw = np.log(c) - r * (step - b) - r * one
                low = int(mix(np.array([x ^ (int(step) * 0xC2B2AE3D27D4EB4F & m64) ^ 1], np.uint64))[0]) & 0xFFFFFFFF
                best = min(best or (draw, low), (draw, low))
            assert int(np.uint32(np.int64(got[i][k]) & 0xFFFFFFFF)) == best[1]


def test_fingerprint_slices_and_similarity(spark):
    texts = pa.array(["a b b c", "x" * 5000, "", "a b b d"], pa.large_string())
    whole = fingerprints.signatures(*word_hashes(texts))[0]
    parts = [fingerprints.signatures(*word_hashes(texts.slice(i, 1)))[0] for i in (0, 1, 3)]
    assert np.array_equal(whole, np.concatenate(parts))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([1, 2, 3, 4], [1, 0, 3, 4]), ([1], None)], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(fingerprints.estimated_similarity(F.col("a"), F.col("b"))).collect()] == [0.75, None]


def test_fingerprints_edges(docs, empty, clashing):
    rows = {}
    for r in fingerprints.fingerprint_documents(docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == len(ROWS)
    assert rows[1][0]["signature"] == rows[2][0]["signature"] and len(rows[1][0]["signature"]) == 64
    assert len(rows[4]) == 2 and rows[4][0] == rows[4][1]
    for i in (5, 6, 7, 8):
        assert rows[i][0]["signature"] is None and rows[i][0]["n_words"] == 0
    assert rows[9][0]["signature"] == rows[10][0]["signature"]
    assert rows[11][0]["n_words"] == len(set(words_of(ROWS[10][1])))
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert sorted(map(str, fingerprints.fingerprint_documents(clashing).collect())) == sorted(map(str, fingerprints.fingerprint_documents(docs).collect()))


# 4


def brute_urls(url):
    low, hits = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in url or ""), []
    inside = set("abcdefghijklmnopqrstuvwxyz0123456789")
    for t in [*urls.STRICT, *urls.SOFT]:
        for i in range(len(low)):
            if low.startswith(t, i) and (i == 0 or low[i - 1] not in inside) and (i + len(t) == len(low) or low[i + len(t)] not in inside):
                hits.append(t)
    strict = {t for t in hits if t in urls.STRICT}
    soft = {t for t in hits if t in urls.SOFT}
    return len([t for t in hits if t in strict]), len([t for t in hits if t in soft]), bool(strict) or len(soft) >= urls.MIN_SOFT


def test_urls_match_brute_force(spark):
    cases = ["http://casino.com", "http://thecasino.com/", "http://a.com/free-bonus", "http://a.com/free/free", "HTTP://XXX.ORG/xxx", "", None, "bet", "http://a/bets.bet?win=1&ads", "é-free-bonusé", "http://x.com/" + "free-" * 5000, "http://casino.com"]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(cases)], "page_id long, url string, score string, rejected int")
    for r in urls.filter_urls(df).collect():
        assert (r["strict_hits"], r["soft_hits"], r["rejected"]) == brute_urls(cases[r["page_id"]])
    assert urls.filter_urls(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        urls.filter_urls(df, {"a": 1.0}, {"a": 1.0})


# 5


def reference_encoding(name=PLAIN):
    import base64

    import tiktoken

    with open(f"{bpe.VOCABULARIES}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", [PLAIN, "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_a_merge_loop(name):
    m, enc = bpe.Merges(f"{bpe.VOCABULARIES}/{name}"), reference_encoding(name)
    texts = [r[1] for r in ROWS if r[1]] + ["aaaaaaaaaaaaaaaaaaaaa", "I'll don't 12345  \n\n x", "<|endoftext|>", "zażółć gęślą jaźń", "😀😀", "the theatre then these"]
    for t in texts:
        assert m.encode(t) == enc.encode_ordinary(t)
        assert m.decode(m.encode(t)) == t


def test_bpe_documents(docs, empty, clashing):
    enc = reference_encoding()
    source = {}
    for r in ROWS:
        source.setdefault(r[0], []).append(r[1])
    rows = bpe.encode_documents(docs).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        text = source[r["doc_id"]][0]
        if text is None:
            assert r["tokens"] is None and r["n_tokens"] is None and r["round_trip"] is None
        else:
            assert r["tokens"] == enc.encode_ordinary(text) and r["n_tokens"] == len(r["tokens"]) and r["round_trip"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(bpe.encode_documents(docs)).collect()}
    assert all(back[k] == v[0] for k, v in source.items())
    assert bpe.encode_documents(empty).count() == 0
    assert bpe.encode_documents(clashing).count() == len(ROWS)


def test_bpe_decoding_of_bad_ids(spark):
    df = spark.createDataFrame([(1, [0, None]), (2, [10**6]), (3, []), (4, None)], "doc_id long, tokens array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(df).collect()} == {1: None, 2: None, 3: "", 4: None}


# 6


def test_counts_match_brute_force(spark, docs, empty, clashing):
    enc, want, seen = reference_encoding(), {}, {}
    for r in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        if r[1] is not None and r[1] in seen:
            continue
        seen[r[1]] = 1
        at = want.setdefault((r[3], r[2]), [0, 0, 0])
        at[0] += 1
        at[1] += len(enc.encode_ordinary(r[1])) if r[1] is not None else 0
        at[2] += len(r[1] or "")
    for df in (docs, clashing):
        assert {(r["source"], r["lang"]): [r["docs"], r["tokens"], r["chars"]] for r in counts.maintain_counts(df).collect()} == want
    assert counts.maintain_counts(empty).count() == 0


def test_ledger_commits_once_and_survives_torn_batches(spark, tmp_path):
    ledger = counts.Ledger(spark, f"{tmp_path}/ledger")
    rows = spark.createDataFrame([("a", "en", "v", 1, 10, 50), ("a", None, "v", 1, 5, 20)], "source string, lang string, version string, docs long, tokens long, chars long")
    assert ledger.totals().count() == 0
    assert ledger.commit("one", rows) and not ledger.commit("one", rows)
    torn = tmp_path / "ledger" / "batch=two"
    torn.mkdir()
    (torn / "part-00000.parquet").write_bytes(b"torn")
    assert {(r["lang"], r["tokens"]) for r in ledger.totals().collect()} == {("en", 10), (None, 5)}
    assert ledger.commit("two", counts.signed(rows, -1))
    assert ledger.totals().count() == 0
    assert ledger.commit("three", counts.revised(rows.withColumn("new", rows["tokens"] + 7), "new"))
    before = sorted(map(str, ledger.totals().collect()))
    ledger.compact()
    assert sorted(map(str, ledger.totals().collect())) == before and not ledger.commit("one", rows)
    with pytest.raises(ValueError):
        ledger.commit("../x", rows)


def test_ledger_takes_several_tables_and_writers(spark, tmp_path, empty):
    path = f"{tmp_path}/ledger"
    one = spark.createDataFrame([(i, prose(i, 30), "en", "a", 1) for i in range(4)], empty.schema)
    two = spark.createDataFrame([(i, prose(i, 30), "en", "b", 1) for i in range(10, 13)], empty.schema)
    totals = lambda df: {r["source"]: r["docs"] for r in df.collect()}
    assert totals(counts.maintain_counts(one, path=path)) == {"a": 4}
    assert totals(counts.maintain_counts(two, path=path)) == {"a": 4, "b": 3}
    assert totals(counts.maintain_counts(one.orderBy("text"), path=path)) == {"a": 4, "b": 3}
    ledger = counts.Ledger(spark, path)
    rows = spark.createDataFrame([("c", "en", "v", 1, 10, 50)], "source string, lang string, version string, docs long, tokens long, chars long")
    # another writer is first, after this one has looked
    rival = counts.Ledger(spark, path)
    own = ledger._rename
    ledger._rename = lambda a, b: (rival.commit("race", rows), own(a, b))[1]
    assert not ledger.commit("race", rows) and totals(ledger.totals()) == {"a": 4, "b": 3, "c": 1}
    # a crash of a compaction before it deletes what it folded, then another compaction
    ledger.sweep = lambda: None
    ledger.compact()
    assert ledger._folders("batch=") and totals(ledger.totals()) == {"a": 4, "b": 3, "c": 1} and not rival.commit("race", rows)
    rival.compact()
    assert not rival._folders("batch=") and totals(rival.totals()) == {"a": 4, "b": 3, "c": 1} and not rival.commit("race", rows)


# 7


def brute_licenses(texts):
    """Every shift of every template over every file, by definition."""
    from quern.llm.licenses import RARE, SLACK, TEMPLATES, words

    files = [words(t or "") for t in texts]
    vocabulary = {w for t in TEMPLATES for w in words(t.text)}
    df = Counter(w for f in files for w in vocabulary & set(f))
    idf = {w: math.log((1 + len(files)) / (1 + df[w])) for w in vocabulary}
    out = []
    for n, f in enumerate(files):
        found = {}
        for t in TEMPLATES:
            ws, phrases = words(t.text), [words(p) for p in t.phrases]
            stands = [[i for i in range(len(f)) if f[i : i + len(p)] == p] for p in phrases]
            if not all(stands):
                continue
            rare = sorted({w for w in ws if w in f}, key=lambda w: (-idf[w], w))[:RARE]
            looked = {*rare, *(w for p in phrases for w in p)}
            at = [next(i for i in range(len(ws)) if ws[i : i + len(p)] == p) for p in phrases]
            for shift in range(-len(ws), len(f)):
                agreed = sum(any(ws[i] == w and 0 <= shift + i < len(f) and f[shift + i] == w for i in range(len(ws))) for w in looked)
                if agreed >= min(2, len(looked)) and all(any(abs(s - shift - a) <= SLACK for s in own) for a, own in zip(at, stands)):
                    share = sum(0 <= shift + i < len(f) and f[shift + i] == w for i, w in enumerate(ws)) / len(ws)
                    key = (t.name, max(shift, 0))
                    found[key] = max(found.get(key, (0, 0, 0)), (share, agreed, len(ws)))
        taken = []
        for (name, start), (share, agreed, size) in sorted(found.items(), key=lambda x: (-round(x[1][0] * x[1][2]), -x[1][0], x[0][1], x[0][0])):
            if not any(m == name and start < s + z and s < start + size for m, s, z in taken):
                taken.append((name, start, size))
                out.append((n, name, start, agreed, round(share, 4)))
    return sorted(out)


def test_licenses_match_a_scan_of_all_shifts(spark):
    """Several notices in a file, broken, overlapping, repeated and cut ones."""
    import random

    from quern.llm.licenses import TEMPLATES

    rng, texts = random.Random(8), [None, "", prose(1, 40)]
    for i in range(40):
        parts = []
        for t in rng.sample(TEMPLATES, 1 + i % 5):
            ws = t.text.split(" ")
            if i % 3 == 1:  # words put in between
                ws.insert(rng.randrange(len(ws)), " ".join(["odd"] * rng.randrange(1, 9)))
            if i % 4 == 3:  # cut at either end
                ws = ws[rng.randrange(3) : len(ws) - rng.randrange(3)]
            parts += [prose(100 + i, rng.randrange(6)), " ".join(ws)]
        texts.append(" ".join(parts) + (" " + parts[-1] if i % 7 == 0 else ""))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((r["doc_id"], r["license"], r["first_word"], r["rare_words"], r["in_place"]) for r in licenses.scan_licenses(df).collect())
    assert got == brute_licenses(texts) and len(got) > 60


def test_licenses_of_long_texts_and_large_vocabularies(spark):
    """A file beyond a slice, and templates of more words than 16 bits count."""
    many = " ".join(f"w{i}" for i in range(40_000))
    own = [licenses.Template("BIG", many + " grant alpha beta", ("grant alpha beta",)), licenses.Template("ZED", "zz zy zx", ("zz zy zx",))]
    rows = [(1, prose(3, 900_000) + " zz zy zx"), (2, "see " + many + " grant alpha beta"), (3, "z" * 4_500_000)]
    assert len(rows[0][1]) > licenses._SLICE
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string"), own).collect()
    assert {(r["doc_id"], r["license"], r["first_word"], r["in_place"]) for r in got} == {(1, "ZED", 900_000, 1.0), (2, "BIG", 1, 1.0)}


def test_licenses(spark, docs, empty, clashing):
    mit, apache = "Released under the MIT License", "Licensed under the Apache License, Version 2.0"
    texts = [
        ("plain", prose(1, 50)), ("mit", f"{prose(2, 30)}\n{mit}\n{prose(3, 40)}"), ("apache", f"# {apache}."), ("both", f"{mit} {prose(5, 3000)} {apache}"), ("near", "under the license of MIT people"),
        ("gpl", "This work is licensed under the GNU General Public License, version 3"), ("null", None), ("empty", ""), ("mit", f"{prose(2, 30)}\n{mit}\n{prose(3, 40)}"),
    ]
    df = spark.createDataFrame(texts, "doc_id string, text string")
    found = Counter((r["doc_id"], r["license"]) for r in licenses.scan_licenses(df).collect())
    assert found == {("mit", "MIT"): 2, ("apache", "Apache-2.0"): 1, ("both", "MIT"): 1, ("both", "Apache-2.0"): 1, ("gpl", "GPL-3.0"): 1}
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs).count() == licenses.scan_licenses(clashing).count() == 0


def test_licenses_match_brute_force(spark):
    """Each template planted at each place: found there, with all words in place."""
    rows, want = [], set()
    for i, t in enumerate(licenses.TEMPLATES):
        before = prose(i, 7 * i)
        rows.append((i, f"{before} {t.text} {prose(i + 50, 9)}"))
        want.add((i, t.name, len(licenses.words(before)), 1.0))
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {(r["doc_id"], r["license"], r["first_word"], r["in_place"]) for r in licenses.scan_licenses(df).collect()}
    assert want <= got and {(i, n) for i, n, _, _ in got} - {(i, n) for i, n, _, _ in want} == set()


def test_licenses_of_files_with_many_notices(spark):
    """Every notice of a file that holds all of them, and of pairs and triples,
    is found where a plain phrase search finds it."""
    import random

    from quern.llm.licenses import TEMPLATES, words

    def phrase_search(text):
        ws, out = words(text), set()
        for t in TEMPLATES:
            if all(any(ws[i : i + len(p)] == p for i in range(len(ws))) for p in map(words, t.phrases)):
                out.add(t.name)
        return out

    rng = random.Random(4)
    texts = ["\n".join(t.text for t in TEMPLATES), "\n\n".join(f"{prose(i, 40)} {t.text}" for i, t in enumerate(reversed(TEMPLATES)))]
    texts.append("\n".join(t.text for t in TEMPLATES if t.name in ("BSD", "MIT")) + "\nLicensed under the Apache License, Version 2.0")
    texts += ["\n".join(t.text for t in rng.sample(TEMPLATES, 2 + i % 7)) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in licenses.scan_licenses(df).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {i: phrase_search(t) for i, t in enumerate(texts)}


# 8


def test_mixing_reaches_its_weights(spark, empty):
    rows = [(i, prose(i, 5 + i % 20), None, "big" if i % 10 else "small", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, empty.schema)
    out = mixing.mix_sources(df, {"small": 3.0}, 1.0).collect()
    size = Counter()
    for r in out:
        size[r["source"]] += len(r["text"]) + 1
    assert abs(size["small"] / sum(size.values()) - 0.75) < 0.03
    assert [r["doc_id"] for r in out] != sorted(r["doc_id"] for r in out)


def test_mixing_draws_poisson_quantiles(spark, docs, empty, clashing):
    import hashlib

    size, n = Counter(), Counter(r[3] for r in ROWS)
    for r in ROWS:
        size[r[3]] += len(r[1] or "") + 1
    total, want = sum(size.values()), Counter()
    for r in ROWS:
        rate = total / len(n) / size[r[3]]
        u = int(hashlib.md5(f"{'null' if r[0] is None else r[0]}|{mixing.SEED}".encode()).hexdigest()[:13], 16) / 2**52
        k, c = 0, math.exp(-rate)
        while c <= u:
            k += 1
            c += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if k:
            want[(r[0], r[3])] += k
    got = Counter((r["doc_id"], r["source"]) for r in mixing.mix_sources(docs).collect())
    assert got == want
    assert Counter((r["doc_id"], r["source"]) for r in mixing.mix_sources(clashing).collect()) == want
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(docs, {}, 0.0).count() == 0
    assert mixing.mix_sources(docs, copy_col=None).columns == docs.columns


def test_poisson_quantiles_of_high_rates(spark):
    """Against sums of exact terms; beyond, against the normal law."""
    from pyspark.sql import functions as F

    us = [2.0**-52, 1e-9, 0.01, 0.3, 0.5, 0.77, 0.999, 1 - 1e-9, 1 - 2.0**-52]
    rows = [(float(r), u) for r in (0.0, 1e-3, 0.7, 20.0, 190.0, 745.3, 1e4, 1e6) for u in (0.0, *us)]
    got = spark.createDataFrame(rows, "rate double, u double").select("rate", "u", mixing.poisson_count(F.col("rate"), F.col("u")).alias("n")).collect()
    for r in got:
        rate, u, k, total = r["rate"], r["u"], 0, 0.0
        if rate == 0 or u == 0:
            assert r["n"] == 0
            continue
        low = max(0, int(rate - 15 * rate**0.5 - 40))
        terms = lambda k: math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        below, k = sum(map(terms, range(low, r["n"]))), r["n"]
        slack = 1e-8 if rate > 1000 else 1e-11  # of lgamma
        assert below <= u + slack and (below + terms(k) > u - slack)
    far = spark.createDataFrame([(1e9, 0.5), (1e9, 0.8413447460685429)], "rate double, u double").select(mixing.poisson_count(F.col("rate"), F.col("u"))).collect()
    assert abs(far[0][0] - 1e9) <= 2 and abs(far[1][0] - (1e9 + 1e9**0.5)) <= 3


def test_mixing_of_a_tiny_source(spark, empty):
    """A source far smaller than its weight: one row in runs of copies."""
    rows = [(1, "x", None, "tiny", 1), (2, "y" * 600_000, None, "big", 1), (3, "z" * 600_000, None, "big", 1)]
    out = mixing.mix_sources(spark.createDataFrame(rows, empty.schema)).select("doc_id", "copy").where("doc_id = 1").collect()
    assert abs(len(out) - 300_000) < 6 * 300_000**0.5 and sorted(r["copy"] for r in out) == list(range(1, len(out) + 1))


# 10


def test_sharding_names(spark, docs, clashing, tmp_path):
    with pytest.raises(ValueError):
        sharding.assign_shards(docs.withColumnRenamed("doc_id", "shard"), id_col="shard")
    carried = sharding.assign_shards(clashing, carry=tuple(clashing.columns))
    assert len(carried.columns) == len({*clashing.columns, *sharding.LEVELS}) and places(carried.drop(*sharding.LEVELS)) == places(docs)
    sharding.write_sharded(docs, f"{tmp_path}/sharded")
    back = spark.read.parquet(f"{tmp_path}/sharded")
    assert back.count() == len(ROWS) and {*docs.columns, *sharding.LEVELS} == set(back.columns)
    assert {r["doc_id"]: (r["region"], r["rack"], str(r["shard"])) for r in back.collect()} == places(docs)


def test_equal_draws_go_to_the_first_name(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(sharding, "_draw", lambda key, path, w: F.lit(1.0))
    assert set(places(spark.range(5).withColumnRenamed("id", "doc_id")).values()) == {("ap", "a", "0")}


def places(df, topology=sharding.TOPOLOGY):
    return {r["doc_id"]: (r["region"], r["rack"], r["shard"]) for r in sharding.assign_shards(df, topology).collect()}


def test_sharding_shares_and_movement(spark, docs, empty, clashing):
    ids = spark.range(30000).withColumnRenamed("id", "doc_id")
    before = places(ids)
    share = Counter(p[0] for p in before.values())
    whole = sharding.weight(sharding.TOPOLOGY)
    for region, racks in sharding.TOPOLOGY.items():
        assert abs(share[region] / 30000 - sharding.weight(racks) / whole) < 0.012
    # the subtree's own weight stays, so nothing leaves or enters the rack
    changed = {**sharding.TOPOLOGY, "eu": {**sharding.TOPOLOGY["eu"], "a": {"0": 2.0, "1": 1.0, "2": 1.0}}}
    after = places(ids, changed)
    moved = {k for k in before if before[k] != after[k]}
    assert moved and all(before[k][:2] == after[k][:2] == ("eu", "a") for k in moved)
    assert all(before[k][2] == "2" or after[k][2] == "0" for k in moved)
    # a weight that rises draws documents, and sends none away
    more = {**sharding.TOPOLOGY, "ap": {**sharding.TOPOLOGY["ap"], "b": {"0": 4.0, "1": 0.5, "2": 0.5}}}
    assert all(p[0] == "ap" for k, p in places(ids, more).items() if p[0] != before[k][0])
    assert len(sharding.assign_shards(docs).collect()) == len(ROWS) and sharding.assign_shards(empty).count() == 0
    assert places(docs) == places(clashing)
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, {"x": {"y": {"z": 0.0}}})
