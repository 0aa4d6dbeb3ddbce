import random
import time

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from quorumlab.llm import annforest, hamming, nearcopies, simhash


def fingerprint(text, words):
    listed = (text or "").encode().lower().split()
    if not listed:
        return 0
    grams = [b" ".join(listed[i : i + words]) for i in range(max(1, len(listed) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("abÄ \t\n", max_size=40)), min_size=1, max_size=8))
def test_fingerprints_equal_their_definition(texts):
    got = simhash.fingerprints([None if t is None else t.encode() for t in texts], 3).view(np.uint64).tolist()
    assert got == [fingerprint(t, 3) for t in texts]


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(str(i * 7919 % 1000) for i in range(3000)).encode()
    whole = simhash.fingerprints([text, b"a b c"], 3)
    monkeypatch.setattr(simhash, "HASHES_AT_ONCE", 300)
    assert (simhash.fingerprints([text, b"a b c"], 3) == whole).all() and whole.view(np.uint64)[0] == fingerprint(text.decode(), 3)


def test_masks_cover_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks(3, 5, 2)]
    rng = random.Random(5)
    for _ in range(2000):
        flipped = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(flipped & m == 0 for m in masks)
    with pytest.raises(ValueError):
        simhash.block_masks(4, 5, 2)


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = {}
    for i in range(400):  # chains and dense clusters, long runs included
        v = base[i % 6]
        for b in rng.sample(range(64), rng.randrange(4)):
            v ^= 1 << b
        prints[v] = min(i, prints.get(v, i))
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in prints], "fp long")
    links = simhash.fingerprint_links(nodes, 3).collect()
    mask = (1 << 64) - 1
    assert all(((r.a & mask) ^ (r.b & mask)).bit_count() <= 3 for r in links)
    by_value = {v: v for v in prints}
    want = components(by_value, 3)
    parent = {v: v for v in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = find(r.a & mask), find(r.b & mask)
        parent[max(a, b)] = min(a, b)
    assert {v: find(v) for v in prints} == want


def test_many_values_without_links_in_one_bucket(spark):
    """100,000 values that agree in 40 bits and lie 4 bits apart or more but for planted pairs."""
    rng = np.random.default_rng(6)
    codes = rng.permutation(1 << 18)[:100_000].astype(np.uint64)
    spread = np.zeros(len(codes), np.uint64)  # each of 18 data bits at its own place, and parity of halves
    for b in range(18):
        spread |= ((codes >> np.uint64(b)) & np.uint64(1)) << np.uint64(b)
    for j in range(6):  # checksums keep most values apart
        parity = np.bitwise_count(spread & np.uint64(0x3FFFF & (0x2D2D5 * (j + 3)))).astype(np.uint64) & np.uint64(1)
        spread |= parity << np.uint64(18 + j)
    run = np.zeros(len(spread), np.int64)
    began = time.time()
    src, dst = simhash._links(run, spread, 1)
    assert time.time() - began < 20
    got = set(zip(np.concatenate(src).tolist(), np.concatenate(dst).tolist(), strict=True))
    have = set(spread.tolist())
    linked = {v for v in have if any(v ^ 1 << b in have for b in range(24))}
    assert {x for pair in got for x in pair} == linked


def test_groups_equal_brute_force(spark, sf_dir, odd_docs, no_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        texts = {r.doc_id: r.text for r in docs.collect()}
        prints = {i: fingerprint(t, 3) for i, t in texts.items()}
        want = components(prints, 3)
        got = simhash.simhash_groups(docs).collect()
        assert len(got) == docs.count()
        assert all(r.fingerprint & (1 << 64) - 1 == prints[r.doc_id] and r.component_id == want[r.doc_id] for r in got)
    assert simhash.simhash_groups(no_docs).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs):
    kept = nearcopies.drop_jaccard_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted(r.doc_id for r in kept.collect())
    assert 1 in ids and 2 not in ids and 7 in ids and sum(i in ids for i in (3, 4, 5)) == 1


# --- Hamming top-k --------------------------------------------------------------------------


def brute_top_k(codes, queries, k):
    out = {}
    for q, code in queries:
        near = sorted({((c ^ code).bit_count(), i) for i, c in codes if i != q})
        out[q] = [(i, d) for d, i in near[:k]]
    return out


def signed(v):
    return v - (1 << 64) if v >> 63 else v


@pytest.mark.parametrize("n", [0, 1, 5, 400])
def test_hamming_top_k_is_exact(spark, n):
    rng = random.Random(n)
    hot = rng.getrandbits(64)
    codes = [(i, hot if i % 3 == 0 else rng.getrandbits(64) if i % 2 else hot ^ 1 << rng.randrange(64)) for i in range(n)]
    queries = [(i, c) for i, c in codes if i % 20 == 0]
    table = spark.createDataFrame([(i, signed(c)) for i, c in codes] + [(None, 5), (10_000, None)] * (n > 0), "vec_id long, code long")
    asked = spark.createDataFrame([(i, signed(c)) for i, c in queries], "query_id long, code long")
    got = {}
    for r in hamming.hamming_top_k(table, asked, 10, block_rows=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
    want = {q: x for q, x in brute_top_k(codes, queries, 10).items() if x}
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 2**64 - 1), st.integers(1, 12))
def test_multi_index_finds_all_within_the_kth_distance(codes, code, k):
    index = hamming.MultiIndex(np.array(codes, np.uint64))
    place, distance = index.nearest(np.uint64(code), np.ones(len(codes), np.int64), k)
    truth = sorted((c ^ code).bit_count() for c in codes)
    assert sorted(distance.tolist())[:k] == truth[:k]
    assert all((codes[i] ^ code).bit_count() == d for i, d in zip(place.tolist(), distance.tolist(), strict=True))


def test_sign_codes(spark):
    rows = [([1.0, -1.0, 0.5],), ([],), (None,), ([float("nan"), 1.0],), ([1.0, None],), ([0.0] * 64 + [2.0, -1.0],)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r[0] for r in df.select(hamming.sign_code(df["v"])).collect()] == [5, None, None, None, None, 1]


# --- Approximate neighbours ------------------------------------------------------------------


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(10, 16))
    v = (centres[rng.integers(0, 10, 3000)] + 0.5 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[100:400] = v[100]  # a third of some neighbourhoods are copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(3001, None), (3002, [0.0] * 16), (3003, [float("nan")] * 16), (3004, [1.0]), (None, [1.0] * 16), (3005, [None] + [1.0] * 15)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in annforest.nearest(table, asked, 10, block_rows=1000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hits, w = 0, v.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((w - w[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(want.tolist()) & {i for i, _ in found})
        assert len(found) == 10 and all(s == pytest.approx(d[i], abs=1e-12) for i, s in found) and found == sorted(found, key=lambda x: (x[1], x[0]))
    assert hits / (10 * len(got)) >= 0.9
    few = annforest.nearest(table.where("vec_id < 4"), asked.where("query_id = 0"), 10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert annforest.nearest(table.where("vec_id < 0"), asked, 10).count() == 0


def test_forest_recall_without_structure_over_blocks(spark):
    """Random directions, where hashes tell least; several blocks, each climbed in part."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sample = v[rng.permutation(6000)[:2000]]
    hashes = annforest.Hashes(32, sample.mean(axis=0))
    share = annforest.needed_share(sample, hashes, 10, 6000, 0.96)
    assert 0.02 < share < 0.9 and share < annforest.needed_share(sample, hashes, 10, 2000, 0.96) + 0.05
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 100 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in annforest.nearest(table, asked, 10, block_rows=2000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((v - v[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_repeated_rows_over_blocks_count_once(spark):
    """Copies of a row, and an id with two vectors or codes, fall into different blocks."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(40, 8))
    rows = [(i, x.tolist(), "q", 1.0) for i, x in enumerate(v)] * 2 + [(5, v[0].tolist(), "q", 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, score double")
    asked = spark.createDataFrame([(0, v[0].tolist())] * 2, "query_id long, embedding array<double>")
    got = annforest.nearest(table, asked, 10, block_rows=8).orderBy("rank").collect()
    d = np.sqrt(((v - v[0]) ** 2).sum(axis=1))
    d[5] = 0.0
    assert [r.vec_id for r in got] == [int(i) for i in np.lexsort((np.arange(40), d)) if i != 0][:10] and got[0].score == 0.0
    codes = [(i, 1 << i % 50) for i in range(60)] * 2 + [(59, 3)]
    table = spark.createDataFrame(codes, "vec_id long, code long")
    asked = spark.createDataFrame([(0, 1), (0, 1)], "query_id long, code long")
    got = [(r.vec_id, r.distance) for r in hamming.hamming_top_k(table, asked, 10, block_rows=16).orderBy("rank").collect()]
    assert got == [(50, 0), (59, 1)] + [(i, 2) for i in range(1, 9)]


def test_searches_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert annforest.nearest(none, asked).count() == 0 and annforest.nearest(asked.selectExpr("query_id as vec_id", "embedding"), asked.where("query_id < 0")).count() == 0
    codes = spark.createDataFrame([], "vec_id long, code long")
    assert hamming.hamming_top_k(codes, codes.withColumnRenamed("vec_id", "query_id")).count() == 0


def test_parts_meet_many_blocks_under_many_keys(spark):
    """More blocks than cores: one slice, and still no key that all blocks share."""
    from pyspark.sql import functions as F

    from quorumlab.llm import blocks

    index = spark.range(64).select(F.shiftleft("id", 33).alias("block"), F.array(F.lit(b"x")).alias("data"))
    parts = spark.range(5).select(F.lit(0).alias("slice"), F.array(F.col("id").cast("string").cast("binary")).alias("data"))
    asked = blocks._asked(index, parts, 64, 1)
    assert asked.count() == asked.distinct().count() == 320 and asked.select("block").distinct().count() == 64
    keys = index.groupBy(F.pmod(F.xxhash64("block"), F.lit(64)).alias("key")).count().collect()
    assert len(keys) >= 32 and max(r["count"] for r in keys) <= 6
