"""Components, spanning forests, components at thresholds, grouped quantiles and the overlap join, each against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlab.operators import agreement, graph, ordered


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def found(spark, edges, kind="long", parts=None):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}")
    rows = graph.connected_components(df.repartition(parts) if parts else df).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_a_task_of_more_edges_than_it_contracts_at_once(spark, monkeypatch):
    """All pairs of 8 nodes in one partition, 22 edges at once: one component, not two."""
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 22)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = list(itertools.combinations(range(8), 2))
        assert found(spark, edges) == dict.fromkeys(range(8), 0)
        monkeypatch.setattr(graph, "EDGES_AT_ONCE", 4)
        chain = [(i, i + 1) for i in range(40)] + [(100 + i, 101 + i) for i in range(9)]
        random.Random(1).shuffle(chain)
        assert found(spark, chain) == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(10)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_many_edges_in_one_partition(spark):
    """1.2 million edges in one task: a path over all even nodes, and one over all odd ones."""
    n = 1_200_000
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 2).alias("b"))
        sizes = graph.connected_components(edges).groupBy("component").count().collect()
        assert sorted(map(tuple, sizes)) == [(0, n // 2 + 1), (1, n // 2 + 1)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hub", [0, 999])
def test_hubs_over_rounds(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 16)
    edges = [(hub, i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(30)]
    want = components({x for e in edges for x in e}, edges)
    assert found(spark, edges, parts=6) == want
    names = [(f"n{a:05}", f"n{b:05}") for a, b in edges]
    assert found(spark, names, "string", 6) == {f"n{k:05}": f"n{v:05}" for k, v in want.items()}


def kruskal(edges):
    parent, out = {}, []

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for w, a, b in sorted((w, min(a, b), max(a, b)) for a, b, w in edges):
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            out.append((a, b, w))
    return sorted(out)


@pytest.mark.parametrize("at_once", [1 << 20, 12])
def test_forest_and_thresholds(spark, monkeypatch, at_once):
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", at_once)
    rng = random.Random(at_once)
    edges = [(a, b, rng.choice([0.0, 0.1, 0.2, 0.25, 0.5, 0.9])) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.2]
    edges += [(40, 41, 0.2), (41, 40, 0.1), (5, 5, 0.0)]  # parallel, the other way round, a loop
    dirty = [*edges, (1, None, 0.1), (1, 2, None), (1, 2, float("nan"))]
    df = spark.createDataFrame(dirty, "a long, b long, w double").repartition(5)
    forest = graph.minimum_spanning_forest(df)
    assert sorted(map(tuple, forest.collect())) == kruskal([e for e in edges if e[0] != e[1]])
    nodes = spark.createDataFrame([(i,) for i in [*range(30), 40, 41, 50, 50, None]], "n long")
    cuts = [0.0, 0.1, 0.15, 0.25, 0.5, 2.0]
    at = {r["n"]: r["components"] for r in graph.components_at(forest, nodes, cuts, "n").collect()}
    for k, cut in enumerate(cuts):
        want = components([*range(30), 40, 41, 50], [(a, b) for a, b, w in edges if w < cut])
        assert {n: c[k] for n, c in at.items()} == want
    none = graph.minimum_spanning_forest(df.limit(0))
    assert none.count() == 0 and all(r["components"] == [r["n"]] * 2 for r in graph.components_at(none, nodes, [0.1, 0.2], "n").collect())


def test_forest_rows_equal_kruskal():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for n, m in ((2, 1), (5, 12), (60, 400)):
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        a, b = a[a != b], b[a != b]
        if not len(a):
            continue
        pairs = sorted({(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())})
        w = rng.integers(0, 5, len(pairs)) / 4
        rows = graph.forest_rows(pa.array([p[0] for p in pairs]), pa.array([p[1] for p in pairs]), w)
        assert sorted((*pairs[i], w[i]) for i in rows) == kruskal([(*p, x) for p, x in zip(pairs, w)])


def test_grouped_quantiles(spark):
    rng = random.Random(3)
    rows = [("hot", float(rng.choice([1, 1, 2, 5]) if rng.random() < 0.5 else rng.random())) for _ in range(3000)] + [("b", 1.0), ("b", 4.0), ("c", -2.5), (None, 3.0), (None, 1.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = {"least": 0.0, "q": 0.25, "median": 0.5, "p99": 0.99, "most": 1.0}
    got = {r["g"]: r for r in ordered.grouped_quantiles(df, ["g"], "v", shares).collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).append(v)
    assert set(got) == {"hot", "b", "c", None}
    for g, r in got.items():
        assert [r[n] for n in shares] == pytest.approx([float(np.quantile(by[g], s)) for s in shares.values()], rel=1e-12)
    joined = ordered.with_quantiles(df.groupBy("g").agg(F.count("v").alias("n")), df, ["g"], F.col("v") * 2, {"median": 0.5})
    assert {r["g"]: r["median"] for r in joined.collect()} == {g: None if g == "d" else pytest.approx(2 * float(np.median(by[g]))) for g in by}
    assert ordered.grouped_quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_a_large_group_lies_in_several_ranges(spark):
    df = spark.range(40_000).select(F.lit("g").alias("g"), F.xxhash64("id").cast("double").alias("v")).repartition(4)
    row = ordered.grouped_quantiles(df, ["g"], "v", {"m": 0.5, "p": 0.9}).first()
    v = [r["v"] for r in df.collect()]
    assert (row["m"], row["p"]) == pytest.approx((float(np.quantile(v, 0.5)), float(np.quantile(v, 0.9))))


def random_fits(spark, n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lo = 280 + rng.random() * 30
        rows.append(("s", "w", f"g{i:05}", rng.random(), rng.random() * 300, None if i % 3 else rng.random(), lo, lo + rng.random() * 25, rng.random()))
    return spark.createDataFrame(rows, "solute string, solvent string, src string, a double, b double, c double, t_min double, t_max double, r2 double"), rows


def test_overlap_join_in_blocks(spark, monkeypatch):
    fits, rows = random_fits(spark, 120)
    fits = fits.unionAll(fits.limit(3).withColumn("solvent", F.lit("x")))
    monkeypatch.setattr(agreement, "BLOCK", 10)
    got = [(r["gi"], r["gj"]) for r in agreement.fit_pairs(fits).where("solvent = 'w'").collect()]
    want = {(x[2], y[2]) for x, y in itertools.combinations(sorted(rows, key=lambda r: r[2]), 2) if min(x[7], y[7]) - max(x[6], y[6]) >= 5}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_hot_pair_is_spread_over_tasks(spark):
    fits, _ = random_fits(spark, 3000)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("16", "false", "-1")):
        spark.conf.set(k, v)
    try:
        counts = [r["n"] for r in agreement.fit_pairs(fits).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(counts) >= 8 and max(counts) < 0.35 * sum(counts)


def test_leave_one_out_equals_its_definition(spark):
    fits, rows = random_fits(spark, 6, seed=5)
    rows = [(*r[:6], 290.0, 301.5, r[8]) for r in rows]
    fits = spark.createDataFrame(rows, fits.schema)
    want = []
    for i, r in enumerate(rows):
        for t in np.arange(290.0, 301.5, 1.0):
            v = [x[3] + x[4] / t + (x[5] or 0) * np.log(t) for x in rows]
            want.append((r[2], abs(v[i] - (sum(v) - v[i]) / (len(v) - 1))))
    got = sorted((r["src"], r["dev"]) for r in agreement.leave_one_out(fits).collect())
    assert [g for g, _ in got] == [g for g, _ in sorted(want)] and [d for _, d in got] == pytest.approx([d for _, d in sorted(want)], abs=1e-9)
