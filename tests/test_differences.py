"""Order statistics of pairwise differences against all pairs."""

import itertools
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlab.operators import differences
from quorumlab.operators.differences import difference_quantiles

SHARES = {"least": 0.0, "median": 0.5, "p90": 0.9, "most": 1.0}


def expected(rows):
    groups = {}
    for g, s, m, v in rows:
        if None not in (g, s, m, v) and np.isfinite(v):
            groups.setdefault(g, []).append((s, m, v))
    out = {}
    for c, x in groups.items():
        d = [abs(a[2] - b[2]) for a, b in itertools.combinations(x, 2) if a[0] == b[0] and a[1] != b[1]]
        if d:
            out[c] = (len(d), *(float(np.quantile(d, s)) for s in SHARES.values()))
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "g string, s int, m string, v double").repartition(3)
    got = {r["g"]: (r["n"], *(r[k] for k in SHARES)) for r in difference_quantiles(df, "g", ["s"], "m", "v", SHARES).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c in want:
        assert got[c][0] == want[c][0] and got[c][1:] == pytest.approx(want[c][1:], abs=1e-9)


def table(seed, n, cells=3):
    rng = random.Random(seed)
    draw = lambda: rng.choice([rng.random() * 100, float(rng.randrange(5)), 1e6 * rng.random()])
    return [(f"c{rng.randrange(cells)}", rng.randrange(3), f"m{rng.randrange(4)}", draw()) for _ in range(n)]


ODD = [("x", 1, "a", 1.0), ("x", 1, "a", 2.0), ("x", 2, "b", 2.0), ("y", 1, "a", 3.0), ("z", 1, "a", 1.0), ("z", 1, "b", 1.0), ("z", 1, "b", 1.0)]
ODD += [(None, 1, "a", 1.0), ("z", None, "a", 1.0), ("z", 1, None, 1.0), ("z", 1, "c", None), ("z", 1, "c", float("nan")), ("z", 1, "c", float("inf"))]


def test_few_and_odd_rows(spark):
    check(spark, table(1, 150) + ODD)
    assert difference_quantiles(spark.createDataFrame([], "g string, s int, m string, v double"), "g", ["s"], "m", "v", SHARES).count() == 0


def test_by_bisection(spark, monkeypatch):
    monkeypatch.setattr(differences, "FEW", 4)
    check(spark, table(2, 300) + ODD)


def test_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(differences, "FEW", 4)
    monkeypatch.setattr(differences, "BLOCK", 25)
    check(spark, table(3, 200, cells=2) + ODD)


def test_counts_of_one_block():
    rng = np.random.default_rng(5)
    v, m = rng.integers(0, 30, 80) / 4, rng.integers(0, 3, 80).astype(str)
    entries = sorted(set(zip(v, m)))
    block = differences.Block(np.array([e[0] for e in entries]), np.array(["c"] * len(entries)), np.array([e[1] for e in entries]), np.array([sum((a, b) == e for a, b in zip(v, m)) for e in entries]))
    for most in (0.0, 0.25, 1.6, 100.0):
        want = sum(m[i] != m[j] and abs(v[i] - v[j]) <= most for i, j in itertools.combinations(range(80), 2))
        assert differences.pairs_within(block, None, most) == want


def test_a_cell_of_100_000_rows(spark):
    df = spark.range(100_000).select(F.lit("c").alias("cell"), F.concat(F.lit("m"), (F.col("id") % 7).cast("string")).alias("m"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e6).alias("v"))
    began = time.time()
    row = difference_quantiles(df, "cell", [], "m", "v", SHARES).first()
    assert time.time() - began < 120
    rows = df.collect()
    v, m = np.array([r["v"] for r in rows]), np.array([r["m"] for r in rows])
    order = np.argsort(v)
    v, m = v[order], m[order]
    sizes = np.unique(m, return_counts=True)[1]
    assert row["n"] == (100_000**2 - int((sizes**2).sum())) // 2 and row["most"] == pytest.approx(max(v[-1] - v[m != m[-1]][0], v[m != m[0]][-1] - v[0]))
    within = 0  # how many pairs of all lie below the median found, of other members
    for x in np.unique(m):
        own, other = v[m == x], v[m != x]
        within += int((np.searchsorted(other, own + row["median"], side="right") - np.searchsorted(other, own, side="left")).sum())
    assert within == pytest.approx(row["n"] / 2, rel=1e-4)


def test_cells_of_a_large_group_lie_apart(spark, monkeypatch):
    monkeypatch.setattr(differences, "BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = [("g", f"c{i}", f"m{rng.integers(5)}", float(v)) for i in range(12) for v in rng.integers(0, 10_000, 30)] + [("g", "hot", f"m{rng.integers(5)}", float(v)) for v in rng.integers(0, 10_000, 150)]
    df = spark.createDataFrame(rows, "g string, s string, m string, v double")
    held = {}
    for r in differences._blocks(df, "g", ["s"], "m", "v").collect():
        for cell in set(r["cells"]):
            held.setdefault(cell, []).append((r["home"], r["block"], len(r["values"])))
    assert len(held) == 13 and sum(len(x) > 1 for x in held.values()) == 1  # the hot cell alone is in several rows
    assert len({home for x in held.values() for home, _, _ in x}) > 2
    d = sorted(abs(a[3] - b[3]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and a[2] != b[2])
    got = differences.difference_quantiles(df, "g", ["s"], "m", "v", {"median": 0.5, "p90": 0.9, "most": 1.0}).collect()
    assert len(got) == 1 and got[0]["n"] == len(d) and np.allclose([got[0]["median"], got[0]["p90"], got[0]["most"]], np.quantile(d, [0.5, 0.9, 1.0]))
