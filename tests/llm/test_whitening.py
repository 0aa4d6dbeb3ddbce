"""Whitening against numpy's eigenvectors, and what takes no part."""

import math

import numpy as np
import pytest

from quorumlab.llm import queries, whitening
from quorumlab.llm.whitening import one_sided_jacobi


def expected(vectors):
    x = np.unique(np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000, axis=0)
    n, sums = len(x), x.sum(0)
    c = (n * x - sums) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, sums, e[::-1], v[:, ::-1]


def test_query_equals_eigenvectors(spark, sf_dir):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    n, sums, e, v = expected(list(rows.values()))
    signs, found = {}, queries.op12_whitening(spark, sf_dir).collect()
    assert sorted((r.vec_id, r.component) for r in found) == sorted((i, c) for i in rows for c in range(1, 17))
    for r in found:
        x = np.floor(64 * rows[r.vec_id]).astype(np.int64) + 1_000_000
        want = float((x - sums / n) @ v[:, r.component - 1] / math.sqrt(e[r.component - 1]))
        sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert r.whitened == pytest.approx(sign * want, abs=1e-7)
        assert (r.n, r.deviation) == (n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)))
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-9) and r.identity_error < 1e-9


@pytest.mark.parametrize("shape", [(1, 1), (5, 3), (8, 8), (40, 7), (3, 6)])
def test_jacobi_equals_svd(shape):
    a = np.random.default_rng(shape[0]).normal(size=shape) * 10.0 ** -np.arange(shape[1])
    s, v = one_sided_jacobi(a)
    want = np.linalg.svd(a, compute_uv=False)
    assert s[: len(want)] == pytest.approx(want, rel=1e-8) and (s[len(want) :] < 1e-12).all()
    assert v.T @ v == pytest.approx(np.eye(shape[1]), abs=1e-13)
    assert np.linalg.norm(a @ v, axis=0) == pytest.approx(s, abs=1e-12)


def test_jacobi_keeps_small_values_of_graded_columns():
    a = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))[0] * 10.0 ** -np.arange(0, 18, 3)
    assert one_sided_jacobi(a)[0] == pytest.approx(10.0 ** -np.arange(0, 18, 3), rel=1e-10)


def test_tree_of_triangles(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    v = np.random.default_rng(4).normal(size=(300, 5)) @ np.diag([5, 4, 3, 2, 1])
    n, sums, e, _ = expected(v)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(9)
    model = whitening.fit_whitening(rows)
    assert model.n == n and model.sums.tolist() == sums.tolist() and model.deviations**2 == pytest.approx(e, rel=1e-12)


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, component int, n long, x string"
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -1.0]), (2, [0.0, 0.0])]
    bad = [(3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [])]
    rows = spark.createDataFrame([(*r, 9, 9, "y") for r in good + bad], kind)
    found = whitening.whiten(rows, whitening.fit_whitening(rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in found) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]
    assert {r.n for r in found} == {3} and max(r.identity_error for r in found) < 1e-12
    one = rows.where("vec_id = 1")
    assert whitening.whiten(one, whitening.fit_whitening(one)).count() == 0  # one distinct vector has no variance
    for none in (rows.where("vec_id > 2"), rows.limit(0)):
        assert whitening.fit_whitening(none) is None and whitening.whiten(none, None).count() == 0
    with pytest.raises(Exception, match="several lengths"):
        whitening.fit_whitening(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>").coalesce(1))


def test_deviations_beyond_a_long():
    whole = np.array([[1 << 40, 0], [3, 4]], np.int64)
    assert whitening._exact_norms(whole).to_pylist() == [None, 25]
