"""Product codes against plain rounds in Python integers."""

import hashlib

import numpy as np
import pytest

from quorumlab.llm import queries, vectorcodes
from quorumlab.llm.vectorcodes import compress_vectors, nearest, with_label_error


def plain(vectors, parts, entries, rounds):
    """Codes, errors and codebooks by whole sums in each round."""
    v = [[int(np.floor(1024 * float(x))) for x in row] for row in vectors]
    w = len(v[0]) // parts
    cut = [[row[p * w : (p + 1) * w] for p in range(parts)] for row in v]
    books = [[list(row[p]) for row in cut[:entries]] for p in range(parts)]

    def assigned():
        out = []
        for row in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(row[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for i in range(len(books[p])):
                mine = [row[p] for row, a in zip(cut, now) if a[p][1] == i]
                if mine:
                    books[p][i] = [sum(c) // len(mine) for c in zip(*mine)]
    now = assigned()
    return [[x[1] for x in a] for a in now], [sum(x[0] for x in a) for a in now], books


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 4), (2, 500, 2), (1, 3, 6)])
def test_equals_plain_rounds(spark, parts, entries, rounds):
    v = np.random.default_rng(parts).normal(size=(300, 8)).round(2)
    rows = spark.createDataFrame([(i, x.tolist(), "l") for i, x in enumerate(v)], "vec_id long, embedding array<double>, l string").repartition(5)
    coded, books = compress_vectors(rows, label="l", parts=parts, entries=entries, rounds=rounds)
    codes, errors, want = plain(v, parts, entries, rounds)
    assert {r.id: (r.code, r.error) for r in coded.collect()} == {i: (c, e) for i, (c, e) in enumerate(zip(codes, errors))}
    assert books.entries.tolist() == want


def test_query_equals_plain_rounds(spark, sf_dir):
    rows = sorted(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    codes, errors, books = plain([r.embedding for r in rows], 4, 256, 4)
    by_label = {}
    for r, e in zip(rows, errors):
        by_label[r.label] = by_label.get(r.label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    want = [(r.vec_id, "".join(f"{c:02x}" for c in code), e, by_label[r.label], digest) for r, code, e in zip(rows, codes, errors)]
    assert sorted(map(tuple, queries.op13_vector_codes(spark, sf_dir).collect())) == want


def test_only_changes_are_sent(spark):
    v = np.random.default_rng(2).normal(size=(50, 4))
    rows = spark.createDataFrame([(i, x.tolist(), c, b) for i, (x, c, b) in enumerate(zip(v, [[1, 1]] * 50, [[1, 1]] * 49 + [[0, 1]]))], "id long, v array<double>, code array<int>, before array<int>")
    whole = rows.selectExpr("v", "code", "before").withColumn("v", vectorcodes.F.transform("v", lambda x: vectorcodes.F.floor(x * 1024)))
    sent = {(r.part, r.entry, r.place): r.change for r in vectorcodes._changes(whole, (2, 3, 2)).collect()}
    last = np.floor(v[-1] * 1024).astype(int).tolist()
    assert sent == {(0, 1, 0): 1, (0, 1, 1): last[0], (0, 1, 2): last[1], (0, 0, 0): -1, (0, 0, 1): -last[0], (0, 0, 2): -last[1]}


def test_large_integers_stay_exact():
    v, book = np.array([[1 << 40, 3], [5, 5]], np.int64), np.array([[(1 << 40) + 1, 3], [1 << 40, 2], [5, 5]], np.int64)
    at, error = nearest(v, book)
    assert at.tolist() == [0, 2] and error.tolist() == [1, 0]


def test_odd_vectors(spark):
    kind = "vec_id long, embedding array<double>, label int, code string, error long"
    good = [(2, [1.0, 2.0], None), (2, [1.0, 2.0], None), (1, [3.0, -1.0], 5), (None, [0.0, 0.1], 5)]
    bad = [(0, None, 5), (0, [None, 1.0], 5), (0, [float("nan"), 1.0], None), (0, [1.0, float("-inf")], 5), (0, [], 5)]
    rows = spark.createDataFrame([(*r, "z", 7) for r in good + bad], kind)
    coded, books = compress_vectors(rows, label="label", parts=2, entries=2, rounds=1)
    # Entries start as the parts of ids 1 and 2.
    assert books.entries.tolist() == [[[3072], [682]], [[-461], [2048]]]
    found = with_label_error(coded).collect()
    assert sorted(((r.id or 0), r.code) for r in found) == [(0, [1, 0]), (1, [0, 0]), (2, [1, 1]), (2, [1, 1])]
    sums = {}
    for r in found:
        sums[r.label] = sums.get(r.label, 0) + r.error
    assert all(r.label_error == sums[r.label] for r in found)
    for none in (rows.where("vec_id = 0"), rows.limit(0)):
        coded, books = compress_vectors(none, label="label", parts=2)
        assert with_label_error(coded).count() == 0 and books is None
    with pytest.raises(Exception, match="equal parts"):
        compress_vectors(rows, parts=3)
