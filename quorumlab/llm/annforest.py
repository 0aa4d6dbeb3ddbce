"""Approximate nearest neighbours by a forest of hash prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.blocks import build_blocks, distinct_rows, expand, search_blocks

#: Trees; each has hash strings of LENGTH bits.
TREES = 64
LENGTH = 24
#: Share of true neighbours that the sample must show as gathered, and how many of its vectors are asked for.
TARGET, ASKED = 0.96, 512
#: Distinct vectors to gather from a block at least.
LEAST = 256
BLOCK_ROWS = 32_768
#: Bound on the sample whose mean centres the hashes and on which the ascent is calibrated.
SAMPLE = 4096


class Hashes:
    """Bits of random directions, orthogonal within a tree where the dimension allows, around a centre."""

    def __init__(self, dimension: int, centre: np.ndarray, trees: int = TREES, length: int = LENGTH, seed: int = 17) -> None:
        draw, columns = np.random.default_rng(seed), []
        for _ in range(trees):
            made = []
            while sum(x.shape[1] for x in made) < length:
                made.append(np.linalg.qr(draw.normal(size=(dimension, dimension)))[0])
            columns.append(np.concatenate(made, axis=1)[:, :length])
        self.directions, self.centre = np.concatenate(columns, axis=1), centre
        self.trees, self.length = trees, length

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """trees x vectors: hash strings as numbers, the first bit the highest."""
        powers = (1 << np.arange(self.length - 1, -1, -1)).astype(np.int64)
        out = np.empty((self.trees, len(vectors)), np.int32)
        for at in range(0, len(vectors), 4096):
            bits = (vectors[at : at + 4096] - self.centre) @ self.directions > 0
            out[:, at : at + 4096] = (bits.reshape(-1, self.trees, self.length) @ powers).T
        return out


def usable_vectors(column: pa.ChunkedArray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors (float64) that may take part, and which rows they are.

    Left out: null, of another dimension, with null or non-finite components, zero.
    """
    array = column.combine_chunks()
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    good = np.array(array.is_valid()) & (array.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dimension)
    rows = np.flatnonzero(good)
    flat = array.take(pa.array(rows)).flatten().cast(pa.float64())
    v = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dimension)  # null components become NaN
    fine = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
    return v[fine], rows[fine]


def gather(order: np.ndarray, sorted_: np.ndarray, wanted: np.ndarray, length: int, least: int) -> np.ndarray:
    """Places of the candidates of one query: wanted has its hash string in each tree.

    Down: each tree's longest prefix that any of its strings shares with the query's. Up: from
    the longest of these, all trees give what matches one bit less, one tree after the other,
    until `least` distinct vectors are met or the roots are.
    """
    trees, n = sorted_.shape
    met = np.zeros(n, bool)
    taken_lo, taken_hi = np.zeros(trees, np.int64), np.zeros(trees, np.int64)
    at = np.array([np.searchsorted(sorted_[t], wanted[t]) for t in range(trees)])
    near = np.stack([sorted_[np.arange(trees), np.clip(at - 1, 0, n - 1)], sorted_[np.arange(trees), np.clip(at, 0, n - 1)]]) ^ wanted
    longest = length - np.frexp(near.astype(np.float64))[1].min(axis=0)  # bits of the common prefix
    found = 0
    for level in range(int(longest.max()), -1, -1):
        for t in range(trees):
            if longest[t] < level:
                continue
            low = (int(wanted[t]) >> (length - level)) << (length - level)
            lo = int(np.searchsorted(sorted_[t], low))
            hi = int(np.searchsorted(sorted_[t], low + (1 << (length - level))))
            if taken_hi[t] == taken_lo[t]:
                fresh = order[t, lo:hi]
            else:
                fresh = np.concatenate((order[t, lo : taken_lo[t]], order[t, taken_hi[t] : hi]))
            taken_lo[t], taken_hi[t] = lo, hi
            if len(fresh):
                found += int((~met[fresh]).sum())
                met[fresh] = True
                if found >= least:
                    return np.flatnonzero(met)
    return np.flatnonzero(met)


def needed_share(sample: np.ndarray, hashes: Hashes, k: int, rows: int, target: float, asked: int = ASKED) -> float:
    """The share of a forest's vectors to gather so that `target` of true neighbours are among them, measured on a sample.

    Of `rows` vectors in all the sample holds its part, so the k nearest of all are about the k * len(sample) / rows nearest
    of the sample, at least one. A vector is met at the longest prefix that it shares with the query in any tree, at one
    level by the number of the tree, as gather does.
    """
    n = len(sample)
    if n < 3:
        return 1.0
    near = min(n - 1, max(1, -(-k * n // max(rows, n))))
    strings = hashes.of(sample)
    ranks = []
    for i in range(0, n, max(1, n // asked)):
        d = ((sample - sample[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        apart = hashes.length - np.frexp((strings ^ strings[:, i : i + 1]).astype(np.float64))[1]
        tree = apart.argmax(axis=0)
        level = apart[tree, np.arange(n)]
        met = np.empty(n, np.int64)
        met[np.lexsort((tree, -level))] = np.arange(n)
        ranks.append(met[np.argpartition(d, near - 1)[:near]])
    return float(np.quantile(np.concatenate(ranks), target) + 1) / n


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = TREES, target: float = TARGET, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): near vectors of each query and their exact Euclidean distance.

    vectors(vec_id, embedding) and queries(query_id, embedding). Every usable vector is indexed, in
    blocks: for each tree the sorted array of its hash strings. How far the trees are climbed follows from a sample of
    about SAMPLE vectors, drawn by a hash of vec_id: so far that `target` of its true neighbours are met (needed_share), and
    LEAST vectors of a block at least. Candidates of each block are measured in double precision on the original
    vectors. The dimension is the most frequent one, and the sample's mean is the centre. Null, zero and
    non-finite vectors, those of other dimensions and null ids take no part; a query's own rows are left
    out; ties go to the smaller vec_id; equal vectors count as one candidate. An id in several rows counts once, with
    its nearest; of a repeated query_id one vector is asked for. Empty tables give no rows; other columns are ignored.
    """
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", "embedding")
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).where("d > 0").orderBy(F.desc("n"), "d").limit(1).collect()
    dimension, n = (sizes[0]["d"], sizes[0]["n"]) if sizes else (1, 0)
    draw = F.pmod(F.xxhash64("vec_id", F.lit("centre")), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    drawn = rows.where(draw).select("vec_id", "embedding").dropDuplicates(["vec_id"]).select("embedding").toArrow().column(0) if n else None  # about SAMPLE rows
    sample = np.unique(usable_vectors(drawn, dimension)[0], axis=0) if n else np.zeros((0, 1))
    hashes = Hashes(dimension, sample.mean(axis=0) if len(sample) else np.zeros(dimension), trees)
    share = needed_share(sample, hashes, k, n, target)
    names = ["vectors", "ids", "starts", "order", "strings"]

    def build(table: pa.Table) -> dict[str, bytes]:
        v, at = usable_vectors(table.column("embedding"), dimension)
        ids = table.column("vec_id").to_numpy()[at]
        whole = np.ascontiguousarray(v).view(f"V{8 * dimension}").reshape(-1)
        kind = np.unique(whole, return_inverse=True)[1].reshape(-1) if len(v) else np.zeros(0, np.int64)
        once = np.unique(np.stack([kind, ids], axis=1), axis=0, return_index=True)[1]  # repeated rows
        kind, ids, v = kind[once], ids[once], v[once]
        first, sorted_ids, starts = distinct_rows(kind, ids)
        v = v[first]
        strings = hashes.of(v)
        order = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        made = v, sorted_ids, starts, order, np.take_along_axis(strings, order.astype(np.int64), axis=1)
        return dict(zip(names, (x.tobytes() for x in made), strict=True))

    def prepare(row: dict[str, bytes]) -> tuple[np.ndarray, ...]:
        kinds = np.float64, np.int64, np.int64, np.int32, np.int32
        v, ids, starts, order, strings = (np.frombuffer(row[x], kind) for x, kind in zip(names, kinds, strict=True))
        return v.reshape(-1, dimension), ids, starts, order.reshape(trees, -1), strings.reshape(trees, -1)

    def search(block: tuple[np.ndarray, ...], mine: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        v, ids, starts, order, strings = block
        asked, at = usable_vectors(mine.column("embedding"), dimension)
        if not len(v) or not len(asked):
            return
        wanted, named = hashes.of(asked), mine.column("query_id").to_numpy()[at]
        for i, own in enumerate(named):
            place = gather(order, strings, wanted[:, i], hashes.length, max(LEAST, int(np.ceil(share * len(v)))))
            apart = v[place] - asked[i]
            score = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            if len(place) > 2 * k + 2:
                best = score <= np.partition(score, k + 1)[k + 1]  # k and the query's own
                place, score = place[best], score[best]
            got, d = expand(place, score, ids, starts, own, k)
            yield np.full(len(got), own), got, d

    index = build_blocks(rows, block_rows, build, names)
    asked = queries.where("query_id is not null and embedding is not null").select("query_id", "embedding").dropDuplicates(["query_id"])
    return search_blocks(index, asked, names, prepare, search, k, "double")
