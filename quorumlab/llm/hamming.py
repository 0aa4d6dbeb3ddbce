"""Exact top-k of binary codes by incremental multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quorumlab.llm.blocks import build_blocks, distinct_rows, expand, search_blocks

BITS = 64
BLOCK_ROWS = 1 << 18


def sign_codes(vectors: pa.Array) -> pa.Array:
    """64-bit codes of lists of numbers: bit b is 1 if the components b, b + 64, ... sum to more than 0.

    Null for a null or empty list and for one with null or non-finite components.
    """
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    row = np.repeat(np.arange(len(sizes)), sizes)
    bit = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % BITS
    finite = np.isfinite(flat)
    good = (sizes > 0) & (np.bincount(row, ~finite, minlength=len(sizes)) == 0)
    sums = np.bincount(row * BITS + bit, np.where(finite, flat, 0.0), minlength=len(sizes) * BITS).reshape(-1, BITS)
    codes = ((sums > 0).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)
    return pa.array(codes, mask=~good)


def sign_code(vector: Column) -> Column:
    """The sign code (long) of an array column."""

    @F.arrow_udf("long")
    def code(batch: pa.Array) -> pa.Array:
        return sign_codes(batch)

    return code(vector.cast("array<double>"))


@cache
def flips(width: int, radius: int) -> np.ndarray:
    """All masks of `width` bits of which exactly `radius` are set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


class MultiIndex:
    """Codes in buckets by each of their segments."""

    def __init__(self, codes: np.ndarray, buckets: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """buckets: what as_arrays gave of an index of the same codes, or else it is made."""
        n = max(2, len(codes))
        count = max(1, min(BITS, round(BITS / np.log2(n))))  # buckets hold about one code each
        edges = [BITS * i // count for i in range(count + 1)]
        self.codes, self.segments = codes, list(zip(edges, edges[1:], strict=False))
        if buckets:
            self.members = buckets[0].reshape(count, len(codes))
            self.starts = np.split(buckets[1], np.cumsum([(1 << (hi - lo)) + 1 for lo, hi in self.segments])[:-1])
        else:
            values = [self.values(codes, lo, hi) for lo, hi in self.segments]
            self.members = np.array([np.argsort(v, kind="stable") for v in values], np.int32).reshape(count, len(codes))
            self.starts = [np.concatenate(([0], np.cumsum(np.bincount(v, minlength=1 << (hi - lo))))).astype(np.int32) for v, (lo, hi) in zip(values, self.segments, strict=True)]
        self.met_by = np.zeros(len(codes), np.int64)  # the number of the last search that met a code
        self.searches = 0

    def as_arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.members, np.concatenate(self.starts)

    @staticmethod
    def values(codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((codes >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def nearest(self, code: np.uint64, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of all codes up to the distance at which k rows (weight: rows of each code) are found.

        Segments are searched one by one at radius 0, then 1, and so on. After segment j at radius
        r every code within segments * r + j bits has been met: one further away from the query in
        every segment searched would differ in more bits. The search ends once k rows lie within that.
        """
        self.searches += 1
        places, distances = [], []
        within = np.zeros(BITS + 2, np.int64)
        for radius in range(max(hi - lo for lo, hi in self.segments) + 1):
            for j, (lo, hi) in enumerate(self.segments):
                if radius <= hi - lo:
                    buckets = int(self.values(code, lo, hi)) ^ flips(hi - lo, radius)
                    first, last = self.starts[j][buckets].astype(np.int64), self.starts[j][buckets + 1].astype(np.int64)
                    sizes = last - first
                    full = sizes > 0
                    first, sizes = first[full], sizes[full]
                    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                    met = self.members[j][at]
                    met = met[self.met_by[met] != self.searches]
                    self.met_by[met] = self.searches
                    d = np.bitwise_count(self.codes[met] ^ code).astype(np.int64)
                    places.append(met)
                    distances.append(d)
                    np.add.at(within, d, weight[met])
                covered = len(self.segments) * radius + j
                if within[: covered + 1].sum() >= k:
                    break
            else:
                continue
            break
        place, distance = np.concatenate(places), np.concatenate(distances)
        near = distance <= covered
        return place[near], distance[near]


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k codes nearest to each query, exactly.

    codes(vec_id, code) are searched in blocks of distinct codes, so copies of one cost nothing;
    queries(query_id, code) come in bounded parts. A query's own row (query_id = vec_id) is left
    out, ties go to the smaller vec_id, and fewer than k codes are all returned. An id with several
    codes counts once, with the nearest; of a repeated query_id one code is asked for. Rows with a null
    id or code take no part. Empty tables give no rows; other columns are ignored.
    """
    names = ["codes", "ids", "starts", "members", "buckets"]

    def build(table: pa.Table) -> dict[str, bytes]:
        code, ids = (table.column(c).to_numpy() for c in ("code", "vec_id"))
        first, sorted_ids, starts = distinct_rows(code, ids)
        members, buckets = MultiIndex(code[first].view(np.uint64)).as_arrays()
        return dict(zip(names, (x.tobytes() for x in (code[first], sorted_ids, starts, members, buckets)), strict=True))

    def prepare(row: dict[str, bytes]) -> tuple[MultiIndex, np.ndarray, np.ndarray]:
        buckets = np.frombuffer(row["members"], np.int32), np.frombuffer(row["buckets"], np.int32)
        return MultiIndex(np.frombuffer(row["codes"], np.uint64), buckets), np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)

    def search(block: tuple[MultiIndex, np.ndarray, np.ndarray], asked: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        index, ids, starts = block
        sorted_codes, weight = index.codes.view(np.int64), np.minimum(np.diff(starts), k + 2)
        for own, wanted in zip(asked.column("query_id").to_numpy(), asked.column("code").to_numpy(), strict=True):
            # The query's own row isn't a found row; so look for one more where it lies under this code.
            at = int(np.searchsorted(sorted_codes, wanted))
            same = 0
            if at < len(sorted_codes) and sorted_codes[at] == wanted:
                mine = ids[starts[at] : starts[at + 1]]
                place = int(np.searchsorted(mine, own))
                same = int(place < len(mine) and mine[place] == own)
            place, distance = index.nearest(np.int64(wanted).view(np.uint64), weight, k + 1 + same)
            got, d = expand(place, distance, ids, starts, own, k)
            yield np.full(len(got), own), got, d.astype(np.int32)

    usable = codes.where("vec_id is not null and code is not null").select("vec_id", "code")
    index = build_blocks(usable.dropDuplicates(["vec_id", "code"]), block_rows, build, names)
    asked = queries.where("query_id is not null and code is not null").select("query_id", "code").groupBy("query_id").agg(F.min("code").alias("code"))
    return search_blocks(index, asked, names, prepare, search, k, "int").withColumnRenamed("score", "distance")
