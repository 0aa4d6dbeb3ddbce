"""Shards of near-equal bytes by sampled splitters and range partitioning."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quorumlab.session import cut

#: Keys drawn for each range, on average; more make ranges of more equal weight.
DRAWS_PER_RANGE = 48
#: Rows for each range, which is what one task sorts, and the bounds on the number of ranges; the larger bounds the sample.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 200_000, 64, 16_384
#: A range heavier than this many times the mean is drawn from again and subdivided.
OVERFULL = 2.0
#: Equal texts of more than a shard's bytes over this are placed one group at a time; the rest by ranges. Bounds the error at a
#: boundary, and the groups that reach the driver: shards times this.
UNITS_PER_SHARD = 256
ROUNDS = 6


class Splitters:
    """Sorted range boundaries over keys of two longs."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.unique(keys.reshape(-1, 2), axis=0)
        self.packed = self._pack(self.keys[:, 0], self.keys[:, 1])

    @staticmethod
    def _pack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Keys as bytes that sort like the pairs of longs."""
        flip = np.uint64(1 << 63)
        both = np.stack([a.astype(np.int64).view(np.uint64) ^ flip, b.astype(np.int64).view(np.uint64) ^ flip], axis=1)
        return np.ascontiguousarray(both.astype(">u8")).view("S16").reshape(-1)

    def range_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many boundaries lie at or before each key. Bytes that end in zeros compare as if cut there, which keeps their order."""
        return np.searchsorted(self.packed, self._pack(a, b), side="right")

    def column(self, a: str, b: str):
        @F.arrow_udf("int")
        def find(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array(self.range_of(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)).astype(np.int32))

        return find(a, b)


def _draw(rows: DataFrame, expected: float, total: int, seed: int) -> np.ndarray:
    """Keys drawn with a chance in proportion to their size, each as often as its size asks for; about `expected` rows reach the driver."""
    step = max(1.0, total / max(expected, 1))
    chance = F.pmod(F.xxhash64("__a", "__b", "doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    times = F.floor(F.col("size") / step + chance).cast("long")
    got = rows.select("__a", "__b", times.alias("n")).where("n > 0").groupBy("__a", "__b").agg(F.sum("n").alias("n")).toArrow()
    keys = np.stack([got.column(c).to_numpy() for c in ("__a", "__b")], axis=1) if len(got) else np.zeros((0, 2), np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    return np.repeat(keys[order], got.column("n").to_numpy()[order], axis=0)


def _split(keyed: DataFrame, total: int, ranges: int) -> Splitters:
    """Splitters at the quantiles of a sample weighted by size; overfull ranges are drawn from again and subdivided."""
    drawn = _draw(keyed, ranges * DRAWS_PER_RANGE, total, 0)
    splitters = Splitters(drawn[DRAWS_PER_RANGE // 2 :: DRAWS_PER_RANGE])
    most = OVERFULL * total / ranges
    for seed in range(1, ROUNDS):
        sums = keyed.withColumn("__range", splitters.column("__a", "__b")).groupBy("__range").agg(F.sum("size").alias("s"), F.min(F.struct("__a", "__b")).alias("lo"), F.max(F.struct("__a", "__b")).alias("hi")).collect()
        overfull = [r["__range"] for r in sums if r["s"] > most and r["lo"] != r["hi"]]
        if not overfull:
            break
        heavy = sum(r["s"] for r in sums if r["__range"] in set(overfull))
        again = keyed.where(splitters.column("__a", "__b").isin(overfull))
        more = _draw(again, heavy / total * ranges * DRAWS_PER_RANGE * 2**seed, heavy, seed)
        splitters = Splitters(np.concatenate((splitters.keys, more[DRAWS_PER_RANGE // 2 :: DRAWS_PER_RANGE])))
    return splitters


def place_largest_first(sizes: list[int], shards: int) -> tuple[list[int], list[int]]:
    """The shard of each size, which come in falling order: the least loaded one, the smallest on ties; and the loads."""
    heap, placed = [(0, i) for i in range(shards)], []
    for size in sizes:
        load, shard = heapq.heappop(heap)
        placed.append(shard)
        heapq.heappush(heap, (load + size, shard))
    return placed, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def fill_levels(loads: list[int], rest: int) -> np.ndarray:
    """Ends, for each shard, of its part of `rest` more bytes, which level the loads as far as they can."""
    need, order = np.zeros(len(loads)), np.argsort(loads, kind="stable")
    sorted_ = np.array(loads, np.float64)[order]
    for k in range(len(loads), 0, -1):
        level = (rest + sorted_[:k].sum()) / k
        if level >= sorted_[k - 1]:
            need[order[:k]] = level - sorted_[:k]
            break
    return np.cumsum(need)


def shard_by_bytes(docs: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of all documents, in shards of near-equal bytes.

    size: UTF-8 bytes of the text (null: none) plus overhead. Documents of equal text stay in one shard, unless they
    are more than a shard's mean, which no shard could hold: those are divided, each into a run of shards. Groups of more
    than 1/UNITS_PER_SHARD of a shard are placed first, the largest first, each where least is; all other
    documents fill what room is left. For that they are ordered by a hash of their text; splitters at the quantiles of a
    sample weighted by size part this order into ranges, overfull ranges are drawn from again and subdivided, and
    exact sums over the ranges give each document its place in the order, so balance doesn't depend on the sample's luck.
    A shard misses the mean by 1/UNITS_PER_SHARD, unless a whole group is larger than the rest can level.
    slot counts from 0 in each shard. Null texts are equal to empty ones, a null doc_id sorts as the smallest, repeated
    rows count as often as they come, an empty table gives no rows, other columns are ignored. The driver sees the sample,
    a row for each range, and the large groups: all bounded by the constants above.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = cut(docs.select("doc_id", (F.length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("__a")))
    every = slim.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    total, n = every["s"], every["n"]
    if not total:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    spark, target = docs.sparkSession, total / shards
    ranges = int(np.clip(n // ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES))

    groups = slim.groupBy("__a").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    large = groups.where(F.col("s") > target / UNITS_PER_SHARD).collect()  # shards * UNITS_PER_SHARD at most
    whole = sorted((r for r in large if r["n"] == 1 or r["s"] <= target), key=lambda r: (-r["s"], r["__a"]))
    placed, loads = place_largest_first([r["s"] for r in whole], shards)
    pieces = lambda rows: max(1, min(MOST_RANGES // max(1, len(whole)), -(-rows // ROWS_PER_RANGE)))
    known = [(r["__a"], shard, pieces(r["n"])) for r, shard in zip(whole, placed, strict=True)]
    known += [(r["__a"], -1, 1) for r in large if r["n"] > 1 and r["s"] > target]
    known = spark.createDataFrame(known, "__g long, __shard int, __pieces int")
    rows = slim.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(known), F.col("__a") == F.col("__g"), "left")

    # Large groups: a cell is a part of a group that one task numbers.
    own = rows.where("__shard >= 0").withColumn("__cell", F.pmod(F.xxhash64("doc_id", "__row"), F.col("__pieces")))
    in_cell = F.row_number().over(Window.partitionBy("__a", "__cell").orderBy("doc_id", "__row"))
    own = own.select("doc_id", "size", "text_crc32", F.col("__shard").alias("shard"), "__a", "__cell", in_cell.alias("__number"))

    # All others, in ranges; those of divided groups are ordered by a hash of the row, so that they can be parted.
    apart = F.col("__shard").isNotNull()
    keyed = rows.where("__shard is null or __shard < 0").withColumn("__whole", ~apart)
    keyed = keyed.withColumn("__b", F.when(apart, F.xxhash64("doc_id", "__row")).otherwise(F.lit(0)).cast("long")).drop("__g", "__shard", "__pieces")
    rest = int(total - sum(loads))
    ends = fill_levels(loads, rest)

    @F.arrow_udf("int")
    def shard_at(at: pa.Array) -> pa.Array:
        place = np.searchsorted(ends, at.to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.minimum(place, int(np.searchsorted(ends, ends[-1]))).astype(np.int32))

    splitters = _split(keyed, rest, ranges) if rest else Splitters(np.zeros((0, 2), np.int64))
    ranged = keyed.withColumn("__range", splitters.column("__a", "__b"))
    sums = ranged.groupBy("__range").agg(F.sum("size").alias("s")).toArrow().sort_by("__range")  # a row for each range
    number, s = (sums.column(c).to_numpy() for c in ("__range", "s"))
    start = spark.createDataFrame(list(zip(number.tolist(), (np.cumsum(s) - s).tolist(), strict=True)), "__r int, __bytes long")
    order = Window.partitionBy("__range").orderBy("__a", "__b", "__row")
    other = ranged.join(F.broadcast(start), F.col("__range") == F.col("__r"))
    other = other.withColumn("__end", F.col("__bytes") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    unit = Window.partitionBy("__range", "__a", F.when(~F.col("__whole"), F.col("__row")))
    middle = (F.min(F.col("__end") - F.col("size")).over(unit) + F.max("__end").over(unit)) / 2
    other = other.withColumn("shard", shard_at(middle))
    in_range = F.row_number().over(Window.partitionBy("__range", "shard").orderBy("__a", "__b", "__row"))
    other = other.select("doc_id", "size", "text_crc32", "shard", F.lit(None).cast("long").alias("__a"), F.col("__range").cast("long").alias("__cell"), in_range.alias("__number"))

    done = cut(own.unionByName(other))
    cells = done.groupBy("shard", "__a", "__cell").agg(F.count("*").alias("n")).toArrow().sort_by([("shard", "ascending"), ("__a", "ascending"), ("__cell", "ascending")])
    shard, size = (cells.column(c).to_numpy() for c in ("shard", "n"))  # a row for each range or part of a large group
    before = np.cumsum(size) - size
    before -= before[np.searchsorted(shard, shard)]
    first = list(zip(shard.tolist(), cells.column("__a").to_pylist(), cells.column("__cell").to_pylist(), before.tolist(), strict=True))
    first = F.broadcast(spark.createDataFrame(first, "__s int, __ga long, __gc long, __first long"))
    on = (F.col("shard") == F.col("__s")) & F.col("__a").eqNullSafe(F.col("__ga")) & (F.col("__cell") == F.col("__gc"))
    return done.join(first, on).select("doc_id", "size", "text_crc32", "shard", (F.col("__first") + F.col("__number") - 1).alias("slot"))
