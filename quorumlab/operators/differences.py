"""Exact order statistics of all pairwise differences in cells, without making a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quorumlab.session import cut

#: Distinct (value, cell, member) that one task holds of a group; larger groups lie in several blocks.
BLOCK = 1 << 15
#: Up to so many of them pairs are simply compared, in the task.
FEW = 192
#: Differences tried at once in a round over blocks.
TRIES = 7


class Places:
    """How many rows of one code lie before a place in the order of values."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.width = len(codes) + 1
        self.names, code = np.unique(codes, return_inverse=True)
        self.keys = np.sort(code.astype(np.int64) * self.width + np.arange(len(codes)))
        self.before = np.concatenate([[0], np.cumsum(counts[self.keys % self.width])])

        self.asked: tuple | None = None

    def below(self, places: np.ndarray, codes: np.ndarray) -> np.ndarray:
        if self.asked is None or self.asked[0] is not codes:  # names are looked up once, not for each difference tried
            at = np.minimum(np.searchsorted(self.names, codes), len(self.names) - 1)
            first = at.astype(np.int64) * self.width
            self.asked = codes, first, self.before[np.searchsorted(self.keys, first)], self.names[at] == codes
        _, first, start, known = self.asked
        return np.where(known, self.before[np.searchsorted(self.keys, first + places)] - start, 0)


class Block:
    """Distinct (value, cell, member) of a stretch of a group, ascending by value, with how many rows each stands for."""

    def __init__(self, values: np.ndarray, cells: np.ndarray, members: np.ndarray, counts: np.ndarray) -> None:
        owns = np.char.add(np.char.add(cells.astype(str), "\x1f"), members.astype(str))
        order = np.lexsort((owns, values))
        self.values, self.cells, self.owns, self.counts = values[order], cells.astype(str)[order], owns[order], counts[order]
        self.n = len(order)
        self.of_cell, self.of_own = Places(self.cells, self.counts), Places(self.owns, self.counts)

    def partners(self, places: np.ndarray, other: Block) -> np.ndarray:
        """For each entry of other, how many rows before its place are of the same cell and of another member."""
        return self.of_cell.below(places, other.cells) - self.of_own.below(places, other.owns)


def pairs_within(a: Block, b: Block | None, most: float) -> int:
    """How many pairs of rows of one cell and different members differ by `most` or less: one row of a, one of b, whose values aren't smaller; or both of a."""
    c = b or a
    within = c.partners(np.searchsorted(c.values, a.values + most, side="right"), a)
    if b is None:  # only partners that come after
        within = within - a.partners(np.arange(a.n) + 1, a)
    return int((a.counts * within).sum())


def halves(low: float, high: float, tries: int) -> np.ndarray:
    """Differences to try between low, where too few pairs are within, and high, where enough are."""
    return np.unique(np.linspace(low, high, tries + 2)[1:-1])


def search(count: Callable[[float], int], rank: int, most: float) -> float:
    """The smallest difference within which more than rank pairs lie, to the last digits of a double."""
    if count(0.0) > rank:
        return 0.0
    low, high = 0.0, most
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high or high - low <= 1e-15 * most:
            break
        if count(middle) > rank:
            high = middle
        else:
            low = middle
    return high


def places(n: int, shares: list[float]) -> list[tuple[int, int, float]]:
    """For each share the two ranks, from 0, that it lies between, and where."""
    return [(int(np.floor((n - 1) * s)), int(np.ceil((n - 1) * s)), (n - 1) * s - np.floor((n - 1) * s)) for s in shares]


def quantiles_of_block(block: Block, shares: list[float]) -> tuple[int, list[float] | None]:
    """How many pairs there are, and the quantiles of their differences."""
    if block.n <= FEW:
        i, j = np.triu_indices(block.n, 1)
        apart = (block.cells[i] == block.cells[j]) & (block.owns[i] != block.owns[j])
        i, j = i[apart], j[apart]
        d, c = block.values[j] - block.values[i], block.counts[i] * block.counts[j]
        order = np.argsort(d, kind="stable")
        d, ends = d[order], np.cumsum(c[order])
        n = int(ends[-1]) if len(ends) else 0
        at = lambda rank: float(d[np.searchsorted(ends, rank, side="right")])
    else:
        most = float(block.values[-1] - block.values[0])
        n = pairs_within(block, None, float("inf"))
        at = lambda rank: search(lambda x: pairs_within(block, None, x), rank, most)
    if not n:
        return 0, None
    known = {rank: at(rank) for rank in sorted({r for lo, hi, _ in places(n, shares) for r in (lo, hi)})}
    return n, [known[lo] + (known[hi] - known[lo]) * part for lo, hi, part in places(n, shares)]


ARRAYS = ("values", "cells", "members", "counts")


def _blocks(rows: DataFrame, group: str, cell: list[str], member: str, value: str) -> DataFrame:
    """(g, home, block, blocks, values, cells, members, counts): a group's distinct (value, cell, member), in one row up to BLOCK of them.

    In a larger group no cell is spread over rows that another cell shares: cells up to BLOCK lie whole in bins of about BLOCK, and a larger cell
    is a home of its own, in blocks by value. Only blocks of one home have pairs with each other.
    """
    clean = rows.dropna(subset=[group, *cell, member, value])
    where = F.to_json(F.struct(*cell)) if cell else F.lit("")
    counts = clean.select(F.col(group).alias("g"), where.alias("s"), F.col(member).cast("string").alias("m"), F.col(value).cast("double").alias("v"))
    counts = counts.where(~F.isnan("v") & (F.abs("v") != float("inf"))).groupBy("g", "v", "s", "m").agg(F.count("*").alias("c"))
    ranged = cut(counts.repartitionByRange("g", "s", "v", "m").withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("g", "s", "_range").agg(F.count("*").alias("_s"))
    w = Window.partitionBy("g", "s")
    before = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("g", "s", "_range", before.alias("_before"), F.sum("_s").over(w).alias("_cell"), F.sum("_s").over(Window.partitionBy("g")).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("g", "s", "_range").orderBy("v", "m"))
    placed = ranged.withColumn("_i", inside).join(sizes, ["g", "s", "_range"])
    one, small = F.col("_n") <= BLOCK, F.col("_cell") <= BLOCK  # a group in one row; a cell that shares its row with others of its bin
    home = F.when(one, "").when(small, F.concat(F.lit("bin "), F.pmod(F.xxhash64("s"), F.ceil(F.col("_n") / BLOCK)).cast("string"))).otherwise(F.concat(F.lit("cell "), F.col("s")))
    block = F.when(one | small, F.lit(0)).otherwise(F.floor((F.col("_before") + F.col("_i") - 1) / BLOCK)).cast("int")
    made = placed.groupBy("g", home.alias("home"), block.alias("block")).agg(F.max(F.ceil(F.col("_n") / BLOCK)).cast("int").alias("blocks"), F.collect_list(F.struct("v", "s", "m", "c")).alias("e"))  # about BLOCK
    return made.select("g", "home", "block", "blocks", *[F.col(f"e.{c}").alias(name) for c, name in zip("vsmc", ARRAYS, strict=True)], F.array_min("e.v").alias("least"), F.array_max("e.v").alias("most"))


def _read(batch: pa.RecordBatch, i: int, prefix: str = "") -> Block:
    values, cells, members, counts = (batch.column(prefix + c)[i].values.to_numpy(zero_copy_only=False) for c in ARRAYS)
    return Block(values, cells, members, counts)


def difference_quantiles(rows: DataFrame, group: str, cell: list[str], member: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each named share): exact quantiles of |difference| over all pairs of rows of one cell and different members, pooled over a group's cells.

    No pair is made. A group's distinct (value, cell, member) are sorted with prefix counts; how many pairs lie within a difference is
    then a binary search for each entry, less the pairs of its own member, and bisection on the difference finds each rank, to the last digits of a double. Groups of
    up to BLOCK entries are settled by one task each. Larger ones lie in blocks, each cell's apart from the others': a round counts the pairs of blocks for TRIES
    differences between the bounds of each rank, so no task holds more than two blocks; pairs of blocks that lie farther apart than
    every difference tried are skipped. Rows with a null group, cell, member or value, or a value that isn't finite, are left out; groups without a pair have no
    row; repeated rows count as often as they come.
    """
    names, wanted = list(shares), list(map(float, shares.values()))
    blocks = cut(_blocks(rows, group, cell, member, value))
    schema = ", ".join([f"g {dict(rows.dtypes)[group]}", "n long", *[f"`{x}` double" for x in names]])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [quantiles_of_block(_read(batch, i), wanted) for i in range(batch.num_rows)]
            kept = [i for i, (n, _) in enumerate(found) if n]
            cols = [batch.column("g").take(pa.array(kept, pa.int64())), pa.array([found[i][0] for i in kept], pa.int64())]
            cols += [pa.array([found[i][1][k] for i in kept], pa.float64()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, ["g", "n", *names])

    small = blocks.where("blocks = 1").select("g", *ARRAYS).mapInArrow(settle, schema)
    large = _large_groups(blocks.where("blocks > 1"), wanted)
    made = small.unionByName(rows.sparkSession.createDataFrame([(c, n, *q) for c, n, q in large], schema)) if large else small
    return made.withColumnRenamed("g", group)


def _large_groups(blocks: DataFrame, shares: list[float]) -> list[tuple]:
    """(group, n, quantiles) of groups that lie in several blocks; a row on the driver for each such group, of which there are at most rows / BLOCK."""
    spark = blocks.sparkSession
    bounds = {r["g"]: float(r["y"] - r["x"]) for r in blocks.groupBy("g").agg(F.min("least").alias("x"), F.max("most").alias("y")).collect()}
    if not bounds:
        return []
    kind = dict(blocks.dtypes)["g"]
    left = blocks.select("g", "home", F.col("block").alias("p"), F.col("most").alias("a_most"), *[F.col(c).alias(f"a_{c}") for c in ARRAYS])
    right = blocks.select("g", "home", F.col("block").alias("q"), F.col("least").alias("b_least"), *[F.col(c).alias(f"b_{c}") for c in ARRAYS])
    pairs = left.join(right, ["g", "home"]).where("p <= q")  # pairs of blocks of a cell or bin, not of rows

    def count(tries: dict) -> dict:
        """For each group how many pairs lie within each of its differences."""
        asked = F.broadcast(spark.createDataFrame([(c, [float(x) for x in d]) for c, d in tries.items()], f"g {kind}, d array<double>"))  # a row for each large group

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, many = [], []
                for i in range(batch.num_rows):
                    a = _read(batch, i, "a_")
                    b = None if batch.column("p")[i].as_py() == batch.column("q")[i].as_py() else _read(batch, i, "b_")
                    for k, d in enumerate(batch.column("d")[i].as_py()):
                        at.append((i, k))
                        many.append(pairs_within(a, b, d))
                named = batch.column("g").take(pa.array([i for i, _ in at], pa.int64()))
                yield pa.RecordBatch.from_arrays([named, pa.array([k for _, k in at], pa.int32()), pa.array(many, pa.int64())], ["g", "k", "n"])

        near = pairs.join(asked, "g").where(F.col("b_least") - F.col("a_most") <= F.array_max("d"))
        counted = near.mapInArrow(tally, f"g {kind}, k int, n long").groupBy("g", "k").agg(F.sum("n").alias("n"))
        out = {c: [0] * len(d) for c, d in tries.items()}
        for r in counted.collect():
            out[r["g"]][r["k"]] = r["n"]
        return out

    totals = {c: n[0] for c, n in count({c: [float("inf")] for c in bounds}).items()}
    ranks = {c: sorted({r for lo, hi, _ in places(n, shares) for r in (lo, hi)}) for c, n in totals.items() if n}
    open_ = {(c, r): (-1.0, bounds[c]) for c, rs in ranks.items() for r in rs}
    done = {}
    while open_:
        tries = {}
        for (c, _), (low, high) in open_.items():
            tries.setdefault(c, set()).update([0.0] * (low < 0) + halves(max(low, 0.0), high, TRIES).tolist())
        tries = {c: sorted(x) for c, x in tries.items()}
        found = {c: list(zip(tries[c], n, strict=True)) for c, n in count(tries).items()}
        for (c, r), (low, high) in list(open_.items()):
            enough = [d for d, n in found[c] if n > r and d <= high]
            short = [d for d, n in found[c] if n <= r and d >= low]
            low, high = max([low, *short]), min([high, *enough])
            open_[c, r] = low, high
            if high == 0.0 or high - low <= 1e-15 * bounds[c] or not low < (low + high) / 2 < high:
                done[c, r] = high
                del open_[c, r]
    out = []
    for c, rs in ranks.items():
        out.append((c, totals[c], [float(done[c, lo] + (done[c, hi] - done[c, lo]) * part) for lo, hi, part in places(totals[c], shares)]))
    return out
