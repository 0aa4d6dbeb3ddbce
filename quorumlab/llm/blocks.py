"""Searches of a query set against all rows in blocks: an index row for each block, queries in bounded parts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from quorumlab.session import cut

#: Queries of a part, at most: what a task holds at once beside a block.
QUERIES_AT_ONCE = 4096
#: Tasks that share the queries of a block, at most, where there are fewer blocks than cores.
SLICES = 8


def build_blocks(rows: DataFrame, block_rows: int, build: Callable[[pa.Table], dict[str, bytes]], names: list[str]) -> DataFrame:
    """(block, data): an index of one row for each block of about block_rows rows; build makes its columns (all binary).

    Each task builds the blocks of the rows it was dealt; what it holds is bounded by two blocks.
    """
    n = rows.count()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            made = build(pa.Table.from_batches(held))
            return pa.RecordBatch.from_arrays([pa.array([[made[x] for x in names]], pa.list_(pa.binary()))], names=["data"])

        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                held.append(part)
                size += part.num_rows
                if size >= 2 * block_rows:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    # Dealt by turns and not by a key: the number of blocks follows the rows alone, and no key is hot.
    dealt = rows.repartition(max(1, -(-n // block_rows)))
    return cut(dealt.mapInArrow(make, "data array<binary>").select(F.monotonically_increasing_id().alias("block"), "data"))


def _packed(queries: DataFrame, parts: int, slices: int) -> DataFrame:
    """(slice, data): the queries in about `parts` rows of Arrow bytes, dealt to slices by turns."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES_AT_ONCE):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, QUERIES_AT_ONCE))
                data = pa.array([[sink.getvalue().to_pybytes()]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([number % slices], pa.int32()), data], names=["slice", "data"])

    return cut(queries.repartition(parts).mapInArrow(pack, "slice int, data array<binary>"))


def _asked(index: DataFrame, parts: DataFrame, blocks: int, slices: int) -> DataFrame:
    """(block, slice, data): every part of the queries for every block, as many times as there are parts and blocks.

    Blocks meet parts under about as many keys as there are blocks and slices, for which parts are repeated first, so no key grows with the blocks.
    """
    own = index.select("block", F.pmod(F.xxhash64("block"), F.lit(blocks)).cast("int").alias("key")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return own.join(parts.withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))), ["slice", "key"]).select("block", "slice", "data")


def search_blocks(
    index: DataFrame, queries: DataFrame, names: list[str], prepare: Callable[[dict[str, bytes]], Any],
    search: Callable[[Any, pa.Table], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], k: int, score: str,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of all blocks for each query.

    prepare makes a block's row usable, once for all its queries; search gives (query ids, row ids, scores) of
    the block's best for a part of the queries. The lower score, then the smaller id, is the better, and an id that
    several rows have counts once, with its best score. Blocks and parts meet by key: every part is sent to every
    block's task, which streams the parts past the block; nothing comes to the driver and the plan is the same at every size.
    """
    n, blocks = queries.count(), max(1, index.count())
    slices = max(1, min(SLICES, -(-index.sparkSession.sparkContext.defaultParallelism // blocks)))
    parts = _packed(queries, max(1, slices, -(-n // QUERIES_AT_ONCE)), slices)
    copies = index.select("block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "data")
    asked = _asked(index, parts, blocks, slices).select("block", "slice", F.lit(1).alias("kind"), "data")
    kind = "double" if score == "double" else "int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("data")[i].as_py()
                if batch.column("kind")[i].as_py() == 0:
                    block = prepare(dict(zip(names, data, strict=True)))
                    continue
                for ids, rows, scores in search(block, pa.ipc.open_stream(data[0]).read_all()):
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows), pa.array(scores)], names=["query_id", "vec_id", "score"])

    met = copies.unionAll(asked).repartition(2 * blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    every = met.mapInArrow(run, f"query_id long, vec_id long, score {kind}").repartition("query_id")
    once = every.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def distinct_rows(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the first row of each distinct key, and the ids in ascending order under each, with their starts."""
    order = np.lexsort((ids, keys))
    sorted_ = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order[starts], ids[order], np.append(starts, len(keys))


def expand(best: np.ndarray, scores: np.ndarray, ids: np.ndarray, starts: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, without the query's own, under distinct rows `best` that come with scores.

    ids holds an id once under each distinct row, so only k + 1 of a row can count and copies cost no more than that.
    """
    sizes = np.minimum(starts[best + 1] - starts[best], k + 1)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows = ids[np.repeat(starts[best], sizes) + inner]
    weight = np.repeat(scores, sizes)
    keep = rows != own
    rows, weight = rows[keep], weight[keep]
    # An id under several distinct rows counts once.
    order = np.lexsort((rows, weight))
    rows, weight = rows[order], weight[order]
    once = np.sort(np.unique(rows, return_index=True)[1])[:k]
    return rows[once], weight[once]
