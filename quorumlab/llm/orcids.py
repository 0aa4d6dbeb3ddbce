"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quorumlab.llm.wordids import memo

SCHEMA = "part int, doc_id long, place long, n_tokens long, ids array<int>"


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """docs as rows of SCHEMA, ascending by doc_id within and over partitions.

    Ranges are cut by (doc_id, text hash, place in the input), so a repeated id is spread over as
    many ranges as its rows ask for. place counts the ids before a document in its own part.
    """
    ordered = ["doc_id", "__hash", "__row"]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    ranged = ranged.repartitionByRange(*ordered).sortWithinPartitions(*ordered).select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, place = memo(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            at = 0
            for ids in own.encode(batch.column(1), end_id):
                ends = ids.offsets.to_numpy().astype(np.int64)
                doc_ids = batch.column(0).slice(at, len(ids)).cast(pa.int64())
                cols = [pa.array(np.full(len(ids), part, np.int32)), doc_ids, pa.array(place + ends[:-1]), pa.array(np.diff(ends)), ids]
                yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "place", "n_tokens", "ids"])
                place += int(ends[-1])
                at += len(ids)

    return ranged.mapInArrow(encode, SCHEMA)


def write_token_ids(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 1, stripe_bytes: int = 32 << 20, index_rows: int = 1000, compression: str = "zstd") -> None:
    """Encodes every whole text of docs(doc_id, text), ends it with end_id, and writes ORC files in ascending doc_id order.

    A file is a run of stripes of about stripe_bytes. Integers are run-length encoded, every
    index_rows rows have their own index entry (least and greatest doc_id) and Bloom filter, so
    readers split files by stripes and skip what can't hold a wanted id. Null and empty texts
    are the end id alone; null ids come first; repeated rows are written as often as they come;
    other columns are ignored; an empty table gives no rows. One document is one row, however long.
    """
    options = {
        "compression": compression, "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01",
    }
    token_rows(docs, tokenizer_path, end_id).write.mode("overwrite").options(**options).orc(path)


def read_token_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from files of write_token_ids; start counts the ids of all documents before.

    What lies before a part comes from the parts' sums, which read two narrow columns; one row for
    each written file is broadcast. With doc_ids, the condition reaches the reader, which skips
    stripes and index groups by their statistics and Bloom filters.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids")


@F.arrow_udf(T.LongType())
def ids_crc32(ids: pa.Array) -> pa.Array:
    """crc32 (unsigned) of each array of ids as little-endian unsigned 32-bit integers."""
    ends = ids.offsets.to_numpy()
    flat = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
    return pa.array([zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files."""
    return read_token_ids(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))
