"""Vectors as integers, and tables that rounds hand on."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quorumlab.session import remove_folder, shared_folder

#: Integers from here on would lose exactness.
MOST = 2.0**52


def whole_numbers(column: pa.Array | pa.ChunkedArray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * component) of the usable vectors, and which rows they are.

    Left out: null and empty vectors, and those with null or non-finite components. Vectors of several
    lengths, and components too large for exact integers, are errors.
    """
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths > 0)
    sizes = np.unique(lengths[rows])
    if len(sizes) > 1:
        raise ValueError(f"vectors of several lengths: {sizes.tolist()}")
    flat = array.take(pa.array(rows)).flatten().cast(pa.float64())
    v = flat.to_numpy(zero_copy_only=False).reshape(len(rows), int(sizes[0]) if len(sizes) else 0)  # null components become NaN
    fine = np.isfinite(v).all(axis=1)
    scaled = np.floor(scale * v[fine])
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError("components too large for exact integers")
    return scaled.astype(np.int64), rows[fine]


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow array of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length, without nulls, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if len(column) else 0)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read again, and where it lies."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(df: DataFrame, *paths: str) -> None:
    for path in paths:
        remove_folder(df.sparkSession, path)
