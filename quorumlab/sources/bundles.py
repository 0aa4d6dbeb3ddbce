"""Python data sources: arrays with their provenance as NumPy bundles, written with a commit step, and digests of files hashed in chunks."""

from __future__ import annotations

import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StringType, StructType

#: Bytes of a file that a task holds while it hashes, and rows of a bundle.
CHUNK, ROWS = 8 << 20, 1 << 16
#: Bytes of rows, as they come, that a part holds.
PART_BYTES = 32 << 20
MANIFEST = "_manifest.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def digest_of(path: str) -> tuple[int, str]:
    """Size and SHA-256 of a file of any size, CHUNK bytes at a time."""
    store, where = _store(path)
    found, size = hashlib.sha256(), 0
    with store.open_input_stream(where, buffer_size=None) as f:
        while part := f.read(CHUNK):
            found.update(part)
            size += len(part)
    return size, found.hexdigest()


def file_digests(spark: SparkSession, path: str, tasks: int = 64) -> DataFrame:
    """(path, length, sha256) of each file under path. Files are listed by Spark, without their content, and hashed where tasks run.

    Empty files, and those whose names begin with _ or ., which Spark's readers pass over, have no row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time
                size, found = digest_of(batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([size], pa.int64()), pa.array([found])], ["path", "length", "sha256"])

    return files.select("path").repartition(tasks, "path").mapInArrow(hashed, "path string, length long, sha256 string")


@dataclass
class Written(WriterCommitMessage):
    parts: list[dict]


@dataclass
class Part(InputPartition):
    name: str


class ArrayBundle(DataSource):
    """format("array_bundle"): .npz files of aligned columns, one or more for each task, listed by a manifest that the commit writes.

    Columns of arrays (of one length in a bundle) become matrices of float32 or float64, numbers and texts become vectors; row i of
    each is the same row. Nulls aren't allowed. Readers see the parts that the manifest lists, one partition each: parts of a job that failed are removed, and
    without a manifest there is nothing to read.
    """

    @classmethod
    def name(cls) -> str:
        return "array_bundle"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BundleReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return BundleWriter(self.options["path"], schema, overwrite)


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Parts of PART_BYTES or little more each, so that a task holds one part, however many rows it has."""
        written, held, size = Written([]), [], 0
        try:
            for batch in iterator:
                step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, step):
                    held.append(batch.slice(at, step))
                    size += held[-1].nbytes
                    if size >= PART_BYTES:
                        written.parts.append(self._write_part(held))
                        held, size = [], 0
            if held:
                written.parts.append(self._write_part(held))
        except BaseException:
            self.abort([written])
            raise
        return written

    def _write_part(self, batches: list[pa.RecordBatch]) -> dict:
        from pyspark import TaskContext

        table = pa.Table.from_batches(batches).combine_chunks()
        arrays = {}
        for field in self.schema.fields:
            column = table.column(field.name).chunk(0)
            if column.null_count:
                raise ValueError(f"{field.name} has nulls")
            if isinstance(field.dataType, ArrayType):
                widths = np.unique(column.value_lengths().to_numpy(zero_copy_only=False))
                if len(widths) > 1 or column.flatten().null_count:
                    raise ValueError(f"{field.name} isn't a matrix")
                kind = np.float32 if isinstance(field.dataType.elementType, FloatType) else np.float64
                arrays[field.name] = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), int(widths[0]))
            else:
                values = column.to_numpy(zero_copy_only=False)
                arrays[field.name] = values.astype(str) if isinstance(field.dataType, StringType) else values
        raw = io.BytesIO()
        np.savez_compressed(raw, **arrays)
        name = f"part-{TaskContext.get().partitionId():05}-{self.job}-{uuid.uuid4().hex[:8]}.npz"
        store, where = _store(self.path)
        store.create_dir(where, recursive=True)
        with store.open_output_stream(f"{where}/{name}") as f:
            f.write(raw.getbuffer())
        return {"part": name, "rows": len(table), "sha256": hashlib.sha256(raw.getbuffer()).hexdigest()}

    def commit(self, messages: list[Written | None]) -> None:
        """Lists the new parts behind those there were, or instead of them; the manifest is moved into place at last."""
        store, where = _store(self.path)
        store.create_dir(where, recursive=True)
        old = [] if self.overwrite else read_manifest(self.path)
        new = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["part"])
        draft = f"{where}/{MANIFEST}.{self.job}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps({"columns": self.schema.simpleString(), "parts": old + new}).encode())
        store.move(draft, f"{where}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        """Removes the parts of tasks that had ended."""
        store, where = _store(self.path)
        for p in (p for m in messages if m for p in m.parts):
            if store.get_file_info(f"{where}/{p['part']}").type == fs.FileType.File:
                store.delete_file(f"{where}/{p['part']}")


def read_manifest(path: str) -> list[dict]:
    """The committed parts of a bundle; none where there is no manifest."""
    store, where = _store(path)
    if store.get_file_info(f"{where}/{MANIFEST}").type != fs.FileType.File:
        return []
    with store.open_input_stream(f"{where}/{MANIFEST}") as f:
        return json.loads(f.read())["parts"]


class BundleReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[Part]:
        return [Part(p["part"]) for p in read_manifest(self.path)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Part):
            return
        store, where = _store(self.path)
        with store.open_input_stream(f"{where}/{partition.name}") as f:
            arrays = np.load(io.BytesIO(f.read()))
        held = {field.name: arrays[field.name] for field in self.schema.fields}  # only the columns asked for are unpacked
        n = len(next(iter(held.values()))) if held else 0
        for at in range(0, n, ROWS):
            cols = []
            for field in self.schema.fields:
                part = held[field.name][at : at + ROWS]
                if isinstance(field.dataType, ArrayType):
                    ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                    kind = pa.float64() if isinstance(field.dataType.elementType, DoubleType) else pa.float32()
                    cols.append(pa.ListArray.from_arrays(ends, pa.array(part.reshape(-1)).cast(kind)))
                else:
                    cols.append(pa.array(part.tolist()) if isinstance(field.dataType, StringType) else pa.array(part))
            yield pa.RecordBatch.from_arrays(cols, [field.name for field in self.schema.fields])


def write_bundle(rows: DataFrame, path: str, row_id: str, append: bool = False) -> None:
    """rows as a bundle of arrays; row_id must be one of its columns, so that arrays kept elsewhere can be aligned with them."""
    if row_id not in rows.columns:
        raise ValueError(f"{row_id} isn't a column")
    rows.sparkSession.dataSource.register(ArrayBundle)
    rows.write.format("array_bundle").mode("append" if append else "overwrite").save(path)


def read_bundle(spark: SparkSession, path: str, schema: str) -> DataFrame:
    spark.dataSource.register(ArrayBundle)
    return spark.read.format("array_bundle").schema(schema).load(path)


def file_objects(spark: SparkSession, path: str, description: str = "", encoding: str = "application/octet-stream") -> list[dict]:
    """The metadata entry of each file under path; a row for each file on the driver."""
    rows = file_digests(spark, path).orderBy("path").collect()
    return [
        {
            "@type": "cr:FileObject", "@id": r["path"].rsplit("/", 1)[-1], "name": r["path"].rsplit("/", 1)[-1], "description": description, "contentUrl": r["path"],
            "encodingFormat": encoding, "contentSize": f"{r['length']} B", "sha256": r["sha256"],
        }
        for r in rows
    ]


def check_files(spark: SparkSession, path: str, document: dict) -> DataFrame:
    """(id, state) of each file that the document or the folder has: same, changed, missing or unlisted."""
    said = spark.createDataFrame([(f["@id"], f["sha256"]) for f in document["distribution"]], "id string, said string")
    found = file_digests(spark, path).select(F.substring_index("path", "/", -1).alias("id"), "sha256")
    state = F.when(F.col("said").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing").when(F.col("said") == F.col("sha256"), "same").otherwise("changed")
    return said.join(found, "id", "full").select("id", state.alias("state"))
