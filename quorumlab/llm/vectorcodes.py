"""Product codes of vectors by Lloyd rounds whose sums are kept up by what changed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.vectors import lists, matrix, release, stored, whole_numbers
from quorumlab.session import cut

#: A component x becomes floor(SCALE * x).
SCALE = 1024
ROWS_AT_ONCE = 4096
#: Keys over which the rows of one label are spread when they meet their label's sum.
SALTS = 32


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of integers the nearest entry, the lowest index on ties, and its exact squared distance."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * v.shape[1] < 1 << 53:  # doubles hold every term exactly
        a, b = v.astype(np.float64), book.astype(np.float64)
        d = (b**2).sum(1) - 2 * (a @ b.T)
        at = d.argmin(1)
        return at, ((v - book[at]) ** 2).sum(1)
    wide, entries = v.astype(object), book.astype(object)
    d = np.stack([((wide - e) ** 2).sum(1) for e in entries], axis=1)
    at = d.argmin(1)
    return at, d[np.arange(len(v)), at]


class Codebooks:
    """entries[part, entry, position] of integers, with the running sums and counts of the parts assigned to each."""

    def __init__(self, first: np.ndarray, parts: int) -> None:
        """first: the vectors whose parts are the entries at the start."""
        n, d = first.shape
        self.entries = first.reshape(n, parts, d // parts).transpose(1, 0, 2).copy()
        self.sums = np.zeros(self.entries.shape, object)  # unbounded integers
        self.counts = np.zeros(self.entries.shape[:2], object)

    def move(self, changes: list[tuple[int, int, int, int]]) -> None:
        """Adds (part, entry, place, change), place 0 being the count, and replaces each used entry by floor(sum / count)."""
        for part, entry, place, change in changes:
            if place:
                self.sums[part, entry, place - 1] += change
            else:
                self.counts[part, entry] += change
        used = self.counts > 0
        self.entries[used] = (self.sums[used] // self.counts[used][:, None]).astype(np.int64)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _assigned(rows: DataFrame, entries: np.ndarray, kind: str) -> DataFrame:
    """rows(id, label, v, code) with the code that the entries give, the one before, and the parts' errors."""
    parts, _, width = entries.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(at, ROWS_AT_ONCE)
                v = matrix(some.column("v")).reshape(some.num_rows, parts, width)
                found = [nearest(v[:, p], entries[p]) for p in range(parts)]
                code = np.stack([x for x, _ in found], axis=1).astype(np.int32)
                errors = sum(e for _, e in found).tolist()
                error = pa.array([e if e < 1 << 63 else None for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("label"), some.column("v"), lists(code), some.column("code"), error], ["id", "label", "v", "code", "before", "error"])

    return rows.select("id", "label", "v", "code").mapInArrow(assign, f"{kind}, v array<long>, code array<int>, before array<int>, error long")


def _changes(rows: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(part, entry, place, change) of the parts whose assignment changed: plus where they came, minus where they left.

    A task adds up its own first and sends at most a row for each number of the codebooks.
    """
    parts, n, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, n, width + 1), np.int64)
        for batch in batches:
            v = matrix(batch.column(0)).reshape(batch.num_rows, parts, width)
            now, before = matrix(batch.column(1)), matrix(batch.column(2))
            for p in range(parts):
                moved = np.flatnonzero(now[:, p] != before[:, p])
                terms = np.column_stack([np.ones(len(moved), np.int64), v[moved, p]])
                np.add.at(total[p], now[moved, p], terms)
                left = before[moved, p] >= 0
                np.subtract.at(total[p], before[moved, p][left], terms[left])
        part, entry, place = np.nonzero(total)
        cols = [pa.array(x.astype(np.int32)) for x in (part, entry, place)] + [pa.array(total[part, entry, place])]
        yield pa.RecordBatch.from_arrays(cols, ["part", "entry", "place", "change"])

    moved = rows.where("code <> before").select("v", "code", "before")
    sent = moved.mapInArrow(add, "part int, entry int, place int, change long")
    return sent.groupBy("part", "entry", "place").agg(F.sum("change").alias("change"))


def compress_vectors(rows: DataFrame, row_id: str = "vec_id", column: str = "embedding", label: str | None = None, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code array<int>, error) of each usable vector, and the codebooks of its parts.

    Components become floor(1024 * x); a vector is cut into equal consecutive parts. A part position's codebook starts
    as that part of the vectors of the smallest ids (on equal ids by their integers, nulls last). Each round assigns every part to
    the nearest entry, ties to the lower index; the assignments are written with the vectors to the shared folder, and only what the parts that
    changed add or take away is shuffled, into running integer sums on the driver (their size is the codebooks'). A used entry becomes the floor of
    sum over count, others stay. After the rounds all parts are assigned once more; error is the squared distance
    over all parts, null where it doesn't fit a long. Null and empty vectors and those with null or non-finite components
    take no part; repeated rows count as often as they come; other columns are ignored; without a usable vector no
    row and no codebooks (None) are returned. Vectors of several lengths, or of one that the parts don't divide, are errors.
    """
    kinds = dict(rows.dtypes)
    kind = f"id {kinds[row_id]}, label {kinds[label] if label else 'string'}"

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, kept = whole_numbers(batch.column(2), SCALE)
            if v.shape[1] % parts:
                raise ValueError(f"{v.shape[1]} components don't make {parts} equal parts")
            some = batch.select([0, 1]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*some.columns, lists(v), lists(np.full((len(v), parts), -1, np.int32))], ["id", "label", "v", "code"])

    chosen = rows.select(F.col(row_id).alias("id"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), F.col(column).alias("v"))
    held = chosen.mapInArrow(convert, f"{kind}, v array<long>, code array<int>")
    first = held.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    if not first:
        return rows.sparkSession.createDataFrame([], f"{kind}, code array<int>, error long"), None
    books, path = Codebooks(np.array([r["v"] for r in first], np.int64), parts), None
    for _ in range(rounds):
        held, now = stored(_assigned(held, books.entries, kind), "codes")
        if path:
            release(rows, path)
        path = now
        books.move([tuple(r) for r in _changes(held, books.entries.shape).collect()])
    coded = cut(_assigned(held, books.entries, kind).select("id", "label", "code", "error"))
    if path:
        release(rows, path)
    return coded, books


def hex_code(code):
    """Entries' indexes as two hex digits each, in part order."""
    return F.array_join(F.transform(code, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")


def with_label_error(coded: DataFrame) -> DataFrame:
    """coded(id, label, ..., error) with label_error: the sum over rows of the same label, nulls together, null where it doesn't fit a long.

    A label's sum is repeated for SALTS keys, over which its rows are spread, so a label of very many rows needs no task of its own.
    """
    sums = coded.groupBy(F.col("label").alias("_l")).agg(F.expr("try_sum(error)").alias("label_error"))
    sums = sums.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = coded.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return salted.join(sums, (F.col("_s") == F.col("_t")) & F.col("label").eqNullSafe(F.col("_l"))).drop("_s", "_t", "_l")
