"""Best-fit packing by exact-complement hashing over the counts of piece lengths."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quorumlab.llm.wordids import memo
from quorumlab.session import cut

#: Groups of (length, salt) beyond one for each length, so that a group holds about 1/4096 of all pieces at most.
SALTS = 4096


def cut_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and the end id, cut only where longer than capacity."""

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def pieces(batch: pa.Array) -> pa.Array:
        ends, rows, width = [0], [], 4 * capacity
        for lists in memo(tokenizer_path).encode(batch, end_id):
            flat, at = memoryview(lists.values.to_numpy().astype("<i4", copy=False)).cast("B"), (4 * lists.offsets.to_numpy().astype(np.int64)).tolist()
            for start, end in zip(at, at[1:], strict=False):
                for i, lo in enumerate(range(start, end, width)):
                    hi = min(lo + width, end)
                    rows.append((i, (lo - start) // 4, (hi - lo) // 4, zlib.crc32(flat[lo:hi])))
                ends.append(len(rows))
        cols = list(zip(*rows, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)

    return docs.select("doc_id", F.explode(pieces("text")).alias("p")).select("doc_id", "p.*")


class ComplementIndex:
    """Finds one, two or three available lengths whose sum is exactly a gap."""

    def __init__(self, available: np.ndarray) -> None:
        self.available = available

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.available[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        has = self.available[: gap + 1] > 0
        both = has & has[::-1]
        both[0] = both[gap] = False
        if gap % 2 == 0 and self.available[gap // 2] < 2:
            both[gap // 2] = False
        found = np.flatnonzero(both)
        return (int(found[-1]), gap - int(found[-1])) if len(found) else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        has = self.available[: gap + 1] > 0
        has[0] = False
        size = 1 << (2 * gap + 1).bit_length()
        wave = np.fft.rfft(has.astype(np.float64), size)
        sums = np.fft.irfft(wave * wave, size)[: gap + 1] > 0.5  # sums of two available lengths
        for first in np.flatnonzero(has & sums[::-1])[::-1].tolist():
            self.available[first] -= 1
            rest = self.pair(gap - first) if gap > first else None
            self.available[first] += 1
            if rest:
                return (first, *rest)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        return self.single(gap) or self.pair(gap) or self.triple(gap)


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in a sequence, how many such sequences) that use up the counts.

    From the longest length down, the gap beside it is filled by a single, pair or triple that
    fits exactly, as many times at once as all its lengths last; where none fits exactly, the
    longest length that fits goes in and the smaller gap is tried again. The work depends on
    the number of distinct lengths, not of pieces.
    """
    available = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        available[length] += n
    index, patterns = ComplementIndex(available), []
    if available[capacity]:
        patterns.append(((capacity,), int(available[capacity])))
        available[capacity] = 0
    for seed in range(capacity - 1, 0, -1):
        while available[seed]:
            items = [seed]
            available[seed] -= 1
            while gap := capacity - sum(items):
                exact = index.fill(gap)
                fitting = np.flatnonzero(available[: gap + 1]) if exact is None else ()
                more = exact or ((int(fitting[-1]),) if len(fitting) else ())
                for x in more:
                    available[x] -= 1
                items += more
                if exact or not more:
                    break
            uses = Counter(items)
            times = min(int(available[x]) // n for x, n in uses.items())
            for x, n in uses.items():
                available[x] -= n * times
            patterns.append((tuple(items), times + 1))
    return patterns


class Placement:
    """Where the piece of a given length and rank goes: a sequence and an offset there."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]], groups: list[tuple[int, int, int]], capacity: int) -> None:
        """groups: (length, salt, pieces of both)."""
        taken, rows, base = Counter(), [], 0
        for items, times in patterns:
            offset = 0
            for x in items:
                rows.append((x, taken[x], base, offset))
                taken[x] += times
                offset += x
            base += times
        rows.sort()
        self.length, self.first, self.base, self.offset = np.array(rows, np.int64).reshape(-1, 4).T
        self.sequences = base
        salts, before = Counter(), {}
        for length, salt, n in sorted(groups):
            before[length, salt] = salts[length]
            salts[length] += n
        self.at = np.zeros(capacity + 2, np.int64)
        most = Counter()
        for length, salt in before:
            most[length] = max(most[length], salt + 1)
        self.at[1:] = np.cumsum([most[x] for x in range(capacity + 1)])
        self.before = np.zeros(self.at[-1], np.int64)
        for (length, salt), n in before.items():
            self.before[self.at[length] + salt] = n
        self.starts = np.searchsorted(self.length, np.arange(capacity + 2))

    def place(self, length: np.ndarray, salt: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """number: from 1 within the length and salt."""
        rank = self.before[self.at[length] + salt] + number - 1
        wide = np.int64(1) << np.int64(44)  # ranks of a length stay below
        found = np.searchsorted(self.length * wide + self.first, length * wide + rank, side="right") - 1
        return self.base[found] + rank - self.first[found], self.offset[found]


def pack(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset, in as few sequences of capacity as the plan finds.

    Only the counts of lengths and of salted groups of them reach the driver: 4096 + capacity
    rows at most for the defaults. `order` names columns that tell pieces apart; rows equal in
    all of them are interchangeable. A hot length is ranked in as many salted groups as its
    share asks for. An empty table gives no rows.
    """
    spark, names = pieces.sparkSession, pieces.columns
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    each = -(-sum(counts.values()) // SALTS) or 1
    salts = spark.createDataFrame([(x, -(-n // each)) for x, n in counts.items()], "__length long, __salts long")
    salted = (
        pieces.join(F.broadcast(salts), pieces["length"] == salts["__length"])
        .withColumn("__salt", F.pmod(F.xxhash64(*order), "__salts"))
        .drop("__length", "__salts")
    )
    groups = [tuple(r) for r in salted.groupBy("length", "__salt").agg(F.count("*").alias("n")).collect()]
    placement = Placement(plan_sequences(counts, capacity), groups, capacity)

    @F.arrow_udf("sequence_id long, offset long")
    def place(length: pa.Array, salt: pa.Array, number: pa.Array) -> pa.Array:
        out = placement.place(*(x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, salt, number)))
        return pa.StructArray.from_arrays([pa.array(x) for x in out], names=["sequence_id", "offset"])

    ranked = salted.withColumn("__number", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)))
    return ranked.withColumn("__p", place("length", "__salt", "__number")).select(*names, "__p.sequence_id", "__p.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    Ids are those of the plain call: an added token's exact string in a text gives that token. Null
    and empty texts are one piece, the end id alone. Repeated rows are packed as often as
    they come. Other columns are ignored.
    """
    pieces = cut(cut_pieces(docs, tokenizer_path, end_id, capacity))
    return pack(pieces, capacity, ["doc_id", "piece", "start", "ids_crc32"])
