"""Near duplicates by SimHash: pigeonhole blocks, join on blocks, verified Hamming distance."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quorumlab.operators.graph import connected_components
from quorumlab.session import cut

SEED = 42
BITS = 64
#: Hashes counted at once; bounds the memory of a text of any length.
HASHES_AT_ONCE = 1 << 18
#: Rows of a block up to which all its pairs are compared by shifted arrays.
SMALL_RUN = 24
#: Rows of a block from which it is parted further, and how often at most.
LONG_RUN, DEEPEST = 1024, 3


def shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles of a whole text, in arrays of bounded length.

    A-Z are lower-cased; words are runs without ASCII white space; fewer words than asked
    for give one shingle of all of them, and none give nothing.
    """
    parts = (text or b"").lower().split()  # bytes: only A-Z, and only the six ASCII spaces
    if not parts:
        return
    size = min(words, len(parts))
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - size + 1].tolist()
    ends = ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), HASHES_AT_ONCE):
        to = at + HASHES_AT_ONCE
        yield np.array([digest(line[i:j], SEED) for i, j in zip(starts[at:to], ends[at:to], strict=True)], np.uint64)


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each group of hashes; starts begin the groups.

    Eight masks spread the bits over byte lanes, which are summed 255 hashes at a time.
    """
    sizes = np.diff(np.append(starts, len(hashes)))
    pieces = -(-sizes // 255)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))
    inner = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(starts, pieces) + inner * 255
    counts = np.empty((len(starts), BITS), np.int64)
    lane = np.uint64(0x0101010101010101)
    for b in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(b)) & lane, cuts)
        counts[:, b::8] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return counts


def bit_counts_of(hashes: Iterable[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text, which ends with a None: how often each bit is set in its hashes, and how many hashes there are."""
    counts, totals = [], []
    waiting: list[np.ndarray] = []
    owners: list[int] = []
    held = number = 0

    def flush() -> None:
        if waiting:
            starts = np.cumsum([0, *map(len, waiting[:-1])])
            for i, row, n in zip(owners, bit_counts(np.concatenate(waiting), starts), map(len, waiting), strict=True):
                counts[i] += row
                totals[i] += n
        waiting.clear()
        owners.clear()

    for part in hashes:
        if number == len(counts):
            counts.append(np.zeros(BITS, np.int64))
            totals.append(0)
        if part is None:
            number += 1
            continue
        waiting.append(part)
        owners.append(number)
        if (held := held + len(part)) >= HASHES_AT_ONCE:
            flush()
            held = 0
    flush()
    return np.array(counts).reshape(-1, BITS), np.array(totals, np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


def majority(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Fingerprints as int64: a bit is 1 if set in over half the hashes."""
    return _packed(2 * counts > totals[:, None])


def fingerprints(texts: list[bytes | None], words: int) -> np.ndarray:
    """The fingerprint of each text as int64: a bit is 1 if set in over half the shingle hashes."""
    return majority(*bit_counts_of(part for text in texts for part in chain(shingle_hashes(text, words), (None,))))


def fingerprint_column(text: str = "text", words: int = 3):
    """A column expression with the fingerprint (long) of a text column; null texts give 0."""

    @F.arrow_udf("long")
    def compute(batch: pa.Array) -> pa.Array:
        out, step = [], 512
        for at in range(0, len(batch), step):
            out.append(fingerprints(batch.slice(at, step).to_pylist(), words))
        return pa.array(np.concatenate(out) if out else np.empty(0, np.int64))

    return compute(F.col(text).cast("binary"))


def block_masks(radius: int, blocks: int, shared: int) -> list[int]:
    """Masks of all choices of `shared` of the blocks, as signed longs.

    Fingerprints that differ in at most blocks - shared bits agree on one mask at least.
    """
    if blocks - shared < radius:
        raise ValueError(f"{blocks} blocks of which {shared} are shared don't cover a distance of {radius}")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the links among values: each found value takes its unfound neighbours along."""
    rest, src, dst = values, [], []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            v = front.pop()
            near = np.bitwise_count(rest ^ v) <= radius
            if near.any():
                found = rest[near]
                src.append(np.full(len(found), v))
                dst.append(found)
                front.extend(found)
                rest = rest[~near]
    empty = np.empty(0, np.uint64)
    return (np.concatenate(src), np.concatenate(dst)) if src else (empty, empty)


def _parts_of(values: np.ndarray, radius: int) -> list[np.uint64]:
    """Masks that share out the bits in which values differ; values within the radius agree on one mask at least."""
    varying = int(np.bitwise_or.reduce(values ^ values[0]))
    bits = [b for b in range(BITS) if varying >> b & 1]
    return [np.uint64(sum(1 << b for b in bits[i :: radius + 1])) for i in range(radius + 1)] if len(bits) > radius else []


def _links(run: np.ndarray, values: np.ndarray, radius: int, depth: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links within each run of equal block keys: all pairs of a short run, a forest of a long one.

    A very long run is parted first by the bits that still differ in it, so that values without links aren't all compared.
    """
    bounds = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
    sizes = np.diff(bounds)
    src, dst = [], []
    short = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    ids, v = np.repeat(np.arange(len(sizes)), sizes)[short], values[short]
    for d in range(1, min(SMALL_RUN, int(sizes.max(initial=1)))):
        near = (ids[d:] == ids[:-d]) & (np.bitwise_count(v[d:] ^ v[:-d]) <= radius)
        src.append(v[:-d][near])
        dst.append(v[d:][near])
    for i in np.flatnonzero(sizes > SMALL_RUN):
        mine = values[bounds[i] : bounds[i + 1]]
        masks = _parts_of(mine, radius) if len(mine) > LONG_RUN and depth < DEEPEST else []
        for mask in masks:
            key = mine & mask
            order = np.argsort(key, kind="stable")
            s, t = _links(key[order], mine[order], radius, depth + 1)
            src += s
            dst += t
        if not masks:
            s, t = _forest(mine, radius)
            src.append(s)
            dst.append(t)
    return src, dst


def fingerprint_links(nodes: DataFrame, radius: int = 3, blocks: int = 5, shared: int = 2) -> DataFrame:
    """Links (a, b) that join distinct fingerprints within `radius` bits into their components.

    Each fingerprint goes to one bucket per choice of shared blocks; a bucket is streamed as a
    sorted run and gives its verified links, or only a spanning forest of them if it is large,
    so a dense group never becomes all its pairs. Memory: 8 bytes for each row of one bucket.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in block_masks(radius, blocks, shared)])
    keyed = nodes.select("fp", F.posexplode(masks).alias("choice", "mask")).select(F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("block"), "fp")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_run, held = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            run = np.concatenate((held_run, batch.column(0).to_numpy(zero_copy_only=False)))
            values = np.concatenate((held, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
            if not len(run):
                continue
            last = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
            held_run, held = run[last:], values[last:]
            yield from emit(run[:last], values[:last])
        yield from emit(held_run, held)

    def emit(run: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(run):
            src, dst = _links(run, values, radius)
            if sum(map(len, src)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (src, dst)], names=["a", "b"])

    dealt = keyed.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(scan, "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3, blocks: int = 5, shared: int = 2) -> DataFrame:
    """(doc_id, fingerprint long, component_id) of every document of docs(doc_id, text, ...).

    Equal fingerprints collapse to one node before any join, so copies cost nothing further.
    component_id is the smallest doc_id linked directly or over others. Null and empty texts
    have fingerprint 0 and link like any other; a null doc_id is kept and takes no part in
    the minimum; other columns are ignored; an empty table gives no rows.
    """
    prints = cut(docs.select("doc_id", fingerprint_column("text", words).alias("fp")))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(fingerprint_links(nodes, radius, blocks, shared))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
