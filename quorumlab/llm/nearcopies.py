"""Near copies: candidates by SimHash blocks and by prefixes, thinned by sketches, links by the exact Jaccard similarity of sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.simhash import SEED, bit_counts_of, fingerprint_links, majority, shingle_hashes
from quorumlab.llm.workers import release_kept
from quorumlab.operators.graph import connected_components
from quorumlab.session import Scratch, cut

#: Rows whose shingles are counted to learn which are common: so many and such a share at least, so that what the counts miss doesn't grow with the table.
SAMPLE, SHARE = 8192, 1 / 16
#: How often a shingle must occur there, how many are remembered, and the count from which no more is told apart to choose them.
COMMON_FROM, MOST_COMMON, HIGHEST = 2, 1 << 20, 1 << 16
#: Bits of a set's sketch: a power of two from its size on, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Sets in a bucket up to which all its pairs are candidates at once; a larger bucket gives rows in proportion to its size.
SMALL_RUN = 3
#: Times that each set of a large bucket meets two others there before those still apart all meet.
ROUNDS = 1
#: Candidate pairs that a task holds at once to give each of them once.
PAIRS_AT_ONCE = 1 << 18
#: Sets of texts that a task remembers between the pairs it verifies.
SETS_HELD = 256
#: Hashes of texts or sets that a task remembers, so as to give each of them once.
HASHES_REMEMBERED = 1 << 17
#: Nodes up to which a list of them (8 bytes each) is broadcast.
BROADCAST_ROWS = 1 << 20


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    parts = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _digest(hashes: np.ndarray) -> int:
    """A set's identity as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _sketch(hashes: np.ndarray) -> bytes:
    """For each value of the hashes' low bits, whether an odd number of the set has it. Sketches of x and y differ in as many bits as x and y in elements, at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(hashes) - 1).bit_length())) if len(hashes) else LEAST_BITS
    return np.packbits(np.bincount((hashes & np.uint64(bits - 1)).view(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _bits_apart(x: list[bytes], y: list[bytes]) -> np.ndarray:
    """In how many bits each two sketches differ; the longer is folded to the length of the other."""
    n, m = (np.fromiter(map(len, side), np.int64, len(side)) for side in (x, y))
    out = np.empty(len(x), np.int64)
    for i, j in set(zip(n.tolist(), m.tolist(), strict=True)):
        at = np.flatnonzero((n == i) & (m == j))
        u, v = (np.bitwise_xor.reduce(np.frombuffer(b"".join([side[k] for k in at]), np.uint8).reshape(len(at), -1, min(i, j)), axis=1) for side in (x, y))
        out[at] = np.bitwise_count(u ^ v).sum(axis=1)
    return out


def _most_common(docs: DataFrame, words: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that are common in a sample of the rows, sorted, and how often each occurs; MOST_COMMON at most, the most frequent."""
    share = min(1.0, max(SHARE, SAMPLE / max(1, docs.count())))
    picked = docs.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingle_set(t, words) for t in batch.column(0).slice(at, 512).to_pylist()]
                h, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    found = scratch.keep(picked.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_FROM))
    levels = found.groupBy(F.least("n", F.lit(HIGHEST)).alias("n")).agg(F.count("*").alias("m")).collect()  # HIGHEST rows at most
    least, rows = HIGHEST + 1, 0
    for level in sorted(levels, key=lambda r: -r["n"]):
        if (rows := rows + level["m"]) > MOST_COMMON:
            break
        least = level["n"]
    found = found.where(F.col("n") >= least).toArrow()  # MOST_COMMON rows at most
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest shingles of a set, so many that sets of the similarity share one of them at least.

    Sets of that similarity share ceil(similarity * n) of either's n shingles at least, so in any order that
    is the same for all sets, they share one of the first n - ceil(similarity * n) + 1 of each.
    """
    known, often = common
    if not len(hashes):
        return hashes
    n = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        n = np.where(known[at] == hashes, often[at], 0)
    return hashes[np.argsort(n, kind="stable")[: len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-9)) + 1]]


def _possible(n: np.ndarray, place: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets x and y can have the similarity if the shingle at these places is the first that they share.

    What is left out here can only be a pair that isn't similar, or that another shingle, the first one shared, brings up.
    """
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    rest = np.minimum(n[x] - place[x], n[y] - place[y])
    return (small >= similarity * large - 1e-6) & (rest * (1 + similarity) >= similarity * (small + large) - 1e-6)


def _run_bounds(run: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))


def _first_pairs(run: np.ndarray, n: np.ndarray, place: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of candidate pairs in runs sorted by n, and of the rows of long runs.

    A short run gives all its pairs. A long one gives the pairs with its smallest set, then with the smallest
    too large for that one, and so on; the others wait until it is known what these pairs join.
    """
    bounds = _run_bounds(run)
    sizes = np.diff(bounds)
    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes))
    end = np.repeat(bounds[1:], sizes)[at]
    src, dst, long_ = [], [], []
    for d in range(1, min(SMALL_RUN, int(sizes.max(initial=1)))):
        x = at[at + d < end]
        y = x + d
        ok = _possible(n, place, x, y, similarity)
        src.append(x[ok])
        dst.append(y[ok])
    for i in np.flatnonzero(sizes > SMALL_RUN):
        centre, stop = bounds[i], bounds[i + 1]
        long_.append(np.arange(centre, stop))
        while centre < stop:
            to = bounds[i] + int(np.searchsorted(n[bounds[i] : stop], n[centre] / similarity + 1e-6, "right"))
            y = np.arange(centre + 1, to)
            y = y[_possible(n, place, np.full(len(y), centre), y, similarity)]
            src.append(np.full(len(y), centre))
            dst.append(y)
            centre = max(to, centre + 1)
    empty = [np.empty(0, np.int64)]
    return np.concatenate(src or empty), np.concatenate(dst or empty), np.concatenate(long_ or empty)


def _other_pairs(run: np.ndarray, n: np.ndarray, place: np.ndarray, label: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the candidate pairs of each run that aren't yet in one group."""
    src, dst, bounds = [], [], _run_bounds(run)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        groups, which, count = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
        if len(groups) < 2:
            continue
        largest = which == count.argmax()
        for i in np.flatnonzero(~largest):
            others = (which != which[i]) & largest
            others[i + 1 :] |= which[i + 1 :] != which[i]
            y = lo + np.flatnonzero(others)
            x = np.full(len(y), lo + i)
            ok = _possible(n, place, x, y, similarity)
            src.append(x[ok])
            dst.append(y[ok])
    empty = [np.empty(0, np.int64)]
    return np.concatenate(src or empty), np.concatenate(dst or empty)


def _few_pairs(run: np.ndarray, n: np.ndarray, place: np.ndarray, node: np.ndarray, label: np.ndarray, turn: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of two candidate pairs at most for each row, of sets that aren't yet in one group, whatever the size of a run.

    A row meets the one beside it in an order of its own for each run and turn, and one of its run's middle: the row that
    comes at this turn by the share of rarer shingles before its place. Sets with few shingles of their own are most similar to all.
    """
    mixed = (node.view(np.uint64) ^ run.view(np.uint64) ^ np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    order = np.lexsort((mixed, run))
    bounds = _run_bounds(run)
    sizes = np.diff(bounds)
    middle = np.lexsort((node, place / n, run))[bounds[:-1] + np.minimum(turn, sizes - 1)]
    x, y = np.concatenate((order[:-1], np.repeat(middle, sizes))), np.concatenate((order[1:], np.arange(len(run))))
    apart = (run[x] == run[y]) & (label[x] != label[y])
    x, y = x[apart], y[apart]
    ok = _possible(n, place, x, y, similarity)
    return x[ok], y[ok]


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of the first column, a batch or more at a time."""
    held = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(width)]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if len(cols[0]):
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last run may go on in the next batch
            held = [c[last:] for c in cols]
            if last:
                yield [c[:last] for c in cols]
    if held is not None:
        yield held


class _Pairs:
    """Gathers pairs of nodes, the smaller first, and gives each once in PAIRS_AT_ONCE."""

    def __init__(self) -> None:
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        self.held.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
        self.size += len(a)
        return self.take() if self.size >= PAIRS_AT_ONCE else None

    def take(self) -> np.ndarray | None:
        out = np.concatenate(self.held) if self.held else np.empty((0, 2), np.int64)
        self.held, self.size = [], 0
        if not len(out):
            return None
        out = out[np.lexsort((out[:, 1], out[:, 0]))]
        return out[np.concatenate(([True], (out[1:] != out[:-1]).any(axis=1)))]


def _alike(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs(a, b, ...) whose sketches, of nodes(node, n, sketch), allow the similarity.

    Sets of it differ in (1 - similarity) / (1 + similarity) of their summed sizes at most, and their sketches in no more bits: no similar pair is left out.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            apart = _bits_apart(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())
            yield batch.select(pairs_columns).filter(pa.array(apart * (1 + similarity) <= (1 - similarity) * n + 1e-6))

    pairs_columns, kinds = pairs.columns, ", ".join(f"{c} {kind}" for c, kind in pairs.dtypes)
    one, two = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select(*pairs_columns, "na", "nb", "sa", "sb").mapInArrow(check, kinds)


def _texts_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text): one text, compressed, of each of the nodes(node, text_hash) in pairs(a, b).

    Where these are few (BROADCAST_ROWS, checked), other texts are left out before the shuffle. A task
    gives a text once, so that copies of one text don't meet in a task by their number.
    """
    met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = scratch.keep(nodes.join(met, "node", "left_semi").select("node", "text_hash"))
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted.select("text_hash")), "text_hash", "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            hashes, fresh = batch.column(0).to_pylist(), []
            for i, h in enumerate(hashes):
                if h not in seen:
                    fresh.append(i)
                    seen.add(h)
            if len(seen) >= HASHES_REMEMBERED:
                seen.clear()
            texts = batch.column(1).take(pa.array(fresh, pa.int64())).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i in fresh], pa.int64()), pa.array([press.compress(t or b"") for t in texts], pa.binary())], names=["text_hash", "text"])

    packed = texts.mapInArrow(pack, "text_hash long, text binary")
    return scratch.keep(packed.join(wanted, "text_hash").groupBy("text_hash", "node").agg(F.first("text").alias("text")).select("node", "text"))


def _similar_pairs(pairs: DataFrame, texts: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Those of pairs(a, b) whose whole shingle sets, of texts(node, text), have the similarity."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        unpress = zstandard.ZstdDecompressor()

        def of(node: int, text: pa.Scalar) -> np.ndarray:
            if node not in sets:
                if len(sets) >= SETS_HELD:
                    sets.clear()
                sets[node] = shingle_set(unpress.decompress(text.as_py()), words)
            return sets[node]

        for batch in batches:
            kept = []
            for i, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                x, y = of(a, batch.column(2)[i]), of(b, batch.column(3)[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    one, two = (texts.select(F.col("node").alias(c), F.col("text").alias(t)) for c, t in (("a", "ta"), ("b", "tb")))
    return scratch.keep(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long"))


def _simhash_pairs(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints lie within the radius: fingerprints that share blocks, verified, as in
    simhash.fingerprint_links, and sets of one fingerprint with the smallest of them."""
    by_print = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    same = nodes.join(by_print, "fp").where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    near = fingerprint_links(by_print.select("fp"), radius)
    for end in ("a", "b"):
        near = near.join(by_print.select(F.col("fp").alias(end), F.col("rep").alias(f"{end}_rep")), end).drop(end)
    both = same.unionAll(near.select("a_rep", "b_rep"))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs(a, b) that groups(node, component) have already joined."""
    for end in ("a", "b"):
        pairs = pairs.join(groups.select(F.col("node").alias(end), F.col("component").alias(f"{end}_group")), end)
    return pairs.where("a_group = b_group").select("a", "b")


def _labelled(docs: DataFrame, words: int, similarity: float, radius: int, scratch: Scratch) -> DataFrame:
    """(doc_id, text_hash, kept), to be read while the scratch tables are there: kept is the (none, doc_id, text_hash) of the one document of its group that stays.

    Groups are of documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, chained.

    Exact, on hashes of 64 bits: no pair of that similarity is missed and none below it links. Equal sets are one
    node. Candidates come from the SimHash of each text first: fingerprints within `radius` bits by shared blocks.
    Sets of the similarity can lie much further apart than any radius that blocks can cover, so a node also goes to
    the bucket of each shingle of its prefix (see _prefix); what meets there, may be similar and isn't yet in one
    group is a candidate too. Candidates whose sketches differ too much go (see _alike), all others' texts are compared as whole sets. Large buckets are gone through
    several times: first with one set of theirs, then each set with two others that the links found so far have not
    joined to it, at last all that is still apart, so a dense group never becomes all its pairs. Null and empty texts have the empty set, one node that links to no other.
    """
    common = docs.sparkSession.sparkContext.broadcast(_most_common(docs, words, scratch))  # bounded by MOST_COMMON
    kind = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, node, n, sketch = batch.slice(at, 512), [], [], []

                def hashes(texts: list[bytes | None]) -> Iterator[np.ndarray | None]:
                    for text in texts:
                        pieces = list(shingle_hashes(text, words))
                        s = np.unique(np.concatenate(pieces)) if pieces else np.empty(0, np.uint64)
                        node.append(_digest(s))
                        n.append(len(s))
                        sketch.append(_sketch(s))
                        yield from pieces
                        yield None

                fp = majority(*bit_counts_of(hashes(part.column(2).to_pylist())))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node, pa.int64()), pa.array(fp), pa.array(n, pa.int64()), pa.array(sketch, pa.binary())], names=["doc_id", "text_hash", "node", "fp", "n", "sketch"])

    prints = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    prints = scratch.keep(prints.mapInArrow(describe, f"doc_id {kind}, text_hash long, node long, fp long, n long, sketch binary"))
    nodes = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("least"), F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    nodes = scratch.keep(nodes)
    close = scratch.keep(_simhash_pairs(nodes, radius))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                token, node, size = [], [], []
                for text in batch.column(0).slice(at, 512).to_pylist():
                    s = shingle_set(text, words)
                    if (name := _digest(s)) not in seen:  # a task gives the prefix of a set once
                        seen.add(name)
                        token.append(_prefix(s, common.value, similarity).view(np.int64))
                        node.append(np.full(len(token[-1]), name))
                        size.append((np.int64(len(s)) << 32) | np.arange(len(token[-1])))
                if len(seen) >= HASHES_REMEMBERED:
                    seen.clear()
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, size, node)], names=["token", "size", "node"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pairs = ["token", "a", "b", "size"], _Pairs()

        def batch_of(p: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            if p is not None:
                none = pa.nulls(len(p), pa.int64())
                yield pa.RecordBatch.from_arrays([none, pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy()), none], names=names)

        for token, size, node in _runs(batches, 3):
            fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (size[1:] != size[:-1]) | (node[1:] != node[:-1])))  # copies of one set
            token, size, node = (c[fresh] for c in (token, size, node))
            x, y, long_ = _first_pairs(token, size >> 32, size & 0xFFFFFFFF, similarity)
            yield from batch_of(pairs.add(node[x], node[y]))
            if len(long_):
                yield pa.RecordBatch.from_arrays([pa.array(token[long_]), pa.array(node[long_]), pa.nulls(len(long_), pa.int64()), pa.array(size[long_])], names=names)
        yield from batch_of(pairs.take())

    def others(turn: int):
        def pairs_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = _Pairs()

            def batch_of(p: np.ndarray | None) -> Iterator[pa.RecordBatch]:
                if p is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], names=["a", "b"])

            for token, size, node, label in _runs(batches, 4):
                n, place = size >> 32, size & 0xFFFFFFFF
                x, y = _few_pairs(token, n, place, node, label, turn, similarity) if turn < ROUNDS else _other_pairs(token, n, place, label, similarity)
                yield from batch_of(pairs.add(node[x], node[y]))
            yield from batch_of(pairs.take())

        return pairs_apart

    dealt = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(spread, "token long, size long, node long")
    found = scratch.keep(dealt.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(first, "token long, a long, b long, size long"))
    asked = scratch.keep(found.where("token is null").select("a", "b").distinct().join(close, ["a", "b"], "left_anti"))
    long_ = found.where("token is not null").select("token", "size", F.col("a").alias("node"))
    alike = scratch.keep(_alike(close.withColumn("by_print", F.lit(True)).unionAll(asked.withColumn("by_print", F.lit(False))), nodes, similarity))
    texts = _texts_of(alike, nodes, docs, scratch)
    links = _similar_pairs(alike.where("by_print"), texts, words, similarity, scratch)
    open_ = alike.where("not by_print").select("a", "b")
    open_ = open_.join(_joined(open_, connected_components(links)), ["a", "b"], "left_anti")
    links = links.unionAll(_similar_pairs(open_, texts, words, similarity, scratch))
    if not long_.isEmpty():
        known = asked.unionAll(close)
        for turn in range(ROUNDS + 1):
            groups = connected_components(links)
            labelled = long_.join(groups, "node", "left").select("token", "size", "node", F.coalesce("component", "node").alias("label"))
            more = labelled.repartition("token").sortWithinPartitions("token", "size", "node").mapInArrow(others(turn), "a long, b long").distinct()
            more = scratch.keep(more.join(known, ["a", "b"], "left_anti"))
            alike, known = scratch.keep(_alike(more, nodes, similarity)), known.unionAll(more)
            if not alike.isEmpty():
                links = links.unionAll(_similar_pairs(alike, _texts_of(alike, nodes, docs, scratch), words, similarity, scratch))
    groups = connected_components(links)
    rooted = scratch.keep(nodes.join(groups, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    return prints.select("doc_id", "text_hash", "node").join(rooted.join(kept, "root").select("node", "kept"), "node").select("doc_id", "text_hash", "kept")


def jaccard_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(doc_id, component_id) of every row, repeated ones too: the smallest doc_id of its group; null if the group has none.

    Null and empty texts share the empty set; very long texts are compared as whole sets; other columns are ignored; an empty table gives no rows.
    """
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        return cut(_labelled(docs, words, similarity, radius, scratch).select("doc_id", F.col("kept.doc_id").alias("component_id")))


def drop_jaccard_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """docs with one row, of the smallest doc_id, left of each group of near copies.

    Texts under one doc_id are judged apart. A group without a doc_id keeps the smallest hash of a text. Of rows that
    repeat the kept doc_id and text one stays, the smallest by all columns written as JSON. Null and empty texts link to
    none but each other's equal sets; very long texts are compared as whole sets; other columns are kept, whatever their names and types; an empty table gives no rows.
    """
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    with Scratch(docs.sparkSession, "near-copies") as scratch:
        rows = _labelled(docs, words, similarity, radius, scratch).groupBy("doc_id", "text_hash").agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
        judged = cut(rows.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text"), stays.alias("__stays"), (F.col("n") > 1).alias("__again")).where("not __stays or __again"))

    def same(of: DataFrame):
        return docs["doc_id"].eqNullSafe(of["__id"]) & (F.xxhash64(docs["text"]) == of["__text"])

    single = docs.join(judged, same(judged), "left_anti")
    again = judged.where("__stays")
    if again.isEmpty():
        return single
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    repeated = docs.join(again, same(again)).groupBy(again["__id"], again["__text"]).agg(F.min_by(row, F.to_json(row)).alias("r"))
    return single.unionByName(repeated.select("r.*"))
