"""Connected components by contraction in tasks and star steps; spanning forests, and components at every threshold cut from one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quorumlab.session import cut


#: Edges that a task contracts at once; bounds its memory.
EDGES_AT_ONCE = 1 << 20
#: Keys over which the edges of one node are spread.
SALTS = 32


def _state(edges: DataFrame) -> tuple[int, int, bool]:
    """How many edges, a sum of their hashes, and whether one task had all of them at once."""
    marked = edges.select(F.xxhash64("hi", "lo").alias("h"), F.spark_partition_id().alias("p"), "whole")
    row = marked.agg(F.count("*").alias("n"), F.bit_xor("h").alias("h"), F.min("p").alias("p0"), F.max("p").alias("p1"), F.bool_and("whole").alias("w")).first()
    return row["n"], row["h"] or 0, row["p0"] == row["p1"] and bool(row["w"] or not row["n"])


def _codes(a: pa.Array, b: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct nodes, ascending, and both ends as places among them."""
    both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    order = pc.sort_indices(both.dictionary)
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    u, v = np.split(place[both.indices.to_numpy(zero_copy_only=False)], [len(a)])
    return both.dictionary.take(order), u, v


def stars(hi: pa.Array, lo: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The same components as edges from each node to its component's smallest."""
    values, u, v = _codes(hi, lo)
    root = np.arange(len(values))
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a root hangs under a smaller one
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    hung = np.flatnonzero(root != np.arange(len(root)))
    return values.take(pa.array(hung)), values.take(pa.array(root[hung]))


def _contracted(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars: not more edges, and the same components.

    EDGES_AT_ONCE at a time; stars that leave room meet the next edges. whole: the task's stars were made of all its edges.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sent = [], 0, False
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES_AT_ONCE:
                made = contracted(held)
                held, size = [made], made.num_rows
                if 2 * size > EDGES_AT_ONCE:
                    yield marked(made, False)
                    held, size, sent = [], 0, True
        if size:
            yield marked(contracted(held), not sent)

    def contracted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        hi, lo = (table.column(i).chunk(0) for i in (0, 1))
        return pa.RecordBatch.from_arrays(list(stars(hi, lo)), schema=table.schema)

    def marked(made: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*made.columns, pa.array([whole] * made.num_rows, pa.bool_())], ["hi", "lo", "whole"])

    kinds = dict(edges.dtypes)
    return edges.mapInArrow(contract, f"hi {kinds['hi']}, lo {kinds['lo']}, whole boolean")


def _with_least(rows: DataFrame, key: str, value: str) -> DataFrame:
    """rows with m, the least value of the key: a key's rows are spread over salts, and its least is sent to each."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)))
    least = salted.groupBy(key, "salt").agg(F.min(value).alias("m")).groupBy(key).agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts"))
    return salted.join(least.select(key, "m", F.explode("salts").alias("salt")), [key, "salt"]).drop("salt")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Nodes are numbers or strings. Each task first contracts the edges that it holds to stars. If fewer than EDGES_AT_ONCE
    are left, one task contracts them all at once, which settles them. Otherwise rounds follow until nothing changes or one task can: all neighbours of a
    node hang under the smallest one (large star), then all smaller neighbours under the smallest
    (small star), then tasks contract again. Edges never outgrow their number at the start, rounds
    grow with the logarithm of the diameter, and every round is cut by a checkpoint. A node's
    edges are spread over SALTS keys in both steps, so no task takes all of a hub's. Nulls and loops are dropped;
    no edges give an empty frame.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y))
    e = cut(_contracted(e.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct()))
    state = _state(e)
    for _ in range(max_rounds):
        if state[2]:
            break
        if state[0] < EDGES_AT_ONCE:
            e = cut(_contracted(e.select("hi", "lo").coalesce(1)))
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("hi"), F.least("u", "m").alias("lo")).distinct()
        small = _with_least(large, "hi", "lo").select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        e = cut(_contracted(small.distinct()))
        if (now := _state(e))[:2] == state[:2]:
            break
        state = now
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(roots)


def forest_rows(a: pa.Array, b: pa.Array, w: np.ndarray) -> np.ndarray:
    """Which edges make the minimum spanning forest; equal weights are told apart by their ends.

    In each round every tree takes its first edge to another tree in that order; a round at least halves the trees that still
    have such an edge.
    """
    _, u, v = _codes(a, b)
    n = int(max(u.max(initial=-1), v.max(initial=-1))) + 1
    order = np.lexsort((np.maximum(u, v), np.minimum(u, v), w))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root, chosen, left = np.arange(n), np.zeros(len(u), bool), np.flatnonzero(u != v)
    while len(left):
        x, y = root[u[left]], root[v[left]]
        apart = x != y
        left, x, y = left[apart], x[apart], y[apart]
        first = np.full(n, len(u), np.int64)
        for end in (x, y):
            np.minimum.at(first, end, rank[left])
        took = np.unique(first[first < len(u)])
        picked = order[took]
        chosen[picked] = True
        s, t = root[u[picked]], root[v[picked]]
        while len(s):  # hang the trees together
            i, j = root[s], root[t]
            far = i != j
            s, t, i, j = s[far], t[far], i[far], j[far]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return np.flatnonzero(chosen)


def _thinned(edges: DataFrame) -> DataFrame:
    """Each task's edges without those that its own spanning forest can do without: no forest of all edges has these."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, sent = [], 0, False
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES_AT_ONCE:
                kept = thinned(held)
                held, size = [kept], kept.num_rows
                if 2 * size > EDGES_AT_ONCE:
                    yield marked(kept, False)
                    held, size, sent = [], 0, True
        if size:
            yield marked(thinned(held), not sent)

    def thinned(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        a, b, w = (table.column(i).chunk(0) for i in range(3))
        return table.take(pa.array(forest_rows(a, b, w.to_numpy(zero_copy_only=False)))).combine_chunks().to_batches()[0] if len(table) else held[0]

    def marked(kept: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array([whole] * kept.num_rows, pa.bool_())], ["a", "b", "w", "whole"])

    kinds = dict(edges.dtypes)
    return edges.select("a", "b", "w").mapInArrow(thin, f"a {kinds['a']}, b {kinds['b']}, w double, whole boolean")


def minimum_spanning_forest(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "w") -> DataFrame:
    """(a, b, w), a < b: the edges of the minimum spanning forest, equal weights told apart by their ends.

    Tasks drop what their own forest can do without. What one task then can't hold at once goes through rounds: each tree takes its lightest edge
    to another tree (the least is found with a partial aggregate, so a hub needs no task of its own), trees that this links become one, and of
    parallel edges between two trees the lightest stays. A round at least halves the trees. Nulls, NaN weights and loops are dropped.
    """
    x, y, w = F.col(a), F.col(b), F.col(weight).cast("double")
    clean = edges.where(x.isNotNull() & y.isNotNull() & (x != y) & w.isNotNull() & ~F.isnan(w))
    e = clean.groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.min(w).alias("w"))
    thin, found = cut(_thinned(e)), None
    where = thin.select("whole", F.spark_partition_id().alias("p")).agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.bool_and("whole").alias("whole")).first()
    if where["p0"] == where["p1"] and where["whole"] is not False:
        return thin.select("a", "b", "w")
    left = thin.select("a", "b", "w", F.col("a").alias("s"), F.col("b").alias("t"))  # s, t: the trees of a and b
    while left.limit(1).count():
        e = F.struct("w", "a", "b").alias("e")
        ends = left.select(F.col("s").alias("tree"), e).unionAll(left.select(F.col("t").alias("tree"), e))
        took = cut(ends.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct().join(left.select("a", "b", "s", "t"), ["a", "b"]))
        found = took.select("a", "b", "w") if found is None else cut(found.unionAll(took.select("a", "b", "w")))
        trees = cut(connected_components(took, "s", "t"))
        moved = left
        for end in ("s", "t"):
            moved = moved.join(trees.select(F.col("node").alias(end), "component"), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
        between = moved.where("s <> t").groupBy(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.min(e).alias("e"))
        left = cut(between.select("e.a", "e.b", "e.w", "s", "t"))
    return found


def components_at(forest: DataFrame, nodes: DataFrame, thresholds: list[float], node: str = "node") -> DataFrame:
    """(node, components): for each threshold, in the given order, the component that edges strictly below it make.

    forest(a, b, w) is a spanning forest, so cutting it gives the components of the whole graph. Thresholds are worked upwards: each takes
    only the edges since the one before, with their ends already replaced by components, so an edge is used once and the graph is
    never copied for a threshold. Nodes without edges are components of their own.
    """
    steps = sorted(set(map(float, thresholds)))
    place = [steps.index(float(x)) for x in thresholds]
    every = nodes.select(F.col(node).alias("node")).where("node is not null").distinct()
    kind = dict(every.dtypes)["node"]
    first = F.expr(f"size(filter(array({', '.join(f'{x}D' for x in steps)}), x -> x <= w))")
    forest = forest.select("a", "b", "w", first.alias("k")).where(F.col("k") < len(steps))
    used = {r["k"]: r["n"] for r in forest.groupBy("k").agg(F.count("*").alias("n")).collect()}  # a row for each threshold
    if sum(used.values()) < EDGES_AT_ONCE:

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks() if (held := list(batches)) else None
            for k in range(len(steps)) if table else ():
                some = table.filter(pc.less_equal(table.column("k"), k)).combine_chunks()
                if len(some):
                    hung, under = stars(some.column("b").chunk(0), some.column("a").chunk(0))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(hung), pa.int32()), hung, under], ["k", "hung", "under"])

        found = forest.coalesce(1).mapInArrow(each, f"k int, hung {kind}, under {kind}")
        maps = found.groupBy("hung").agg(F.map_from_entries(F.collect_list(F.struct("k", "under"))).alias("m"))  # an entry for each threshold
        joined = every.join(maps, F.col("node") == F.col("hung"), "left")
        return joined.select(F.col("node").alias(node), F.array(*[F.coalesce(F.try_element_at("m", F.lit(i)), "node") for i in place]).alias("components"))
    labels = every.withColumn("at", F.array().cast(f"array<{kind}>")).withColumn("now", F.col("node"))
    for k in range(len(steps)):
        if used.get(k):
            of = lambda end: labels.select(F.col("node").alias(end), F.col("now").alias(f"_{end}"))
            linked = connected_components(forest.where(F.col("k") == k).join(of("a"), "a").join(of("b"), "b"), "_a", "_b").withColumnRenamed("node", "now")
            labels = labels.join(linked, "now", "left").withColumn("now", F.coalesce("component", "now")).drop("component")
        labels = labels.withColumn("at", F.concat("at", F.array("now")))
        labels = cut(labels) if used.get(k) else labels
    return labels.select(F.col("node").alias(node), F.array(*[F.col("at")[i] for i in place]).alias("components"))


def pass_messages(nodes: DataFrame, edges: DataFrame, mean: bool = False) -> DataFrame:
    """(node, x): for each node the sum, or mean, of its in-neighbours' vectors.

    nodes(node, x array) and edges(src, dst). Elements are summed by position with a partial
    aggregate before the shuffle, so a node of very many neighbours needs no task of its own. Nodes
    without neighbours keep no row.
    """
    sent = edges.join(nodes, edges["src"] == nodes["node"]).select("dst", F.posexplode("x").alias("i", "v"))
    how = F.avg if mean else F.sum
    cells = sent.groupBy("dst", "i").agg(how("v").alias("v"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return cells.groupBy("dst").agg(F.transform(ordered, lambda c: c["v"]).alias("x")).withColumnRenamed("dst", "node")
