"""Canonical keys of many labelled graphs at once: colour refinement as rounds of messages, with ties broken by trying each member."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quorumlab.session import cut

#: Rounds after which a graph must have come to rest; a path's colours travel one bond a round.
MOST_ROUNDS = 200


def _hash(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def _refined(nodes: DataFrame, bonds: DataFrame) -> DataFrame:
    """nodes(graph, trial, node, colour) whose colours tell apart all that rounds of messages can: a node's new colour is made of its own
    and the sorted (bond, colour) of its neighbours. Rounds end when no graph gains a colour."""
    count = lambda df: df.select("graph", "trial", "colour").distinct().count()

    def heard(of: DataFrame) -> DataFrame:
        sent = of.select("graph", "trial", F.col("node").alias("src"), F.col("colour").alias("c")).join(bonds, ["graph", "src"])
        around = sent.groupBy("graph", "trial", F.col("dst").alias("node")).agg(F.sort_array(F.collect_list(F.struct("bond", "c"))).alias("around"))
        return of.join(around, ["graph", "trial", "node"], "left").select("graph", "trial", "node", "rest", _hash(F.col("colour"), F.col("around")).alias("colour"))

    nodes = cut(nodes)
    before = count(nodes)
    for _ in range(MOST_ROUNDS // 2):
        nodes = cut(heard(heard(nodes)))  # two rounds for each look at whether anything changed
        if (now := count(nodes)) == before:
            return nodes
        before = now
    raise RuntimeError(f"colours did not come to rest in {MOST_ROUNDS} rounds")


def _written(nodes: DataFrame, bonds: DataFrame, labels: list[str], kinds: list[str]) -> DataFrame:
    """(graph, n_nodes, texts): each graph as it is written, nodes by their places in the order of names; a text for each label and kind of bond.

    nodes(graph, node, labels) and bonds(graph, src, dst, kinds). One shuffle gathers a graph, and its text is made inside its row.
    """
    label = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"l{i}") for i, c in enumerate(labels)]
    kind = [F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(kinds)]
    points = nodes.where("graph is not null and node is not null").select("graph", F.struct("node", *label).alias("point"))
    lines = bonds.where(F.col("graph").isNotNull() & (F.col("src") != F.col("dst"))).select("graph", F.struct("src", "dst", *kind).alias("line"))
    both = points.unionByName(lines, allowMissingColumns=True).groupBy("graph").agg(F.array_sort(F.collect_set("point")).alias("points"), F.collect_set("line").alias("lines"))
    once = F.filter("points", lambda p, i: (i == 0) | (p["node"] != F.get(F.col("points"), i - 1)["node"]))
    both = both.where(F.size("points") > 0).select("graph", once.alias("points"), "lines").withColumn("names", F.col("points.node"))
    place = lambda end: F.array_position("names", end)  # noqa: E731 0 if unknown
    ends = F.transform("lines", lambda x: F.struct(F.least(place(x["src"]), place(x["dst"])).alias("a"), F.greatest(place(x["src"]), place(x["dst"])).alias("b"), *[x[f"k{i}"].alias(f"k{i}") for i in range(len(kinds))]))
    both = both.select("graph", "points", F.filter(ends, lambda x: x["a"] > 0).alias("ends"))
    def text(label: str, kind: str) -> Column:
        bonds = F.transform("ends", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x[kind].alias("bond")))
        return F.to_json(F.struct(F.transform("points", lambda p: p[label]).alias("labels"), F.array_sort(F.array_distinct(bonds)).alias("bonds")))

    texts = [text(f"l{i}", f"k{i}") for i in range(len(labels))]
    return both.select("graph", F.size("points").cast("long").alias("n_nodes"), F.array(*texts).alias("texts"))


def _name(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _keys_of(texts: DataFrame) -> DataFrame:
    """(name, key) of distinct texts of graphs (see _written)."""
    held = cut(texts.distinct()).select(_name(F.col("text")).alias("graph"), F.from_json("text", "labels array<string>, bonds array<struct<a: int, b: int, bond: string>>").alias("g"))
    points = cut(held.select("graph", F.posexplode("g.labels").alias("node", "label")).withColumn("node", F.col("node") + 1))
    given = held.select("graph", F.explode("g.bonds").alias("x")).select("graph", F.col("x.a").alias("src"), F.col("x.b").alias("dst"), F.col("x.bond").alias("bond"))
    both = cut(given.unionByName(given.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), "bond")))
    degree = both.groupBy("graph", F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("next"))
    # What makes nodes of one colour stand for each other: a leaf's only neighbour, or having none.
    rest = F.when(F.col("n").isNull(), "none").when(F.col("n") == 1, F.concat(F.lit("at "), F.col("next").cast("string")))
    state = points.join(degree, ["graph", "node"], "left").select("graph", F.lit("").alias("trial"), "node", rest.alias("rest"), _hash(F.col("label")).alias("colour"))
    done = None
    while True:
        state = _refined(state, both)
        cells = state.groupBy("graph", "trial", "colour").agg(F.count("*").alias("n"), F.countDistinct("rest").alias("rests"), F.count("rest").alias("leaves"), F.min("node").alias("one"))
        first = cells.where("n > 1").groupBy("graph", "trial").agg(F.min("colour").alias("tied"))
        first = cut(first.join(cells.withColumnRenamed("colour", "tied"), ["graph", "trial", "tied"]).select("graph", "trial", "tied", F.when((F.col("rests") == 1) & (F.col("leaves") == F.col("n")), F.col("one")).alias("only")))
        told = state.join(first, ["graph", "trial"], "left_anti").select("graph", "trial", "node", "colour")
        done = told if done is None else done.unionByName(told)
        if first.isEmpty():
            break
        tied = state.join(first, ["graph", "trial"])
        marks = tied.where((F.col("colour") == F.col("tied")) & (F.col("only").isNull() | (F.col("only") == F.col("node")))).select("graph", "trial", F.col("node").alias("mark"))
        tried = tied.select("graph", "trial", "node", "rest", "colour").join(marks, ["graph", "trial"])
        marked = F.when(F.col("node") == F.col("mark"), _hash(F.col("colour"), F.lit("marked"))).otherwise(F.col("colour"))
        state = tried.select("graph", F.concat_ws(",", "trial", F.col("mark").cast("string")).alias("trial"), "node", "rest", marked.alias("colour"))
    return _least_text(cut(done), points, both).select(F.col("graph").alias("name"), "key")


def canonical_keys(nodes: DataFrame, bonds: DataFrame, graph: str = "graph", node: str = "node", label: str = "label", src: str = "src", dst: str = "dst", bond: str = "bond") -> DataFrame:
    """(graph, key, n_nodes): equal keys for graphs that differ in the names of their nodes alone, other keys for others.

    nodes(graph, node, label) and undirected bonds(graph, src, dst, bond), each once in either direction. Graphs that are written alike once their nodes are
    numbered in the order of names have one key, so rounds are gone through by distinct texts alone, all of them at once: colours
    are refined; where several nodes of a graph still share one, the first such colour (an order that names don't touch) is taken and each of its nodes
    marked in a trial of its own, until all trials are told apart. A trial's nodes in the order of their colours give its labels and bonds as a text; the
    least text of a graph is hashed to its key. Equal ends of one neighbour, and equal nodes without one, stand for each other, so only one of these is tried. Trials multiply with
    a graph's other symmetry (equal parts that hang apart, too), not with the number of graphs. A graph is meant to be small (a molecule): it is one row, its text one value. Null labels are a label;
    of a node with several labels the least counts; bonds with an unknown end, and loops, are left out; a graph without bonds has the key of its labels.
    """
    points = nodes.select(F.col(graph).alias("graph"), F.col(node).alias("node"), F.col(label).alias("label"))
    lines = bonds.select(F.col(graph).alias("graph"), F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(bond).alias("bond"))
    written = _written(points, lines, ["label"], ["bond"]).select("graph", "n_nodes", F.col("texts")[0].alias("text"))
    keys = _keys_of(written.select("text"))
    return written.withColumn("name", _name(F.col("text"))).join(keys, "name").select(F.col("graph").alias(graph), "key", "n_nodes")


def _least_text(done: DataFrame, points: DataFrame, both: DataFrame) -> DataFrame:
    """The key of each graph from trials(graph, trial, node, colour) in which every node has a colour of its own."""
    order = done.groupBy("graph", "trial").agg(F.array_sort(F.collect_list("colour")).alias("order"))  # a graph's nodes
    placed = cut(done.join(order, ["graph", "trial"]).select("graph", "trial", "node", F.array_position("order", F.col("colour")).alias("at")))
    labels = placed.join(points, ["graph", "node"]).groupBy("graph", "trial").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("labels"), F.count("*").alias("n_nodes"))
    ends = both.join(placed.withColumnsRenamed({"node": "src", "at": "a"}), ["graph", "src"]).join(placed.withColumnsRenamed({"node": "dst", "at": "b"}), ["graph", "trial", "dst"])
    lines = ends.where("a < b").groupBy("graph", "trial").agg(F.array_sort(F.collect_list(F.struct("a", "b", "bond"))).alias("bonds"))
    text = F.to_json(F.struct("labels", F.coalesce("bonds", F.array().cast("array<struct<a:bigint,b:bigint,bond:string>>")).alias("bonds")))
    texts = labels.join(lines, ["graph", "trial"], "left").select("graph", "n_nodes", text.alias("text"))
    return texts.groupBy("graph").agg(F.sha2(F.min("text"), 256).alias("key"), F.max("n_nodes").alias("n_nodes"))


def policy_keys(nodes: DataFrame, bonds: DataFrame, policies: dict[str, tuple[str, str]]) -> DataFrame:
    """(graph, a key for each policy): a policy names the label of nodes and the kind of bonds that it looks at, so that what it leaves out (a stereo mark,
    an isotope, an order of bonds) merges graphs."""
    names = list(policies)
    written = _written(nodes, bonds, [policies[n][0] for n in names], [policies[n][1] for n in names]).select("graph", "texts")
    keys = _keys_of(written.select(F.explode("texts").alias("text")))  # all policies go through the same rounds
    out = written.select("graph", *[_name(F.col("texts")[i]).alias(f"_{i}") for i in range(len(names))])
    for i, n in enumerate(names):
        out = out.join(keys.select(F.col("name").alias(f"_{i}"), F.col("key").alias(n)), f"_{i}").drop(f"_{i}")
    return out


def policy_merges(keys: DataFrame, policies: list[str]) -> DataFrame:
    """(policy, n_keys, n_merged, largest): distinct keys of each policy, how many keys of the first one it merges away, and its largest group."""
    together = cut(keys.groupBy(*policies).agg(F.count("*").alias("_n")))
    parts = None
    for name in policies:
        sizes = together.groupBy(F.col(name).alias("k")).agg(F.sum("_n").alias("n"), F.countDistinct(policies[0]).alias("m"))
        one = sizes.agg(F.count("*").alias("n_keys"), F.sum(F.col("m") - 1).alias("n_merged"), F.max("n").alias("largest")).select(F.lit(name).alias("policy"), "n_keys", "n_merged", "largest")
        parts = one if parts is None else parts.unionAll(one)
    return parts
