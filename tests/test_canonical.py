"""Canonical keys: relabelled copies agree, other graphs don't."""

import itertools
import random

import pytest

from quorumlab.operators import canonical
from quorumlab.operators.canonical import canonical_keys, policy_keys, policy_merges

NODES, BONDS = "graph string, node int, label string", "graph string, src int, dst int, bond int"


def keys(spark, graphs):
    """graphs: name -> (labels by node, bonds)."""
    nodes = spark.createDataFrame([(g, v, x) for g, (labels, _) in graphs.items() for v, x in labels.items()], NODES)
    bonds = spark.createDataFrame([(g, *b) for g, (_, edges) in graphs.items() for b in edges], BONDS)
    return {r["graph"]: r["key"] for r in canonical_keys(nodes, bonds).collect()}


def renamed(labels, edges, rng):
    names = list(labels)
    to = dict(zip(names, rng.sample(range(1000), len(names))))
    shuffled = [(to[b], to[a], k) if rng.random() < 0.5 else (to[a], to[b], k) for a, b, k in edges]
    rng.shuffle(shuffled)
    return {to[v]: x for v, x in labels.items()}, shuffled


def ring(n, label="C", bond=1):
    return dict.fromkeys(range(n), label), [(i, (i + 1) % n, bond) for i in range(n)]


def test_copies_agree_and_others_do_not(spark):
    rng = random.Random(4)
    two_triangles = (dict.fromkeys(range(6), "C"), [(0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1)])
    prism = (dict.fromkeys(range(6), "C"), [(0, 1, 1), (1, 2, 1), (2, 0, 1), (3, 4, 1), (4, 5, 1), (5, 3, 1), (0, 3, 1), (1, 4, 1), (2, 5, 1)])
    bipartite = (dict.fromkeys(range(6), "C"), [(a, b, 1) for a in range(3) for b in range(3, 6)])  # as regular as the prism
    star = ({0: "C"} | dict.fromkeys(range(1, 5), "F"), [(0, i, 1) for i in range(1, 5)])
    chain = ({0: "C", 1: "C", 2: "O", 3: None}, [(0, 1, 1), (1, 2, 2), (2, 3, 1)])
    base = {
        "ring6": ring(6), "triangles": two_triangles, "prism": prism, "bipartite": bipartite, "star": star, "chain": chain, "ringO": ({**ring(6)[0], 3: "O"}, ring(6)[1]),
        "mixed": (ring(6)[0], [(i, (i + 1) % 6, 1 + i % 2) for i in range(6)]), "one": ({7: "N"}, []), "two": ({7: "N", 8: "N"}, []), "otherchain": ({0: "C", 1: "C", 2: "O", 3: None}, [(0, 1, 2), (1, 2, 1), (2, 3, 1)]),
    }
    graphs = {f"{name}{i}": (g if not i else renamed(*g, rng)) for name, g in base.items() for i in range(3)}
    got = keys(spark, graphs)
    for a, b in itertools.combinations(graphs, 2):
        assert (got[a] == got[b]) == (a.rstrip("012") == b.rstrip("012")), (a, b)


def test_random_graphs_against_all_orders(spark):
    rng = random.Random(6)
    graphs, least = {}, {}
    for i in range(40):
        n = rng.randrange(2, 6)
        labels = {v: rng.choice("CO") for v in range(n)}
        edges = [(a, b, rng.choice([1, 2])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        graphs[f"g{i}"] = renamed(labels, edges, rng)
        texts = []
        for order in itertools.permutations(range(n)):
            at = {v: k for k, v in enumerate(order)}
            texts.append((tuple(labels[v] for v in order), tuple(sorted((min(at[a], at[b]), max(at[a], at[b]), k) for a, b, k in edges))))
        least[f"g{i}"] = min(texts)
    got = keys(spark, graphs)
    for a, b in itertools.combinations(graphs, 2):
        assert (got[a] == got[b]) == (least[a] == least[b])


def test_odd_rows_and_policies(spark):
    nodes = spark.createDataFrame([("a", 1, "C", "C@"), ("a", 2, "O", "O"), ("b", 5, "O", "O"), ("b", 6, "C", "C"), ("c", 1, "C", "C"), (None, 1, "C", "C"), ("c", None, "C", "C"), ("a", 1, "C", "C@")], "graph string, node int, label string, marked string")
    bonds = spark.createDataFrame([("a", 1, 2, 1), ("a", 2, 1, 1), ("b", 5, 6, 1), ("b", 5, 5, 1), ("b", 5, 9, 1), ("c", None, 1, 1), ("z", 1, 2, 1)], "graph string, src int, dst int, bond int")
    found = policy_keys(nodes, bonds, {"marked": ("marked", "bond"), "plain": ("label", "bond")})
    rows = {r["graph"]: r for r in found.collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"]["plain"] == rows["b"]["plain"] != rows["c"]["plain"] and rows["a"]["marked"] != rows["b"]["marked"]
    merges = {r["policy"]: (r["n_keys"], r["n_merged"], r["largest"]) for r in policy_merges(found, ["marked", "plain"]).collect()}
    assert merges == {"marked": (3, 0, 1), "plain": (2, 1, 2)}
    assert canonical_keys(nodes.limit(0), bonds).count() == 0


def test_rounds_are_gone_through_by_distinct_texts(spark, monkeypatch):
    seen, refined = [], canonical._refined
    monkeypatch.setattr(canonical, "_refined", lambda nodes, bonds: seen.append(nodes.count()) or refined(nodes, bonds))
    graphs = {f"g{i}": ({10 * i + v: x for v, x in enumerate("CCO")}, [(10 * i, 10 * i + 1, 1), (10 * i + 1, 10 * i + 2, 2)]) for i in range(50)}
    got = keys(spark, graphs | {"turned": ({1: "O", 2: "C", 3: "C"}, [(1, 2, 2), (3, 2, 1)])})
    assert len(set(got.values())) == 1 and len(got) == 51 and seen == [6]
