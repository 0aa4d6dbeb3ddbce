"""Registries of methods, featurizers and canonicalizers, and the drivers of experiment grids."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quorumlab.functions import molecules
from quorumlab.operators import models
from quorumlab.operators.ordered import global_running
from quorumlab.operators.splits import draw

SEEDS = [42, 101, 123, 456, 789]
EVAL_SPLITS = ["eval", "ood", "gold", "silver", "bronze"]


def resolve_entry_point(name: str) -> Any:
    """The object that "module:Symbol" names."""
    module, _, symbol = name.partition(":")
    if not symbol:
        raise ValueError(f"{name!r} isn't of the form module:Symbol")
    return getattr(importlib.import_module(module), symbol)


@dataclass
class Method:
    """kind: tree and analytic methods train here; functional and custom ones name an entry point;
    neural ones are registered so that results can be listed, and refuse to train."""

    name: str
    kind: str
    features: list[str] = field(default_factory=list)
    entry_point: str | None = None
    params: dict[str, Any] = field(default_factory=dict)

    def train(self, train: DataFrame, seed: int):
        if self.kind == "tree":
            return models.fit_trees(self.name.removesuffix("_filtered"), train, self.features, seed, self.name.endswith("_filtered"), **self.params)
        if self.kind in ("functional", "custom"):
            if not self.entry_point:
                raise NotImplementedError(f"{self.name} has no entry point")
            return resolve_entry_point(self.entry_point)(train, seed, **self.params)
        raise NotImplementedError(f"{self.name} ({self.kind}) is trained outside this engine; register an entry point of kind functional")


METHODS: dict[str, Method] = {}


def register_method(method: Method) -> Method:
    METHODS[method.name] = method
    return method


for _name in ("gradient_boosting", "random_forest", "decision_tree", "random_forest_filtered"):
    register_method(Method(_name, "tree"))
for _name in ("graph_convolution", "graph_attention", "graph_isomorphism", "merged_graph", "descriptor_network"):
    register_method(Method(_name, "neural"))


def load_params(path: str, name: str) -> dict[str, Any]:
    """A method's tuned parameters from a JSON file; KeyError if missing, but {} for methods from outside."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if name in found:
        return found[name]
    if name in METHODS and METHODS[name].kind in ("functional", "custom"):
        return {}
    raise KeyError(name)


Featurizer = Callable[[pd.Series], pd.Series]
FEATURIZERS: dict[str, Featurizer] = {}
CANONICALIZERS: dict[str, Callable[[pd.Series], pd.Series]] = {"trim": lambda s: s.str.strip(), "upper": lambda s: s.str.strip().str.upper()}


def register_featurizer(name: str, f: Featurizer) -> None:
    """f gives a list of floats for each key (None for an invalid one)."""
    FEATURIZERS[name] = f


def featurizer(name: str) -> Featurizer:
    if name not in FEATURIZERS:
        raise ValueError(f"unknown featurizer {name!r}; known are {sorted(FEATURIZERS)}")
    return FEATURIZERS[name]


def _letter_counts(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else [float(k.count(c)) for c in "BCFINOPS"] + [float(len(k)), float(k.count("=")), float(k.count("("))])


register_featurizer("letter_counts", _letter_counts)


def of_molecules(f: Callable[[molecules.Molecule], list]) -> Featurizer:
    """A featurizer of keys that are SMILES; None for those that can't be read."""
    return lambda keys: keys.map(lambda k: None if (m := molecules.parse(k)) is None else f(m))


for _name in ("topology", "environments", "atom_pairs"):
    register_featurizer(_name, of_molecules(getattr(molecules, _name)))


def molecule_graphs(keys: DataFrame, key: str) -> DataFrame:
    """(key, nodes, edges) of each distinct key: seven features an atom and both directions of each bond; nulls if unreadable."""

    @F.pandas_udf("struct<nodes: array<array<float>>, edges: array<array<int>>>")
    def graph(s: pd.Series) -> pd.DataFrame:
        found = [molecules.parse(k) for k in s]
        return pd.DataFrame({"nodes": [m and molecules.node_features(m) for m in found], "edges": [m and molecules.edge_index(m) for m in found]})

    return keys.select(key).where(F.col(key).isNotNull()).distinct().select(key, graph(key).alias("g")).select(key, "g.nodes", "g.edges")


def batch_graphs(graphs: DataFrame, key: str) -> DataFrame:
    """graphs in the order of their key, with `first`, the nodes before each, and edges shifted by it; unreadable ones go.

    The running count of nodes is taken range by range, so no task holds the batch.
    """
    sized = graphs.where("nodes is not null").withColumn("_n", F.size("nodes").cast("long"))
    run = global_running(sized, [F.col(key)], "_n").withColumn("first", F.col("cum") - F.col("_n"))
    return run.withColumn("edges", F.transform("edges", lambda e: F.transform(e, lambda i: i + F.col("first")))).drop("_n", "cum", "rank")


def map_distinct(df: DataFrame, key: str, f: Callable[[pd.Series], pd.Series], kind: str, out: str) -> DataFrame:
    """df with out = f(key), computed once for each distinct key and joined back.

    The function runs as an Arrow UDF; how the join is done is left to the keys' measured size.
    """
    udf = F.pandas_udf(lambda s: f(s), kind)
    keys = df.select(F.col(key).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return df.join(keys.select("_k", udf("_k").alias(out)), F.col(key) == F.col("_k"), "left").drop("_k")


def canonicalize(df: DataFrame, key: str, policy: str, out: str) -> DataFrame:
    return map_distinct(df, key, CANONICALIZERS[policy], "string", out)


def feature_table(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """(key, features) of all distinct keys of the columns; invalid keys get none."""
    keys = df.select(F.explode(F.array(*columns)).alias("key")).where("key is not null").distinct()
    return keys.select("key", F.pandas_udf(featurizer(name), "array<float>")("key").alias("features"))


def assemble(df: DataFrame, table: DataFrame, solute: str, solvent: str, t: str) -> DataFrame:
    """df with `features`: solute, solvent and four temperature features; unknown keys and infinities are zeros."""
    from quorumlab.functions.scalar import temperature_features

    width = table.agg(F.max(F.size("features")).alias("n")).first()["n"] or 0
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    a, b = (table.select(F.col("key").alias(k), F.col("features").alias(f)) for k, f in (("_ka", "_fa"), ("_kb", "_fb")))
    out = df.join(a, F.col(solute) == F.col("_ka"), "left").join(b, F.col(solvent) == F.col("_kb"), "left")
    tail = F.array(*[c.cast("float") for c in temperature_features(F.greatest(F.col(t), F.lit(1e-6)))])
    joined = F.concat(F.coalesce("_fa", zeros), F.coalesce("_fb", zeros), tail)
    clean: Column = F.transform(joined, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0).cast("float")).otherwise(x))
    return out.withColumn("features", clean).drop("_ka", "_fa", "_kb", "_fb")


def missing_features(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key has no features, with their count by key."""
    good = table.where("features is not null").select(F.col("key").alias("_k"))
    return df.join(good, F.col(key) == F.col("_k"), "left_anti").groupBy(key).agg(F.count("*").alias("n_skipped"))


def sweep_grid(spark: SparkSession, **axes: list) -> DataFrame:
    """Every combination of the axes' values, in a stable order."""
    from itertools import product

    names = list(axes)
    return spark.createDataFrame([tuple(x) for x in product(*axes.values())], names)


def training_fraction(rows: DataFrame, key: Column, fraction: float, seed: int, stratum: str | None = None) -> DataFrame:
    """A seeded part of the training rows: 32 rows at least, or by stratum one of each at least."""
    from quorumlab.operators.splits import stratified_subsample, subsample

    if stratum:
        return stratified_subsample(rows, stratum, key, fraction, seed)
    return subsample(rows, key, None, fraction, seed)


def validation_cut(rows: DataFrame, key: Column, n: int, seed: int, least: int = 2048, share: float = 0.05) -> DataFrame:
    """rows with `validation` on max(least, share of n) of them, in the order of a seeded hash, which is numbered range by range."""
    k = min(n, max(least, round(n * share)))
    return global_running(rows, [draw(seed, key), key]).withColumn("validation", F.col("rank") <= k).drop("rank")


def status(spark: SparkSession, results: DataFrame) -> DataFrame:
    """(method, kind, n_runs): every registered method and what results(method, seed, ...) there are."""
    listed = spark.createDataFrame([(m.name, m.kind) for m in METHODS.values()], "method string, kind string")
    return listed.join(results.groupBy("method").agg(F.countDistinct("seed").alias("n")), "method", "left").select("method", "kind", F.coalesce("n", F.lit(0)).alias("n_runs"))


def occlusion_importance(rows: DataFrame, vector: str, score: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """rows exploded by element of the vector with `importance`: |score - score with the element at 0|.

    All variants are scored in Arrow batches; only the index and two scores leave the batch.
    """
    f = F.pandas_udf(lambda s: score(s), "double")
    base = rows.withColumn("_base", f(vector))
    each = base.withColumn("element", F.explode(F.sequence(F.lit(0), F.size(vector) - 1)))
    zeroed = F.transform(F.col(vector), lambda x, i: F.when(i == F.col("element"), F.lit(0.0)).otherwise(x))
    return each.withColumn("importance", F.abs(F.col("_base") - f(zeroed))).drop("_base")


def group_importance(importances: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """mean, sum, sample deviation and count by group; the largest means of the first group key if top is given."""
    out = importances.groupBy(*by).agg(F.avg("importance").alias("mean"), F.sum("importance").alias("sum"), F.stddev_samp("importance").alias("std"), F.count("*").alias("n"))
    if top is None:
        return out
    w = Window.partitionBy(by[0]).orderBy(F.desc("mean"), *by[1:])
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
