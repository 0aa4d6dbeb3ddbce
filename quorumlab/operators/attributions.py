"""Exact path-dependent attributions of tree models: a forest as a table of leaf paths, scored in Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlab.session import remove_folder, shared_folder

#: Numbers that a batch's intermediate arrays hold at most.
CELLS = 1 << 21


@dataclass
class LeafPaths:
    """Leaves whose paths split on the same number of distinct features.

    For each leaf its value (the tree's weight included), and for each feature on its path (columns) the feature's place, the interval
    low < x <= high in which a row follows the path at all its splits, and the share of training rows that do (the product of the
    children's shares at those splits).
    """

    value: np.ndarray
    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(spark: SparkSession, model) -> list[list[dict]]:
    """For each tree its nodes by id, read from the files that the model writes of itself; their number is the model's size. n is the weight of a node's training rows."""
    path = f"{shared_folder(spark).rstrip('/')}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    try:
        saved = spark.read.parquet(f"{path}/data")
        if "treeID" not in saved.columns:
            saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
        rows = saved.select(
            "treeID", "nodeData.id", "nodeData.prediction", F.col("nodeData.impurityStats")[0].alias("n"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
            F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.leftCategoriesOrThreshold").alias("at"), F.col("nodeData.split.numCategories").alias("categories"),
        ).collect()
    finally:
        remove_folder(spark, path)
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict()
    return [trees[t] for t in sorted(trees)]


def leaf_paths(trees: list[dict[int, dict]], weights: list[float]) -> tuple[float, list[LeafPaths]]:
    """The expected prediction over the training rows, and the leaves of all trees by the number of features on their paths."""
    base, by_size = 0.0, {}
    for nodes, weight in zip(trees, weights, strict=True):
        stack = [(nodes[0], {})]  # what a path asks of each feature: low, high, share
        while stack:
            node, path = stack.pop()
            if node["left"] < 0:
                value = weight * node["prediction"]
                base += value * float(np.prod([s for _, _, s in path.values()]))
                if path:
                    by_size.setdefault(len(path), []).append((value, path))
                continue
            if node["categories"] >= 0:
                raise ValueError("only splits on continuous features have thresholds")
            f, at = node["feature"], node["at"][0]
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["left"], (low, min(high, at))), (node["right"], (max(low, at), high))):
                stack.append((nodes[child], path | {f: (*bounds, share * nodes[child]["n"] / node["n"])}))
    tables = []
    for size in sorted(by_size):
        cells = np.array([[(f, *path[f]) for f in path] for _, path in by_size[size]])
        tables.append(LeafPaths(np.array([v for v, _ in by_size[size]]), cells[:, :, 0].astype(np.int64), cells[:, :, 1], cells[:, :, 2], cells[:, :, 3]))
    return base, tables


def attribute(x: np.ndarray, tables: list[LeafPaths]) -> np.ndarray:
    """Shapley values of each feature (columns) for each row of x, where a feature that isn't known takes both ways by the training rows' shares.

    A leaf's game is a product over the features on its path: o (1 if the row's feature follows the path, else 0) where known, the share z where not.
    Its Shapley value for f is value * (o_f - z_f) * the integral over t from 0 to 1 of the product over the others of o * t + z * (1 - t),
    which weighs subsets by their size. That is a polynomial, so Gauss-Legendre nodes integrate it exactly.
    """
    x = np.where(np.isnan(x), np.inf, x)  # a missing value goes right
    out = np.zeros(x.shape)
    for table in tables:
        leaves, size = table.feature.shape
        t, w = np.polynomial.legendre.leggauss((size + 1) // 2)
        t, w = (t + 1) / 2, w / 2
        which = np.zeros((leaves * size, x.shape[1]))
        which[np.arange(leaves * size), table.feature.reshape(-1)] = 1
        step = max(1, CELLS // (leaves * size * len(t)))
        for at in range(0, len(x), step):
            v = x[at : at + step][:, table.feature]  # rows, leaves, features of the path
            known = ((v > table.low) & (v <= table.high)).astype(np.float64)
            factor = known[..., None] * t + table.share[..., None] * (1 - t)
            others = np.prod(factor, axis=2, keepdims=True) / factor
            part = (known - table.share) * (others @ w) * table.value[:, None]
            out[at : at + step] += part.reshape(len(v), -1) @ which
    return out


def tree_attributions(model: PipelineModel, rows: DataFrame, name: str = "attribution") -> DataFrame:
    """rows with <name> array<double>, a value for each input column of the model, and <name>_base; both sum to the prediction.

    model: a fitted pipeline of a VectorAssembler and a tree regressor (one tree, a forest, or boosted trees). Rows with a null
    input have nulls; rows keep their other columns.
    """
    assembler = next(s for s in model.stages if isinstance(s, VectorAssembler))
    columns, trees = assembler.getInputCols(), model.stages[-1]
    nodes = node_table(rows.sparkSession, trees)
    if trees.__class__.__name__.startswith("GBT"):
        weights = list(trees.treeWeights)
    else:
        weights = [1 / len(nodes)] * len(nodes)
    base, tables = leaf_paths(nodes, weights)

    @F.arrow_udf("array<double>")
    def score(batch: pa.Array) -> pa.Array:
        whole = np.flatnonzero(np.array(batch.is_valid()))
        x = batch.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(len(whole), len(columns))
        values = attribute(x, tables)
        spread = np.zeros(len(batch), bool)
        spread[whole] = True
        ends = np.concatenate([[0], np.cumsum(spread) * len(columns)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)), mask=pa.array(~spread))

    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    x = F.when(known, F.array(*[F.col(c).cast("double") for c in columns]))
    return rows.withColumn(name, score(x)).withColumn(f"{name}_base", F.when(known, F.lit(base)))


def mean_magnitudes(attributed: DataFrame, columns: list[str], by: list[str] | None = None, name: str = "attribution") -> DataFrame:
    """(by, feature, importance, mean): how much each feature moves predictions, in any direction and on the whole."""
    cells = attributed.select(*(by or []), F.posexplode(name).alias("_i", "_v")).groupBy(*(by or []), "_i").agg(F.avg(F.abs("_v")).alias("importance"), F.avg("_v").alias("mean"))
    return cells.select(*(by or []), F.element_at(F.array(*map(F.lit, columns)), F.col("_i") + 1).alias("feature"), "importance", "mean")
