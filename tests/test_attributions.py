"""Tree attributions against the enumeration of all subsets, and boosting stopped early against a plain loop."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlab.operators import attributions, models
from quorumlab.plans import catalogue

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)).round(2)
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] * x[:, 2] + 0.3 * rng.normal(size=400)
    return spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id long, a double, b double, c double, d double, y double").repartition(3)


def game(nodes, x, known):
    """The expectation of one tree if only some features are known."""

    def value(node):
        if node["left"] < 0:
            return node["prediction"]
        left, right = nodes[node["left"]], nodes[node["right"]]
        if node["feature"] in known:
            return value(left if x[node["feature"]] <= node["at"][0] else right)
        return (left["n"] * value(left) + right["n"] * value(right)) / node["n"]

    return value(nodes[0])


def enumerated(trees, weights, x):
    m = len(x)
    out = [0.0] * m
    for nodes, weight in zip(trees, weights):
        for f in range(m):
            rest = [g for g in range(m) if g != f]
            for k in range(m):
                w = math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m)
                for s in itertools.combinations(rest, k):
                    out[f] += weight * w * (game(nodes, x, {*s, f}) - game(nodes, x, set(s)))
    return out


@pytest.mark.parametrize("name, params", [("decision_tree", {"maxDepth": 5}), ("random_forest", {"numTrees": 4, "maxDepth": 5}), ("gradient_boosting", {"maxIter": 5, "maxDepth": 4})])
def test_equal_to_subsets_and_additive(spark, table, name, params):
    model = models.fit_trees(name, table, COLUMNS, **params)
    told = attributions.tree_attributions(model, model.transform(table)).collect()
    assert len(told) == 400
    for r in told:
        assert sum(r["attribution"]) + r["attribution_base"] == pytest.approx(r["y_pred"], abs=1e-9)
    trees = attributions.node_table(spark, model.stages[-1])
    weights = list(model.stages[-1].treeWeights) if name == "gradient_boosting" else [1 / len(trees)] * len(trees)
    for r in told[:6]:
        x = [r[c] for c in COLUMNS]
        assert r["attribution"] == pytest.approx(enumerated(trees, weights, x), abs=1e-10)
        assert r["attribution_base"] == pytest.approx(sum(w * game(t, x, set()) for t, w in zip(trees, weights)), abs=1e-10)


def test_null_inputs_flat_trees_and_batches(spark, table, monkeypatch):
    monkeypatch.setattr(attributions, "CELLS", 50)
    model = models.fit_trees("decision_tree", table, COLUMNS, maxDepth=2)
    odd = table.limit(3).unionAll(spark.createDataFrame([(900, None, 1.0, 1.0, 1.0, 0.0), (901, 1.0, 1.0, 1.0, 1.0, None)], table.schema))
    got = {r["id"]: r["attribution"] for r in attributions.tree_attributions(model, odd).collect()}
    assert got[900] is None and len(got[901]) == 4
    flat = models.fit_trees("decision_tree", table.withColumn("y", F.lit(2.0)), COLUMNS)
    r = attributions.tree_attributions(flat, table).first()
    assert r["attribution"] == [0.0] * 4 and r["attribution_base"] == 2.0
    means = attributions.mean_magnitudes(attributions.tree_attributions(model, table), COLUMNS).collect()
    assert max(means, key=lambda r: r["importance"])["feature"] in ("a", "b", "c") and len(means) == 4
    assert attributions.tree_attributions(model, table.limit(0)).count() == 0


def test_boosting_stops_on_the_held_rows(spark, table):
    """Labels of the training rows are noise: every stage but the first few makes held rows worse."""
    noisy = table.withColumn("y", F.when(F.col("id") % 2 == 0, F.col("y") + 4 * F.sin(F.col("id") * 12.9898)).otherwise(F.col("y")))
    train, held = noisy.where("id % 2 = 0"), noisy.where("id % 2 = 1")
    whole = models.fit_trees("gradient_boosting", train, COLUMNS, maxIter=15, maxDepth=5, stepSize=1.0)
    cut, losses = models.stop_early(whole, held, patience=4)
    trees, weights = whole.stages[-1].trees, whole.stages[-1].treeWeights
    rows = whole.stages[0].transform(held).select("_v", "y").collect()
    total, plain = np.zeros(len(rows)), []
    for tree, weight in zip(trees, weights):
        total += [weight * tree.predict(r["_v"]) for r in rows]
        plain.append(float(np.mean((total - [r["y"] for r in rows]) ** 2)))
    best = 0
    for i, loss in enumerate(plain):
        if loss < plain[best]:
            best = i
        elif i - best >= 4:
            break
    assert len(cut.stages[-1].trees) == best + 1 < 15 and losses == pytest.approx(plain[: len(losses)])
    error = cut.transform(held).agg(F.avg((F.col("y_pred") - F.col("y")) ** 2).alias("e")).first()["e"]
    assert error == pytest.approx(plain[best])
    assert len(attributions.tree_attributions(cut, held).first()["attribution"]) == 4
    same, none = models.stop_early(whole, held.limit(0))
    assert same is whole and none == []


def test_training_rows_are_dealt_evenly(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(catalogue, "TASK_ROWS", 500)
    rows = catalogue.training_rows(spark, sf_dir)
    sizes = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == -(-rows.count() // 500) and max(sizes) < 700
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, catalogue.assembled(spark, sf_dir).collect()))


@pytest.fixture(scope="module")
def repeated(spark, sf_dir, tmp_path_factory):
    """The tables three times over, with keys of their own."""
    folder = tmp_path_factory.mktemp("repeated")
    for name, keys in (("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]), ("part", ["p_partkey"]), ("supplier", ["s_suppkey"])):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet").crossJoin(spark.range(3).withColumnRenamed("id", "_i"))
        rows.withColumns({k: F.col(k) + F.col("_i") * 1_000_000 for k in keys}).drop("_i").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def trained(monkeypatch):
    """Rows that each training reads, and the measurements that they stand for."""
    fit, seen = models.fit_trees, []
    monkeypatch.setattr(models, "fit_trees", lambda name, train, *a, **k: seen.append((train.count(), train.agg(F.sum("n")).first()[0] if "n" in train.columns else train.count())) or fit(name, train, *a, **k))
    return seen


def test_regressors_train_on_distinct_features(spark, repeated, trained, monkeypatch):
    """Three times the measurements are no more rows to train on; their weights are."""
    monkeypatch.setattr(models, "FOREST", 2)
    monkeypatch.setattr(models, "TREES", {k: models.TREES[k] for k in ("decision_tree", "random_forest")})
    got = {r["model"]: r for r in catalogue.tree_regressors(spark, repeated).collect()}
    assert set(got) == {"decision_tree", "random_forest"} and got["decision_tree"]["rmse"] < 0.1 and got["random_forest"]["rmse"] < 0.2, got
    rows = catalogue.measurements(spark, repeated)
    total, cells = rows.count(), rows.select("solute", "solvent", "t").distinct().count()
    assert [n + got["decision_tree"]["n"] for _, n in trained] == [total, total] and all(n <= cells < total / 3 for n, _ in trained)


def test_attributions_are_made_for_distinct_features(spark, repeated, trained):
    r = catalogue.tree_attributions(spark, repeated).first()
    rows = catalogue.measurements(spark, repeated)
    held, total, cells = rows.where("rid % 5 = 0").count(), rows.count(), rows.select("solute", "solvent", "t").distinct().count()
    assert (r["n_rows"], r["n_off"], r["fewer_trees"]) == (held, 0, True)
    assert trained[0][1] == total - held and trained[0][0] <= cells < total / 3


@pytest.mark.parametrize("name, params", [("decision_tree", {"maxDepth": 6}), ("gradient_boosting", {"maxIter": 5, "maxDepth": 3})])
def test_condensed_rows_train_the_same_trees(spark, name, params):
    """Few rows, so that Spark finds thresholds from all of them in either case."""
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), bool(h), float(a * 0.7 + (b - 4) ** 2 + e)) for a, b, h, e in zip(rng.integers(1, 6, 3000), rng.integers(1, 9, 3000), rng.integers(0, 3, 3000) == 0, rng.normal(size=3000))]
    table = spark.createDataFrame(rows, "a int, b int, held boolean, y double").repartition(3)
    held, short = table.where("held"), models.condensed(table, ["a", "b", "held"]).withColumn("r", F.rand(1)).orderBy("r").drop("r").localCheckpoint()
    assert short.count() == 80 and short.agg(F.sum("n"), F.sum("w")).first() == (3000, 3000)
    whole, brief = models.fit_trees(name, table.where("not held"), ["a", "b"], **params), models.fit_trees(name, short.where("not held"), ["a", "b"], weight="w", **params)
    pairs = brief.transform(whole.transform(held.select("a", "b").distinct()).withColumnRenamed("y_pred", "e").drop("_v")).collect()
    assert [r["y_pred"] for r in pairs] == pytest.approx([r["e"] for r in pairs], abs=1e-9)
    told = [attributions.tree_attributions(m, held.select("a", "b").distinct()).orderBy("a", "b").collect() for m in (whole, brief)]
    assert np.array([[*r["attribution"], r["attribution_base"]] for r in told[1]]) == pytest.approx(np.array([[*r["attribution"], r["attribution_base"]] for r in told[0]]), abs=1e-9)
    if name == "gradient_boosting":
        (a, losses), (b, others) = models.stop_early(whole, held), models.stop_early(brief, short.where("held"), spread="spread")
        assert others == pytest.approx(losses) and len(a.stages[1].trees) == len(b.stages[1].trees)


def test_resamples_and_weighted_filters(spark):
    """Resamples draw single rows: a group of n rows varies as they do, and its mean with them."""
    rows = spark.range(40_000).select((F.col("id") % 4).alias("k"), F.when(F.col("id") % 8 < 4, 1.0).otherwise(3.0).alias("y")).unionAll(spark.createDataFrame([(9, None)], "k long, y double"))
    got = {r["k"]: r for r in models.condensed(rows, ["k"], resamples=30).collect()}
    assert (got[9]["n"], got[9]["w"], got[9]["y"], got[9]["y0"]) == (1, 0, None, None)
    assert (got[0]["n"], got[0]["y"], got[0]["spread"]) == (10_000, 2.0, pytest.approx(10_000.0))
    w, y = (np.array([[got[k][f"{c}{i}"] for i in range(30)] for k in range(4)]) for c in "wy")
    assert 70 < w.std() < 130 and abs(w.mean() - 10_000) < 60 and 0.007 < y.std() < 0.013 and len(set(w.reshape(-1))) > 60
    table = spark.range(500).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("c"), F.lit(2.0).alias("flat")).withColumn("b", 2 * F.col("a") + 1)
    short = table.groupBy("a", "b", "c", "flat").agg(F.count("*").alias("w"))
    assert models.select_features(short, ["a", "b", "flat", "c"], weight="w") == models.select_features(table, ["a", "b", "flat", "c"]) == ["a", "c"]
    v, r = models.weighted_spread(short, ["a", "c"], "w")
    e = table.agg(F.var_pop("a"), F.var_pop("c"), F.corr("a", "c")).first()
    assert [*v, r[0, 1]] == pytest.approx(list(e))
