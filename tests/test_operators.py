import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quorumlab.functions import scalar
from quorumlab.operators import agreement, audit, clean, fits, metrics, models, splits, tiers
from quorumlab.operators import graph, ordered
from quorumlab.operators.graph import connected_components
from quorumlab.sources import tables


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_half_even_rounding(spark):
    df = frame(spark, [(298.25,), (293.15,)], "t double")
    assert values(df.select(scalar.round_half_even(F.col("t"), 1).alias("r")), "r") == [298.2, 293.2]


def test_decimals_as_written(spark):
    df = frame(spark, [("1.2500",), ("3",), ("0.1",), ("1e-5",)], "s string")
    assert values(df.select(scalar.n_decimals(F.col("s")).alias("n")), "n") == [2, 0, 1, 0]


def test_label_recovery_and_edges(spark):
    df = frame(spark, [(None, 0.5, 1.0, 100.0), (None, 0.0, 1.0, 100.0), (None, 1.0, 1.0, 100.0), (2.0, 0.5, 1.0, 100.0), (None, 0.5, None, 100.0)], "y double, x double, d double, w double")
    out = values(clean.recover_labels(df, "y", "x", "d", "w"), "y", "label_tag")
    assert out[0] == (pytest.approx(1.0), "recovered_ok")
    assert out[1:] == [(None, "recovered_bad_x"), (None, "recovered_bad_x"), (2.0, "given"), (None, "recovered_no_density")]


def test_concentration_inverts_mole_fraction(spark):
    df = frame(spark, [(0.3, 0.9, 46.0)], "x double, d double, w double")
    s = F.pow(F.lit(10.0), scalar.mole_fraction_to_log(F.col("x"), F.col("d"), F.col("w")))
    assert values(df.select(scalar.concentration_to_mole_fraction(s, F.col("d"), F.col("w")).alias("b")), "b")[0] == pytest.approx(0.3)


def test_density_cascade_tags(spark):
    exact = tables.density_dimension(frame(spark, [(" Water", "298.15", "0,997", 1), ("water", "298.15", "0.998", 2), ("water", "bad", "1", 3)], "n string, t string, d string, i int"), "n", "t", "d", "i")
    linear = tables.coefficient_dimension(frame(spark, [("ethanol", "-0.001", "1.1", 1)], "n string, a string, b string, i int"), "n", "a", "b", "i")
    library = frame(spark, [("glycol", 1.11)], "name string, density double")
    rows = frame(spark, [("Water", 298.15), ("ETHANOL", 300.0), ("glycol", 300.0), ("Glykol", 300.0), ("none", 300.0)], "solvent string, t double")
    out = clean.density_cascade(rows, exact, linear, library=library, aliases={"Glykol": "glycol"}).orderBy("solvent")
    got = {r["solvent"]: (r["density"], r["density_tag"]) for r in out.collect()}
    assert got["Glykol"] == got["glycol"]
    assert got["Water"] == (0.998, "density_dict_exact") and got["ETHANOL"] == (pytest.approx(0.8), "coef_linear") and got["glycol"] == (1.11, "library") and got["none"] == (None, "unavailable")


def test_waterfall_conserves_rows(spark):
    rows = frame(spark, [(1, "bad", 1.0), (2, "a", 1.0), (3, "a", 1.0), (4, "a", None), (5, "b", 2.0), (6, None, 2.0)], "rid long, src string, y double")
    marked = clean.waterfall(rows, [("source", F.col("src") != "bad"), ("label", F.col("y").isNotNull())], [F.col("src"), F.col("y")], "rid")
    assert dict(values(marked, "rid", "step")) == {1: "source", 2: "kept", 3: "duplicate", 4: "label", 5: "kept", 6: "source"}
    counts = values(clean.waterfall_counts(marked, ["source", "label"]).orderBy("ord"), "step", "dropped", "remaining")
    assert counts == [("source", 2, 4), ("label", 1, 3), ("duplicate", 1, 2)]


def test_range_edges(spark):
    df = frame(spark, [(-15.0,), (2.0,), (2.0001,)], "y double")
    assert df.where(F.col("y").between(clean.LOGS_MIN, clean.LOGS_MAX)).count() == 2


def test_corrections_keep_old_values(spark):
    df = frame(spark, [("a", 1.0), ("b", 2.0), (None, 3.0)], "src string, y double")
    out = clean.correct(df, [("C1", F.col("src") == "a", {"y": F.col("y") * 10})])
    assert sorted(values(out.select(F.coalesce("src", F.lit("-")).alias("src"), "y", "old_y", "correction"), "src", "y", "old_y", "correction")) == [("-", 3.0, 3.0, None), ("a", 10.0, 1.0, "C1"), ("b", 2.0, 2.0, None)]
    assert values(clean.correction_log(out), "correction", "n_rows", "moved") == [("C1", 1, 9.0)]


def test_keep_first_by_order(spark):
    df = frame(spark, [("k", 2, "late"), ("k", 1, "first")], "key string, rid int, v string")
    assert values(clean.dedup_keep_first(df, ["key"], ["rid"]), "v") == ["first"]


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    star = [("s000", f"s{i:03}") for i in range(1, 50)]
    out = dict(values(connected_components(frame(spark, chain + star + [("x", "x"), (None, "y")], "a string, b string")), "node", "component"))
    assert {out[f"n{i:03}"] for i in range(61)} == {"n000"} and {out[f"s{i:03}"] for i in range(50)} == {"s000"} and len(out) == 111
    assert connected_components(frame(spark, [], "a string, b string")).count() == 0


def test_bit_exact_chain(spark):
    rows = frame(spark, [("A", 1), ("B", 1), ("B", 2), ("C", 2), ("D", 3), (None, 3)], "m string, k int")
    out = dict(values(agreement.bit_exact_groups(rows, "m", ["k"]), "m", "component"))
    assert out == {"A": "A", "B": "A", "C": "A", "D": "D"}
    assert values(agreement.number_by_size(agreement.bit_exact_groups(rows, "m", ["k"])).orderBy("gid"), "component", "size", "gid") == [("A", 3, 0), ("D", 1, 1)]


def curve(t, a=-12.0, b=-1500.0, c=2.0):
    return a + b / t + c * math.log(t)


def test_fit_classes_and_exact_fits(spark):
    rows = [("s", "v", "three", t, curve(t)) for t in (293.15, 303.15, 323.15)] + [("s", "v", "two", t, 1 + 100 / t) for t in (293.15, 303.15)] + [("s", "v", "one", 300.0, 1.0), ("s", "v", "one", 300.0, 3.0)]
    rows += [("s", "v", "flat", t, 0.5) for t in (290.0, 300.0, 310.0, 320.0)] + [("s", "v", None, 300.0, 1.0)]
    out = {r["src"]: r for r in fits.fit_curves(frame(spark, rows, "solute string, solvent string, src string, t double, y double")).collect()}
    assert {k: r["model"] for k, r in out.items()} == {"three": "apelblat", "two": "vanthoff", "one": "single_point", "flat": "apelblat"}
    three = out["three"]
    assert (three["a"], three["b"], three["c"]) == (pytest.approx(-12, rel=1e-6), pytest.approx(-1500, rel=1e-6), pytest.approx(2, rel=1e-6)) and three["r2"] == pytest.approx(1) and three["rmse"] < 1e-9
    assert out["two"]["c"] is None and out["two"]["b"] == pytest.approx(100) and out["flat"]["r2"] == 1.0
    assert out["one"]["n"] == 1 and out["one"]["r2"] is None and out["one"]["y_min"] == 2.0


def test_cascade_equals_least_squares(spark, sf_dir):
    m = tables.measurements(spark, sf_dir)
    a = fits.fit_curves(m).select("solute", "solvent", "src", "r2", "rmse")
    b = fits.fit_curves_lstsq(m).select("solute", "solvent", "src", F.col("r2").alias("r2_"), F.col("rmse").alias("rmse_"))
    far = a.join(b, ["solute", "solvent", "src"]).where((F.abs(F.col("r2") - F.col("r2_")) > 1e-6) | (F.abs(F.col("rmse") - F.col("rmse_")) > 1e-6))
    assert far.count() == 0 and a.count() == b.count()


FIT = "solute string, solvent string, src string, a double, b double, c double, t_min double, t_max double, r2 double, rmse double"


def test_overlap_edge_and_grid(spark):
    rows = [("s", "v", "g1", 1.0, 0.0, None, 290.0, 295.0, 1.0, 0.0), ("s", "v", "g2", 1.5, 0.0, None, 290.0, 300.0, 1.0, 0.0), ("s", "v", "g3", 1.0, 0.0, None, 290.01, 295.0, 1.0, 0.0)]
    pairs = agreement.fit_pairs(frame(spark, rows, FIT))
    assert sorted(values(pairs, "gi", "gj")) == [("g1", "g2")]
    assert values(agreement.group_pair_mae(pairs), "n", "sum_abs") == [(6, pytest.approx(3.0))]
    assert agreement.atom_deltas(pairs).count() == 6


def test_two_level_mean_differs_from_weighted(spark):
    gp = frame(spark, [("s", "v", "a", "b", 10, 1.0), ("s", "v", "a", "c", 1000, 300.0)], "solute string, solvent string, gi string, gj string, n long, sum_abs double")
    r = agreement.pair_mae(gp).first()
    assert r["pair_mae"] == pytest.approx(0.2) and r["pair_mae_max"] == pytest.approx(0.3)
    assert sorted(values(agreement.weighted_group_mae(gp), "weighted_mae")) == [pytest.approx(0.1), pytest.approx(0.3)]


def test_theta_is_strict(spark):
    edges = frame(spark, [("a", "b", 0.01), ("b", "c", 0.0099)], "gi string, gj string, weighted_mae double")
    nodes = frame(spark, [("a",), ("b",), ("c",)], "src string")
    assert dict(values(agreement.merge_groups(edges, nodes, 0.01), "src", "component")) == {"a": "a", "b": "b", "c": "b"}
    at = graph.components_at(graph.minimum_spanning_forest(edges, "gi", "gj", "weighted_mae"), nodes, [0.005, 0.01, 0.02], "src")
    assert dict(values(at, "src", "components")) == {"a": ["a", "a", "a"], "b": ["b", "b", "a"], "c": ["c", "b", "a"]}


def test_leave_one_out_deviations(spark):
    rows = [("s", "v", g, a, 0.0, None, 290.0, 295.0, 1.0, 0.0) for g, a in (("x", 1.0), ("y", 2.0), ("z", 6.0))]
    f = frame(spark, rows, FIT)
    members = frame(spark, [("x",), ("y",), ("z",), ("w",)], "src string")
    out = {r["src"]: (r["n_grid"], r["mean_dev"], r["flagged"]) for r in agreement.source_reliability(f, members, threshold=1.5).collect()}
    assert out == {"x": (6, pytest.approx(3.0), True), "y": (6, pytest.approx(1.5), True), "z": (6, pytest.approx(4.5), True), "w": (0, None, False)}
    assert values(agreement.best_representative(f.withColumn("g", F.lit(1)), "g"), "src") == ["x"]


def test_tier_edges_and_nesting(spark):
    pm = frame(spark, [("a", "v", 0.1), ("b", "v", 0.2), ("c", "v", 0.5), ("d", "v", 0.5001)], "solute string, solvent string, pair_mae double")
    out = {r["solute"]: (r["tier_gold"], r["tier_silver"], r["tier_bronze"]) for r in tiers.assign_tiers(pm).collect()}
    assert out == {"a": (True, True, True), "b": (False, True, True), "c": (False, False, True)}


def test_sigma_rules(spark):
    tier = frame(spark, [(s, "v") for s in ("one", "equal", "apart")], "solute string, solvent string")
    measured = frame(spark, [(s, "v", 300.0) for s in ("one", "equal", "apart", "outside")], "solute string, solvent string, t double")
    f = [("one", 1.0), ("equal", 1.0), ("equal", 1.0), ("apart", 0.9), ("apart", 1.1)]
    fitted = frame(spark, [(s, "v", str(i), a, 0.0, None, 300.0, 310.0, 1.0, 0.0) for i, (s, a) in enumerate(f)], FIT)
    out = {r["solute"]: r["sigma"] for r in tiers.tier_rows(measured, fitted, tier).collect()}
    assert out == {"one": None, "equal": 0.012, "apart": pytest.approx(math.sqrt(0.02))}


def test_cumulative_cut_and_holdout_sizes(spark):
    rows = frame(spark, [(k,) for k, n in (("a", 50), ("b", 30), ("c", 10), ("d", 10)) for _ in range(n)] + [(None,)], "k string")
    assert [x for x, _ in sorted(values(splits.head_by_share(rows, "k", 0.85), "k", "n"))] == ["a", "b", "c"]
    pairs = frame(spark, [(s, f"m{i}") for s, n in (("one", 1), ("ten", 10), ("eleven", 11)) for i in range(n)], "s string, m string")
    out = splits.stratified_holdout(pairs, "s", "m").where("held_out").groupBy("s").count()
    assert dict(values(out, "s", "count")) == {"one": 1, "ten": 1, "eleven": 2}


def test_splits_do_not_leak(spark, sf_dir):
    m = tables.measurements(spark, sf_dir)
    tier = m.where("solute = 'Brand#11'").select("solute", "solvent").distinct()
    out = dict(values(splits.leakage(splits.make_splits(m, tier), tier), "check", "n_shared"))
    assert all(out[k] == 0 for k in ("train_tier_solutes", "eval_tier_solutes", "ood_tier_solutes", "train_eval_pairs", "train_ood_solvents"))


def test_split_priority(spark):
    pair = lambda s: frame(spark, [(s, "v")], "solute string, solvent string")
    named = {"gold": pair("a"), "ood": pair("b"), "train": pair("a")}
    assert dict(values(splits.assign_by_priority(named, pair("a").union(pair("b")).union(pair("c"))), "solute", "split")) == {"a": "gold", "b": "ood", "c": "train"}


def test_samples_are_whole_and_seeded(spark):
    rows = spark.range(1000).withColumn("s", (F.col("id") % 3).cast("string"))
    key = F.col("id").cast("string")
    a, b = (values(splits.subsample(rows, key, 1000, 0.1, 7), "id") for _ in range(2))
    assert a == b and len(set(a)) == 100 and len(values(splits.subsample(rows, key, 1000, 0.001, 7), "id")) == 32
    assert splits.stratified_subsample(rows, "s", key, 0.01, 7).count() == 9


def test_samples_of_large_strata_rank_only_the_draws_at_the_edge(spark, monkeypatch):
    ranked, running = [], splits.global_running
    monkeypatch.setattr(splits, "global_running", lambda rows, order: ranked.append(rows.count()) or running(rows, order))
    rows = spark.range(5000).withColumn("s", F.when(F.col("id") % 10 > 1, F.lit("hot")).otherwise(F.when(F.col("id") % 10 == 1, F.lit("cold"))))
    key = F.col("id").cast("string")
    drawn = sorted(rows.withColumn("d", splits.draw(7, key)).collect(), key=lambda r: (r["d"], str(r["id"])))
    first = lambda k, *s: sorted([r["id"] for r in drawn if not s or r["s"] == s[0]][:k])
    found = splits.stratified_subsample(rows, "s", key, 0.3, 7)
    assert found.columns == rows.columns and sorted(values(found, "id")) == sorted(first(1200, "hot") + first(150, "cold") + first(150, None))
    for n, fraction, k in ((5000, 0.37, 1850), (None, 0.37, 1850), (None, 0.0, 32), (None, 1.0, 5000), (None, 2.0, 5000)):
        assert sorted(values(splits.subsample(rows, key, n, fraction, 7), "id")) == first(k)
    assert max(ranked) < 50  # not the 5000 rows, nor a stratum
    repeated = rows.withColumn("k", F.lit("one"))
    assert splits.subsample(repeated, F.col("k"), None, 0.1, 7).count() == 500 and splits.subsample(rows.limit(0), key, None, 0.5, 7).count() == 0


PRED = "split string, solvent string, y_true double, y_pred double, sigma double"


def test_metric_variants(spark):
    rows = [("e", "a", 1.0, 2.0, 0.001), ("e", "a", 3.0, 3.0, None), ("e", "b", 0.0, 0.01, 0.001)]
    module = metrics.evaluate_predictions(frame(spark, rows, PRED), ["split"], "module").first()
    sdk = metrics.evaluate_predictions(frame(spark, rows, PRED), ["split"], "sdk").first()
    assert module["ps_rmse"] == pytest.approx((math.sqrt(0.5) + 0.01) / 2) and sdk["ps_rmse"] == pytest.approx(math.sqrt(0.5))
    assert module["z_rmse"] == pytest.approx(math.sqrt((1000**2 + 10**2) / 2)) and sdk["z_rmse"] == pytest.approx(math.sqrt((100**2 + 1) / 2))
    assert sdk["f_aleatoric"] == 0 and module["mape_n"] == 2 and module["z_n"] == 2
    constant = metrics.evaluate_predictions(frame(spark, [("e", "a", 1.0, 1.0, None)], PRED), ["split"], "sdk").first()
    assert constant["r2"] is None and constant["z_rmse"] is None
    bare = frame(spark, [("e", 1.0, 2.0)], "split string, y_true double, y_pred double")
    assert metrics.evaluate_predictions(bare, ["split"], "module", ["rmse", "z_rmse"]).first().asDict() == {"split": "e", "rmse": 1.0, "z_rmse": None}
    with pytest.raises(ValueError):
        metrics.evaluate_predictions(bare, ["split"], "other")


def test_deviation_kinds(spark):
    r = frame(spark, [("m", "s", "x", 1.0), ("m", "s", "x", 3.0), ("m", "s", "x", float("nan"))], "method string, split string, metric string, value double")
    out = metrics.seed_aggregate(r, ["method", "split", "metric"]).first()
    assert (out["mean"], out["std"], out["n"]) == (2.0, 1.0, 2)
    table = metrics.method_table(metrics.seed_aggregate(r, ["method", "split", "metric"]), ["s_x", "s_y"], ["m"]).first()
    assert table["s_x"] == 2.0 and table["s_y"] is None and table["ord"] == 1


def test_gradient_targets_equal_numpy(spark):
    t, y = [0.0, 1.0, 3.0], [0.0, 0.5, 0.9]
    out = models.gradient_targets(frame(spark, [("k", a, b) for a, b in zip(t, y, strict=True)], "k string, t double, y double"), ["k"]).orderBy("t")
    assert values(out, "g") == [pytest.approx(g) for g in np.gradient(y, t)] == [pytest.approx(0.5), pytest.approx(0.4), pytest.approx(0.2)]


def test_spearman_and_steps(spark):
    rows = [("s", "v", "g", float(t), y) for t, y in ((1, 1.0), (2, 3.0), (3, 2.0), (4, 3.0))]
    out = fits.monotonicity(frame(spark, rows, "solute string, solvent string, src string, t double, y double")).first()
    assert out["spearman_rho"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 3.5, 2, 3.5])[0, 1])
    assert (out["n_up"], out["n_down"], out["worst_drop"], out["monotone"]) == (2, 1, -1.0, False)


def test_ridge_models(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": ["a"] * 40 + ["b"] * 5, "x": rng.normal(size=45), "z": rng.normal(size=45)})
    pdf["y"] = 2 * pdf.x - pdf.z + 1
    df = spark.createDataFrame(pdf)
    model = models.ridge_1d(df, "g", "x", "y", 1.0, 30)
    assert sorted(values(model, "n")) == [40, 45]
    assert models.ridge_predict(df, model, "g", "x").where("y_pred is null").count() == 0
    many = models.ridge_by_group(df, "g", ["x", "z"], "y", 1e-9, 30).first()
    assert many["coefficients"] == [pytest.approx(2), pytest.approx(-1)] and many["intercept"] == pytest.approx(1)
    assert models.select_features(df.withColumn("twin", F.col("x") * 2).withColumn("flat", F.lit(1.0)), ["x", "twin", "z", "flat"]) == ["x", "z"]


def test_standardize(spark):
    df = frame(spark, [(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = models.standardize(df, ["a", "b"]).orderBy("a")
    assert values(out, "a", "b") == [(pytest.approx(-1, abs=1e-6), 5.0), (pytest.approx(1, abs=1e-6), 5.0)]


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(size=400)
    r = models.bootstrap_mean_ci(spark.createDataFrame(pd.DataFrame({"v": x})), "v", resamples=2000).first()
    half = 1.96 * x.std() / 20
    assert r["low"] == pytest.approx(x.mean() - half, abs=0.25 * half) and r["high"] == pytest.approx(x.mean() + half, abs=0.25 * half)


def test_gamma_fit_and_special_functions(spark):
    rng = np.random.default_rng(2)
    r = models.gamma_fit(spark.createDataFrame(pd.DataFrame({"v": rng.gamma(0.68, 0.3, 5000)})), "v").first()
    assert r["shape"] == pytest.approx(0.68, rel=0.06) and r["scale"] == pytest.approx(0.3, rel=0.1) and r["ks"] < 0.03
    assert models.gamma_fit(spark.createDataFrame([(1.0,)], "v double"), "v").first()["shape"] is None
    assert models.lower_gamma(1.0, 2.0) == pytest.approx(1 - math.exp(-2)) and models.digamma(1.0) == pytest.approx(-0.5772156649015329)
    assert models.f_survival(1.0, 1.0, 1.0) == pytest.approx(0.5) and models.f_survival(4.0, 2.0, 10.0) == pytest.approx((1 + 4 * 2 / 10) ** -5)


def test_anova_equals_its_definition(spark):
    rows = [("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), ("single", 9.0)]
    r = metrics.anova(frame(spark, rows, "g string, y double"), "g", "y").first()
    y = np.array([v for _, v in rows])
    assert r["ss_total"] == pytest.approx(((y - y.mean()) ** 2).sum())
    big = [np.array([1.0, 2.0]), np.array([4.0, 6.0])]
    grand = np.concatenate(big).mean()
    f = sum(len(g) * (g.mean() - grand) ** 2 for g in big) / (sum(((g - g.mean()) ** 2).sum() for g in big) / 2)
    assert r["f_value"] == pytest.approx(f)


def test_audits(spark):
    df = frame(spark, [("a", 1, "x"), ("a", 1, "y"), ("b", None, "x"), (None, None, None)], "k string, v int, s string")
    profile = {r["column_name"]: r["null_count"] for r in audit.schema_profile(df).collect()}
    assert profile == {"k": 1, "v": 2, "s": 1}
    assert tuple(audit.duplicate_counts(df, ["k", "v"]).first()) == (1, 2)
    assert values(audit.copy_pairs(df, ["k", "v"], "s", 5), "src_a", "src_b", "n_shared") == [("x", "y", 1)]
    near = frame(spark, [("k", 1.0, 1.0, 1), ("k", 1.05, 1.0005, 2), ("k", 1.25, 1.0005, 3), ("j", 1.0, 1.0, 4)], "k string, t double, y double, i int")
    assert values(audit.near_duplicates(near, ["k"], "t", "y", "i", 0.1, 0.001), "i") == [2]
    assert audit.validity_scan(df, "k", F.when(F.col("k") != "b", F.col("k"))).count() == 1
    assert values(audit.majority(frame(spark, [("g", "b"), ("g", "a"), ("g", None)], "g string, v string"), "g", "v"), "v") == ["a"]


def test_tanimoto_process(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((300, 24)) < 0.3).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), float(v[:4].sum())) for i, v in enumerate(x)] + [(999, None, 0.0)], "id long, x array<double>, y double")
    out = models.fit_tanimoto_process(df.where("id < 200"), "x", "y", "id", most=150)(df).where("id >= 200").orderBy("id").toPandas()
    known = out[out.id < 999]
    assert np.corrcoef(known.y, known.y_pred)[0, 1] > 0.7 and out.y_pred.notna().all()
    assert models.tanimoto(np.array([[1.0, 1, 0], [0, 0, 0]]), np.array([[1.0, 0, 0], [0, 0, 0]])).tolist() == [[0.5, 0], [0, 1]]


def test_messages_and_temperature_stamp(spark):
    from quorumlab.operators.graph import pass_messages

    nodes = frame(spark, [(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "node int, x array<double>")
    edges = frame(spark, [(1, 3), (2, 3), (3, 1)], "src int, dst int")
    assert sorted(values(pass_messages(nodes, edges), "node", "x")) == [(1, [5.0, 6.0]), (3, [4.0, 6.0])]
    assert dict(values(pass_messages(nodes, edges, mean=True), "node", "x"))[3] == [2.0, 3.0]
    stamped = nodes.limit(1).select(scalar.stamp_temperature(F.array("x"), F.lit(300.0)).alias("s")).first()["s"]
    assert stamped[0] == [1.0, 2.0, 1.0, pytest.approx(10 / 3), 1.0, 0.0]


def test_bootstrap_of_tied_values(spark):
    """Two values alone: the interval is that of a share, sqrt(1/4/n) wide."""
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0] * 20_000 + [0.0] * 20_000}))
    r = models.bootstrap_mean_ci(df, "v", resamples=2000).first()
    assert r["low"] == pytest.approx(0.5 - 1.96 * 0.0025, abs=0.0005) and r["high"] == pytest.approx(0.5 + 1.96 * 0.0025, abs=0.0005)


def test_ridge_far_from_zero_and_its_fallback(spark):
    rng = np.random.default_rng(1)
    x = 1e8 + rng.random(200)
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * 200, "x": x, "y": 2 * x - 2e8}))
    found = {r["g"]: r for r in models.ridge_by_group(df, "g", ["x"], "y", 1.0, 30).collect()}
    d = x - x.mean()
    assert found["a"]["coefficients"][0] == pytest.approx(2 * (d @ d) / (d @ d + 1), rel=1e-6) and found[None]["coefficients"] == found["a"]["coefficients"]
    small = spark.createDataFrame([("b", 0.5, None), ("a", 0.5, None)], "g string, x double, y double")
    model = models.ridge_by_group(spark.createDataFrame([("a", float(i), 3.0 * i) for i in range(40)], "g string, x double, y double"), "g", ["x"], "y", 0.0, 30)
    assert [r["y_pred"] for r in models.ridge_predict_by_group(small, model, "g", ["x"]).collect()] == pytest.approx([1.5, 1.5])


def test_ranks_sums_and_quantiles_over_ranges(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 50, 3000).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").repartition(7)
    run = ordered.global_running(df, ["v", "i"], "v").orderBy("rank").collect()
    order = np.lexsort((np.arange(3000), v))
    assert [r["i"] for r in run] == order.tolist() and [r["rank"] for r in run] == list(range(1, 3001))
    assert [r["cum"] for r in run] == pytest.approx(np.cumsum(v[order]).tolist())
    q = ordered.exact_quantiles(df, "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 0.999, "e": 1.0}).first()
    assert list(q) == pytest.approx(np.quantile(v, [0.0, 0.37, 0.5, 0.999, 1.0]).tolist())
    assert ordered.exact_quantiles(df.where("v < 0"), "v", {"a": 0.5}).first()["a"] is None
    assert [r["i"] for r in ordered.first_rows(df, ["v", "i"], 10).orderBy("v", "i").collect()] == order[:10].tolist()


def test_components_over_many_rounds(spark, monkeypatch):
    """Edges that no task holds at once: a long chain, a hub, and strings."""
    monkeypatch.setattr(graph, "EDGES_AT_ONCE", 8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (None, 3)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert found == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}
    named = spark.createDataFrame([(str(a), str(b)) for a, b in edges if a is not None], "a string, b string").repartition(3)
    found = {r["node"]: r["component"] for r in connected_components(named).collect()}
    assert found["60"] == "0" and found["1079"] == "1000"


def test_resamples_have_the_size_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(models, "VALUES_AT_ONCE", 16)
    monkeypatch.setattr(models, "RESAMPLES_AT_ONCE", 70)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.exponential(size=700), np.repeat(2.5, 300)])
    df = spark.createDataFrame(pd.DataFrame({"v": x})).repartition(5)
    got = models.bootstrap_sums(df, "v", resamples=400).toPandas()
    assert len(got) == 400 and (got["w"] == 1000).all()
    means = got["s"] / got["w"]
    assert means.mean() == pytest.approx(x.mean(), abs=5 * x.std() / math.sqrt(1000 * 400)) and means.std() == pytest.approx(x.std() / math.sqrt(1000), rel=0.15)
    again = models.bootstrap_sums(df, "v", resamples=400).toPandas()
    assert sorted(got["s"]) == pytest.approx(sorted(again["s"]))
    assert models.bootstrap_sums(df.limit(0), "v", resamples=5).count() == 0
    one = models.bootstrap_sums(df.limit(1), "v", resamples=5).collect()
    assert len({r["s"] for r in one}) == 1 and {r["w"] for r in one} == {1}


def test_sums_within_rows_equal_grid_rows(spark):
    """atom_sums and group_deviation against the grid rows that they stand for, null c and members without fits included."""
    rng = random.Random(8)
    rows = [("s", "v", f"g{i}", rng.random(), rng.random() * 9, None if i == 2 else rng.random(), 280.0 + i, 300.0 + 2 * i) for i in range(6)]
    good = spark.createDataFrame(rows, "solute string, solvent string, src string, a double, b double, c double, t_min double, t_max double")
    pairs = agreement.fit_pairs(good)
    d = F.abs("delta")
    want = agreement.atom_deltas(pairs).groupBy("gi", "gj").agg(F.count("*"), F.sum(d), F.sum(d * d), F.max(d)).orderBy("gi", "gj").collect()
    got = agreement.atom_sums(pairs).select("gi", "gj", "n", "sum_abs", "sum_squares", "most").orderBy("gi", "gj").collect()
    assert len(got) == 15 and [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-12)
    members = good.select("src").unionAll(spark.createDataFrame([("none",)], "src string"))
    one = agreement.source_reliability(good, members, threshold=0.3).select("src", "n_grid", "mean_dev", "flagged").orderBy("src").collect()
    two = agreement.group_deviation(good, members, threshold=0.3).orderBy("src").collect()
    assert [(r[0], r[1], r[3]) for r in one] == [(r[0], r[1], r[3]) for r in two] and two[-1].mean_dev is None
    assert np.allclose([r.mean_dev for r in one[:-1]], [r.mean_dev for r in two[:-1]], rtol=1e-12)
