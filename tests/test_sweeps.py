"""Sweeps: at once, restarted, broken and stopped runs."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from quorumlab.plans import plumbing, sweeps


def cells(spark, value):
    return spark.createDataFrame([("eval", "RMSE", float(value)), ("ood", "RMSE", float(value) + 1)], "split string, metric string, value double")


def table(spark, path, axes="a string, b int"):
    return {(r["a"], r["b"], r["split"]): r["value"] for r in sweeps.results(spark, path, axes).collect()}


def test_broken_run_and_restart(spark, tmp_path):
    path, calls = str(tmp_path / "runs"), []
    runs = sweeps.grid(a=["x", "y"], b=[1, 2, 3])
    assert runs[0] == {"a": "x", "b": 1} and runs[1] == {"a": "x", "b": 2}

    def run(key):
        calls.append(key)
        if key == {"a": "y", "b": 2} and len(calls) <= 6:
            raise ValueError("broken")
        return cells(spark, key["b"] * (10 if key["a"] == "y" else 1))

    first = sweeps.run_sweep(spark, path, runs, run, at_once=3)
    assert [o.state for o in first] == ["done"] * 4 + ["failed", "done"] and "broken" in first[4].error
    assert len(table(spark, path)) == 10 and sweeps.run_id(runs[4]) not in sweeps.finished(spark, path)
    again = sweeps.run_sweep(spark, path, runs, run, at_once=3)
    assert [o.state for o in again] == ["kept"] * 4 + ["done", "kept"] and len(calls) == 7
    assert table(spark, path)["y", 2, "ood"] == 21.0 and len(table(spark, path)) == 12


def test_a_run_replaces_itself_alone(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = sweeps.grid(a=["x"], b=[1, 2])
    sweeps.run_sweep(spark, path, runs, lambda k: cells(spark, k["b"]))
    out = sweeps.run_sweep(spark, path, runs[:1], lambda k: cells(spark, 7), force=True)
    assert out[0].state == "done" and table(spark, path) == {("x", 1, "eval"): 7.0, ("x", 1, "ood"): 8.0, ("x", 2, "eval"): 2.0, ("x", 2, "ood"): 3.0}
    none = sweeps.run_sweep(spark, path, [{"a": "z", "b": 1}], lambda k: cells(spark, 1).limit(0))
    assert none[0].state == "empty" and len(table(spark, path)) == 4


def test_a_stopped_run_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "runs")
    slow, quick = {"a": "slow", "b": 1}, {"a": "quick", "b": 1}

    def run(key):
        if key["a"] == "slow":
            sleepy = F.udf(lambda x: time.sleep(60) or "eval")
            return spark.range(1).select(sleepy("id").alias("split"), F.lit("RMSE").alias("metric"), F.lit(1.0).alias("value"))
        return cells(spark, 5)

    def stop():
        for _ in range(60):
            time.sleep(0.5)
            if sweeps.run_id(quick) in sweeps.finished(spark, path):
                spark.sparkContext.cancelJobsWithTag(sweeps.tag_of(slow))
                return

    watcher = threading.Thread(target=stop)
    watcher.start()
    began = time.time()
    out = sweeps.run_sweep(spark, path, [slow, quick], run, at_once=2)
    watcher.join()
    assert [o.state for o in out] == ["failed", "done"] and time.time() - began < 50
    assert set(table(spark, path)) == {("quick", 1, "eval"), ("quick", 1, "ood")}


def mean_model(method, rows, seed):
    mean = rows.agg(F.avg("y").alias("_m"))
    return lambda df: df.crossJoin(F.broadcast(mean)).withColumnRenamed("_m", "y_pred")


def test_scaling_and_transfer_runs(spark):
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("y"), F.lit(0.0).alias("x"))
    held = rows.where("id < 50").withColumn("split", F.lit("eval"))
    run = sweeps.scaling_run(rows, held, F.col("id").cast("string"), mean_model)
    whole = {r["metric"]: r["value"] for r in run({"method": "m", "fraction": 1.0, "seed": 1}).collect()}
    assert whole == {"RMSE": pytest.approx((sum((i - 4.5) ** 2 for i in range(10)) / 10) ** 0.5), "MAE": pytest.approx(2.5), "N": 50.0}
    source = rows.withColumn("y", F.lit(100.0))
    moved = sweeps.transfer_run(source, rows, held, F.col("id").cast("string"), mean_model, ["x"])
    at = lambda v: {r["metric"]: r["value"] for r in moved({"method": "m", "variant": v, "fraction": 1.0, "seed": 1}).collect()}["MAE"]
    assert at("scratch") == pytest.approx(2.5) and at("residual") == pytest.approx(2.5) and at("pooled") > 40
    with pytest.raises(ValueError, match="unknown variant"):
        at("other")


def test_failed_runs_are_no_result(spark, sf_dir, tmp_path, monkeypatch):
    """Means over the seeds that are left looked like means over all of them."""
    folder = tmp_path / "scratch"
    monkeypatch.setattr(plumbing, "scratch", lambda spark, name: f"{folder}/{name}")
    baseline = plumbing.mean_baseline

    def breaks(method, train, seed):
        if seed in (101, 0):
            raise ValueError("broken")
        return baseline(method, train, seed)

    monkeypatch.setattr(plumbing, "mean_baseline", breaks)
    with pytest.raises(RuntimeError, match="3 of 6 runs failed.*broken"):
        plumbing.fraction_aggregate(spark, sf_dir)
    with pytest.raises(RuntimeError, match="4 of 4 runs failed"):  # its baseline's seed is 0 in all runs
        plumbing.grid_runs(spark, sf_dir)
    assert not list(folder.iterdir())
    outcomes = [sweeps.Outcome({"a": "x"}, s) for s in ("done", "kept", "empty")]
    assert sweeps.whole(outcomes) is outcomes
