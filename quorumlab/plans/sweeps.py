"""Sweeps over grids of runs: several at once, each committed as a partition of one results table, restarted from what is finished."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlab.plans.registry import training_fraction
from quorumlab.sources.sinks import path_exists

#: What a run writes for each number of its result; run_id is the partition.
RESULTS = "split string, metric string, value double, run_id string"


@dataclass
class Outcome:
    """state: done (now), kept (finished before), empty (gave no row, and will be tried again) or failed, with its error."""

    key: dict
    state: str
    error: str | None = None
    seconds: float = 0.0


def grid(**axes: Iterable) -> list[dict]:
    """Every combination of the axes' values, the last axis first to change."""
    return [dict(zip(axes, x, strict=True)) for x in product(*axes.values())]


def run_id(key: dict) -> str:
    return json.dumps(key, sort_keys=True, separators=(",", ":"))


def tag_of(key: dict) -> str:
    """The tag of all jobs of a run; sparkContext.cancelJobsWithTag(tag_of(key)) stops it and leaves the others."""
    return "run-" + hashlib.md5(run_id(key).encode()).hexdigest()


def finished(spark: SparkSession, path: str) -> set[str]:
    """Ids of the runs that the results table has; a row for each run."""
    if not path_exists(spark, path):
        return set()
    return {r["run_id"] for r in spark.read.schema(RESULTS).parquet(path).select("run_id").distinct().collect()}


def results(spark: SparkSession, path: str, axes: str) -> DataFrame:
    """(axes, split, metric, value) of all finished runs; axes is the schema of the runs' keys."""
    rows = spark.read.schema(RESULTS).parquet(path)
    return rows.select(F.from_json("run_id", axes).alias("k"), "split", "metric", "value").select("k.*", "split", "metric", "value")


def run_sweep(spark: SparkSession, path: str, runs: list[dict], run: Callable[[dict], DataFrame], at_once: int = 4, force: bool = False, pool: str | None = None) -> list[Outcome]:
    """Runs what the results table at path lacks (all of it with force), so many at once, and tells what became of each.

    run gives (split, metric, value) for a key. A run's rows are written as one partition when its last job ends, so a run
    that fails, or is stopped by its tag, leaves nothing and doesn't touch the others; calling again runs what is missing.
    A failed run raises nothing here: pass the outcomes to whole() before results are aggregated. A run that is repeated replaces
    its own rows. Runs share the scheduler's pool if one is named. The grid is a list on the driver: a row for each run.
    """
    known = set() if force else finished(spark, path)

    @inheritable_thread_target(spark)
    def one(key: dict) -> Outcome:
        name, began = run_id(key), time.time()
        if name in known:
            return Outcome(key, "kept")
        spark.sparkContext.addJobTag(tag_of(key))
        if pool:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
        try:
            rows = run(key).select("split", "metric", F.col("value").cast("double").alias("value"), F.lit(name).alias("run_id"))
            rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        except Exception as e:  # noqa: BLE001 the others go on, the error is reported
            return Outcome(key, "failed", f"{type(e).__name__}: {e}", time.time() - began)
        finally:
            spark.sparkContext.removeJobTag(tag_of(key))
            if pool:
                spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)
        return Outcome(key, "done", None, time.time() - began)

    with ThreadPoolExecutor(max_workers=at_once) as threads:
        out = list(threads.map(one, runs))
    written = finished(spark, path)
    return [Outcome(o.key, "empty", None, o.seconds) if o.state == "done" and run_id(o.key) not in written else o for o in out]


def whole(outcomes: list[Outcome]) -> list[Outcome]:
    """The outcomes of a sweep of which no run failed; what aggregates over runs asks for this first, as a failed run is only missing from the results."""
    failed = [o for o in outcomes if o.state == "failed"]
    if failed:
        raise RuntimeError(f"{len(failed)} of {len(outcomes)} runs failed: " + "; ".join(f"{run_id(o.key)}: {o.error}" for o in failed))
    return outcomes


def error_cells(scored: DataFrame) -> DataFrame:
    """(split, metric, value): RMSE, MAE and N of rows with y and y_pred by split."""
    e = F.col("y_pred") - F.col("y")
    one = scored.groupBy("split").agg(F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"), F.count("*").cast("double").alias("N"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("RMSE", "MAE", "N")])
    return one.select("split", F.explode(cells).alias("c")).select("split", "c.*")


def scaling_run(train: DataFrame, held: DataFrame, key: Column, fit: Callable[[str, DataFrame, int], Callable[[DataFrame], DataFrame]], stratum: str | None = None) -> Callable[[dict], DataFrame]:
    """A run of a scaling sweep: trains on the key's fraction of the training rows, drawn by its seed, and scores all held rows.

    fit(method, rows, seed) gives what adds y_pred to rows. With a stratum each of its values keeps its share.
    """

    def run(at: dict) -> DataFrame:
        rows = training_fraction(train, key, at["fraction"], at["seed"], stratum)
        return error_cells(fit(at["method"], rows, at["seed"])(held))

    return run


def transfer_run(source: DataFrame, target: DataFrame, held: DataFrame, key: Column, fit: Callable, columns: list[str]) -> Callable[[dict], DataFrame]:
    """A run of a transfer sweep, by its `variant`: scratch (target rows alone), pooled (source and target), or residual
    (a model of the source, and one of what it misses on the target; a linear analogue of fine-tuning that needs no network)."""

    def run(at: dict) -> DataFrame:
        part = training_fraction(target, key, at["fraction"], at["seed"])
        if at["variant"] == "scratch":
            scored = fit(at["method"], part, at["seed"])(held)
        elif at["variant"] == "pooled":
            scored = fit(at["method"], source.select("y", *columns).unionByName(part.select("y", *columns)), at["seed"])(held)
        elif at["variant"] == "residual":
            first = fit(at["method"], source, at["seed"])
            left = first(part).withColumn("y", F.col("y") - F.col("y_pred")).drop("y_pred")
            second = fit(at["method"], left, at["seed"])
            both = first(held).withColumnRenamed("y_pred", "_first")
            scored = second(both).withColumn("y_pred", F.col("y_pred") + F.col("_first"))
        else:
            raise ValueError(f"unknown variant {at['variant']!r}")
        return error_cells(scored)

    return run
