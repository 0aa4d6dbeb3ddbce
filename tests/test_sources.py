import json

import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from quorumlab.functions import molecules
from quorumlab.plans import registry
from quorumlab.sources import bundles, sinks, tables
from quorumlab.streaming import incremental


def test_csv_keeps_decimals_as_text(spark, tmp_path):
    (tmp_path / "m.csv").write_text("name,value\na,1.250\nb,nope\n")
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
    out = tables.scan_csv_keeping_text(spark, str(tmp_path / "m.csv"), schema, "value").orderBy("name").collect()
    assert [(r["value"], r["value_text"]) for r in out] == [(1.25, "1.250"), (None, "nope")]


def test_nan_becomes_null(spark):
    df = tables.nan_to_null(spark.createDataFrame([(float("nan"), "x"), (1.0, None)], "v double, s string"))
    assert df.where("v is null").count() == 1


def test_phases_caches_and_runs(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "phase")
    assert sinks.phase(spark, path, build).count() == 3 and sinks.phase(spark, path, build).count() == 3 and len(built) == 1
    cache = str(tmp_path / "cache")
    make = lambda keys: keys.withColumn("v", F.col("k") * 2)
    first = spark.createDataFrame([(1,), (2,)], "k int")
    assert sinks.append_missing(spark, cache, first, ["k"], make).count() == 2
    assert sorted(r["k"] for r in sinks.append_missing(spark, cache, spark.createDataFrame([(2,), (3,)], "k int"), ["k"], make).collect()) == [1, 2, 3]
    results = str(tmp_path / "results")
    metrics = spark.createDataFrame([("eval", "rmse", 1.0)], "split string, metric string, value double")
    sinks.write_run(metrics, results, "m", 42)
    sinks.write_run(metrics, results, "m", 43)
    grid = registry.sweep_grid(spark, method=["m"], seed=[42, 43, 44])
    assert [r["seed"] for r in sinks.finished_runs(spark, results, grid).collect()] == [44]
    assert {r["method"]: r["n_runs"] for r in registry.status(spark, spark.read.parquet(results)).collect()}["random_forest"] == 0


def test_results_tree_and_report(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "seed_1.json").write_text(json.dumps({"eval": {"_rmse": 0.5, "note": "x"}}))
    out = sinks.flatten_results(spark, str(tmp_path / "a")).collect()
    assert [(r["split"], r["metric"], r["value"]) for r in out] == [("eval", "rmse", 0.5)]
    assert json.loads(sinks.json_report(spark.createDataFrame([(1, None)], "a int, b string")).first()["report"]) == {"a": 1, "b": None}


def test_gzip_csv_and_metadata(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "k string, v double")
    sinks.write_phase(df.coalesce(1), str(tmp_path / "out"), as_csv=True, gzip=True)
    files = bundles.file_objects(spark, str(tmp_path / "out"))
    assert len(files) == 1 and len(files[0]["sha256"]) == 64 and files[0]["name"].endswith(".csv.gz")
    record = sinks.record_set(df, "rows", ["k"], {"k": "the key"}, files[0]["@id"])
    rai = dict.fromkeys(sinks.REQUIRED_RAI, "text")
    document = sinks.dataset_document("d", "a set", "https://creativecommons.org/licenses/by/4.0/", files, [record], rai)
    sinks.assert_consistent(document)
    assert [f["dataType"] for f in record["field"]] == ["sc:Text", "sc:Float"]
    for broken in ({**document, "recordSet": [record, record]}, {**document, "distribution": []}, {**document, "rai:dataBiases": ""}):
        with pytest.raises(ValueError):
            sinks.assert_consistent(broken)
    sinks.check_key(df, ["k"])
    with pytest.raises(ValueError):
        sinks.check_key(df.union(df), ["k"])


def test_split_loader_names(spark, tmp_path):
    spark.createDataFrame([("s", "O", "Water", 300.0, 1.0)], "Solute_Canon string, Solvent_Canon string, Solvent string, Temperature_K double, LogS double").write.parquet(f"{tmp_path}/train")
    spark.createDataFrame([("s", "O", 300.0, 1.0, 0.1), ("s", "C", 300.0, 1.0, None)], "Solute_Canon string, Solvent_Canon string, Temperature_K double, LogS_consensus double, sigma double").write.parquet(f"{tmp_path}/gold")
    out = sinks.load_splits(spark, str(tmp_path), {"train": "train", "gold": "gold"})
    assert sorted((r["split"], r["Solvent"], r["Solvent_Name"]) for r in out.collect()) == [("gold", "C", "Unknown"), ("gold", "O", "Water"), ("train", "O", "Water")]
    assert sinks.split_overview(out).count() == 2


def test_registries(spark):
    df = spark.createDataFrame([(" CCO", "O", 300.0), (None, "O", 0.0)], "solute string, solvent string, t double")
    assert registry.canonicalize(df, "solute", "trim", "canon").where("canon = 'CCO'").count() == 1
    table = registry.feature_table(df, ["solute", "solvent"], "letter_counts")
    out = registry.assemble(df, table, "solute", "solvent", "t").collect()
    assert {len(r["features"]) for r in out} == {2 * 11 + 4} and all(x == x and abs(x) != float("inf") for r in out for x in r["features"])
    assert registry.missing_features(df, table, "solute").count() == 1
    with pytest.raises(ValueError):
        registry.featurizer("unknown")
    with pytest.raises(NotImplementedError):
        registry.METHODS["graph_attention"].train(df, 1)
    assert registry.resolve_entry_point("json:dumps") is json.dumps
    assert registry.Method("own", "custom", entry_point="builtins:print").train("x", 1) is None


def test_samples_for_training(spark):
    rows = spark.range(200)
    key = F.col("id").cast("string")
    assert registry.training_fraction(rows, key, 0.1, 1).count() == 32
    assert registry.validation_cut(rows, key, 200, 1, least=10, share=0.05).where("validation").count() == 10


def test_occlusion(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id int, v array<double>")
    out = registry.occlusion_importance(df, "v", lambda s: s.map(lambda x: float(x[0] * 3 + x[1])))
    assert {r["element"]: r["importance"] for r in out.collect()} == {0: 3.0, 1: 2.0}
    assert registry.group_importance(out.withColumn("g", F.lit("a")), ["g", "element"], top=1).first()["element"] == 0


def test_stream_deduplication(spark, tmp_path):
    rows = pd.DataFrame({"k": ["a", "a", "b"], "at": pd.to_datetime(["2024-01-01 00:00:00"] * 3), "value": [1.0, 1.0, 2.0]})
    spark.createDataFrame(rows).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, at timestamp, value double").parquet(f"{tmp_path}/in")
    q = incremental.deduplicate_stream(stream, ["k"], "at", "1 hour").writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 2
    counts = incremental.windowed_source_counts(stream, "at", "k", "1 hour", "1 hour").writeStream.format("memory").outputMode("complete").queryName("counted").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert {r["k"]: r["n"] for r in spark.table("counted").collect()} == {"a": 2, "b": 1}


def test_smiles_are_read_or_refused():
    m = molecules.parse("C[C@@H](N)C(=O)[O-].[Na+]")
    assert m.symbols == ["C", "C", "N", "C", "O", "O", "Na"] and m.hydrogens == [3, 1, 2, 0, 0, 0, 0] and m.charges == [0, 0, 0, 0, 0, -1, 1] and len(m.bonds) == 5
    assert molecules.parse("c1cc[nH]c1").hydrogens == [1, 1, 1, 1, 1] and molecules.parse("C%12CC%12").in_ring() == [True] * 3
    assert all(molecules.parse(x) is None for x in (None, "", "C1CC", "C(", "C)", "xyz", "[Zz]", "1C"))
    ethanol, same, other = (molecules.parse(x) for x in ("CCO", "OCC", "CCN"))
    for f in (molecules.environments, molecules.atom_pairs, molecules.topology):
        assert f(ethanol) == f(same)
    assert molecules.environments(ethanol) != molecules.environments(other) and len(molecules.topology(ethanol)) == len(molecules.TOPOLOGY_NAMES)
    assert sum(molecules.atom_pairs(ethanol)) == 3
