"""Bundles of arrays with a commit step, digests of files of any size, and the metadata document's checks."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorumlab.plans import plumbing
from quorumlab.sources import bundles, sinks
from quorumlab.sources.tables import measurements

SCHEMA = "rid long, name string, y double, x array<float>, z array<double>"


def table(spark, n=500):
    return spark.range(n).select(
        F.col("id").alias("rid"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), (F.col("id") / 3).alias("y"),
        F.array(*[(F.col("id") * k).cast("float") for k in range(3)]).alias("x"), F.array(F.col("id") / 7, F.lit(1.5)).alias("z"),
    ).repartition(4)


def test_round_trip_and_columns(spark, tmp_path):
    path, rows = str(tmp_path / "b"), table(spark)
    bundles.write_bundle(rows, path, "rid")
    parts = bundles.read_manifest(path)
    assert len(parts) == 4 and sum(p["rows"] for p in parts) == 500
    for p in parts:
        raw = open(f"{path}/{p['part']}", "rb").read()
        assert hashlib.sha256(raw).hexdigest() == p["sha256"]
        arrays = np.load(f"{path}/{p['part']}")
        assert arrays["x"].dtype == np.float32 and arrays["x"].shape == (p["rows"], 3)
        assert (arrays["x"][:, 2] == 2 * arrays["rid"]).all() and [f"n{i}" for i in arrays["rid"]] == arrays["name"].tolist()
    back = bundles.read_bundle(spark, path, SCHEMA)
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert bundles.read_bundle(spark, path, "z array<double>, rid long").where("z[1] = 1.5").count() == 500
    bundles.write_bundle(rows.where("rid < 10").withColumn("rid", F.col("rid") + 1000), path, "rid", append=True)
    assert bundles.read_bundle(spark, path, SCHEMA).count() == 510
    bundles.write_bundle(rows.limit(7), path, "rid")
    assert bundles.read_bundle(spark, path, SCHEMA).count() == 7
    bundles.write_bundle(rows.limit(0), path, "rid")
    assert bundles.read_bundle(spark, path, SCHEMA).count() == 0


def test_a_task_of_many_rows_writes_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundles, "PART_BYTES", 4000)
    path, rows = str(tmp_path / "b"), table(spark).coalesce(1)

    class Writer(bundles.BundleWriter):
        def __init__(self, schema):
            super().__init__(path, schema, True)

    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))
    batches = rows.toArrow().to_batches()
    writer = Writer(rows.schema)
    found = writer.write(iter(batches))
    assert len(found.parts) > 2 and sum(p["rows"] for p in found.parts) == 500 and max(p["rows"] for p in found.parts) < 200
    writer.commit([found])
    assert sorted(map(tuple, bundles.read_bundle(spark, path, SCHEMA).collect())) == sorted(map(tuple, rows.collect()))
    before = sorted(os.listdir(path))
    broken = rows.withColumn("y", F.when(F.col("rid") < 450, F.col("y"))).orderBy("rid").toArrow().to_batches()
    with pytest.raises(ValueError, match="has nulls"):
        Writer(rows.schema).write(iter(broken))
    assert sorted(os.listdir(path)) == before  # a task that fails takes its earlier parts along


def test_sums_of_ids_that_no_long_holds_are_exact(spark, tmp_path, sf_dir):
    for name in ("part", "supplier", "lineitem"):
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            rows = rows.withColumn("l_orderkey", F.col("l_orderkey").cast("long") + 9_000_000_000_000)
        rows.write.parquet(str(tmp_path / f"{name}.parquet"))
    want = {}
    for r in measurements(spark, str(tmp_path)).select("solvent", "rid").collect():
        want[r["solvent"]] = want.get(r["solvent"], 0) + r["rid"]
    found = {r["solvent"]: int(r["rids"]) for r in plumbing.array_bundle(spark, str(tmp_path)).collect()}
    assert found == want and max(want.values()) > 1 << 63


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "b"), table(spark)
    bundles.write_bundle(rows, path, "rid")
    before = sorted(os.listdir(path))
    for broken in (
        rows.withColumn("x", F.when(F.col("rid") == 77, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("x"))),
        rows.withColumn("y", F.when(F.col("rid") != 77, F.col("y"))),
    ):
        with pytest.raises(Exception, match="isn't a matrix|has nulls"):
            bundles.write_bundle(broken, path, "rid")
        assert bundles.read_bundle(spark, path, SCHEMA).count() == 500 and json.load(open(f"{path}/{bundles.MANIFEST}"))["parts"]
    assert {x for x in before} <= set(os.listdir(path))
    with pytest.raises(ValueError):
        bundles.write_bundle(rows, path, "other")
    assert bundles.read_bundle(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_digests_of_small_odd_and_large_files(spark, tmp_path):
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "empty").write_bytes(b"")
    (folder / "with space.bin").write_bytes(bytes(range(256)) * 100_000)
    with open(folder / "large", "wb") as f:  # above 2 GB, sparse
        f.truncate((2 << 30) + 12_345)
    found = {r["path"].rsplit("/", 1)[-1]: (r["length"], r["sha256"]) for r in bundles.file_digests(spark, str(folder)).collect()}
    zero = hashlib.sha256()
    for _ in range(2048):
        zero.update(bytes(1 << 20))
    zero.update(bytes(12_345))
    assert set(found) == {"with space.bin", "large"} and bundles.digest_of(str(folder / "empty")) == (0, hashlib.sha256(b"").hexdigest())
    assert found["with space.bin"] == (25_600_000, hashlib.sha256(bytes(range(256)) * 100_000).hexdigest())
    assert found["large"] == ((2 << 30) + 12_345, zero.hexdigest())


def test_files_against_the_document(spark, tmp_path):
    folder = tmp_path / "out"
    folder.mkdir()
    for name in "abc":
        (folder / f"{name}.csv").write_text(f"k\n{name}\n")
    document = {"distribution": bundles.file_objects(spark, str(folder), "rows", "text/csv")}
    (folder / "a.csv").write_text("k\nx\n")
    (folder / "b.csv").unlink()
    (folder / "d.csv").write_text("k\n")
    assert dict(map(tuple, bundles.check_files(spark, str(folder), document).collect())) == {"a.csv": "changed", "b.csv": "missing", "c.csv": "same", "d.csv": "unlisted"}


def test_document_checks(spark):
    files = [{"@type": "cr:FileObject", "@id": "f", "sha256": "0" * 64}]
    record = sinks.record_set(spark.range(1), "rows", ["id"], {}, "f")
    rai = dict.fromkeys(sinks.REQUIRED_RAI, "text") | {"rai:hasSyntheticData": False}
    good = sinks.dataset_document("d", "a set", "https://spdx.org/licenses/MIT", files, [record], rai, version="1.0", creator={"@type": "sc:Person", "name": "A"})
    sinks.assert_consistent(good)
    assert len(sinks.REQUIRED_RAI) == 23 and good["version"] == "1.0"
    for key in sinks.REQUIRED_RAI:
        with pytest.raises(ValueError, match="missing"):
            sinks.assert_consistent({k: v for k, v in good.items() if k != key})
    for change in ({"@type": "sc:Thing"}, {"conformsTo": sinks.CONFORMS_TO[:1]}, {"distribution": [files[0] | {"sha256": ""}]}, {"distribution": [files[0] | {"@type": "sc:File"}]}, {"distribution": files * 2}, {"distribution": []}):
        with pytest.raises(ValueError):
            sinks.assert_consistent(good | change)
