"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quorumlab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (AQE, UTC, ANSI)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where none is set, one of its own on a local master, as in tests; on a cluster an error, since
    a machine's own folder would lose what is written there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not folder and found.isDefined():
        folder = found.get()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = os.path.join(tempfile.gettempdir(), "quorumlab-checkpoints")
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python workers in batches of so many rows at most, so that batches of long texts stay small in both processes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator has written, on whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and returns it without its lineage.

    Survives lost executors, unlike a local checkpoint or a cache of one copy.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables written once as Parquet in the shared folder, without their lineage; leaving the context removes them all.

    Unlike a checkpoint's, the last stage of a table's plan runs once, columns are encoded, and the files go when they aren't needed any more.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.tables = spark, 0
        self.folder = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        if self.tables:
            remove_folder(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
