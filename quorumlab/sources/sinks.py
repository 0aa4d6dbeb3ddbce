"""Sinks and reports: phase tables, CSV, JSON reports, result runs, dataset metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quorumlab.session import remove_folder


def write_phase(df: DataFrame, path: str, as_csv: bool = False, gzip: bool = False, partition_by: list[str] | None = None) -> None:
    """A phase's table as Parquet, or as CSV (with a header, gzip if asked)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if as_csv:
        writer.option("header", True).option("compression", "gzip" if gzip else "none").csv(path)
    else:
        writer.parquet(path)


def phase(spark: SparkSession, path: str, build, force: bool = False) -> DataFrame:
    """The table at path, built and written first where it is missing or force is set."""
    if force or not path_exists(spark, path):
        write_phase(build(), path)
    return spark.read.parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes what lies at path, if anything does."""
    if path_exists(spark, path):
        remove_folder(spark, path)


def append_missing(spark: SparkSession, path: str, wanted: DataFrame, key: list[str], build) -> DataFrame:
    """The cache at path after build(missing keys) is appended for keys of wanted that it lacks."""
    keys = wanted.select(*key).distinct()
    if path_exists(spark, path):
        keys = keys.join(spark.read.parquet(path).select(*key), key, "left_anti")
    build(keys).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def json_report(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("report"))


def write_run(metrics: DataFrame, path: str, method: str, seed: int) -> None:
    """metrics(split, metric, value) of one run, as the partition (method, seed) of the results table."""
    rows = metrics.select("split", "metric", "value", F.lit(method).alias("method"), F.lit(seed).alias("seed"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("method", "seed").parquet(path)


def finished_runs(spark: SparkSession, path: str, grid: DataFrame) -> DataFrame:
    """Rows of grid(method, seed, ...) that the results table doesn't have yet."""
    if not path_exists(spark, path):
        return grid
    return grid.join(spark.read.parquet(path).select("method", "seed").distinct(), ["method", "seed"], "left_anti")


def flatten_results(spark: SparkSession, path: str) -> DataFrame:
    """(run, split, metric, value) of a tree of JSON files that map split to metric to number.

    Leading underscores of metric names go; what isn't a number is left out.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("run"), "value")
    splits = raw.select("run", F.explode(F.from_json("value", T.MapType(T.StringType(), T.StringType()))).alias("split", "inner"))
    cells = splits.select("run", "split", F.explode(F.from_json("inner", T.MapType(T.StringType(), T.StringType()))).alias("metric", "text"))
    named = cells.select("run", "split", F.regexp_replace("metric", "^_+", "").alias("metric"), F.expr("try_cast(text AS DOUBLE)").alias("value"))
    return named.where("value is not null")


#: Field types of dataset metadata for each kind of column.
FIELD_TYPES = {"string": "sc:Text", "double": "sc:Float", "float": "sc:Float", "int": "sc:Integer", "bigint": "sc:Integer", "smallint": "sc:Integer", "boolean": "sc:Boolean"}


def record_set(df: DataFrame, name: str, key: list[str], descriptions: dict[str, str], file_id: str) -> dict:
    """A metadata record set: a field for each column, with its type, description and source."""
    fields = [
        {"@type": "cr:Field", "@id": f"{name}/{c}", "name": c, "description": descriptions.get(c, ""), "dataType": FIELD_TYPES.get(kind, "sc:Text"), "source": {"fileObject": {"@id": file_id}, "extract": {"column": c}}}
        for c, kind in df.dtypes
    ]
    return {"@type": "cr:RecordSet", "@id": name, "name": name, "key": [{"@id": f"{name}/{c}"} for c in key], "field": fields}


#: The vocabularies that a document conforms to, and the keys on responsible use that it must have.
CONFORMS_TO = ["http://mlcommons.org/croissant/1.1", "http://mlcommons.org/croissant/RAI/1.0"]
REQUIRED_RAI = (
    "rai:dataLimitations", "rai:dataBiases", "rai:personalSensitiveInformation", "rai:dataUseCases", "rai:dataSocialImpact", "rai:hasSyntheticData", "prov:wasDerivedFrom", "prov:wasGeneratedBy",
    "rai:dataCollection", "rai:dataCollectionType", "rai:dataCollectionMissingData", "rai:dataCollectionRawData", "rai:dataCollectionTimeframe", "rai:dataImputationProtocol",
    "rai:dataPreprocessingProtocol", "rai:dataManipulationProtocol", "rai:dataAnnotationProtocol", "rai:dataAnnotationPlatform", "rai:dataAnnotationAnalysis", "rai:annotationsPerItem",
    "rai:annotatorDemographics", "rai:machineAnnotationTools", "rai:dataReleaseMaintenancePlan",
)


def dataset_document(name: str, description: str, license_url: str, files: list[dict], records: list[dict], responsible: dict[str, object], **more: object) -> dict:
    """The whole metadata document (JSON-LD); `more` are further properties of the data set (creator, citeAs, version, url, ...)."""
    context = {
        "@language": "en", "@vocab": "https://schema.org/", "sc": "https://schema.org/", "cr": "http://mlcommons.org/croissant/", "rai": "http://mlcommons.org/croissant/RAI/",
        "prov": "http://www.w3.org/ns/prov#", "citeAs": "cr:citeAs", "conformsTo": "dct:conformsTo", "dct": "http://purl.org/dc/terms/", "dataType": {"@id": "cr:dataType", "@type": "@vocab"},
        "extract": "cr:extract", "field": "cr:field", "fileObject": "cr:fileObject", "key": "cr:key", "column": "cr:column", "recordSet": "cr:recordSet", "source": "cr:source", "sha256": "cr:sha256",
    }
    document = {"@context": context, "@type": "sc:Dataset", "name": name, "description": description, "license": license_url, "conformsTo": CONFORMS_TO, "distribution": files, "recordSet": records}
    return document | more | responsible


def assert_consistent(document: dict) -> None:
    """Raises ValueError for another type, missing vocabularies, repeated ids, entries of another kind, files without a digest, fields or keys that
    name nothing known, or keys on responsible use that are missing or empty (false is an answer)."""
    if document["@type"] != "sc:Dataset":
        raise ValueError(f"a document of type {document['@type']}")
    if absent := [v for v in CONFORMS_TO if v not in document["conformsTo"]]:
        raise ValueError(f"doesn't conform to {absent}")
    files = [f["@id"] for f in document["distribution"]]
    fields = [f for r in document["recordSet"] for f in r["field"]]
    ids = files + [r["@id"] for r in document["recordSet"]] + [f["@id"] for f in fields]
    if repeated := sorted({x for x in ids if ids.count(x) > 1}):
        raise ValueError(f"repeated ids: {repeated}")
    kinds = [(document["distribution"], "cr:FileObject"), (document["recordSet"], "cr:RecordSet"), (fields, "cr:Field")]
    if other := [x["@id"] for entries, kind in kinds for x in entries if x["@type"] != kind]:
        raise ValueError(f"of another kind: {other}")
    if bare := [f["@id"] for f in document["distribution"] if len(f.get("sha256", "")) != 64]:
        raise ValueError(f"files without a digest: {bare}")
    if unknown := sorted({f["source"]["fileObject"]["@id"] for f in fields} - set(files)):
        raise ValueError(f"fields of unknown files: {unknown}")
    if loose := sorted({k["@id"] for r in document["recordSet"] for k in r["key"]} - {f["@id"] for f in fields}):
        raise ValueError(f"keys that are no fields: {loose}")
    if missing := [k for k in REQUIRED_RAI if document.get(k) in (None, "", [])]:
        raise ValueError(f"missing: {missing}")


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """(name, n_rows) of each table."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("name"), "n_rows") for n, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def check_key(df: DataFrame, key: list[str]) -> None:
    """Raises ValueError if a table's key isn't unique or has nulls."""
    bad = df.groupBy(*key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)).cast("boolean"))
    if first := bad.limit(1).collect():
        raise ValueError(f"key {key} is broken: {json.dumps(first[0].asDict(), default=str)}")


SPLIT_COLUMNS = {"Solute_Canon": "Solute", "Solvent_Canon": "Solvent", "Solvent": "Solvent_Name", "Temperature_K": "Temperature", "LogS": "LogS", "LogS_consensus": "LogS", "sigma": "Uncertainty"}


def load_splits(spark: SparkSession, folder: str, splits: dict[str, str]) -> DataFrame:
    """One table of all splits under the toolkit's column names, with a `split` column.

    A solvent's name is the last one seen over the splits in order; tiers, which have none, get it
    from there, and `Unknown` stands in for a missing one.
    """
    from quorumlab.sources.tables import last_name_wins

    parts = []
    for i, (name, file) in enumerate(splits.items()):
        raw = spark.read.parquet(f"{folder}/{file}")
        cols = [F.col(c).alias(SPLIT_COLUMNS[c]) for c in raw.columns if c in SPLIT_COLUMNS]
        parts.append(raw.select(*cols, F.lit(name).alias("split"), F.lit(i).alias("_order")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if "Solvent_Name" not in every.columns:
        every = every.withColumn("Solvent_Name", F.lit(None).cast("string"))
    names = last_name_wins(every.select(F.col("Solvent").alias("_s"), F.col("Solvent_Name").alias("_name"), "_order"), "_s", "_name", ["_order"])
    out = every.join(names, every["Solvent"] == names["_s"], "left")
    return out.withColumn("Solvent_Name", F.coalesce("Solvent_Name", "_name", F.lit("Unknown"))).drop("_s", "_name", "_order")


def split_overview(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("Solute").alias("n_solutes"), F.countDistinct("Solvent").alias("n_solvents"))


def load_pretraining(spark: SparkSession, path: str, schema: T.StructType, label: str = "dgsolv") -> DataFrame:
    """(solute, solvent, t, y) of a pretraining table whose label has one fixed temperature."""
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return raw.select(F.col("Solute").alias("solute"), F.col("Solvent").alias("solvent"), F.lit(298.15).alias("t"), F.col(label).alias("y"))
