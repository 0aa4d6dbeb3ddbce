"""Registered queries of sources, sinks, caches, feature tables and experiment plumbing, with their SQL.

What a query writes goes to a folder of its own below the session's shared folder.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from quorumlab.functions import scalar
from quorumlab.operators import audit, metrics, models, splits
from quorumlab.plans import registry, sweeps
from quorumlab.plans.catalogue import M, PRED, SPLITS, made_splits, query, r6, rounded, split_rows
from quorumlab.session import cut, shared_folder
from quorumlab.sources import bundles, sinks, tables
from quorumlab.sources.tables import measurements, scan_parquet


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- Sources and sinks -----------------------------------------------------------------------

PART = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_brand", T.StringType()), T.StructField("p_retailprice", T.DoubleType())])


def part_as_csv(spark, sf_dir, gzip: bool = False) -> str:
    path = scratch(spark, "csv")
    sinks.write_phase(scan_parquet(spark, sf_dir, "part").select(F.col("p_partkey").cast("long"), "p_brand", F.col("p_retailprice").cast("double")), path, as_csv=True, gzip=gzip)
    return path


BRANDS = "SELECT p_brand, count(*) AS n, round(sum(p_retailprice::DOUBLE), 4) AS total FROM part GROUP BY 1"


def brands(df: DataFrame) -> DataFrame:
    return df.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"))


@query(BRANDS)
def csv_phase(spark, sf_dir):
    """A phase's table written as CSV and scanned under its declared schema."""
    return brands(tables.scan_csv(spark, part_as_csv(spark, sf_dir), PART))


@query(BRANDS)
def compressed_csv(spark, sf_dir):
    return brands(tables.scan_csv(spark, part_as_csv(spark, sf_dir, gzip=True), PART))


@query("""SELECT length(rtrim(split_part(p_retailprice::DOUBLE::VARCHAR, '.', 2), '0'))::INT AS decimals, count(*) AS n, round(sum(p_retailprice::DOUBLE), 4) AS total FROM part GROUP BY 1""")
def csv_text_column(spark, sf_dir):
    """A number kept as it was written beside its value: how many decimals it was given with."""
    raw = tables.scan_csv_keeping_text(spark, part_as_csv(spark, sf_dir), PART, "p_retailprice")
    return raw.groupBy(scalar.n_decimals(F.col("p_retailprice_text")).alias("decimals")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("total"))


@query("SELECT 1::BIGINT AS n_builds, count(*) AS n_rows FROM part UNION ALL SELECT 2, count(*) FROM part")
def phase_cache(spark, sf_dir):
    """A cached phase: built on the first call, read on the second, built again by force."""
    path, builds, out = scratch(spark, "phase"), [], None

    def build() -> DataFrame:
        builds.append(1)
        return scan_parquet(spark, sf_dir, "part")

    for force in (False, False, True):
        rows = sinks.phase(spark, path, build, force).agg(F.count("*").alias("n_rows"))
        found = cut(rows.select(F.lit(len(builds)).cast("long").alias("n_builds"), "n_rows"))  # before the files are replaced
        out = found if out is None else out.unionAll(found)
    return out.distinct()


@query(f"""WITH {SPLITS}, c AS (SELECT split, count(*) AS n_rows, count(DISTINCT solute) AS n_solutes, count(DISTINCT solvent) AS n_solvents FROM sp GROUP BY 1), l AS (SELECT arg_max(src, rid) AS name, solvent FROM sp GROUP BY 2),
g AS (SELECT m.* FROM m JOIN tp USING (solute, solvent)) SELECT split, n_rows, n_solutes, n_solvents, 0::BIGINT AS n_unknown FROM c
UNION ALL SELECT 'gold', count(*), count(DISTINCT solute), count(DISTINCT g.solvent), count(*) FILTER (l.solvent IS NULL) FROM g LEFT JOIN l USING (solvent) HAVING count(*) > 0""")
def split_loader(spark, sf_dir):
    """Splits written under the curated names and loaded under the toolkit's, tiers with names from the splits."""
    rows, tp = split_rows(spark, sf_dir)
    folder, files = scratch(spark, "splits"), {}
    named = rows.select(F.col("solute").alias("Solute_Canon"), F.col("solvent").alias("Solvent_Canon"), F.col("src").alias("Solvent"), F.col("t").alias("Temperature_K"), F.col("y").alias("LogS"), "split")
    for name in ("train", "eval", "ood"):
        sinks.write_phase(named.where(F.col("split") == name).drop("split"), f"{folder}/{name}")
        files[name] = name
    gold = measurements(spark, sf_dir).join(tp, ["solute", "solvent"]).select(F.col("solute").alias("Solute_Canon"), F.col("solvent").alias("Solvent_Canon"), F.col("t").alias("Temperature_K"), F.col("y").alias("LogS_consensus"))
    sinks.write_phase(gold, f"{folder}/gold")
    loaded = sinks.load_splits(spark, folder, files | {"gold": "gold"})
    return sinks.split_overview(loaded).join(loaded.groupBy("split").agg(F.count_if(F.col("Solvent_Name") == "Unknown").alias("n_unknown")), "split").select("split", "n_rows", "n_solutes", "n_solvents", "n_unknown")


@query("SELECT p_type AS solvent, count(*) AS n, round(avg(p_retailprice::DOUBLE), 4) AS mean, 298.15::DOUBLE AS t FROM part GROUP BY 1")
def pretraining_scan(spark, sf_dir):
    path = scratch(spark, "pretraining")
    sinks.write_phase(scan_parquet(spark, sf_dir, "part").select(F.col("p_brand").alias("Solute"), F.col("p_type").alias("Solvent"), F.col("p_retailprice").cast("double").alias("dgsolv")), path, as_csv=True)
    schema = T.StructType([T.StructField("Solute", T.StringType()), T.StructField("Solvent", T.StringType()), T.StructField("dgsolv", T.DoubleType())])
    return sinks.load_pretraining(spark, path, schema).groupBy("solvent", "t").agg(F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("mean")).select("solvent", "n", "mean", "t")


@query("""WITH c AS (SELECT 'orders' AS name, column_name AS c, column_type AS k, (SELECT count(*) FROM orders) AS n FROM (DESCRIBE orders) UNION ALL SELECT 'part', column_name, column_type, (SELECT count(*) FROM part) FROM (DESCRIBE part))
SELECT name || '/' || c AS id, CASE WHEN k IN ('DOUBLE', 'FLOAT') THEN 'sc:Float' WHEN k IN ('BIGINT', 'INTEGER', 'SMALLINT') THEN 'sc:Integer' WHEN k = 'BOOLEAN' THEN 'sc:Boolean' ELSE 'sc:Text' END AS kind,
  c IN ('o_orderkey', 'p_partkey') AS is_key, n AS n_rows, true AS files_same FROM c""")
def dataset_fields(spark, sf_dir):
    """The whole metadata document of two tables written as CSV: their files hashed in chunks, checked again against the document."""
    files, records, counts, path = [], [], {}, scratch(spark, "dataset")
    for name, key in (("orders", "o_orderkey"), ("part", "p_partkey")):
        df = scan_parquet(spark, sf_dir, name)
        sinks.write_phase(df, f"{path}/{name}", as_csv=True)
        written = bundles.file_objects(spark, f"{path}/{name}", f"Rows of {name}.", "text/csv")
        files += written
        records.append(sinks.record_set(df, name, [key], {}, written[0]["@id"]))
        counts[name] = spark.read.option("header", True).csv(f"{path}/{name}").count()
    document = sinks.dataset_document("trade", "Orders and parts.", "https://spdx.org/licenses/CC0-1.0", files, records, dict.fromkeys(sinks.REQUIRED_RAI, "none"))
    sinks.assert_consistent(document)
    same = bundles.check_files(spark, path, document).where("state <> 'same' and id like '%.csv'").isEmpty()
    keys = {k["@id"] for r in records for k in r["key"]}
    found = [(f["@id"], f["dataType"], f["@id"] in keys, counts[r["name"]], same) for r in records for f in r["field"]]
    sinks.remove_table(spark, path)
    return spark.createDataFrame(found, "id string, kind string, is_key boolean, n_rows long, files_same boolean")


@query(f"""WITH {M}, ks AS (SELECT p_brand AS k FROM part UNION SELECT p_type FROM part), f AS (SELECT k, (length(k) + len(string_split(k, '=')) + len(string_split(k, '(')) - 2 + {' + '.join(f"(length(k) - length(replace(k, '{c}', '')))" for c in 'BCFINOPS')})::DOUBLE AS total FROM ks)
SELECT solvent, count(*) AS n_rows, sum(rid)::BIGINT AS rids, round(sum(a.total + b.total), 3) AS features, round(sum(y), 4) AS labels FROM m JOIN f a ON a.k = solute JOIN f b ON b.k = solvent GROUP BY 1""")
def array_bundle(spark, sf_dir):
    """Feature matrices written with the rows that they belong to, and read back aligned. Sums of ids are exact: longs, or decimals in tables where one doesn't fit a long."""
    m, path = measurements(spark, sf_dir), scratch(spark, "bundle")
    table = cut(registry.feature_table(m, ["solute", "solvent"], "letter_counts"))
    rows = registry.assemble(m, table, "solute", "solvent", "t").select("rid", "solvent", "y", "features")
    bundles.write_bundle(rows, path, "rid")
    back = bundles.read_bundle(spark, path, "rid long, solvent string, y double, features array<float>")
    width = F.size("features") - 4  # the last four are of temperature
    total = F.aggregate(F.slice("features", F.lit(1), width), F.lit(0.0), lambda s, x: s + x.cast("double"))
    out = cut(back.groupBy("solvent").agg(F.count("*").alias("n_rows"), F.sum(F.col("rid").cast("decimal(20,0)")).alias("rids"), F.round(F.sum(total), 3).alias("features"), F.round(F.sum("y"), 4).alias("labels")))
    sinks.remove_table(spark, path)
    beyond = F.abs("rids") > F.lit((1 << 63) - 1)  # no long holds it; a cast to BIGINT fails there in SQL, too
    return out.withColumn("rids", F.col("rids").cast("long")) if out.where(beyond).isEmpty() else out


RUNS = f"""{PRED}, sd AS (SELECT rid % 3 AS seed, rid FROM sp), ps AS (SELECT sp.split, sp.rid % 3 AS seed, sp.y AS y_true, coalesce(mn.mu, gm.g) AS y_pred FROM sp LEFT JOIN mn USING (solvent), gm),
rs AS (SELECT 'group_mean' AS method, seed::INT AS seed, split, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae FROM ps GROUP BY seed, split),
rl AS (SELECT method, seed, split, 'RMSE' AS metric, rmse AS value FROM rs UNION ALL SELECT method, seed, split, 'MAE', mae FROM rs)"""


def run_metrics(spark, sf_dir) -> DataFrame:
    """(method, seed, split, metric, value) of the group-mean baseline; a seed's run scores the rows of its remainder."""
    rows, _ = split_rows(spark, sf_dir)
    e = F.col("y_pred") - F.col("y_true")
    scored = metrics.dummy_baseline(rows.where("split = 'train'"), rows).groupBy((F.col("rid") % 3).cast("int").alias("seed"), "split").agg(F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("RMSE", "MAE")])
    return cut(scored.select(F.lit("group_mean").alias("method"), "seed", "split", F.explode(cells).alias("c")).select("method", "seed", "split", "c.*"))


@query(f"WITH {RUNS} SELECT method, split, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM rl GROUP BY ALL")
def seed_aggregate(spark, sf_dir):
    return rounded(metrics.seed_aggregate(run_metrics(spark, sf_dir), ["method", "split", "metric"]), "mean", "std")


@query(f"""WITH {RUNS} SELECT method, 1::BIGINT AS ord, round(avg(value) FILTER (split = 'eval' AND metric = 'RMSE'), 6) AS eval_RMSE, round(avg(value) FILTER (split = 'ood' AND metric = 'RMSE'), 6) AS ood_RMSE FROM rl GROUP BY 1""")
def method_table(spark, sf_dir):
    table = metrics.method_table(metrics.seed_aggregate(run_metrics(spark, sf_dir), ["method", "split", "metric"]), ["eval_RMSE", "ood_RMSE"], ["group_mean"])
    return rounded(table, "eval_RMSE", "ood_RMSE").select("method", "ord", "eval_RMSE", "ood_RMSE")


FRACTIONS, SWEEP_SEEDS = [0.1, 0.5, 1.0], [42, 101]


def mean_baseline(method: str, train: DataFrame, seed: int):
    """group_mean predicts the training mean of a solvent, grand_mean that of all rows."""
    group = F.col("solvent") if method == "group_mean" else F.lit("")
    return lambda rows: metrics.dummy_baseline(train.withColumn("_key", group), rows.withColumn("_key", group), "_key").drop("_key")


@query(f"""WITH {SPLITS}, gr AS (SELECT fraction, seed FROM (SELECT unnest({FRACTIONS}::DOUBLE[]) AS fraction), (SELECT unnest({SWEEP_SEEDS}) AS seed)),
pk AS (SELECT * FROM (SELECT fraction, seed, solvent, y, row_number() OVER (PARTITION BY fraction, seed ORDER BY md5(concat_ws('|', seed, rid)), rid::VARCHAR) AS r, count(*) OVER (PARTITION BY fraction, seed) AS n FROM gr, sp WHERE split = 'train') WHERE r <= least(n, greatest(32, round_even(n * fraction, 0)))),
mn AS (SELECT fraction, seed, solvent, avg(y) AS mu FROM pk GROUP BY ALL), gm AS (SELECT fraction, seed, avg(y) AS g FROM pk GROUP BY ALL),
ps AS (SELECT gm.fraction, gm.seed, split, sp.y, coalesce(mu, g) AS f FROM sp, gm LEFT JOIN mn ON mn.fraction = gm.fraction AND mn.seed = gm.seed AND mn.solvent = sp.solvent WHERE split <> 'train'),
sc AS (SELECT fraction, seed, split, sqrt(avg(pow(f - y, 2))) AS rmse, avg(abs(f - y)) AS mae, count(*)::DOUBLE AS n FROM ps GROUP BY ALL),
rl AS (SELECT fraction, seed, split, 'RMSE' AS metric, rmse AS value FROM sc UNION ALL SELECT fraction, seed, split, 'MAE', mae FROM sc UNION ALL SELECT fraction, seed, split, 'N', n FROM sc)
SELECT fraction, 'group_mean' AS method, split, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM rl GROUP BY ALL""")
def fraction_aggregate(spark, sf_dir):
    """A scaling sweep: the baseline is trained on seeded parts of the training rows, several runs at once; means and deviations over seeds."""
    path, kept = scratch(spark, "scaling"), scratch(spark, "scaling-rows")
    try:
        sinks.write_phase(made_splits(spark, sf_dir)[0].select("rid", "solvent", "y", "split"), kept)  # what runs need, in columns, read by each run
        rows = spark.read.parquet(kept)
        run = sweeps.scaling_run(rows.where("split = 'train'"), rows.where("split <> 'train'"), F.col("rid").cast("string"), mean_baseline)
        sweeps.whole(sweeps.run_sweep(spark, path, sweeps.grid(method=["group_mean"], fraction=FRACTIONS, seed=SWEEP_SEEDS), run))
        found = cut(sweeps.results(spark, path, "method string, fraction double, seed int"))
    finally:
        for written in (path, kept):
            sinks.remove_table(spark, written)
    return rounded(metrics.seed_aggregate(found, ["fraction", "method", "split", "metric"]), "mean", "std")


@query(f"WITH {RUNS} SELECT method, seed, split, metric, round(value, 6) AS value FROM rl WHERE seed < 2")
def run_results(spark, sf_dir):
    """Runs written one by one to the results table; a run that is written again replaces itself."""
    found, path = run_metrics(spark, sf_dir), scratch(spark, "runs")
    for seed in (0, 1, 1):
        sinks.write_run(found.where(F.col("seed") == seed), path, "group_mean", seed)
    return rounded(spark.read.parquet(path).select("method", F.col("seed").cast("int").alias("seed"), "split", "metric", "value"), "value")


@query("SELECT 'group_mean' AS method, seed::BIGINT AS seed FROM (SELECT unnest([2, 3]) AS seed)")
def open_runs(spark, sf_dir):
    """What a grid of methods and seeds still lacks."""
    found, path = run_metrics(spark, sf_dir), scratch(spark, "runs")
    for seed in (0, 1):
        sinks.write_run(found.where(F.col("seed") == seed), path, "group_mean", seed)
    grid = registry.sweep_grid(spark, method=["group_mean"], seed=[0, 1, 2, 3])
    return sinks.finished_runs(spark, path, grid).select("method", F.col("seed").cast("long").alias("seed"))


@query(f"WITH {RUNS} SELECT seed, split, metric, round(value, 6) AS value FROM rl")
def results_tree(spark, sf_dir):
    """A tree of JSON files, one for each run, read back as rows."""
    path = scratch(spark, "tree")
    inner = run_metrics(spark, sf_dir).groupBy("seed", "split").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("_"), F.col("metric")), "value"))).alias("m"))
    runs = inner.groupBy("seed").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("split", "m")))).alias("value"))
    runs.write.partitionBy("seed").text(path)
    flat = sinks.flatten_results(spark, path)
    return rounded(flat.select(F.regexp_extract("run", "seed=([0-9]+)", 1).cast("int").alias("seed"), "split", "metric", "value"), "value")


# --- Scalars, look-ups, order ------------------------------------------------------------------


@query("""WITH x AS (SELECT p_type, p_retailprice / 1000 AS s, 0.7 + p_size / 100.0 AS d, 40.0 + p_size AS w FROM part), f AS (SELECT p_type, w / (1000 * d) * s / (1 + w / (1000 * d) * s) AS x FROM x)
SELECT p_type, round(avg(x), 6) AS mean, round(max(x), 6) AS most FROM f GROUP BY 1""")
def mole_fraction_inverse(spark, sf_dir):
    part = scan_parquet(spark, sf_dir, "part").select("p_type", scalar.concentration_to_mole_fraction(F.col("p_retailprice") / 1000, 0.7 + F.col("p_size") / 100.0, 40.0 + F.col("p_size")).alias("x"))
    return rounded(part.groupBy("p_type").agg(F.avg("x").alias("mean"), F.max("x").alias("most")), "mean", "most")


@query(f"""WITH {M}, d AS (SELECT p_brand AS solute, 0.2 + min(p_size) / 100.0 AS new_s FROM part WHERE p_size < 10 GROUP BY 1),
c AS (SELECT m.*, pow(10, y) AS s, 0.05 + t / 10000 AS x, new_s, CASE WHEN src = 'N1-0' AND new_s IS NOT NULL THEN 'C1' WHEN src IN ('N2-0', 'N3-1') THEN 'C2' WHEN src = 'N4-0' THEN 'C3' END AS k FROM m LEFT JOIN d USING (solute)),
n AS (SELECT k, y, x, CASE k WHEN 'C1' THEN new_s WHEN 'C2' THEN s * 10 WHEN 'C3' THEN x ELSE s END AS s2, s FROM c),
o AS (SELECT k, y, x, log10(s2) AS y2, CASE WHEN k = 'C3' THEN s WHEN k IS NOT NULL THEN 0.1 * s2 / (1 + 0.1 * s2) ELSE x END AS x2 FROM n)
SELECT k AS correction, count(*) AS n_rows, round(sum(abs(y2 - y)), 5) AS moved_y, round(sum(abs(x2 - x)), 5) AS moved_x FROM o WHERE k IS NOT NULL GROUP BY 1""")
def recomputed_corrections(spark, sf_dir):
    """Corrections from a dimension, by factor and by swap; what follows from a corrected value is computed anew."""
    new = scan_parquet(spark, sf_dir, "part").where("p_size < 10").groupBy(F.col("p_brand").alias("solute")).agg((0.2 + F.min("p_size") / 100.0).alias("new_s"))
    m = measurements(spark, sf_dir).join(new, "solute", "left").withColumn("s", F.pow(F.lit(10.0), F.col("y"))).withColumn("x", 0.05 + F.col("t") / 10000)
    kind = F.when((F.col("src") == "N1-0") & F.col("new_s").isNotNull(), "C1").when(F.col("src").isin("N2-0", "N3-1"), "C2").when(F.col("src") == "N4-0", "C3")
    s2 = F.when(F.col("k") == "C1", F.col("new_s")).when(F.col("k") == "C2", F.col("s") * 10).when(F.col("k") == "C3", F.col("x"))
    inverse = scalar.concentration_to_mole_fraction(F.col("s2"), F.lit(1.0), F.lit(100.0))
    done = m.withColumn("k", kind).where("k is not null").withColumn("s2", s2).withColumn("y2", F.log10("s2")).withColumn("x2", F.when(F.col("k") == "C3", F.col("s")).otherwise(inverse))
    out = done.groupBy(F.col("k").alias("correction")).agg(F.count("*").alias("n_rows"), F.sum(F.abs(F.col("y2") - F.col("y"))).alias("moved_y"), F.sum(F.abs(F.col("x2") - F.col("x"))).alias("moved_x"))
    return out.withColumns({c: F.round(c, 5) for c in ("moved_y", "moved_x")})


@query(f"""WITH {M}, c AS (SELECT src, solvent, count(*) AS n, min(rid) AS f FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, f) AS k FROM c) SELECT src, solvent AS name, n FROM r WHERE k = 1""")
def majority_first_met(spark, sf_dir):
    return audit.majority(measurements(spark, sf_dir), "src", "solvent", "rid").withColumnRenamed("solvent", "name")


@query(f"""WITH {M}, q AS (SELECT src, avg(y) FILTER (t > 320) AS v FROM m WHERE solvent LIKE 'S%TIN' GROUP BY 1) SELECT src, round(v, 6) AS v, row_number() OVER (ORDER BY v DESC NULLS LAST, src)::INT AS place FROM q""")
def nulls_last(spark, sf_dir):
    """Sources by their mean at high temperatures; those without one come last. One row for each source."""
    q = measurements(spark, sf_dir).where("solvent like 'S%TIN'").groupBy("src").agg(F.avg(F.when(F.col("t") > 320, F.col("y"))).alias("v"))
    return q.select("src", r6("v").alias("v"), F.row_number().over(Window.orderBy(F.desc_nulls_last("v"), "src")).alias("place"))


@query(f"WITH {M}, c AS (SELECT solvent, src, dense_rank() OVER (PARTITION BY solvent ORDER BY solute) - 1 AS id, y FROM m) SELECT solvent, id, count(*) AS n FROM c GROUP BY 1, 2")
def dense_ids(spark, sf_dir):
    ids = measurements(spark, sf_dir).withColumn("id", F.dense_rank().over(Window.partitionBy("solvent").orderBy("solute")) - 1)
    return ids.groupBy("solvent", F.col("id").cast("long").alias("id")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '7', o_orderkey))) AS r, count(*) OVER () AS n FROM orders) SELECT r <= least(n, greatest(2048, round_even(n * 0.05, 0))) AS validation, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM r GROUP BY 1""")
def validation_cut(spark, sf_dir):
    """Training and validation rows by the order of a seeded hash."""
    orders = scan_parquet(spark, sf_dir, "orders").select("o_orderkey")
    marked = registry.validation_cut(orders, F.col("o_orderkey").cast("string"), orders.count(), 7)
    return marked.groupBy("validation").agg(F.count("*").alias("n"), F.sum("o_orderkey").cast("long").alias("key_sum"))


@query(f"""WITH {M}, k AS (SELECT rid, row_number() OVER (ORDER BY md5(concat_ws('|', '5', rid)), rid::VARCHAR) AS r, count(*) OVER () AS n FROM m) SELECT rid FROM k WHERE r <= least(n, greatest(500, round_even(n * 0.01, 0)))""")
def attribution_sample(spark, sf_dir):
    """The rows that attributions are computed for, or that a subset-of-data model keeps."""
    m = measurements(spark, sf_dir).select("rid")
    return splits.subsample(m, F.col("rid").cast("string"), m.count(), 0.01, 5, least=500)


@query(f"WITH {M}, b AS (SELECT DISTINCT p_brand FROM part WHERE p_size > 48), k AS (SELECT solute, count(*) AS n_skipped FROM m WHERE solute NOT IN (SELECT p_brand FROM b) GROUP BY 1) SELECT * FROM k")
def failed_lookups(spark, sf_dir):
    """Rows whose key has no features, counted by key."""
    known = scan_parquet(spark, sf_dir, "part").where("p_size > 48").select(F.col("p_brand").alias("key"), F.array(F.lit(1.0)).alias("features")).distinct()
    return registry.missing_features(measurements(spark, sf_dir), known, "solute")


@query("SELECT DISTINCT p_name AS key FROM part WHERE p_name IS NOT NULL AND NOT contains(p_name, 'a')")
def invalid_keys(spark, sf_dir):
    """Distinct keys that a canonicalizer refuses (here: those without an a)."""
    part = scan_parquet(spark, sf_dir, "part").select(F.col("p_name").alias("key"))
    return audit.validity_scan(part, "key", F.when(F.contains("key", F.lit("a")), F.upper("key")))


# --- Features, caches, drivers -----------------------------------------------------------------

LETTERS = " + ".join(f"(length(k) - length(replace(k, '{c}', '')))" for c in "BCFINOPS=(") + " + length(k)"


@query(f"""WITH {M}, ks AS (SELECT p_brand AS k FROM part UNION SELECT p_type FROM part), f AS (SELECT k, ({LETTERS})::DOUBLE AS total FROM ks)
SELECT rid, 26 AS width, round(a.total + b.total + t / 300 + 1000 / t + pow(t / 300, 2) + ln(t / 300), 3) AS total FROM m JOIN f a ON a.k = solute JOIN f b ON b.k = solvent""")
def feature_arrays(spark, sf_dir):
    """Solute, solvent and temperature features of each row as one array, from a table of distinct keys."""
    m = measurements(spark, sf_dir)
    table = cut(registry.feature_table(m, ["solute", "solvent"], "letter_counts"))
    out = registry.assemble(m, table, "solute", "solvent", "t")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return out.select("rid", F.size("features").alias("width"), F.round(total, 3).alias("total"))


@query("SELECT p_brand AS key, min(p_size)::INT AS built_in FROM (SELECT p_brand, CASE WHEN p_size < 25 THEN 1 ELSE 2 END AS p_size FROM part) GROUP BY 1")
def incremental_cache(spark, sf_dir):
    """A cache that is built for some keys first and for the missing ones later."""
    part, path = scan_parquet(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), "p_size"), scratch(spark, "cache")
    for n, wanted in ((1, part.where("p_size < 25")), (2, part)):
        out = sinks.append_missing(spark, path, wanted, ["key"], lambda keys, n=n: keys.withColumn("built_in", F.lit(n)))
    return out


@query(f"""WITH {M}, v AS (SELECT solvent, t / 300 AS a, y AS b FROM m), e AS (SELECT solvent, 0 AS element, abs(2 * a) AS i FROM v UNION ALL SELECT solvent, 1, abs(-0.5 * b) FROM v)
SELECT solvent, element, round(avg(i), 6) AS mean, round(sum(i), 4) AS sum, round(stddev_samp(i), 6) AS std, count(*) AS n FROM e GROUP BY 1, 2""")
def occlusion(spark, sf_dir):
    """How much a score changes where one element of a vector is put to zero, by solvent and element."""
    rows = measurements(spark, sf_dir).select("solvent", F.array(F.col("t") / 300, "y").alias("x"))
    score = lambda s: pd.Series([2.0 * v[0] - 0.5 * v[1] for v in s], dtype=float)
    out = registry.group_importance(registry.occlusion_importance(rows, "x", score), ["solvent", "element"])
    return rounded(out, "mean", "std").withColumn("sum", F.round("sum", 4))


@query(f"""WITH {PRED}, z AS (SELECT unnest(['group_mean', 'grand_mean']) AS method),
ps AS (SELECT method, split, (rid % 3)::INT AS seed, y, CASE WHEN method = 'group_mean' THEN coalesce(mu, g) ELSE g END AS f FROM sp LEFT JOIN mn USING (solvent), gm, z)
SELECT method, seed, split, round(sqrt(avg(pow(f - y, 2))), 6) AS rmse, CASE WHEN method = 'grand_mean' AND seed = 1 THEN 2 ELSE 1 END AS tries FROM ps WHERE seed < 2 GROUP BY ALL""")
def grid_runs(spark, sf_dir):
    """A sweep in which one run breaks: the others are kept, and calling again makes up for it alone."""
    rows, path, tries = split_rows(spark, sf_dir)[0], scratch(spark, "grid"), {}

    def run(at: dict) -> DataFrame:
        name = sweeps.run_id(at)
        tries[name] = tries.get(name, 0) + 1
        if at == {"method": "grand_mean", "seed": 1} and tries[name] == 1:
            raise RuntimeError("this run breaks")
        return sweeps.error_cells(mean_baseline(at["method"], rows.where("split = 'train'"), 0)(rows.where(F.col("rid") % 3 == at["seed"])))

    try:
        for _ in range(2):
            last = sweeps.run_sweep(spark, path, sweeps.grid(method=["group_mean", "grand_mean"], seed=[0, 1]), run)
        sweeps.whole(last)
        found = cut(sweeps.results(spark, path, "method string, seed int"))
    finally:
        sinks.remove_table(spark, path)
    counted = F.create_map(*[F.lit(x) for pair in tries.items() for x in pair])
    key = F.to_json(F.struct("method", "seed"))
    return found.where("metric = 'RMSE'").select("method", "seed", "split", r6("value").alias("rmse"), F.element_at(counted, key).cast("int").alias("tries"))


@query(f"""WITH {M}, n AS (SELECT count(*) AS n FROM m) SELECT fraction::DOUBLE AS fraction, least(n, greatest(32, round_even(n * fraction, 0)))::BIGINT AS n_rows FROM n, (SELECT unnest([0.05, 0.1, 0.25, 0.5, 1.0]) AS fraction)""")
def training_fractions(spark, sf_dir):
    """The sizes of seeded parts of the training rows at each fraction of a scaling sweep."""
    rows, out = measurements(spark, sf_dir).select("rid"), None
    rows = cut(rows)
    for f in (0.05, 0.1, 0.25, 0.5, 1.0):
        part = registry.training_fraction(rows, F.col("rid").cast("string"), f, 42).agg(F.count("*").alias("n_rows")).select(F.lit(f).alias("fraction"), "n_rows")
        out = part if out is None else out.unionAll(part)
    return out


@query("SELECT 'group_mean' AS method, 1::BIGINT AS n_runs")
def run_status(spark, sf_dir):
    """Registered methods with finished runs."""
    if "group_mean" not in registry.METHODS:
        registry.register_method(registry.Method("group_mean", "analytic"))
    found = registry.status(spark, run_metrics(spark, sf_dir).where("seed = 0"))
    return found.where("n_runs > 0").select("method", "n_runs")


@query(f"""WITH {M}, p AS (SELECT t, y, t * 2 + 1 AS t2, 0.5 AS flat, (rid % 7)::DOUBLE AS z FROM m), v AS (SELECT var_samp(t) AS t, var_samp(t2) AS t2, var_samp(flat) AS flat, var_samp(z) AS z, abs(corr(t, t2)) AS c, abs(corr(t, z)) AS d FROM p)
SELECT k AS feature FROM (SELECT 't' AS k UNION ALL SELECT 'z' FROM v WHERE d <= 0.95 UNION ALL SELECT 't2' FROM v WHERE c <= 0.95 UNION ALL SELECT 'flat' FROM v WHERE flat > 0.01)""")
def feature_filter(spark, sf_dir):
    """Features that vary and aren't correlated with an earlier one."""
    rows = measurements(spark, sf_dir).select("t", (F.col("t") * 2 + 1).alias("t2"), F.lit(0.5).alias("flat"), (F.col("rid") % 7).cast("double").alias("z"))
    kept = models.select_features(rows, ["t", "t2", "flat", "z"], 0.01, 0.95)
    return spark.createDataFrame([(k,) for k in kept], "feature string")


@query(f"""WITH {M}, e AS (SELECT src, solute, solvent, rid, abs(y - avg(y) OVER (PARTITION BY solute, solvent)) AS r FROM m) SELECT rid, src, round(r, 6) AS r FROM e ORDER BY r DESC, rid LIMIT 20""")
def worst_residuals(spark, sf_dir):
    m = measurements(spark, sf_dir)
    mean = m.groupBy("solute", "solvent").agg(F.avg("y").alias("e"))
    r = m.join(mean, ["solute", "solvent"]).select("rid", "src", F.abs(F.col("y") - F.col("e")).alias("r"))
    return rounded(r.orderBy(F.desc("r"), "rid").limit(20), "r")


@query("""WITH s AS (SELECT length(rtrim(split_part(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', 2), '0'))::INT AS d FROM lineitem) SELECT d AS decimals, count(*) AS n FROM s GROUP BY 1""")
def precision_histogram(spark, sf_dir):
    line = scan_parquet(spark, sf_dir, "lineitem").select(scalar.n_decimals(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("decimals"))
    return line.groupBy("decimals").agg(F.count("*").alias("n"))


# --- Molecules ---------------------------------------------------------------------------------

#: SMILES with their atoms, bonds, hydrogens, ring atoms, and closed walks of 3 and 4 steps, counted by hand. Fixed values.
MOLECULES = [
    ("CCO", 3, 2, 6, 0, 0, 8), ("c1ccccc1", 6, 6, 6, 6, 0, 36), ("CC(=O)O", 4, 3, 4, 0, 0, 18), ("C1CC1", 3, 3, 6, 3, 6, 18), ("[NH4+]", 1, 0, 4, 0, 0, 0), ("O", 1, 0, 2, 0, 0, 0),
    ("c1ccncc1", 6, 6, 5, 6, 0, 36), ("CC#N", 3, 2, 3, 0, 0, 8), ("ClCCl", 3, 2, 2, 0, 0, 8), ("c1ccc2ccccc2c1", 10, 11, 8, 10, 0, 78), ("CS(C)=O", 4, 3, 6, 0, 0, 18), ("C1CC", None, None, None, None, None, None),
]
MOLECULES_SQL = "mo(k, smiles, atoms, bonds, hydrogens, ring, walks3, walks4) AS (VALUES " + ", ".join(f"({i}, " + ", ".join("NULL" if x is None else repr(x) for x in r) + ")" for i, r in enumerate(MOLECULES)) + ")"


def with_molecules(spark, sf_dir) -> DataFrame:
    smiles = F.array(*[F.lit(r[0]) for r in MOLECULES])
    return scan_parquet(spark, sf_dir, "part").select("p_partkey", "p_type", F.element_at(smiles, (F.col("p_partkey") % len(MOLECULES)).cast("int") + 1).alias("smiles"))


@query(f"""WITH {MOLECULES_SQL} SELECT smiles, count(*) AS n, any_value(atoms)::DOUBLE AS atoms, any_value(2 * bonds)::DOUBLE AS edges, any_value(hydrogens)::DOUBLE AS hydrogens, any_value(ring)::DOUBLE AS ring
FROM part JOIN mo ON k = p_partkey % {len(MOLECULES)} GROUP BY 1""")
def molecular_graphs(spark, sf_dir):
    """Graphs of the distinct molecules, joined back to the rows."""
    rows = with_molecules(spark, sf_dir)
    of = lambda i: F.aggregate("nodes", F.lit(0.0), lambda s, x: s + x[i].cast("double"))
    g = registry.molecule_graphs(rows, "smiles").select("smiles", F.size("nodes").alias("atoms"), F.size("edges").alias("edges"), of(3).alias("hydrogens"), of(5).alias("ring"))
    known = F.col("hydrogens").isNotNull()
    return rows.groupBy("smiles").agg(F.count("*").alias("n")).join(g, "smiles").select("smiles", "n", F.when(known, F.col("atoms").cast("double")).alias("atoms"), F.when(known, F.col("edges").cast("double")).alias("edges"), "hydrogens", "ring")


@query(f"WITH {MOLECULES_SQL} SELECT p_partkey, smiles, walks3::DOUBLE AS walks3, walks4::DOUBLE AS walks4 FROM part JOIN mo ON k = p_partkey % {len(MOLECULES)}")
def molecular_topology(spark, sf_dir):
    rows = with_molecules(spark, sf_dir)
    table = registry.feature_table(rows, ["smiles"], "topology").select(F.col("key").alias("smiles"), F.col("features")[0].cast("double").alias("walks3"), F.col("features")[1].cast("double").alias("walks4"))
    return rows.join(table, "smiles", "left").select("p_partkey", "smiles", "walks3", "walks4")


@query(f"""WITH {MOLECULES_SQL}, s AS (SELECT smiles, atoms, bonds, (sum(atoms) OVER (ORDER BY smiles) - atoms)::BIGINT AS first FROM (SELECT DISTINCT smiles, atoms, bonds FROM part JOIN mo ON k = p_partkey % {len(MOLECULES)} WHERE atoms IS NOT NULL))
SELECT smiles, first, CASE WHEN bonds > 0 THEN first::DOUBLE END AS least_node FROM s""")
def graph_batch(spark, sf_dir):
    """The molecules as one batch: nodes numbered through, edges shifted."""
    batch = registry.batch_graphs(registry.molecule_graphs(with_molecules(spark, sf_dir), "smiles"), "smiles")
    return batch.select("smiles", F.col("first").cast("long").alias("first"), F.array_min(F.flatten("edges")).cast("double").alias("least_node"))
