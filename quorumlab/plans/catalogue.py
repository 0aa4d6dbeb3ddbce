"""The registered queries of the curation engine, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quorumlab.functions import scalar
from quorumlab.operators import agreement, attributions, audit, canonical, clean, differences, fits, metrics, models, ordered, splits, tiers
from quorumlab.plans import registry
from quorumlab.session import cut
from quorumlab.sources import sinks, tables
from quorumlab.sources.tables import MEASUREMENTS_SQL as M, bit_exact_sql, measurements, scan_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FIT = fits.FITS_SQL

#: Tier cuts that tell pairs of these tables apart; the operators' defaults are wider.
CUTS = {"gold": 0.04, "silver": 0.05, "bronze": 0.07}
THETAS = [0.0, 0.001, 0.002, 0.003, 0.005, 0.007, 0.010, 0.015, 0.020, 0.030, 0.050, 0.080, 0.120, 0.200]
#: Where groups merge, and from which mean deviation a group is flagged, so that these tables show both.
MERGE_AT, FLAG_AT = 0.036, 0.05
BAD_SOURCES = ["N1-0", "N7-1", "N13-0"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def usable_fits(rows: DataFrame) -> DataFrame:
    """Written once to the shared folder: both sides of the pair join read it."""
    return cut(fits.usable(fits.fit_curves(rows)))


#: Measurements of the groups that the merging by difference starts from.
MA = bit_exact_sql()


def exact_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Measurements with src replaced by its bit-exact group (the smallest source that shares a whole record with it, over chains), and (src, prelim)."""
    rows = measurements(spark, sf_dir, ("l_tax", "l_shipdate"))
    keyed = rows.select("src", "solute", "solvent", F.bround("t", 2).alias("tk"), F.bround("y", 4).alias("yk"), "l_tax", F.date_trunc("month", "l_shipdate").alias("mon"))
    members = cut(agreement.bit_exact_groups(keyed, "src", ["solute", "solvent", "tk", "yk", "l_tax", "mon"]).withColumnRenamed("component", "prelim"))
    return rows.join(members, "src").select("rid", "solute", "solvent", F.col("prelim").alias("src"), "t", "y"), members


# --- Audit -----------------------------------------------------------------------------------


@query("""SELECT column_name, null_count, row_count FROM (
  SELECT count(*) AS row_count, count(*) - count(o_orderkey) AS o_orderkey, count(*) - count(o_custkey) AS o_custkey, count(*) - count(o_orderstatus) AS o_orderstatus,
    count(*) - count(o_totalprice) AS o_totalprice, count(*) - count(o_orderdate) AS o_orderdate, count(*) - count(o_orderpriority) AS o_orderpriority FROM orders)
  UNPIVOT (null_count FOR column_name IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))""")
def schema_profile(spark, sf_dir):
    return audit.schema_profile(scan_parquet(spark, sf_dir, "orders")).select("column_name", "null_count", "row_count")


@query(f"""WITH {M}, k AS (SELECT src, solute, solvent, round_even(t, 1) AS tk, count(*) AS n FROM m GROUP BY ALL)
SELECT count(*) FILTER (n > 1) AS n_keys, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_rows FROM k""")
def duplicate_counts(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("tk", F.bround("t", 1))
    return audit.duplicate_counts(m, ["src", "solute", "solvent", "tk"])


@query("""WITH d AS (SELECT user_id, event_type, event_id, value, lag(value) OVER w AS pv, epoch(ts) - epoch(lag(ts) OVER w) AS gap FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT user_id, count(*) AS n_near FROM d WHERE gap < 36000 AND abs(value - pv) < 5 GROUP BY 1""")
def near_duplicates_lag(spark, sf_dir):
    events = scan_parquet(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    near = audit.near_duplicates(events, ["user_id", "event_type"], "us", "value", "event_id", 36000 * 1_000_000, 5.0)
    return near.groupBy("user_id").agg(F.count("*").alias("n_near"))


COPY = f"""WITH {M}, k AS (SELECT solute, solvent, round_even(t, 2) AS tk, round_even(y, 4) AS yk, src FROM m),
c AS (SELECT solute, solvent, tk, yk, count(*) AS n, count(DISTINCT src) AS s FROM k GROUP BY ALL HAVING count(DISTINCT src) > 1)"""


def copy_key_rows(spark, sf_dir):
    return measurements(spark, sf_dir).select("solute", "solvent", F.bround("t", 2).alias("tk"), F.bround("y", 4).alias("yk"), "src")


@query(f"{COPY} SELECT s AS n_sources, count(*) AS n_keys, sum(n - 1)::BIGINT AS extra_rows FROM c GROUP BY 1")
def copy_keys(spark, sf_dir):
    found = audit.copy_keys(copy_key_rows(spark, sf_dir), ["solute", "solvent", "tk", "yk"], "src")
    return found.groupBy("n_sources").agg(F.count("*").alias("n_keys"), F.sum(F.col("n") - 1).alias("extra_rows"))


@query(f"""{COPY}, d AS (SELECT DISTINCT k.* FROM k JOIN c USING (solute, solvent, tk, yk)),
p AS (SELECT a.src AS src_a, b.src AS src_b, count(*) AS n_shared FROM d a JOIN d b USING (solute, solvent, tk, yk) WHERE a.src < b.src GROUP BY 1, 2)
SELECT * FROM p ORDER BY n_shared DESC, src_a, src_b LIMIT 20""")
def copy_pairs_top20(spark, sf_dir):
    return audit.copy_pairs(copy_key_rows(spark, sf_dir), ["solute", "solvent", "tk", "yk"], "src", 20)


@query("""SELECT md5(text) AS text_key, list_sort(list(DISTINCT source))::VARCHAR AS sources FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def copied_texts(spark, sf_dir):
    docs = scan_parquet(spark, sf_dir, "documents").where("text is not null").select(F.md5(F.col("text").cast("binary")).alias("text_key"), "source")
    sets = docs.groupBy("text_key").agg(F.array_sort(F.collect_set("source")).alias("s")).where(F.size("s") > 1)
    return sets.select("text_key", F.concat(F.lit("["), F.array_join("s", ", "), F.lit("]")).alias("sources"))


@query(f"""WITH {M}, c AS (SELECT src, count(*) AS n, count(DISTINCT solute) AS n_solutes, count(DISTINCT solvent) AS n_solvents FROM m GROUP BY 1)
SELECT src, n, n_solutes, n_solvents, round(n / (SELECT sum(n) FROM c), 6) AS share, (SELECT round(quantile_cont(n, 0.9), 6) FROM c) AS p90 FROM c""")
def source_inventory(spark, sf_dir):
    return audit.source_inventory(measurements(spark, sf_dir))


@query("""WITH s AS (SELECT l_suppkey, length(rtrim(split_part(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', 2), '0')) AS d FROM lineitem)
SELECT l_suppkey, round(median(d), 6) AS median_decimals, min(d)::INT AS least, max(d)::INT AS most, count(*) FILTER (d <= 1) AS n_coarse FROM s GROUP BY 1""")
def precision_signature(spark, sf_dir):
    line = scan_parquet(spark, sf_dir, "lineitem").select("l_suppkey", scalar.n_decimals(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("d"))
    return line.groupBy("l_suppkey").agg(r6(F.median("d")).alias("median_decimals"), F.min("d").cast("int").alias("least"), F.max("d").cast("int").alias("most"), F.count_if(F.col("d") <= 1).alias("n_coarse"))


@query("""SELECT 'brand_with_types' AS side, count(*) AS n_many, max(k) AS most FROM (SELECT p_brand, count(DISTINCT p_type) AS k FROM part GROUP BY 1) WHERE k > 1
UNION ALL SELECT 'type_with_brands', count(*), max(k) FROM (SELECT p_type, count(DISTINCT p_brand) AS k FROM part GROUP BY 1) WHERE k > 1""")
def name_collisions(spark, sf_dir):
    return audit.collisions(scan_parquet(spark, sf_dir, "part"), "p_brand", "p_type", "brand_with_types", "type_with_brands")


@query(f"""WITH {M}, x AS (SELECT fmod(t, 5) AS r FROM m)
SELECT round(avg((r < 0.2 OR r > 4.8)::INT), 6) AS on_lattice, round(avg((r > 0.10 AND r < 0.20)::INT), 6) AS just_off FROM x""")
def lattice_fraction(spark, sf_dir):
    r = F.pmod("t", F.lit(5.0))
    return measurements(spark, sf_dir).agg(r6(F.avg(((r < 0.2) | (r > 4.8)).cast("int"))).alias("on_lattice"), r6(F.avg(((r > 0.10) & (r < 0.20)).cast("int"))).alias("just_off"))


@query("""SELECT count(*) FILTER (l_discount <= 0) AS n_not_positive, count(*) FILTER (l_discount > 1) AS n_above_1, count(*) FILTER (l_discount = 1) AS n_is_1,
  count(*) FILTER (l_discount > 0.05) AS n_above_005, count(*) FILTER (l_discount > 0.01) AS n_above_001 FROM lineitem""")
def threshold_counts(spark, sf_dir):
    d = F.col("l_discount")
    return scan_parquet(spark, sf_dir, "lineitem").agg(F.count_if(d <= 0).alias("n_not_positive"), F.count_if(d > 1).alias("n_above_1"), F.count_if(d == 1).alias("n_is_1"), F.count_if(d > 0.05).alias("n_above_005"), F.count_if(d > 0.01).alias("n_above_001"))


@query(f"""WITH {M}, e AS (SELECT src, y - avg(y) OVER (PARTITION BY solute, solvent) AS r FROM m),
s AS (SELECT src, count(*) AS n, median(abs(r)) AS med, avg(abs(r)) AS mean, quantile_cont(abs(r), 0.95) AS p95, max(abs(r)) AS most, avg(r) AS signed FROM e GROUP BY 1 HAVING median(abs(r)) > 0.01)
SELECT src, n, round(med, 6) AS med, round(mean, 6) AS mean, round(p95, 6) AS p95, round(most, 6) AS most, round(signed, 6) AS signed FROM s ORDER BY s.med DESC, src LIMIT 20""")
def residual_by_source(spark, sf_dir):
    m = measurements(spark, sf_dir)
    mean = m.groupBy("solute", "solvent").agg(F.avg("y").alias("e"))
    out = audit.residuals_by_source(m.join(mean, ["solute", "solvent"]).withColumn("r", F.col("y") - F.col("e")), "src", "r", 0.01, 20)
    return rounded(out, "med", "mean", "p95", "most", "signed")


@query(f"""WITH {M}, e AS (SELECT abs(y - avg(y) OVER (PARTITION BY solute, solvent)) AS r FROM m)
SELECT count(*) AS n, round(median(r), 6) AS median, round(avg(r), 6) AS mean, round(quantile_cont(r, 0.95), 6) AS p95, round(quantile_cont(r, 0.99), 6) AS p99, round(max(r), 6) AS most,
  round(avg((r > 0.1)::INT), 6) AS share_01, round(avg((r > 0.5)::INT), 6) AS share_05 FROM e""")
def residual_distribution(spark, sf_dir):
    m = measurements(spark, sf_dir)
    mean = m.groupBy("solute", "solvent").agg(F.avg("y").alias("e"))
    r = m.join(mean, ["solute", "solvent"]).select(F.abs(F.col("y") - F.col("e")).alias("r"))
    r = cut(r)
    out = r.agg(F.count("*").alias("n"), r6(F.avg("r")).alias("mean"), r6(F.max("r")).alias("most"), r6(F.avg((F.col("r") > 0.1).cast("int"))).alias("share_01"), r6(F.avg((F.col("r") > 0.5).cast("int"))).alias("share_05"))
    ends = rounded(ordered.exact_quantiles(r, "r", {"median": 0.5, "p95": 0.95, "p99": 0.99}), "median", "p95", "p99")
    return out.crossJoin(F.broadcast(ends)).select("n", "median", "mean", "p95", "p99", "most", "share_01", "share_05")  # one row


@query("""WITH x AS (SELECT p_type AS cell, p_size AS s, p_partkey AS rid, p_brand AS member, p_retailprice AS v FROM part),
d AS (SELECT a.cell, abs(a.v - b.v) AS d FROM x a JOIN x b ON a.cell = b.cell AND a.s = b.s AND a.rid < b.rid AND a.member <> b.member)
SELECT cell, count(*) AS n_deltas, round(median(d), 6) AS median, round(max(d), 6) AS most, round(quantile_cont(d, 0.9), 6) AS p90 FROM d GROUP BY 1""")
def cell_pair_deltas(spark, sf_dir):
    """How far prices of one type and size lie apart between brands, pooled by type; no pair is made."""
    part = scan_parquet(spark, sf_dir, "part").select(F.col("p_type").alias("cell"), F.col("p_size").alias("s"), F.col("p_brand").alias("member"), F.col("p_retailprice").alias("v"))
    out = differences.difference_quantiles(part, "cell", ["s"], "member", "v", {"median": 0.5, "most": 1.0, "p90": 0.9})
    return rounded(out.withColumnRenamed("n", "n_deltas"), "median", "most", "p90")


@query("""WITH x AS (SELECT p_brand, p_type AS member, p_retailprice AS v, p_partkey AS rid FROM part), d AS (SELECT a.p_brand, abs(a.v - b.v) AS d FROM x a JOIN x b ON a.p_brand = b.p_brand AND a.rid < b.rid AND a.member <> b.member)
SELECT p_brand, count(*) AS n_pairs, round(median(d), 6) AS median, round(quantile_cont(d, 0.9), 6) AS p90, round(max(d), 6) AS most FROM d GROUP BY 1""")
def brand_price_deltas(spark, sf_dir):
    """The same between the types of a brand, whose cells are large."""
    part = scan_parquet(spark, sf_dir, "part").select("p_brand", "p_type", "p_retailprice")
    out = differences.difference_quantiles(part, "p_brand", [], "p_type", "p_retailprice", {"median": 0.5, "p90": 0.9, "most": 1.0})
    return rounded(out.withColumnRenamed("n", "n_pairs"), "median", "p90", "most")


@query(f"""WITH {M}, c AS (SELECT src, solute, count(*) AS n FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, solute) AS k FROM c)
SELECT src, solute AS mode_solute, n FROM r WHERE k = 1""")
def majority_name(spark, sf_dir):
    return audit.majority(measurements(spark, sf_dir), "src", "solute").withColumnRenamed("solute", "mode_solute")


@query(f"""WITH {M}, p AS (SELECT solute, solvent, count(DISTINCT src) AS n FROM m GROUP BY ALL)
SELECT count(*) FILTER (n >= 1) AS n1, count(*) FILTER (n >= 2) AS n2, count(*) FILTER (n >= 3) AS n3, count(*) FILTER (n >= 5) AS n5 FROM p""")
def multi_source_histogram(spark, sf_dir):
    n = measurements(spark, sf_dir).groupBy("solute", "solvent").agg(F.countDistinct("src").alias("n"))
    return n.agg(*[F.count_if(F.col("n") >= k).alias(f"n{k}") for k in (1, 2, 3, 5)])


@query(f"""WITH {M}, l AS (SELECT * FROM (VALUES ('N1-0'), ('N7-1'), ('N13-0'), ('absent')) AS v(src)),
a AS (SELECT src, count(*) AS n, min(t) AS t0, max(t) AS t1, min(y) AS y0, max(y) AS y1 FROM m GROUP BY 1)
SELECT src, coalesce(n, 0) AS n_rows, round(t0, 6) AS t_min, round(t1, 6) AS t_max, round(y0, 6) AS y_min, round(y1, 6) AS y_max FROM l LEFT JOIN a USING (src)""")
def listed_source_audit(spark, sf_dir):
    out = audit.listed_sources(measurements(spark, sf_dir), [*BAD_SOURCES, "absent"])
    return rounded(out, "t_min", "t_max", "y_min", "y_max")


@query(f"""WITH {M} SELECT solute, solvent, count(*) AS n, round(min(t), 6) AS t_min, round(max(t), 6) AS t_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max FROM m WHERE src = 'N1-0' GROUP BY ALL""")
def suspect_source_profile(spark, sf_dir):
    out = measurements(spark, sf_dir).where("src = 'N1-0'").groupBy("solute", "solvent").agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return rounded(out, "t_min", "t_max", "y_min", "y_max")


@query("""SELECT contains(p_name, '@') AS tetrahedral, (contains(p_name, '/') OR contains(p_name, '\\')) AS double_bond, count(*) AS n_rows, count(DISTINCT p_name) AS n_keys FROM part GROUP BY ALL""")
def stereo_flags(spark, sf_dir):
    part = scan_parquet(spark, sf_dir, "part")
    return part.groupBy(scalar.has_tetrahedral_mark(F.col("p_name")).alias("tetrahedral"), scalar.has_double_bond_mark(F.col("p_name")).alias("double_bond")).agg(F.count("*").alias("n_rows"), F.countDistinct("p_name").alias("n_keys"))


@query("""SELECT count(DISTINCT p_type) AS raw, count(DISTINCT lower(p_type)) AS plain, count(DISTINCT split_part(lower(p_type), ' ', 1)) AS coarse,
  count(DISTINCT p_type) - count(DISTINCT split_part(lower(p_type), ' ', 1)) AS merged FROM part""")
def policy_collisions(spark, sf_dir):
    return audit.policy_cardinalities(scan_parquet(spark, sf_dir, "part"), F.col("p_type"), {"plain": F.lower("p_type"), "coarse": F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1))})


# --- Cleaning --------------------------------------------------------------------------------

STEPS = ["bad_source", "null_solvent", "mixture", "weight", "label", "range"]


def waterfall_rows(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("mw", F.col("t") * 3 - 5)
    steps = [("bad_source", ~F.col("src").isin(BAD_SOURCES)), ("null_solvent", F.col("solvent").isNotNull()), ("mixture", ~F.coalesce(F.contains("solute", F.lit("44")), F.lit(False))), ("weight", F.col("mw").isNotNull() & (F.col("mw") <= 940)), ("label", F.col("y").isNotNull()), ("range", F.col("y").between(-1.5, 0.6))]
    return clean.waterfall(m, steps, [F.col("src"), F.col("solute"), F.col("solvent"), F.bround("t", 1)], "rid")


WATERFALL = f"""{M}, s AS (SELECT *, CASE WHEN src IN ('N1-0', 'N7-1', 'N13-0') THEN 'bad_source' WHEN solvent IS NULL THEN 'null_solvent' WHEN contains(solute, '44') THEN 'mixture'
  WHEN NOT (t * 3 - 5 <= 940) THEN 'weight' WHEN y IS NULL THEN 'label' WHEN NOT (y BETWEEN -1.5 AND 0.6) THEN 'range' ELSE 'kept' END AS step0 FROM m),
w AS (SELECT *, CASE WHEN step0 = 'kept' AND row_number() OVER (PARTITION BY step0, src, solute, solvent, round_even(t, 1) ORDER BY rid) > 1 THEN 'duplicate' ELSE step0 END AS step FROM s)"""


@query(f"""WITH {WATERFALL}, o AS (SELECT * FROM (VALUES (0, 'bad_source'), (1, 'null_solvent'), (2, 'mixture'), (3, 'weight'), (4, 'label'), (5, 'range'), (6, 'duplicate')) AS v(ord, step)),
c AS (SELECT step, count(*) AS n FROM w GROUP BY 1)
SELECT ord::INT AS ord, step, coalesce(n, 0) AS dropped, ((SELECT count(*) FROM w) - sum(coalesce(n, 0)) OVER (ORDER BY ord))::BIGINT AS remaining FROM o LEFT JOIN c USING (step)""")
def waterfall(spark, sf_dir):
    return clean.waterfall_counts(waterfall_rows(spark, sf_dir), STEPS)


@query(f"WITH {WATERFALL} SELECT src, count(*) AS n_dropped FROM w WHERE step = 'bad_source' GROUP BY 1")
def bad_source_report(spark, sf_dir):
    return waterfall_rows(spark, sf_dir).where("step = 'bad_source'").groupBy("src").agg(F.count("*").alias("n_dropped"))


@query(f"WITH {WATERFALL} SELECT rid, src, round(t, 6) AS t, round(y, 6) AS y FROM w WHERE step = 'kept'")
def dedup_keep_first(spark, sf_dir):
    return rounded(waterfall_rows(spark, sf_dir).where("step = 'kept'").select("rid", "src", "t", "y"), "t", "y")


@query(f"""WITH {M}, e AS (SELECT lower(trim(p_type)) AS k, round_even(273.15 + p_size, 2) AS tk, arg_max(p_retailprice / 1000, p_partkey) AS d FROM part GROUP BY 1, 2),
l AS (SELECT lower(trim(p_type)) AS k, arg_max(p_size * 0.001, p_partkey) AS a, arg_max(p_retailprice / 2000, p_partkey) AS b FROM part WHERE p_size % 2 = 0 AND NOT contains(p_type, 'TIN') GROUP BY 1),
j AS (SELECT CASE WHEN e.d IS NOT NULL THEN 'density_dict_exact' WHEN l.a IS NOT NULL THEN 'coef_linear' ELSE 'unavailable' END AS tag, coalesce(e.d, l.a * t + l.b) AS d
  FROM m LEFT JOIN e ON lower(trim(solvent)) = e.k AND round_even(t, 2) = e.tk LEFT JOIN l ON lower(trim(solvent)) = l.k)
SELECT tag, count(*) AS n, round(avg(d), 6) AS mean_density FROM j GROUP BY 1""")
def density_cascade(spark, sf_dir):
    part = scan_parquet(spark, sf_dir, "part")
    exact = tables.density_dimension(part.withColumn("t_", 273.15 + F.col("p_size")).withColumn("d_", F.col("p_retailprice") / 1000), "p_type", "t_", "d_", "p_partkey")
    even = part.where("p_size % 2 = 0 and not contains(p_type, 'TIN')")
    linear = tables.coefficient_dimension(even.withColumn("a_", F.col("p_size") * 0.001).withColumn("b_", F.col("p_retailprice") / 2000), "p_type", "a_", "b_", "p_partkey")
    out = clean.density_cascade(measurements(spark, sf_dir), exact, linear)
    return out.groupBy(F.col("density_tag").alias("tag")).agg(F.count("*").alias("n"), r6(F.avg("density")).alias("mean_density"))


@query("""WITH x AS (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE ln(l_quantity) END AS y, l_discount * 10 - 0.05 AS x, CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE 0.8 END AS d, 50 + l_quantity AS w FROM lineitem),
f AS (SELECT *, CASE WHEN y IS NOT NULL THEN 'given' WHEN x IS NULL OR x <= 0 OR x >= 1 THEN 'recovered_bad_x' WHEN d IS NULL THEN 'recovered_no_density' ELSE 'recovered_ok' END AS label_tag,
  coalesce(y, CASE WHEN x > 0 AND x < 1 AND d > 0 AND w > 0 THEN log10(x / (1 - x) * d * 1000 / w) END) AS v FROM x)
SELECT label_tag, count(*) AS n, count(v) AS n_label, round(avg(v), 6) AS mean FROM f GROUP BY 1""")
def label_recovery(spark, sf_dir):
    line = scan_parquet(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.log("l_quantity")).alias("y"), (F.col("l_discount") * 10 - 0.05).alias("x"), F.when(F.col("l_suppkey") % 7 != 0, F.lit(0.8)).alias("d"), (50 + F.col("l_quantity")).alias("w")
    )
    out = clean.recover_labels(line, "y", "x", "d", "w")
    return out.groupBy("label_tag").agg(F.count("*").alias("n"), F.count("y").alias("n_label"), r6(F.avg("y")).alias("mean"))


@query(f"""WITH {M}, c AS (SELECT *, CASE WHEN src = 'N1-0' AND t = 300.15 THEN 'C1' WHEN src IN ('N2-0', 'N3-1') THEN 'C2' WHEN src = 'N4-0' AND solvent LIKE 'PROMO%' THEN 'C3' END AS k FROM m),
n AS (SELECT k, y AS o, CASE k WHEN 'C1' THEN -0.5 WHEN 'C2' THEN log10(pow(10, y) * 10) WHEN 'C3' THEN y + 0.25 END AS v FROM c WHERE k IS NOT NULL)
SELECT k AS correction, count(*) AS n_rows, round(sum(abs(v - o)), 6) AS moved FROM n GROUP BY 1""")
def manual_corrections(spark, sf_dir):
    y = F.col("y")
    rules = [
        ("C1", (F.col("src") == "N1-0") & (F.col("t") == 300.15), {"y": F.lit(-0.5)}),
        ("C2", F.col("src").isin("N2-0", "N3-1"), {"y": F.log10(F.pow(F.lit(10.0), y) * 10)}),
        ("C3", (F.col("src") == "N4-0") & F.col("solvent").like("PROMO%"), {"y": y + 0.25, "solvent": F.regexp_replace("solvent", "^PROMO", "STANDARD")}),
    ]
    return rounded(clean.correction_log(clean.correct(measurements(spark, sf_dir), rules)), "moved")


# --- Grouping and fits -----------------------------------------------------------------------


@query("""WITH RECURSIVE n AS (SELECT o_custkey AS c, o_orderdate AS d, o_orderpriority AS p, floor(o_totalprice / 10000) AS b FROM orders),
e AS (SELECT DISTINCT x.c AS a, y.c AS b FROM n x JOIN n y USING (d, p, b) WHERE x.c <> y.c),
r(node, reach) AS (SELECT DISTINCT c, c FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
k AS (SELECT node, min(reach) AS component FROM r GROUP BY 1), z AS (SELECT component, count(*) AS size FROM k GROUP BY 1),
g AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) - 1 AS gid FROM z)
SELECT node AS o_custkey, component, size, gid FROM k JOIN g USING (component)""")
def bit_exact_groups(spark, sf_dir):
    orders = scan_parquet(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", F.floor(F.col("o_totalprice") / 10000).alias("b"))
    found = cut(agreement.bit_exact_groups(orders, "o_custkey", ["o_orderdate", "o_orderpriority", "b"]))
    sizes = agreement.number_by_size(found)
    return found.join(sizes, "component").select("o_custkey", "component", "size", F.col("gid").cast("long").alias("gid"))


@query(f"WITH {M}, {FIT} SELECT solute, solvent, src, n, model, round(t_min, 6) AS t_min, round(t_max, 6) AS t_max, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM fits")
def curve_fits(spark, sf_dir):
    out = fits.fit_curves(measurements(spark, sf_dir))
    return rounded(out.select("solute", "solvent", "src", "n", "model", "t_min", "t_max", "r2", "rmse"), "t_min", "t_max", "r2", "rmse")


@query(f"""WITH {M}, {FIT} SELECT count(*) AS n_fits, round(median(r2), 6) AS r2_median, round(avg(r2), 6) AS r2_mean, round(avg((r2 >= 0.95)::INT), 6) AS share_r2_95, round(avg((r2 >= 0.99)::INT), 6) AS share_r2_99,
  round(median(rmse), 6) AS rmse_median, round(quantile_cont(rmse, 0.95), 6) AS rmse_p95, count(*) FILTER (r2 < 0.8 OR rmse > 0.3) AS n_bad FROM fits WHERE r2 IS NOT NULL""")
def fit_summary(spark, sf_dir):
    out = fits.fit_summary(fits.fit_curves(measurements(spark, sf_dir)))
    return rounded(out, "r2_median", "r2_mean", "share_r2_95", "share_r2_99", "rmse_median", "rmse_p95")


@query(f"""WITH {M}, a AS (SELECT solute, solvent, src, t, avg(y) AS y FROM m GROUP BY ALL),
b AS (SELECT *, rank() OVER (PARTITION BY solute, solvent, src ORDER BY t)::DOUBLE AS rt, rank() OVER (PARTITION BY solute, solvent, src ORDER BY y) + (count(*) OVER (PARTITION BY solute, solvent, src, y) - 1) / 2 AS ry,
  y - lag(y) OVER (PARTITION BY solute, solvent, src ORDER BY t) AS d FROM a)
SELECT solute, solvent, src, count(*) AS n, round(corr(rt, ry), 6) AS spearman_rho, count(*) FILTER (d > 0) AS n_up, count(*) FILTER (d < 0) AS n_down, round(least(0.0, min(d)), 6) AS worst_drop, round(max(y) - min(y), 6) AS y_range, count(*) FILTER (d < 0) = 0 AS monotone
FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 3""")
def monotonicity(spark, sf_dir):
    return rounded(fits.monotonicity(measurements(spark, sf_dir)), "spearman_rho", "worst_drop", "y_range")


PAIRS = f"""{M}, {FIT},
p AS (SELECT a.solute, a.solvent, a.src AS gi, b.src AS gj, a.a - b.a AS da, a.b - b.b AS db, coalesce(a.c, 0) - coalesce(b.c, 0) AS dc, greatest(a.t_min, b.t_min) AS t0, least(a.t_max, b.t_max) AS t1
  FROM good a JOIN good b ON a.solute = b.solute AND a.solvent = b.solvent AND a.src < b.src WHERE least(a.t_max, b.t_max) - greatest(a.t_min, b.t_min) >= 5),
d AS (SELECT solute, solvent, gi, gj, t0 + i AS t, da + db / (t0 + i) + dc * ln(t0 + i) AS delta FROM (SELECT *, unnest(range(0, floor(t1 - t0)::BIGINT + 1)) AS i FROM p)),
gp AS (SELECT solute, solvent, gi, gj, count(*) AS n, sum(abs(delta)) AS sum_abs FROM d GROUP BY 1, 2, 3, 4),
pm AS (SELECT solute, solvent, count(*) AS n_group_pairs, avg(sum_abs / n) AS pair_mae, max(sum_abs / n) AS pair_mae_max FROM gp GROUP BY 1, 2),
wm AS (SELECT gi, gj, sum(n)::BIGINT AS n_grid, sum(sum_abs) / sum(n) AS weighted_mae FROM gp GROUP BY 1, 2)"""


def group_pairs(spark, sf_dir) -> DataFrame:
    return agreement.group_pair_mae(agreement.fit_pairs(usable_fits(measurements(spark, sf_dir))))


@query(f"WITH {PAIRS} SELECT solute, solvent, n_group_pairs, round(pair_mae, 6) AS pair_mae, round(pair_mae_max, 6) AS pair_mae_max FROM pm")
def pair_mae(spark, sf_dir):
    return rounded(agreement.pair_mae(group_pairs(spark, sf_dir)), "pair_mae", "pair_mae_max")


@query(f"WITH {PAIRS} SELECT solute, solvent, gi, gj, count(*) AS n_points, round(sum(delta), 6) AS sum_delta, round(max(abs(delta)), 6) AS most FROM d GROUP BY 1, 2, 3, 4")
def atom_deltas(spark, sf_dir):
    d = agreement.atom_deltas(agreement.fit_pairs(usable_fits(measurements(spark, sf_dir))))
    return rounded(d.groupBy("solute", "solvent", "gi", "gj").agg(F.count("*").alias("n_points"), F.sum("delta").alias("sum_delta"), F.max(F.abs("delta")).alias("most")), "sum_delta", "most")


@query(f"WITH {PAIRS} SELECT gi, gj, n_grid, round(weighted_mae, 6) AS weighted_mae FROM wm")
def weighted_group_mae(spark, sf_dir):
    return rounded(agreement.weighted_group_mae(group_pairs(spark, sf_dir)), "weighted_mae")


PAIRS_A = PAIRS.replace(M, MA)


@query(f"""WITH RECURSIVE {PAIRS_A}, x AS (SELECT gi AS a, gj AS b FROM wm WHERE weighted_mae < 0.036 UNION ALL SELECT gj, gi FROM wm WHERE weighted_mae < 0.036),
r(node, reach) AS (SELECT DISTINCT src, src FROM m UNION SELECT r.node, x.b FROM r JOIN x ON r.reach = x.a)
SELECT ka.src, ka.prelim, min(reach) AS component FROM r JOIN ka ON node = prelim GROUP BY 1, 2""")
def interp_groups(spark, sf_dir):
    rows, members = exact_members(spark, sf_dir)
    edges = cut(agreement.weighted_group_mae(agreement.group_pair_mae(agreement.fit_pairs(usable_fits(rows)))))
    found = agreement.merge_groups(edges, members.select(F.col("prelim").alias("src")), 0.036)
    return members.join(found.withColumnRenamed("src", "prelim"), "prelim").select("src", "prelim", "component")


@query(f"""WITH {PAIRS}, sweep AS (SELECT unnest({THETAS}::DOUBLE[]) AS theta)
SELECT theta, count(*) AS n_edges, round(max(weighted_mae), 6) AS most FROM sweep JOIN wm ON weighted_mae < theta GROUP BY 1""")
def theta_edges(spark, sf_dir):
    edges = agreement.weighted_group_mae(group_pairs(spark, sf_dir))
    steps = edges.withColumn("theta", F.explode(F.array(*map(F.lit, THETAS)))).where("weighted_mae < theta")
    return steps.groupBy("theta").agg(F.count("*").alias("n_edges"), r6(F.max("weighted_mae")).alias("most"))


SWEEP = f"""WITH RECURSIVE {PAIRS_A}, sweep AS (SELECT unnest({THETAS}::DOUBLE[]) AS theta),
x AS (SELECT theta, gi AS a, gj AS b FROM sweep JOIN wm ON weighted_mae < theta UNION ALL SELECT theta, gj, gi FROM sweep JOIN wm ON weighted_mae < theta),
r(theta, node, reach) AS (SELECT theta, src, src FROM sweep, (SELECT DISTINCT src FROM m) UNION SELECT r.theta, r.node, x.b FROM r JOIN x ON r.reach = x.a AND r.theta = x.theta),
k AS (SELECT theta, node, min(reach) AS component FROM r GROUP BY 1, 2),
rp AS (SELECT * FROM (SELECT good.*, k.theta, k.component, row_number() OVER (PARTITION BY theta, solute, solvent, component ORDER BY r2 DESC NULLS LAST, src) AS rn FROM good JOIN k ON src = node) WHERE rn = 1),
co AS (SELECT *, max(t_min) OVER w AS t0, min(t_max) OVER w AS t1, count(*) OVER w AS kk FROM rp WINDOW w AS (PARTITION BY theta, solute, solvent)),
pt AS (SELECT theta, solute, solvent, component, kk, t0 + i AS t, a + b / (t0 + i) + coalesce(c, 0) * ln(t0 + i) AS v FROM (SELECT *, unnest(range(0, floor(t1 - t0)::BIGINT + 1)) AS i FROM co WHERE kk >= 2 AND t1 - t0 >= 5)),
dv AS (SELECT theta, component, abs(v - (sum(v) OVER (PARTITION BY theta, solute, solvent, t) - v) / (kk - 1)) AS dev FROM pt),
rel AS (SELECT theta, component, count(*) AS n_grid, avg(dev) AS mean_dev FROM dv GROUP BY 1, 2), hs AS (SELECT theta, component FROM rel WHERE mean_dev >= {FLAG_AT}),
fp AS (SELECT a.theta, a.solute, a.solvent, a.component AS gi, b.component AS gj, a.a - b.a AS da, a.b - b.b AS db, coalesce(a.c, 0) - coalesce(b.c, 0) AS dc, greatest(a.t_min, b.t_min) AS t0, least(a.t_max, b.t_max) AS t1
  FROM rp a JOIN rp b ON a.theta = b.theta AND a.solute = b.solute AND a.solvent = b.solvent AND a.component < b.component WHERE least(a.t_max, b.t_max) - greatest(a.t_min, b.t_min) >= 5),
fd AS (SELECT theta, solute, solvent, gi, gj, abs(da + db / (t0 + i) + dc * ln(t0 + i)) AS d FROM (SELECT *, unnest(range(0, floor(t1 - t0)::BIGINT + 1)) AS i FROM fp)),
fg AS (SELECT theta, solute, solvent, gi, gj, avg(d) AS e FROM fd GROUP BY 1, 2, 3, 4, 5)"""


@query(f"""{SWEEP}, z AS (SELECT theta, component, count(*) AS size FROM k GROUP BY 1, 2), gz AS (SELECT theta, count(*) AS n_final_groups, max(size) AS largest FROM z GROUP BY 1),
pp AS (SELECT theta, solute, solvent, avg(e) AS v FROM fg WHERE (theta, gi) NOT IN (SELECT (theta, component) FROM hs) AND (theta, gj) NOT IN (SELECT (theta, component) FROM hs) GROUP BY 1, 2, 3),
s AS (SELECT theta, count(*) AS n_pairs, avg(v) AS mean, quantile_cont(v, 0.9) AS p90, median(v) AS median, sqrt(avg(v * v)) AS rmse FROM pp GROUP BY 1), h AS (SELECT theta, count(*) AS n FROM hs GROUP BY 1)
SELECT theta, n_final_groups, largest, coalesce(h.n, 0) AS n_flagged, coalesce(n_pairs, 0) AS n_pairs, round(mean, 6) AS mean, round(p90, 6) AS p90, round(median, 6) AS median, round(rmse, 6) AS rmse FROM gz LEFT JOIN s USING (theta) LEFT JOIN h USING (theta)""")
def theta_sweep(spark, sf_dir):
    rows, members = exact_members(spark, sf_dir)
    good = usable_fits(rows)
    found = agreement.theta_sweep(good, agreement.group_pair_mae(agreement.fit_pairs(good)), members.select(F.col("prelim").alias("src")), THETAS, FLAG_AT)
    return rounded(found, "mean", "p90", "median", "rmse")


#: The same sweep at one threshold: final groups, and what is made of them.
FINAL = SWEEP.replace(f"unnest({THETAS}::DOUBLE[])", f"unnest([{MERGE_AT}]::DOUBLE[])")


def final_groups(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Members (src, component) of the final groups, the best fit of each, their reliability, and the flagged ones."""
    rows, exact = exact_members(spark, sf_dir)
    good = usable_fits(rows)
    edges = agreement.weighted_group_mae(agreement.group_pair_mae(agreement.fit_pairs(good)))
    members = cut(agreement.merge_groups(edges, exact.select(F.col("prelim").alias("src")), MERGE_AT))
    best = cut(agreement.group_fits(good, members))
    reliability = cut(agreement.group_deviation(best, members, "component", FLAG_AT))
    return members, best, reliability, reliability.where("flagged").select("component")


@query(f"{FINAL} SELECT solute, solvent, component, src, n, round(r2, 6) AS r2 FROM rp")
def final_representatives(spark, sf_dir):
    return rounded(final_groups(spark, sf_dir)[1].select("solute", "solvent", "component", "src", "n", "r2"), "r2")


@query(f"""{FINAL} SELECT node AS src, k.component, coalesce(n_grid, 0) AS n_grid, round(mean_dev, 6) AS mean_dev, coalesce(mean_dev >= {FLAG_AT}, false) AS flagged, count(*) OVER (PARTITION BY k.component) AS n_sources
FROM k LEFT JOIN rel ON k.component = rel.component""")
def final_reliability(spark, sf_dir):
    """The reliability of each final group, spread to its sources."""
    members, _, reliability, _ = final_groups(spark, sf_dir)
    sizes = members.groupBy("component").agg(F.count("*").alias("n_sources"))
    return rounded(members.join(reliability, "component").join(sizes, "component").select("src", "component", "n_grid", "mean_dev", "flagged", "n_sources"), "mean_dev")


FINAL_PAIRS = f"""{FINAL}, fm AS (SELECT solute, solvent, count(*) AS n_group_pairs, avg(e) AS pair_mae, max(e) AS pair_mae_max, bool_or(gi IN (SELECT component FROM hs) OR gj IN (SELECT component FROM hs)) AS any_flagged FROM fg GROUP BY 1, 2),
fn AS (SELECT solute, solvent, count(*) AS n_groups FROM rp GROUP BY 1, 2)"""


def final_pairs(spark, sf_dir) -> DataFrame:
    _, best, _, flagged = final_groups(spark, sf_dir)
    return agreement.pair_agreement(best, best, flagged, "component")


@query(f"{FINAL_PAIRS} SELECT solute, solvent, n_groups, n_groups AS n_usable, n_group_pairs, round(pair_mae, 6) AS pair_mae, round(pair_mae_max, 6) AS pair_mae_max, any_flagged FROM fm JOIN fn USING (solute, solvent)")
def final_pair_mae(spark, sf_dir):
    return rounded(final_pairs(spark, sf_dir).select("solute", "solvent", "n_groups", "n_usable", "n_group_pairs", "pair_mae", "pair_mae_max", "any_flagged"), "pair_mae", "pair_mae_max")


def two_populations(rows: DataFrame) -> DataFrame:
    """rows once as inclusive, and those without a flagged group again as primary."""
    names = F.when(F.col("any_flagged"), F.array(F.lit("inclusive"))).otherwise(F.array(F.lit("inclusive"), F.lit("primary")))
    return rows.withColumn("population", F.explode(names))


@query(f"""{FINAL_PAIRS}, po AS (SELECT *, 'inclusive' AS population FROM fm UNION ALL SELECT *, 'primary' FROM fm WHERE NOT any_flagged)
SELECT population, count(pair_mae) AS n, round(avg(pair_mae), 6) AS mean, round(median(pair_mae), 6) AS median, round(quantile_cont(pair_mae, 0.9), 6) AS p90, round(sqrt(avg(pair_mae * pair_mae)), 6) AS rmse FROM po GROUP BY 1""")
def final_noise_floor(spark, sf_dir):
    out = metrics.distribution_stats(two_populations(final_pairs(spark, sf_dir)), "pair_mae", ["population"])
    return rounded(out.select("population", "n", "mean", "median", "p90", "rmse"), "mean", "median", "p90", "rmse")


@query(f"""{FINAL}, po AS (SELECT d, 'inclusive' AS population FROM fd UNION ALL SELECT d, 'primary' FROM fd WHERE gi NOT IN (SELECT component FROM hs) AND gj NOT IN (SELECT component FROM hs))
SELECT population, count(*) AS n, round(avg(d), 6) AS mean, round(sqrt(avg(d * d)), 6) AS rmse, round(max(d), 6) AS max FROM po GROUP BY 1""")
def final_atoms(spark, sf_dir):
    """The same two populations over grid points."""
    _, best, _, flagged = final_groups(spark, sf_dir)
    marked = flagged.withColumn("f", F.lit(True))
    d = agreement.atom_sums(agreement.fit_pairs(best, "component"))
    for end in ("gi", "gj"):
        d = d.join(F.broadcast(marked.select(F.col("component").alias(end), F.col("f").alias(f"f_{end}"))), end, "left")  # at most a row for each source
    d = d.withColumn("any_flagged", F.coalesce("f_gi", "f_gj", F.lit(False)))
    n = F.sum("n")
    out = two_populations(d).groupBy("population").agg(n.alias("n"), (F.sum("sum_abs") / n).alias("mean"), F.sqrt(F.sum("sum_squares") / n).alias("rmse"), F.max("most").alias("max"))
    return rounded(out, "mean", "rmse", "max")


@query(f"""{FINAL_PAIRS}, ft AS (SELECT solute, solvent, avg(e) AS v FROM fg WHERE gi NOT IN (SELECT component FROM hs) AND gj NOT IN (SELECT component FROM hs) GROUP BY 1, 2)
SELECT solute, solvent, round(v, 6) AS pair_mae, v <= 0.04 AS tier_gold, v <= 0.05 AS tier_silver, v <= 0.07 AS tier_bronze FROM ft WHERE v <= 0.07""")
def final_tiers(spark, sf_dir):
    _, best, _, flagged = final_groups(spark, sf_dir)
    kept = best.join(flagged, "component", "left_anti")
    pairs = agreement.pair_mae(agreement.group_pair_mae(agreement.fit_pairs(kept, "component")))
    return rounded(tiers.assign_tiers(pairs, CUTS).select("solute", "solvent", "pair_mae", "tier_gold", "tier_silver", "tier_bronze"), "pair_mae")


LOO = f"""{M}, {FIT}, co AS (SELECT *, max(t_min) OVER w AS t0, min(t_max) OVER w AS t1, count(*) OVER w AS k FROM good WINDOW w AS (PARTITION BY solute, solvent)),
pt AS (SELECT solute, solvent, src, k, t0 + i AS t, a + b / (t0 + i) + coalesce(c, 0) * ln(t0 + i) AS v FROM (SELECT *, unnest(range(0, floor(t1 - t0)::BIGINT + 1)) AS i FROM co WHERE k >= 2 AND t1 - t0 >= 5)),
dv AS (SELECT src, abs(v - (sum(v) OVER (PARTITION BY solute, solvent, t) - v) / (k - 1)) AS dev FROM pt)"""


@query(f"""WITH {LOO}, s AS (SELECT src, count(*) AS n_grid, avg(dev) AS mean_dev, median(dev) AS median_dev, max(dev) AS max_dev FROM dv GROUP BY 1)
SELECT src, coalesce(n_grid, 0) AS n_grid, round(mean_dev, 6) AS mean_dev, round(median_dev, 6) AS median_dev, round(max_dev, 6) AS max_dev, coalesce(mean_dev >= 0.05, false) AS flagged FROM (SELECT DISTINCT src FROM m) LEFT JOIN s USING (src)""")
def source_reliability(spark, sf_dir):
    out = agreement.source_reliability(usable_fits(measurements(spark, sf_dir)), measurements(spark, sf_dir), threshold=0.05)
    return rounded(out, "mean_dev", "median_dev", "max_dev")


@query(f"""WITH {LOO}, s AS (SELECT src, avg(dev) AS d FROM dv GROUP BY 1), e AS (SELECT src, d FROM (SELECT DISTINCT src FROM m) LEFT JOIN s USING (src))
SELECT count(d) AS n_tested, count(*) - count(d) AS n_untested, count(*) FILTER (d <= 0.2) AS n_close, count(*) FILTER (d >= 0.6) AS n_flagged, round(median(d), 6) AS median, round(avg(d), 6) AS mean FROM e""")
def reliability_summary(spark, sf_dir):
    r = agreement.source_reliability(usable_fits(measurements(spark, sf_dir)), measurements(spark, sf_dir))
    d = F.col("mean_dev")
    return r.agg(F.count(d).alias("n_tested"), (F.count("*") - F.count(d)).alias("n_untested"), F.count_if(d <= 0.2).alias("n_close"), F.count_if(d >= 0.6).alias("n_flagged"), r6(F.median(d)).alias("median"), r6(F.avg(d)).alias("mean"))


@query(f"""WITH {PAIRS}, a AS (SELECT solute, solvent, count(*) AS g FROM fits GROUP BY 1, 2), u AS (SELECT solute, solvent, count(*) AS g FROM good GROUP BY 1, 2), q AS (SELECT solute, solvent, count(*) AS g FROM p GROUP BY 1, 2)
SELECT CASE WHEN coalesce(u.g, 0) < 2 THEN 'fewer_than_2_usable' WHEN coalesce(q.g, 0) = 0 THEN 'no_overlap' ELSE 'compared' END AS reason, count(*) AS n_pairs FROM a LEFT JOIN u USING (solute, solvent) LEFT JOIN q USING (solute, solvent) GROUP BY 1""")
def exclusion_reasons(spark, sf_dir):
    every = cut(fits.fit_curves(measurements(spark, sf_dir)))
    good = fits.usable(every)
    return agreement.exclusion_reasons(every, good, agreement.fit_pairs(good))


@query(f"""WITH {PAIRS}, a AS (SELECT sum(g * (g - 1) / 2) AS n FROM (SELECT count(*) AS g FROM fits GROUP BY solute, solvent)), u AS (SELECT sum(g * (g - 1) / 2) AS n FROM (SELECT count(*) AS g FROM good GROUP BY solute, solvent)), q AS (SELECT count(*) AS n FROM p)
SELECT 'unusable_fit' AS reason, (a.n - u.n)::BIGINT AS n_group_pairs FROM a, u UNION ALL SELECT 'overlap_too_short', (u.n - q.n)::BIGINT FROM u, q UNION ALL SELECT 'compared', n FROM q""")
def group_pair_tally(spark, sf_dir):
    every = cut(fits.fit_curves(measurements(spark, sf_dir)))
    good = fits.usable(every)
    return agreement.group_pair_tally(every, good, agreement.fit_pairs(good))


STATS = "count({v}) AS n, round(avg({v}), 6) AS mean, round(median({v}), 6) AS median, round(quantile_cont({v}, 0.75), 6) AS p75, round(quantile_cont({v}, 0.9), 6) AS p90, round(quantile_cont({v}, 0.95), 6) AS p95, round(quantile_cont({v}, 0.99), 6) AS p99, round(sqrt(avg({v} * {v})), 6) AS rmse, round(max({v}), 6) AS max"
STAT_COLUMNS = ("mean", "median", "p75", "p90", "p95", "p99", "rmse", "max")
FLAGS = f"""{PAIRS}, hs AS (SELECT gi AS g, avg(weighted_mae) AS v FROM (SELECT gi, weighted_mae FROM wm UNION ALL SELECT gj, weighted_mae FROM wm) GROUP BY 1 HAVING avg(weighted_mae) >= 0.058),
fl AS (SELECT pm.*, EXISTS (SELECT 1 FROM gp WHERE gp.solute = pm.solute AND gp.solvent = pm.solvent AND (gi IN (SELECT g FROM hs) OR gj IN (SELECT g FROM hs))) AS any_flagged FROM pm),
po AS (SELECT *, 'inclusive' AS population FROM fl UNION ALL SELECT *, 'primary' FROM fl WHERE NOT any_flagged)"""


@query(f"WITH {FLAGS} SELECT population, {STATS.format(v='pair_mae')} FROM po GROUP BY 1")
def noise_floor_stats(spark, sf_dir):
    """Two populations from one pass: all pairs, and those without a flagged group."""
    gp = cut(group_pairs(spark, sf_dir))
    ends = F.explode(F.array("gi", "gj")).alias("g")
    hos = agreement.weighted_group_mae(gp).select(ends, "weighted_mae").groupBy("g").agg(F.avg("weighted_mae").alias("v")).where("v >= 0.058")
    flagged = gp.select("solute", "solvent", ends).join(hos, "g", "left_semi").select("solute", "solvent").distinct().withColumn("f", F.lit(True))
    both = agreement.pair_mae(gp).join(flagged, ["solute", "solvent"], "left")
    populations = F.when(F.col("f").isNull(), F.array(F.lit("inclusive"), F.lit("primary"))).otherwise(F.array(F.lit("inclusive")))
    return rounded(metrics.distribution_stats(both.withColumn("population", F.explode(populations)), "pair_mae", ["population"]), *STAT_COLUMNS)


@query(f"WITH {PAIRS} SELECT solvent, {STATS.format(v='pair_mae')} FROM pm GROUP BY 1")
def noise_floor_by_solvent(spark, sf_dir):
    return rounded(metrics.distribution_stats(agreement.pair_mae(group_pairs(spark, sf_dir)), "pair_mae", ["solvent"]), *STAT_COLUMNS)


@query()
def bootstrap_ci(spark, sf_dir):
    return rounded(models.bootstrap_mean_ci(agreement.pair_mae(group_pairs(spark, sf_dir)), "pair_mae"), "mean", "low", "high")


@query(f"WITH {PAIRS} SELECT count(*) AS n, round(avg(pair_mae), 6) AS mean, true AS sizes_equal, true AS centred, true AS spread_fits FROM pm")
def bootstrap_moments(spark, sf_dir):
    """Sizes of all resamples, and whether their means have the mean and the spread that drawing with replacement gives."""
    mae = cut(agreement.pair_mae(group_pairs(spark, sf_dir)).select("pair_mae"))
    of = mae.agg(F.count("*").alias("n"), F.avg("pair_mae").alias("mean"), F.stddev_pop("pair_mae").alias("sd"))
    m = F.col("s") / F.col("w")
    drawn = models.bootstrap_sums(mae, "pair_mae", 2000).agg(F.min("w").alias("least"), F.max("w").alias("most"), F.avg(m).alias("centre"), F.stddev_pop(m).alias("spread"), F.count("*").alias("reps"))
    each = F.col("sd") / F.sqrt("n")
    return of.crossJoin(F.broadcast(drawn)).select(  # one row each
        "n", r6("mean").alias("mean"), ((F.col("least") == F.col("n")) & (F.col("most") == F.col("n"))).alias("sizes_equal"),
        (F.abs(F.col("centre") - F.col("mean")) <= 6 * each / F.sqrt("reps")).alias("centred"), F.col("spread").between(0.9 * each, 1.1 * each).alias("spread_fits"),
    )


@query()
def gamma_fit(spark, sf_dir):
    gp = cut(group_pairs(spark, sf_dir)).select((F.col("sum_abs") / F.col("n")).alias("v"))
    return rounded(models.gamma_fit(gp, "v"), "shape", "scale", "ks")


# --- Tiers and splits ------------------------------------------------------------------------

TIERS = f"{PAIRS}, ti AS (SELECT *, pair_mae <= 0.04 AS tier_gold, pair_mae <= 0.05 AS tier_silver, pair_mae <= 0.07 AS tier_bronze FROM pm WHERE pair_mae <= 0.07)"
TROWS = f"""{TIERS}, me AS (SELECT DISTINCT solute, solvent, round_even(t, 2) AS t FROM m WHERE (solute, solvent) IN (SELECT (solute, solvent) FROM ti)),
tv AS (SELECT me.solute, me.solvent, me.t, a + b / me.t + coalesce(c, 0) * ln(me.t) AS v FROM me JOIN good f ON me.solute = f.solute AND me.solvent = f.solvent AND me.t BETWEEN f.t_min AND f.t_max),
tr AS (SELECT solute, solvent, t, count(*) AS n_groups, avg(v) AS consensus, CASE WHEN count(*) >= 2 THEN greatest(stddev_samp(v), 0.012) END AS sigma FROM tv GROUP BY 1, 2, 3)"""


def tier_frames(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    good = usable_fits(measurements(spark, sf_dir))
    ti = cut(tiers.assign_tiers(agreement.pair_mae(agreement.group_pair_mae(agreement.fit_pairs(good))), CUTS))
    return ti, tiers.tier_rows(measurements(spark, sf_dir), good, ti)


@query(f"""WITH {TROWS}, s AS (SELECT solute, solvent, count(*) AS n_rows, count(sigma) AS n_sigma, median(sigma) AS median_sigma, max(n_groups) AS n_groups FROM tr GROUP BY 1, 2)
SELECT solute, solvent, round(pair_mae, 6) AS pair_mae, tier_gold, tier_silver, tier_bronze, n_rows, n_sigma, round(median_sigma, 6) AS median_sigma, n_groups FROM ti JOIN s USING (solute, solvent)""")
def tier_pairs(spark, sf_dir):
    ti, rows = tier_frames(spark, sf_dir)
    info = rows.groupBy("solute", "solvent").agg(F.count("*").alias("n_rows"), F.count("sigma").alias("n_sigma"), F.median("sigma").alias("median_sigma"), F.max("n_groups").alias("n_groups"))
    out = ti.join(info, ["solute", "solvent"])
    return rounded(out.select("solute", "solvent", "pair_mae", "tier_gold", "tier_silver", "tier_bronze", "n_rows", "n_sigma", "median_sigma", "n_groups"), "pair_mae", "median_sigma")


@query(f"WITH {TROWS} SELECT solute, solvent, round(t, 6) AS t, n_groups, round(consensus, 6) AS consensus, round(sigma, 6) AS sigma FROM tr")
def tier_rows(spark, sf_dir):
    return rounded(tier_frames(spark, sf_dir)[1], "t", "consensus", "sigma")


@query(f"""WITH {TROWS}, e AS (SELECT tr.*, unnest(list_filter([CASE WHEN tier_gold THEN 'gold' END, CASE WHEN tier_silver THEN 'silver' END, CASE WHEN tier_bronze THEN 'bronze' END], lambda x: x IS NOT NULL)) AS tier FROM tr JOIN ti USING (solute, solvent))
SELECT tier, count(*) AS n_rows, count(DISTINCT (solute, solvent)) AS n_pairs, count(DISTINCT solute) AS n_solutes, count(DISTINCT solvent) AS n_solvents, round(count(sigma) / count(*), 6) AS sigma_coverage,
  round(median(sigma), 6) AS sigma_median, round(avg(sigma), 6) AS sigma_mean, round(quantile_cont(sigma, 0.9), 6) AS sigma_p90, round(quantile_cont(sigma, 0.95), 6) AS sigma_p95 FROM e GROUP BY 1""")
def tier_summary(spark, sf_dir):
    ti, rows = tier_frames(spark, sf_dir)
    return rounded(tiers.tier_summary(rows, ti, list(CUTS)), "sigma_coverage", "sigma_median", "sigma_mean", "sigma_p90", "sigma_p95")


@query(f"WITH {TROWS} SELECT coalesce(n_groups, 0) AS n_groups, count(*) AS n_rows FROM me LEFT JOIN tr USING (solute, solvent, t) GROUP BY 1")
def contributor_histogram(spark, sf_dir):
    ti, rows = tier_frames(spark, sf_dir)
    return tiers.contributor_histogram(measurements(spark, sf_dir), ti, rows)


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1), s AS (SELECT k, n, sum(n) OVER (ORDER BY n DESC, k) AS cum, sum(n) OVER () AS total FROM c)
SELECT k AS c_nationkey, n, round(cum / total, 6) AS cum_share FROM s WHERE (cum - n) / total < 0.85""")
def ood_cut(spark, sf_dir):
    orders = scan_parquet(spark, sf_dir, "orders").join(scan_parquet(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rounded(splits.head_by_share(orders, "c_nationkey"), "cum_share")


HOLD = """SELECT {s}, {m}, row_number() OVER (PARTITION BY {s} ORDER BY md5(concat_ws('|', '42', {s}, {m})), {m}) <= greatest(1, ceil(0.1 * count(*) OVER (PARTITION BY {s}))) AS held_out"""


@query(f"WITH {M} {HOLD.format(s='solvent', m='solute')} FROM (SELECT DISTINCT solvent, solute FROM m)")
def stratified_holdout(spark, sf_dir):
    return splits.stratified_holdout(measurements(spark, sf_dir), "solvent", "solute")


#: Splits of the measurements; the tier's solutes are those of the best pairs of a few brands.
SPLITS = f"""{M}, tp AS (SELECT DISTINCT solute, solvent FROM m WHERE solute IN ('Brand#11', 'Brand#32') AND solvent LIKE 'S%'),
pool AS (SELECT * FROM m WHERE solute NOT IN (SELECT solute FROM tp)), hc AS (SELECT solvent, count(*) AS n FROM pool GROUP BY 1),
hd AS (SELECT solvent FROM (SELECT solvent, n, sum(n) OVER (ORDER BY n DESC, solvent) AS cum, sum(n) OVER () AS total FROM hc) WHERE (cum - n) / total < 0.85),
ho AS ({HOLD.format(s='solvent', m='solute')} FROM (SELECT DISTINCT solvent, solute FROM pool WHERE solvent IN (SELECT solvent FROM hd))),
sp AS (SELECT pool.*, CASE WHEN hd.solvent IS NULL THEN 'ood' WHEN held_out THEN 'eval' ELSE 'train' END AS split FROM pool LEFT JOIN hd USING (solvent) LEFT JOIN ho USING (solvent, solute))"""


def made_splits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = measurements(spark, sf_dir)
    tp = m.where(F.col("solute").isin("Brand#11", "Brand#32") & F.col("solvent").like("S%")).select("solute", "solvent").distinct()
    return splits.make_splits(m, tp), tp


def split_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows, tp = made_splits(spark, sf_dir)
    return cut(rows), tp


@query(f"WITH {SPLITS} SELECT split, count(*) AS n_rows, count(DISTINCT solute) AS n_solutes, count(DISTINCT solvent) AS n_solvents, count(DISTINCT (solute, solvent)) AS n_pairs FROM sp GROUP BY 1")
def split_summary(spark, sf_dir):
    return splits.split_counts(split_rows(spark, sf_dir)[0])


@query(f"""WITH {SPLITS}, i(k, n) AS (
  SELECT 'train_tier_solutes', count(*) FROM (SELECT solute FROM sp WHERE split = 'train' INTERSECT SELECT solute FROM tp)
  UNION ALL SELECT 'eval_tier_solutes', count(*) FROM (SELECT solute FROM sp WHERE split = 'eval' INTERSECT SELECT solute FROM tp)
  UNION ALL SELECT 'ood_tier_solutes', count(*) FROM (SELECT solute FROM sp WHERE split = 'ood' INTERSECT SELECT solute FROM tp)
  UNION ALL SELECT 'train_eval_pairs', count(*) FROM (SELECT solute, solvent FROM sp WHERE split = 'train' INTERSECT SELECT solute, solvent FROM sp WHERE split = 'eval')
  UNION ALL SELECT 'train_ood_solvents', count(*) FROM (SELECT solvent FROM sp WHERE split = 'train' INTERSECT SELECT solvent FROM sp WHERE split = 'ood')
  UNION ALL SELECT 'train_eval_solutes', count(*) FROM (SELECT solute FROM sp WHERE split = 'train' INTERSECT SELECT solute FROM sp WHERE split = 'eval'))
SELECT k AS "check", n AS n_shared FROM i""")
def leakage_checks(spark, sf_dir):
    return splits.leakage(*split_rows(spark, sf_dir))


@query(f"""WITH {M}, k AS (SELECT rid, solvent, row_number() OVER (PARTITION BY solvent ORDER BY md5(concat_ws('|', '7', rid)), rid) AS r, count(*) OVER (PARTITION BY solvent) AS n FROM m)
SELECT rid, solvent FROM k WHERE r <= greatest(1, round_even(n * 0.05, 0))""")
def stratified_subsample(spark, sf_dir):
    m = measurements(spark, sf_dir).select("rid", "solvent")
    return splits.stratified_subsample(m, "solvent", F.col("rid").cast("string"), 0.05, 7)


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws('|', '101', o_orderkey)), o_orderkey::VARCHAR) AS r, count(*) OVER () AS n FROM orders) WHERE r <= least(n, greatest(32, round_even(n * 0.2, 0)))""")
def fixed_subsample(spark, sf_dir):
    orders = scan_parquet(spark, sf_dir, "orders").select("o_orderkey")
    return splits.subsample(orders, F.col("o_orderkey").cast("string"), orders.count(), 0.2, 101).select("o_orderkey")


# --- Statistics and metrics ------------------------------------------------------------------


@query(f"""WITH {M}, g AS (SELECT solvent, count(*) AS n, avg(y) AS mu, var_pop(y) * count(*) AS ssw FROM m GROUP BY 1), o AS (SELECT *, sum(n * mu) OVER () / sum(n) OVER () AS grand FROM g),
b AS (SELECT sum(n) AS bn, count(*) AS bk, sum(n * mu) / sum(n) AS bg FROM g WHERE n >= 2),
s AS (SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_rows, sum(n * pow(mu - grand, 2)) AS ssb, sum(ssw) AS ssw, sum(CASE WHEN n >= 2 THEN n * pow(mu - bg, 2) END) AS bb, sum(CASE WHEN n >= 2 THEN ssw END) AS bw, any_value(bn) AS bn, any_value(bk) AS bk FROM o, b)
SELECT n_groups, n_rows, round(ssb, 5) AS ss_between, round(ssw, 5) AS ss_within, round(ssb + ssw, 5) AS ss_total, round((bb / (bk - 1)) / (bw / (bn - bk)), 5) AS f_value FROM s""")
def anova(spark, sf_dir):
    out = metrics.anova(measurements(spark, sf_dir), "solvent", "y")
    return out.withColumns({c: F.round(c, 5) for c in ("ss_between", "ss_within", "ss_total", "f_value")})


@query()
def anova_p(spark, sf_dir):
    out = models.anova_p_value(metrics.anova(measurements(spark, sf_dir), "solvent", "y"), "f_value", F.col("n_groups") - 1, F.col("n_rows") - F.col("n_groups"))
    return out.select(r6("f_value").alias("f_value"), r6("p_value").alias("p_value"))


PRED = f"""{SPLITS}, mn AS (SELECT solvent, avg(y) AS mu FROM sp WHERE split = 'train' GROUP BY 1), gm AS (SELECT avg(y) AS g FROM sp WHERE split = 'train'),
pr AS (SELECT sp.split, sp.solvent, sp.y AS y_true, coalesce(mn.mu, gm.g) AS y_pred, mn.mu IS NOT NULL AS seen, CASE WHEN rid % 3 = 0 THEN (rid % 50) / 500.0 END AS sigma FROM sp LEFT JOIN mn USING (solvent), gm)"""


def predictions(spark, sf_dir) -> DataFrame:
    rows, _ = split_rows(spark, sf_dir)
    out = metrics.dummy_baseline(rows.where("split = 'train'"), rows)
    return out.select("split", "solvent", "y_true", "y_pred", "seen", F.when(F.col("rid") % 3 == 0, (F.col("rid") % 50) / 500.0).alias("sigma"))


@query(f"""WITH {PRED} SELECT split, round(1 - sum(pow(y_pred - y_true, 2)) / (var_pop(y_true) * count(*)), 6) AS r2, round(sqrt(avg(pow(y_pred - y_true, 2))), 6) AS rmse, count(*) FILTER (NOT seen) AS n_unseen FROM pr GROUP BY 1""")
def dummy_baseline(spark, sf_dir):
    e = F.col("y_pred") - F.col("y_true")
    out = predictions(spark, sf_dir).groupBy("split").agg((1 - F.sum(e * e) / (F.var_pop("y_true") * F.count("*"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count_if(~F.col("seen")).alias("n_unseen"))
    return rounded(out, "r2", "rmse")


@query(f"""WITH {M}, c AS (SELECT src AS k, count(*) AS n FROM m GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, k) AS r, sum(n) OVER () AS total FROM c)
SELECT top::INT AS top, round(sum(n) / max(total), 6) AS share FROM r JOIN (SELECT unnest([1, 5, 10, 25, 50]) AS top) ON r <= top GROUP BY 1""")
def count_domination(spark, sf_dir):
    return rounded(metrics.count_domination(measurements(spark, sf_dir), "src"), "share")


@query(f"""WITH {M}, d AS (SELECT abs(y - avg(y) OVER ()) AS d FROM m) SELECT round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(quantile_cont(d, 0.99), 6) AS p99 FROM d""")
def heavy_tail(spark, sf_dir):
    m = measurements(spark, sf_dir).select("y")
    d = m.crossJoin(F.broadcast(m.agg(F.avg("y").alias("g")))).select(F.abs(F.col("y") - F.col("g")).alias("d"))  # one row
    d = cut(d)
    ends = rounded(ordered.exact_quantiles(d, "d", {"median": 0.5, "p95": 0.95, "p99": 0.99}), "median", "p95", "p99")
    return d.agg(r6(F.avg("d")).alias("mean")).crossJoin(F.broadcast(ends))  # one row


@query(f"""WITH {M} SELECT {', '.join(f'round(avg((abs(y) < {t})::INT), 6) AS below_{i}' for i, t in enumerate((0.01, 0.05, 0.1, 0.25, 0.5)))} FROM m""")
def label_near_zero(spark, sf_dir):
    return measurements(spark, sf_dir).agg(*[r6(F.avg((F.abs("y") < t).cast("int"))).alias(f"below_{i}") for i, t in enumerate((0.01, 0.05, 0.1, 0.25, 0.5))])


@query(f"""WITH {PRED} SELECT split, count(*) AS n, count(*) FILTER (sigma > 0) AS n_z, count(*) FILTER (abs(y_true) >= 1e-6) AS n_mape, count(DISTINCT solvent) AS n_solvents FROM pr GROUP BY 1""")
def metric_domains(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("sigma") > 0).alias("n_z"), F.count_if(F.abs("y_true") >= 1e-6).alias("n_mape"), F.countDistinct("solvent").alias("n_solvents"))


@query(f"""WITH {M} SELECT solvent, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std, round(median(y), 6) AS median, round(quantile_cont(y, 0.1), 6) AS p10, round(quantile_cont(y, 0.9), 6) AS p90, arg_min(solute, rid) AS first_name FROM m GROUP BY 1""")
def solvent_distribution(spark, sf_dir):
    m = measurements(spark, sf_dir)
    out = m.groupBy("solvent").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.min_by("solute", "rid").alias("first_name"))
    out = ordered.with_quantiles(out, m, ["solvent"], "y", {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return rounded(out.select("solvent", "n", "mean", "std", "median", "p10", "p90", "first_name"), "mean", "std", "median", "p10", "p90")


@query(f"""WITH {PRED}, o AS (SELECT split, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae, median(abs(y_pred - y_true)) AS medae, sqrt(avg(pow((y_pred - y_true) / sigma, 2)) FILTER (sigma > 0)) AS z_rmse, count(*) FILTER (sigma > 0) AS z_n,
  100 * avg(abs((y_pred - y_true) / y_true)) FILTER (abs(y_true) >= 1e-6) AS mape, count(*) FILTER (abs(y_true) >= 1e-6) AS mape_n FROM pr GROUP BY 1),
s AS (SELECT split, avg(r) AS ps_rmse FROM (SELECT split, solvent, sqrt(avg(pow(y_pred - y_true, 2))) AS r FROM pr GROUP BY 1, 2) GROUP BY 1)
SELECT split, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(medae, 6) AS medae, round(z_rmse, 6) AS z_rmse, z_n, round(mape, 4) AS mape, mape_n, round(ps_rmse, 6) AS ps_rmse FROM o JOIN s USING (split)""")
def metrics_module(spark, sf_dir):
    out = metrics.evaluate_predictions(predictions(spark, sf_dir), ["split"], "module")
    return rounded(out, "rmse", "mae", "medae", "z_rmse", "ps_rmse").withColumn("mape", F.round("mape", 4))


@query(f"""WITH {PRED}, o AS (SELECT split, sqrt(avg(pow(y_pred - y_true, 2))) AS rmse, avg(abs(y_pred - y_true)) AS mae, 1 - sum(pow(y_pred - y_true, 2)) / (var_pop(y_true) * count(*)) AS r2, count(*) AS n,
  sqrt(avg(pow((y_pred - y_true) / greatest(sigma, 0.01), 2)) FILTER (sigma > 0)) AS z_rmse, avg((abs(y_pred - y_true) <= 2 * sigma)::INT) FILTER (sigma > 0) AS f_aleatoric FROM pr GROUP BY 1),
s AS (SELECT split, avg(r) AS ps_rmse, avg(q) AS ps_r2 FROM (SELECT split, solvent, sqrt(avg(pow(y_pred - y_true, 2))) AS r, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum(pow(y_pred - y_true, 2)) / (var_pop(y_true) * count(*)) END AS q FROM pr GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1)
SELECT split, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, n, round(z_rmse, 6) AS z_rmse, round(f_aleatoric, 6) AS f_aleatoric, round(ps_rmse, 6) AS ps_rmse, round(ps_r2, 6) + 0.0 AS ps_r2 FROM o JOIN s USING (split)""")
def metrics_sdk(spark, sf_dir):
    out = metrics.evaluate_predictions(predictions(spark, sf_dir), ["split"], "sdk")
    return rounded(out, "rmse", "mae", "r2", "z_rmse", "f_aleatoric", "ps_rmse", "ps_r2").withColumn("ps_r2", F.col("ps_r2") + 0.0)  # no negative zero


# --- Models and features ---------------------------------------------------------------------

RIDGE = f"""{SPLITS}, rt AS (SELECT solvent, 1000 / t AS x, y FROM sp WHERE split = 'train'),
ro AS (SELECT solvent, count(*) AS n, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1.0) AS slope, avg(x) AS mx, avg(y) AS my FROM rt GROUP BY 1 HAVING count(*) >= 30),
rf AS (SELECT covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1.0) AS slope, avg(x) AS mx, avg(y) AS my FROM rt)"""


@query(f"""WITH {RIDGE}, p AS (SELECT split, sp.y, coalesce(ro.my + ro.slope * (1000 / t - ro.mx), rf.my + rf.slope * (1000 / t - rf.mx)) AS f FROM sp LEFT JOIN ro USING (solvent), rf)
SELECT split, count(*) AS n, round(sqrt(avg(pow(f - y, 2))), 6) AS rmse FROM p GROUP BY 1""")
def ridge_by_solvent(spark, sf_dir):
    rows = split_rows(spark, sf_dir)[0].withColumn("x", 1000 / F.col("t"))
    model = models.ridge_1d(rows.where("split = 'train'"), "solvent", "x", "y", 1.0, 30)
    e = F.col("y_pred") - F.col("y")
    return rounded(models.ridge_predict(rows, model, "solvent", "x").groupBy("split").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")), "rmse")


@query(f"""WITH {M}, a AS (SELECT solute, solvent, src, t, avg(y) AS y FROM m GROUP BY ALL), h AS (SELECT *, t - lag(t) OVER w AS h0, lead(t) OVER w - t AS h1, y - lag(y) OVER w AS d0, lead(y) OVER w - y AS d1 FROM a WINDOW w AS (PARTITION BY solute, solvent, src ORDER BY t)),
g AS (SELECT *, coalesce((h0 * h0 * d1 + h1 * h1 * d0) / (h0 * h1 * (h0 + h1)), d1 / h1, d0 / h0) AS g0 FROM h)
SELECT solute, solvent, src, round(t, 6) AS t, round(CASE WHEN g0 > 0 AND g0 < 1 THEN g0 END, 6) AS g FROM g""")
def sobolev_targets(spark, sf_dir):
    return rounded(models.gradient_targets(measurements(spark, sf_dir), fits.KEY).select(*fits.KEY, "t", "g"), "t", "g")


@query(f"WITH {SPLITS} SELECT split, count(*) AS n, round(sum(y), 5) AS sum_y FROM sp WHERE t BETWEEN 295.15 AND 301.15 GROUP BY 1")
def fixed_t_filter(spark, sf_dir):
    rows = split_rows(spark, sf_dir)[0].where(F.col("t").between(295.15, 301.15)).withColumn("t", F.lit(298.15))
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("y"), 5).alias("sum_y"))


@query(f"""WITH {SPLITS}, {FIT}, v AS (SELECT solute, solvent, avg(a + b / 298.15 + coalesce(c, 0) * ln(298.15)) AS y FROM fits WHERE 298.15 BETWEEN t_min AND t_max AND r2 >= 0.95 AND rmse <= 0.3 GROUP BY 1, 2),
o AS (SELECT solute, solvent, 0 AS p, 'gold' AS s FROM tp UNION ALL SELECT solute, solvent, CASE split WHEN 'ood' THEN 1 WHEN 'eval' THEN 2 ELSE 3 END, split FROM sp), b AS (SELECT solute, solvent, arg_min(s, p) AS split FROM o GROUP BY 1, 2)
SELECT coalesce(split, 'train') AS split, count(*) AS n, round(avg(y), 6) AS mean_y FROM v LEFT JOIN b USING (solute, solvent) GROUP BY 1""")
def fixed_t_interp(spark, sf_dir):
    rows, tp = split_rows(spark, sf_dir)
    f = fits.usable(fits.fit_curves(measurements(spark, sf_dir)), 0.95, 0.30).where("298.15 between t_min and t_max")
    at = f.withColumn("y", fits.evaluate(F.lit(298.15))).groupBy("solute", "solvent").agg(F.avg("y").alias("y"))
    named = {"gold": tp} | {s: rows.where(F.col("split") == s) for s in ("ood", "eval", "train")}
    out = at.join(splits.assign_by_priority(named, at), ["solute", "solvent"])
    return rounded(out.groupBy("split").agg(F.count("*").alias("n"), F.avg("y").alias("mean_y")), "mean_y")


#: Rows of features that a task of a model's training reads, about; rows of a dimension up to which it is broadcast.
TASK_ROWS, DIMENSION_ROWS = 1 << 18, 1 << 17


def dimension(rows: DataFrame) -> DataFrame:
    """rows, to be joined to a table many times larger: broadcast if they turn out to be few, so that a key's rows don't meet in one task."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= DIMENSION_ROWS else rows


def with_features(spark, sf_dir, rows: DataFrame, *kept: str) -> DataFrame:
    """The columns kept of rows, and features of their solute, their solvent, and temperature t."""
    part = scan_parquet(spark, sf_dir, "part")
    solute = part.groupBy(F.col("p_brand").alias("solute")).agg(F.avg("p_size").alias("f_size"), F.avg("p_retailprice").alias("f_price"))
    solvent = part.groupBy(F.col("p_type").alias("solvent")).agg(F.avg("p_size").alias("solv_size"), F.max("p_size").cast("double").alias("solv_most"))
    m = rows.join(dimension(solute), "solute", "left").join(dimension(solvent), "solvent", "left")
    names = ["f_size", "f_price", "solv_size", "solv_most"]
    return m.select(*kept, *[scalar.finite_or_zero(F.col(c)).alias(c) for c in names], *scalar.temperature_features(F.col("t")))


def assembled(spark, sf_dir) -> DataFrame:
    """A row of features for each measurement: those of its solute, its solvent, and of temperature."""
    return with_features(spark, sf_dir, measurements(spark, sf_dir), "rid", "y")


def training_rows(spark, sf_dir) -> DataFrame:
    """The same rows dealt over tasks of TASK_ROWS or so, however few splits or keys they come in, for what trains on single rows."""
    parts = max(spark.sparkContext.defaultParallelism, -(-scan_parquet(spark, sf_dir, "lineitem").count() // TASK_ROWS))
    return cut(assembled(spark, sf_dir).repartition(parts, "rid"))


def condensed_rows(spark, sf_dir, held: Column, resamples: int = 0) -> DataFrame:
    """All measurements with features, condensed by solute, solvent, temperature and held; as many rows as there are such, however many measurements.

    The measurements are read once; beyond the joins that make them they are neither written nor shuffled.
    """
    by = ["solute", "solvent", "t", "held"]
    rows = cut(models.condensed(measurements(spark, sf_dir).withColumn("held", held), by, resamples))
    parts = -(-rows.count() // TASK_ROWS) or 1
    return cut(with_features(spark, sf_dir, rows, "held", *[c for c in rows.columns if c not in by]).repartition(parts))


FEATURES = ["f_size", "f_price", "solv_size", "solv_most", "t_scaled", "t_inverse", "t_squared", "t_log"]


@query(f"""WITH {M}, a AS (SELECT p_brand AS solute, avg(p_size) AS f_size, avg(p_retailprice) AS f_price FROM part GROUP BY 1), b AS (SELECT p_type AS solvent, avg(p_size) AS solv_size, max(p_size)::DOUBLE AS solv_most FROM part GROUP BY 1)
SELECT rid, round(y, 6) AS y, round(f_size, 6) AS f_size, round(f_price, 6) AS f_price, round(solv_size, 6) AS solv_size, round(solv_most, 6) AS solv_most, round(t / 300, 6) AS t_scaled, round(1000 / t, 6) AS t_inverse, round(pow(t / 300, 2), 6) AS t_squared, round(ln(t / 300), 6) AS t_log
FROM m JOIN a USING (solute) JOIN b USING (solvent)""")
def feature_assembly(spark, sf_dir):
    return rounded(assembled(spark, sf_dir), "y", *FEATURES)


@query(f"""WITH {M}, x AS (SELECT rid, t, y, avg(t) OVER () AS mt, stddev_pop(t) OVER () AS st, avg(y) OVER () AS my, stddev_pop(y) OVER () AS sy FROM m)
SELECT rid, round((t - mt) / (st + 1e-8), 6) AS t, round((y - my) / (sy + 1e-8), 6) AS y FROM x""")
def standardize(spark, sf_dir):
    return rounded(models.standardize(measurements(spark, sf_dir).select("rid", "t", "y"), ["t", "y"]), "t", "y")


@query("""SELECT p_partkey, round(0.16 - 0.63 * ln(p_size) - 0.0062 * p_retailprice + 0.066 * (p_size % 7) - 0.74 * (p_size / 50.0), 6) AS esol, round(0.5 - ln(p_size), 6) AS gse FROM part""")
def analytic_scores(spark, sf_dir):
    part = scan_parquet(spark, sf_dir, "part")
    logp = F.log("p_size")
    return part.select("p_partkey", r6(scalar.esol(logp, F.col("p_retailprice"), F.col("p_size") % 7, F.col("p_size") / 50.0)).alias("esol"), r6(scalar.general_solubility(logp)).alias("gse"))


@query(f"""WITH {M}, c AS (SELECT solvent, left(solute, 7) AS kind, avg(y) AS v FROM m GROUP BY 1, 2) SELECT solvent, {', '.join(f"round(coalesce(max(v) FILTER (kind = 'Brand#{k}'), 0), 6) AS brand_{k}" for k in range(1, 6))} FROM c GROUP BY 1""")
def kind_pivot(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("kind", F.left("solute", F.lit(7)))
    wide = m.groupBy("solvent").pivot("kind", [f"Brand#{k}" for k in range(1, 6)]).agg(F.avg("y")).na.fill(0.0)
    return wide.select("solvent", *[r6(F.col(f"`Brand#{k}`")).alias(f"brand_{k}") for k in range(1, 6)])


@query(f"""WITH {M}, c AS (SELECT solvent, solute, avg(y) AS v, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY solvent ORDER BY n DESC, solute) AS k FROM c)
SELECT solvent, solute, n, round(v, 6) AS mean, k::INT AS rank FROM r WHERE k <= 5""")
def top_per_group(spark, sf_dir):
    c = measurements(spark, sf_dir).groupBy("solvent", "solute").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    return rounded(audit.top_per_group(c, "solvent", [F.desc("n"), F.col("solute")], 5), "mean")


@query(f"""WITH {SPLITS}, h AS (SELECT DISTINCT solute, solvent FROM sp WHERE split IN ('eval', 'ood')), x AS (SELECT upper(trim(solute)) AS a, solvent AS b, count(*) AS n FROM m GROUP BY 1, 2)
SELECT count(*) AS n_overlap_pairs, sum(n)::BIGINT AS n_overlap_rows, count(DISTINCT a) AS n_solutes FROM x WHERE (a, b) IN (SELECT (upper(solute), solvent) FROM h)""")
def pretraining_overlap(spark, sf_dir):
    rows, _ = split_rows(spark, sf_dir)
    hold = rows.where("split in ('eval', 'ood')").select(F.upper("solute").alias("a"), F.col("solvent").alias("b")).distinct()
    pre = measurements(spark, sf_dir).select(F.upper(F.trim("solute")).alias("a"), F.col("solvent").alias("b"))
    return audit.pair_overlap(pre, hold)


@query(f"""WITH {SPLITS}, h AS (SELECT DISTINCT solute, solvent FROM sp WHERE split IN ('eval', 'ood')) SELECT solvent, count(*) AS n FROM m WHERE (solute, solvent) NOT IN (SELECT (solute, solvent) FROM h) GROUP BY 1""")
def holdout_filter(spark, sf_dir):
    rows, _ = split_rows(spark, sf_dir)
    hold = rows.where("split in ('eval', 'ood')").select("solute", "solvent").distinct()
    return measurements(spark, sf_dir).join(hold, ["solute", "solvent"], "left_anti").groupBy("solvent").agg(F.count("*").alias("n"))


@query(f"""WITH {SPLITS}, n AS (SELECT solvent, rid, src FROM sp), l AS (SELECT solvent, arg_max(src, rid) AS name FROM n GROUP BY 1) SELECT m.solvent, coalesce(l.name, 'Unknown') AS name, count(*) AS n FROM m LEFT JOIN l USING (solvent) GROUP BY 1, 2""")
def last_name_dimension(spark, sf_dir):
    rows, _ = split_rows(spark, sf_dir)
    names = tables.last_name_wins(rows.select("solvent", "rid", F.col("src").alias("name")), "solvent", "name", ["rid"])
    return measurements(spark, sf_dir).join(names, "solvent", "left").groupBy("solvent", F.coalesce("name", F.lit("Unknown")).alias("name")).agg(F.count("*").alias("n"))


@query()
def tree_regressors(spark, sf_dir):
    """rmse of each tree model on rows that a hash holds out; rows that agree in all features are one row with their number as its weight."""
    rows = condensed_rows(spark, sf_dir, F.pmod(F.crc32(F.col("rid").cast("string").cast("binary")), F.lit(5)) == 0, models.FOREST)
    out = None
    for name in models.TREES:
        model = models.fit_trees(name, rows.where("not held"), FEATURES, filtered=name == "random_forest", weight="w")
        e = F.col("y_pred") - F.col("y")
        error = F.sqrt((F.sum(F.col("w") * e * e) + F.sum("spread")) / F.sum("w"))  # of single rows: around their groups' means, and of these
        part = model.transform(rows.where("held")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), r6(error).alias("rmse")).select(F.lit(name).alias("model"), "n", "rmse")
        out = part if out is None else out.unionAll(part)
    return out


@query(f"""WITH {M} SELECT count(*) AS n_rows, 0::BIGINT AS n_off, true AS fewer_trees FROM m WHERE rid % 5 = 0""")
def tree_attributions(spark, sf_dir):
    """Boosted trees stopped early on one fifth of the rows, and what each feature adds to each of its predictions: the parts sum to the prediction.

    Rows that agree in all features have one prediction and one set of attributions, which is made once and counts for all of them.
    """
    rows = condensed_rows(spark, sf_dir, F.col("rid") % 5 == 0)
    held = rows.where("held")
    model = models.fit_trees("gradient_boosting", rows.where("not held"), FEATURES, weight="w", maxIter=12, maxDepth=3, stepSize=0.9)
    model, losses = models.stop_early(model, held, patience=3, spread="spread")
    model.stages[0].setHandleInvalid("keep")  # rows that lack an input have no attributions, and count
    told = attributions.tree_attributions(model, model.transform(held))
    off = F.abs(F.aggregate("attribution", F.col("attribution_base"), lambda s, v: s + v) - F.col("y_pred")) > 1e-9
    fewer = F.lit(len(model.stages[-1].trees) <= min(12, len(losses)))
    return told.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(off, F.col("n"))), F.lit(0)).alias("n_off"), F.first(fewer).alias("fewer_trees"))


@query("""WITH p AS (SELECT p_type AS solvent, p_retailprice AS y, p_size::DOUBLE AS a, (p_partkey % 13)::DOUBLE AS b FROM part), g AS (SELECT * FROM p UNION ALL SELECT NULL, y, a, b FROM p),
s AS (SELECT solvent, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) + 1 AS aa, var_pop(b) * count(*) + 1 AS bb, covar_pop(a, b) * count(*) AS ab, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS yb
  FROM g GROUP BY 1 HAVING count(*) >= 2 OR solvent IS NULL), v AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS sa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS sb FROM s)
SELECT solvent, n, round(sa, 4) AS slope_a, round(sb, 4) AS slope_b, round(my - sa * ma - sb * mb, 3) AS intercept FROM v""")
def ridge_many_features(spark, sf_dir):
    part = scan_parquet(spark, sf_dir, "part").select(F.col("p_type").alias("solvent"), F.col("p_retailprice").alias("y"), F.col("p_size").cast("double").alias("a"), (F.col("p_partkey") % 13).cast("double").alias("b"))
    out = models.ridge_by_group(part, "solvent", ["a", "b"], "y", 1.0, 2)
    return out.select("solvent", "n", F.round(F.col("coefficients")[0], 4).alias("slope_a"), F.round(F.col("coefficients")[1], 4).alias("slope_b"), F.round("intercept", 3).alias("intercept"))




# --- Set operations and reports --------------------------------------------------------------


@query(f"""WITH {SPLITS}, a AS (SELECT DISTINCT solute, solvent FROM sp WHERE split = 'train'), b AS (SELECT DISTINCT solute, solvent FROM sp WHERE split <> 'train')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'distinct', count(*) FROM (SELECT DISTINCT solute FROM a)""")
def set_operations(spark, sf_dir):
    rows, _ = split_rows(spark, sf_dir)
    a, b = (rows.where(c).select("solute", "solvent").distinct() for c in ("split = 'train'", "split <> 'train'"))
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "distinct": a.select("solute").distinct()}
    return sinks.row_counts(parts).select(F.col("name").alias("op"), F.col("n_rows").alias("n"))


@query("SELECT 'nation' AS name, count(*) AS n_rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def row_count_report(spark, sf_dir):
    return sinks.row_counts({n: scan_parquet(spark, sf_dir, n) for n in ("nation", "orders", "part")})


@query("""SELECT p_brand, p_type, count(*) AS n, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1, 2""")
def key_verification(spark, sf_dir):
    part = scan_parquet(spark, sf_dir, "part")
    return part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"), F.countDistinct("p_name").alias("n_names"))


@query("""SELECT CAST(json_object('r_regionkey', r_regionkey, 'r_name', r_name) AS VARCHAR) AS report FROM region""")
def region_report(spark, sf_dir):
    return sinks.json_report(scan_parquet(spark, sf_dir, "region").select("r_regionkey", "r_name"))


#: An order's line items as a chain: a graph whose names are line numbers. A chain reads the same from both ends.
CHAINS = """dl AS (SELECT l_orderkey, l_linenumber, min(l_returnflag || l_linestatus) AS fs, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2), runs AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM dl),
pieces AS (SELECT l_orderkey, run, count(*) AS n, list(fs ORDER BY l_linenumber) AS a, list(f ORDER BY l_linenumber) AS b, list('' ORDER BY l_linenumber) AS c FROM runs GROUP BY 1, 2),
ways AS (SELECT l_orderkey, n, least(a, list_reverse(a))::VARCHAR AS a, least(b, list_reverse(b))::VARCHAR AS b, c::VARCHAR AS c FROM pieces),
gk AS (SELECT l_orderkey, sum(n)::BIGINT AS n, string_agg(a, ';' ORDER BY a) AS marked, string_agg(b, ';' ORDER BY b) AS flag, string_agg(c, ';' ORDER BY c) AS plain FROM ways GROUP BY 1)"""


def order_graphs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    line = scan_parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    nodes = line.groupBy(F.col("l_orderkey").alias("graph"), F.col("l_linenumber").alias("node")).agg(F.min(F.concat("l_returnflag", "l_linestatus")).alias("marked"), F.min("l_returnflag").alias("flag"))
    bonds = nodes.select("graph", (F.col("node") - 1).alias("src"), F.col("node").alias("dst"), F.lit(1).alias("bond"))  # those without a line before go as keys are made
    return nodes.withColumn("plain", F.lit("")), bonds


@query(f"WITH {CHAINS}, z AS (SELECT marked, n, count(*) AS size FROM gk GROUP BY 1, 2) SELECT n AS n_nodes, size, count(*) AS n_keys FROM z GROUP BY 1, 2")
def graph_keys(spark, sf_dir):
    """How many orders share a canonical key: line items joined in a chain, whichever end it is read from."""
    nodes, bonds = order_graphs(spark, sf_dir)
    keys = canonical.canonical_keys(nodes, bonds, label="marked")
    return keys.groupBy("key", "n_nodes").agg(F.count("*").alias("size")).groupBy("n_nodes", "size").agg(F.count("*").alias("n_keys"))


@query(f"""WITH {CHAINS}, k AS (SELECT 'marked' AS policy, marked AS k, marked FROM gk UNION ALL SELECT 'flag', flag, marked FROM gk UNION ALL SELECT 'plain', plain, marked FROM gk),
z AS (SELECT policy, k, count(*) AS n, count(DISTINCT marked) AS m FROM k GROUP BY 1, 2) SELECT policy, count(*) AS n_keys, sum(m - 1)::BIGINT AS n_merged, max(n) AS largest FROM z GROUP BY 1""")
def graph_policy_merges(spark, sf_dir):
    """Keys of the same graphs where less of a label counts, and how many keys that merges."""
    nodes, bonds = order_graphs(spark, sf_dir)
    policies = ["marked", "flag", "plain"]
    return canonical.policy_merges(canonical.policy_keys(nodes, bonds, {p: (p, "bond") for p in policies}), policies)


@query(f"""WITH {M}, d AS (SELECT DISTINCT solute FROM m), c AS (SELECT solute, upper(trim(solute)) AS canon FROM d)
SELECT canon, count(*) AS n, round(avg(y), 6) AS mean FROM m JOIN c USING (solute) GROUP BY 1""")
def canonical_keys(spark, sf_dir):
    out = registry.canonicalize(measurements(spark, sf_dir), "solute", "upper", "canon")
    return rounded(out.groupBy("canon").agg(F.count("*").alias("n"), F.avg("y").alias("mean")), "mean")
