"""Sources: explicit schemas, CSV and Parquet scans, look-up dimensions, and the measurement view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

#: Columns of a raw measurement table as it arrives; identifiers stay text.
RAW_MEASUREMENTS = T.StructType(
    [T.StructField(x, T.StringType()) for x in ("SMILES_Solute", "SMILES_Solvent", "Solvent")]
    + [T.StructField(x, T.DoubleType()) for x in ("Temperature_K", "Solubility(mole_fraction)", "Solubility(mol/L)", "LogS(mol/L)")]
    + [T.StructField(x, T.StringType()) for x in ("Compound_Name", "CAS", "PubChem_CID", "FDA_Approved", "Source")]
)

#: Columns that identify a row of each curated table.
PRIMARY_KEYS = {
    "cleaned": ["Source", "Solute_Canon", "Solvent_Canon", "Temperature_K"],
    "fits": ["solute", "solvent", "gid"],
    "tier_rows": ["solute", "solvent", "t"],
    "tier_pairs": ["solute", "solvent"],
    "splits": ["solute", "solvent", "t", "src"],
}


def scan_parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header under a declared schema, never an inferred one."""
    return spark.read.schema(schema).option("header", True).csv(path)


def scan_csv_keeping_text(spark: SparkSession, path: str, schema: T.StructType, column: str) -> DataFrame:
    """As scan_csv, with one numeric column also kept as it was written, in <column>_text."""
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name == column else f.dataType) for f in schema])
    raw = scan_csv(spark, path, as_text)
    return raw.withColumn(f"{column}_text", F.col(column)).withColumn(column, F.expr(f"try_cast(`{column}` AS DOUBLE)"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN, which Spark takes for a value, becomes null in every floating column."""
    floating = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    return df.withColumns({c: F.when(~F.isnan(F.col(c)), F.col(c)) for c in floating})


def decimal_comma(c: Column) -> Column:
    """A number written with a decimal point or comma; null where it is neither."""
    return F.regexp_replace(c.cast("string"), ",", ".").try_cast("double")


def density_dimension(raw: DataFrame, name: str, temperature: str, density: str, order: str) -> DataFrame:
    """(name_key, t_key, density): normalised names, T to 2 places; unparseable rows go, the last of a key wins."""
    rows = raw.select(F.lower(F.trim(name)).alias("name_key"), F.bround(decimal_comma(F.col(temperature)), 2).alias("t_key"), decimal_comma(F.col(density)).alias("density"), F.col(order).alias("_order"))
    rows = rows.dropna(subset=["name_key", "t_key", "density"])
    return rows.groupBy("name_key", "t_key").agg(F.max_by("density", "_order").alias("density"))


def coefficient_dimension(raw: DataFrame, name: str, a: str, b: str, order: str) -> DataFrame:
    """(name_key, a, b) for density = a * T + b; the last of a name wins."""
    rows = raw.select(F.lower(F.trim(name)).alias("name_key"), decimal_comma(F.col(a)).alias("a"), decimal_comma(F.col(b)).alias("b"), F.col(order).alias("_order"))
    rows = rows.dropna(subset=["name_key", "a", "b"])
    best = rows.groupBy("name_key").agg(F.max_by(F.struct("a", "b"), "_order").alias("v"))
    return best.select("name_key", "v.a", "v.b")


def last_name_wins(rows: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """(key, name): the name that comes last in the order, among rows that have one."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    named = rows.where(F.col(key).isNotNull() & F.col(name).isNotNull())
    return named.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(key, name)


def measurements(spark: SparkSession, sf_dir: str, also: tuple[str, ...] = ()) -> DataFrame:
    """Measurements read off the star schema: (rid, solute, solvent, src, t, y), and columns of lineitem named in also.

    part's brand and type are the pair, the supplier's nation and parity the source, quantity the
    temperature and a price its reading. rid orders the rows as they came in. The two dimensions
    are small beside lineitem; whether they are broadcast is left to their measured size.
    """
    line = scan_parquet(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", *also)
    part = scan_parquet(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    supplier = scan_parquet(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000 + (F.col("l_partkey") * 31 + F.col("l_suppkey")) % 100_000).cast("long").alias("rid"),
        F.col("p_brand").alias("solute"),
        F.col("p_type").alias("solvent"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string"), F.lit("-"), (F.col("l_suppkey") % 2).cast("string")).alias("src"),
        (F.lit(273.15) + F.col("l_quantity")).alias("t"),
        (F.log10(F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount"))) - 5).alias("y"),
        *also,
    )


#: The same view as SQL, for oracles.
MEASUREMENTS_SQL = """m AS (
  SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + (l_partkey * 31 + l_suppkey) % 100000)::BIGINT AS rid, p_brand AS solute, p_type AS solvent,
    'N' || s_nationkey || '-' || (l_suppkey % 2) AS src, 273.15 + l_quantity AS t,
    log10(l_quantity * p_retailprice * (1 - l_discount)) - 5 AS y
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def bit_exact_sql(m: str = MEASUREMENTS_SQL) -> str:
    """m with src replaced by its group of sources that share an exact record, chains included (for WITH RECURSIVE)."""
    base = m.replace("m AS (", "m0 AS (", 1).replace(" - 5 AS y\n", " - 5 AS y, l_tax, date_trunc('month', l_shipdate) AS mon\n")
    return f"""{base},
sk AS (SELECT DISTINCT solute, solvent, round_even(t, 2) AS tk, round_even(y, 4) AS yk, l_tax, mon, src FROM m0),
se AS (SELECT DISTINCT a.src AS a, b.src AS b FROM sk a JOIN sk b USING (solute, solvent, tk, yk, l_tax, mon) WHERE a.src <> b.src),
sr(node, reach) AS (SELECT DISTINCT src, src FROM m0 UNION SELECT sr.node, se.b FROM sr JOIN se ON sr.reach = se.a),
ka AS MATERIALIZED (SELECT node AS src, min(reach) AS prelim FROM sr GROUP BY 1),
m AS (SELECT rid, solute, solvent, prelim AS src, t, y FROM m0 JOIN ka USING (src))"""
