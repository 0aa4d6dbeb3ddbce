"""Audits of raw tables: profiles, duplicates, copies between sources, collisions, residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.operators.ordered import with_quantiles


def schema_profile(df: DataFrame) -> DataFrame:
    """(column_name, kind, null_count, row_count) from one aggregate over the table."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    kinds = dict(df.dtypes)
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("kind"), F.col(c).alias("null_count"), F.col("_n").alias("row_count")) for c in df.columns])
    return counts.select(F.explode(cells).alias("x")).select("x.*")


def duplicate_counts(df: DataFrame, key: list[str]) -> DataFrame:
    """(n_keys, n_rows) of keys that occur more than once; nulls compare equal."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("n_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def near_duplicates(df: DataFrame, key: list[str], x: str, y: str, order: str, dx: float, dy: float) -> DataFrame:
    """Rows closer than dx and dy, strictly, to the row before them in the same key by (x, order)."""
    w = Window.partitionBy(*key).orderBy(x, order)
    pairs = df.withColumn("_dx", F.col(x) - F.lag(x).over(w)).withColumn("_dy", F.abs(F.col(y) - F.lag(y).over(w)))
    return pairs.where((F.col("_dx") < dx) & (F.col("_dy") < dy)).drop("_dx", "_dy")


def copy_keys(df: DataFrame, key: list[str], source: str) -> DataFrame:
    """Keys that rows of more than one source share: (key, n, n_sources)."""
    return df.groupBy(*key).agg(F.count("*").alias("n"), F.countDistinct(source).alias("n_sources")).where("n_sources > 1")


def copy_pairs(df: DataFrame, key: list[str], source: str, top: int) -> DataFrame:
    """The pairs of sources that share most keys, the names on ties.

    Pairs are made within each key's sorted set of sources, whose length the number of sources
    bounds, so that no row joins all others of its key.
    """
    sets = df.dropna(subset=[*key, source]).groupBy(*key).agg(F.array_sort(F.collect_set(source)).alias("s")).where(F.size("s") > 1)
    pairs = sets.select(F.posexplode("s").alias("i", "src_a"), "s").select("src_a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("src_b"))
    return pairs.groupBy("src_a", "src_b").agg(F.count("*").alias("n_shared")).orderBy(F.desc("n_shared"), "src_a", "src_b").limit(top)


def source_inventory(df: DataFrame) -> DataFrame:
    """(src, n, n_solutes, n_solvents, share, p90): p90 is over all sources' counts."""
    c = df.groupBy("src").agg(F.count("*").alias("n"), F.countDistinct("solute").alias("n_solutes"), F.countDistinct("solvent").alias("n_solvents"))
    total = c.agg(F.sum("n").alias("_t"), F.expr("percentile(n, 0.9)").alias("p90"))
    return c.crossJoin(F.broadcast(total)).select("src", "n", "n_solutes", "n_solvents", F.round(F.col("n") / F.col("_t"), 6).alias("share"), F.round("p90", 6).alias("p90"))  # one row


def collisions(df: DataFrame, a: str, b: str, name_ab: str, name_ba: str) -> DataFrame:
    """How many values of a have several of b, and the other way."""
    def side(x: str, y: str, name: str) -> DataFrame:
        many = df.groupBy(x).agg(F.countDistinct(y).alias("k")).where("k > 1")
        return many.agg(F.count("*").alias("n_many"), F.max("k").alias("most")).select(F.lit(name).alias("side"), "n_many", "most")

    return side(a, b, name_ab).unionAll(side(b, a, name_ba))


def residuals_by_source(df: DataFrame, source: str, residual: str, least_median: float, top: int) -> DataFrame:
    """Sources with the largest median absolute residual above a bound."""
    r = F.abs(F.col(residual))
    s = df.groupBy(source).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.max(r).alias("most"), F.avg(residual).alias("signed"))
    s = with_quantiles(s, df, [source], r, {"med": 0.5, "p95": 0.95})
    return s.where(F.col("med") > least_median).orderBy(F.desc("med"), source).limit(top)


def cell_pair_deltas(df: DataFrame, cell: list[str], rid: str, member: str, value: str) -> DataFrame:
    """(cell, d): absolute differences of each unordered pair of rows of different members in a cell."""
    b = df.select(*[F.col(c).alias("_" + c) for c in [*cell, rid, member, value]])
    same = [F.col(c) == F.col("_" + c) for c in cell]
    on = (F.col(rid) < F.col("_" + rid)) & (F.col(member) != F.col("_" + member))
    for c in same:
        on = on & c
    return df.join(b, on).select(*cell, F.abs(F.col(value) - F.col("_" + value)).alias("d"))


def majority(df: DataFrame, group: str, value: str, order: str | None = None) -> DataFrame:
    """The most frequent value of each group and its count; on ties the one met first in the order column, or else the smallest."""
    first = F.min(order) if order else F.lit(None)
    c = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"), first.alias("_first"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "_first", value)
    return c.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(group, value, "n")


def listed_sources(df: DataFrame, names: list[str]) -> DataFrame:
    """A row for each listed source, with 0 rows if absent."""
    listed = df.sparkSession.createDataFrame([(x,) for x in names], "src string")
    a = df.join(F.broadcast(listed), "src", "left_semi").groupBy("src").agg(F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))
    return listed.join(a, "src", "left").select("src", F.coalesce("n", F.lit(0)).cast("long").alias("n_rows"), "t_min", "t_max", "y_min", "y_max")


def policy_cardinalities(df: DataFrame, raw: Column, policies: dict[str, Column]) -> DataFrame:
    """Distinct keys as given and under each policy, and how many the last one merges."""
    out = df.agg(F.countDistinct(raw).alias("raw"), *[F.countDistinct(c).alias(k) for k, c in policies.items()])
    return out.withColumn("merged", F.col("raw") - F.col(list(policies)[-1]))


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_overlap(pre: DataFrame, hold: DataFrame) -> DataFrame:
    """Rows and pairs of pre(a, b) that hold(a, b) has too."""
    pairs = pre.groupBy("a", "b").agg(F.count("*").alias("n")).join(hold, ["a", "b"], "left_semi")
    return pairs.agg(F.count("*").alias("n_overlap_pairs"), F.sum("n").alias("n_overlap_rows"), F.countDistinct("a").alias("n_solutes"))


def validity_scan(df: DataFrame, key: str, canonicalize: Column) -> DataFrame:
    """Distinct keys for which the canonicalizer gives null."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().where(canonicalize.isNull())
