"""Global ranks, running sums and exact quantiles, of all rows or by group, without a task that holds all rows or a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.session import cut


def global_running(rows: DataFrame, order: list[Column | str], value: str | None = None) -> DataFrame:
    """rows with `rank` (from 1, in the given order) and, of a value column, the running sum `cum`.

    Rows are range partitioned by the order; each range is numbered by its own task, after a row for each range has
    told how much lies before it. The order should be total, else ties are numbered as they lie.
    """
    ranged = cut(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    total = F.sum(value) if value else F.lit(None)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"), total.alias("_s"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    w = Window.partitionBy("_range").orderBy(*order)
    out = ranged.join(F.broadcast(sizes), "_range").withColumn("rank", F.col("_n0") + F.row_number().over(w))
    if value:
        out = out.withColumn("cum", F.col("_s0") + F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("_range", "_n0", "_s0")


def first_rows(rows: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first k rows in the order, for a k that may grow with the table (a small k is a plain limit)."""
    return global_running(rows, order).where(F.col("rank") <= k).drop("rank")


def exact_quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: a column for each named share, interpolated between neighbours; nulls are left out, no rows give nulls.

    Equal values are counted first, so the order is over distinct values and a hot value is one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    run = global_running(counts, ["v"], "c").select("v", "c", "cum")
    total = run.agg(F.coalesce(F.max("cum"), F.lit(0)).alias("n"))  # one row
    run = run.crossJoin(F.broadcast(total))
    picked = []
    for name, share in shares.items():
        place = (F.col("n") - 1) * share
        for end, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            picked.append(F.max(F.when((F.col("cum") > at) & (F.col("cum") - F.col("c") <= at), F.col("v"))).alias(f"{name}_{end}"))
        picked.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
    ends = run.agg(*picked)
    return ends.select(*[(F.col(f"{x}_lo") + (F.col(f"{x}_hi") - F.col(f"{x}_lo")) * F.col(f"{x}_part")).alias(x) for x in shares])


def grouped_quantiles(rows: DataFrame, by: list[str], value: Column | str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each named share): exact quantiles of each group, interpolated between neighbours.

    Equal values of a group are counted first. The counts are range partitioned by (group, value), so a large group lies in as many ranges as its
    values fill; a row for each group in a range then tells how much of the group lies before it, and which of a range's values
    a wanted place falls on is decided inside the range. Nulls in the value are left out; a group without values has no row; a null
    group is a group.
    """
    counts = rows.select(*by, (F.col(value) if isinstance(value, str) else value).cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    ranged = cut(counts.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy("_range", *by).agg(F.sum("_c").alias("_s"))  # groups and ranges together bound its rows
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_{c}") for c in by], "_s", before.alias("_before"), F.sum("_s").over(group).alias("_n"))
    ends = {}  # wanted places, from 0
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(share))
        ends |= {f"_{name}_lo": F.floor(place), f"_{name}_hi": F.ceil(place)}
    parts = parts.withColumns(ends)
    held = None  # only ranges that hold a wanted place are looked into
    for name in ends:
        inside = (F.col(name) >= F.col("_before")) & (F.col(name) < F.col("_before") + F.col("_s"))
        held = inside if held is None else held | inside
    on = F.col("_range") == F.col("_r")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    w = Window.partitionBy("_range", *by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.join(parts.where(held), on).withColumn("_cum", F.col("_before") + F.sum("_c").over(w))
    hits = {name: (F.col("_cum") > F.col(name)) & (F.col("_cum") - F.col("_c") <= F.col(name)) for name in ends}
    any_hit = None
    for hit in hits.values():
        any_hit = hit if any_hit is None else any_hit | hit
    found = run.where(any_hit).groupBy(*by).agg(F.max("_n").alias("_n"), *[F.max(F.when(hit, F.col("_v"))).alias(f"{name}_v") for name, hit in hits.items()])
    out = []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(share))
        lo, hi = F.col(f"_{name}_lo_v"), F.col(f"_{name}_hi_v")
        out.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    return found.select(*by, *out)


def with_quantiles(table: DataFrame, rows: DataFrame, by: list[str], value: Column | str, shares: dict[str, float]) -> DataFrame:
    """table(by, ...), a row for each group of rows, with grouped_quantiles of rows; null where a group has no value."""
    found = grouped_quantiles(rows, by, value, shares)
    found = found.withColumnsRenamed({c: f"_q_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_q_{c}"))
    return table.join(found, on, "left").drop(*[f"_q_{c}" for c in by])
