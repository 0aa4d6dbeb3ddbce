"""The cleaning waterfall, density cascade, label recovery and manual corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.functions.scalar import mole_fraction_to_log, recovery_reason, round_half_even

MW_MAX, LOGS_MIN, LOGS_MAX = 1000.0, -15.0, 2.0


def first_failure(steps: list[tuple[str, Column]]) -> Column:
    """The name of the first step whose condition a row doesn't meet, or `kept`; null conditions fail."""
    out = None
    for name, holds in steps:
        fails = ~F.coalesce(holds, F.lit(False))
        out = F.when(fails, name) if out is None else out.when(fails, name)
    return out.otherwise("kept")


def waterfall(rows: DataFrame, steps: list[tuple[str, Column]], dedup_key: list[Column], order: str) -> DataFrame:
    """rows with `step`: what dropped each one; the last step keeps the first row (by order) of each key.

    One scan and one shuffle: the steps that look at a row alone are marked on the way, and the
    duplicates by a window over the same rows, in which dropped ones number apart from kept ones.
    """
    names = [f"_k{i}" for i in range(len(dedup_key))]
    marked = rows.withColumn("step", first_failure(steps)).withColumns(dict(zip(names, dedup_key, strict=True)))
    again = F.row_number().over(Window.partitionBy("step", *names).orderBy(order)) > 1
    return marked.withColumn("step", F.when((F.col("step") == "kept") & again, "duplicate").otherwise(F.col("step"))).drop(*names)


def waterfall_counts(marked: DataFrame, names: list[str]) -> DataFrame:
    """(ord, step, dropped, remaining) in the order of the steps, from one aggregate."""
    spark = marked.sparkSession
    every = [*names, "duplicate"]
    order = spark.createDataFrame(list(enumerate(every)), "ord int, step string")
    counts = marked.groupBy("step").agg(F.count("*").alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row for each step
    total = F.coalesce(F.max("total").over(Window.partitionBy()), F.lit(0))
    out = order.join(counts, "step", "full").select("ord", "step", F.coalesce("n", F.lit(0)).alias("dropped"), total.alias("total"))
    return out.where("ord is not null").select("ord", "step", "dropped", (F.col("total") - F.sum("dropped").over(Window.orderBy("ord"))).alias("remaining"))


def dedup_keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ingestion order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def density_cascade(rows: DataFrame, exact: DataFrame, linear: DataFrame, name: str = "solvent", t: str = "t", library: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """rows with density and its tag: an exact (name, T to 2 places) entry, else a * T + b, else a
    library's value for the name or its alias (case as given), else none. The dimensions are left to Catalyst to broadcast by size."""
    key, at = F.lower(F.trim(name)), round_half_even(F.col(t), 2)
    e = exact.select(F.col("name_key").alias("_en"), F.col("t_key").alias("_et"), F.col("density").alias("_exact"))
    c = linear.select(F.col("name_key").alias("_cn"), "a", "b")
    out = rows.join(e, (key == F.col("_en")) & (at == F.col("_et")), "left").join(c, key == F.col("_cn"), "left")
    fitted = F.col("a") * F.col(t) + F.col("b")
    if library is not None:
        known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[F.col(name)] if aliases else F.lit(None)
        out = out.join(library.select(F.col("name").alias("_ln"), F.col("density").alias("_library")), F.coalesce(known, F.col(name)) == F.col("_ln"), "left")
    else:
        out = out.withColumn("_library", F.lit(None).cast("double")).withColumn("_ln", F.lit(None).cast("string"))
    tag = F.when(F.col("_exact").isNotNull(), "density_dict_exact").when(fitted.isNotNull(), "coef_linear").when(F.col("_library").isNotNull(), "library").otherwise("unavailable")
    return out.withColumn("density", F.coalesce("_exact", fitted, "_library")).withColumn("density_tag", tag).drop("_en", "_et", "_exact", "_cn", "a", "b", "_ln", "_library")


def recover_labels(rows: DataFrame, label: str, x: str, density: str, weight: str) -> DataFrame:
    """rows with missing labels computed from the mole fraction, and `label_tag` saying how."""
    computed = mole_fraction_to_log(F.col(x), F.col(density), F.col(weight))
    tag = F.when(F.col(label).isNotNull(), "given").otherwise(F.concat(F.lit("recovered_"), recovery_reason(F.col(x), F.col(density), F.col(weight))))
    return rows.withColumn("label_tag", tag).withColumn(label, F.coalesce(label, computed))


def correct(rows: DataFrame, rules: list[tuple[str, Column, dict[str, Column]]]) -> DataFrame:
    """rows with each rule's new values where its condition holds, `correction` naming the rule, and
    the values before in old_<column>. The first rule that holds applies."""
    rule = None
    for name, holds, _ in rules:
        rule = F.when(holds, name) if rule is None else rule.when(holds, name)
    columns = sorted({c for _, _, new in rules for c in new})
    out = rows.withColumn("correction", rule).withColumns({"old_" + c: F.col(c) for c in columns})
    changed = {}
    for c in columns:
        value = F.col(c)
        for name, _, new in rules:
            if c in new:
                value = F.when(F.col("correction") == name, new[c]).otherwise(value)
        changed[c] = value
    return out.withColumns(changed)


def correction_log(corrected: DataFrame) -> DataFrame:
    return corrected.where("correction is not null").groupBy("correction").agg(F.count("*").alias("n_rows"), F.sum(F.abs(F.col("y") - F.col("old_y"))).alias("moved"))
