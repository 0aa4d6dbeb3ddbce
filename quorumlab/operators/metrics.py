"""Error metrics of predictions, in the module's and the toolkit's variants, and label statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.operators.ordered import with_quantiles

#: Labels nearer to 0 than this are left out of mape.
MAPE_EPS = 1e-6
#: The toolkit divides by no sigma below this.
SIGMA_CLIP = 0.01


def _error() -> Column:
    return F.col("y_pred") - F.col("y_true")


def _r2(sse: Column, sst: Column) -> Column:
    """1 - sse / sst; null where the truth is constant."""
    return F.when(sst > 0, 1 - sse / F.when(sst > 0, sst))


def _usable_sigma() -> Column:
    s = F.col("sigma")
    return s.isNotNull() & ~F.isnan(s) & (s > 0) & (s != float("inf"))


def simple_metrics(pred: DataFrame, by: list[str]) -> DataFrame:
    """rmse, mae, medae, r2 and n for each group of `by`."""
    e = _error()
    one = pred.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), _r2(F.sum(e * e), F.var_pop("y_true") * F.count("*")).alias("r2"), F.count("*").alias("n"))
    return with_quantiles(one, pred, by, F.abs(e), {"medae": 0.5}).select(*by, "rmse", "mae", "medae", "r2", "n")


def metrics_module(pred: DataFrame, by: list[str]) -> DataFrame:
    """rmse, mae, medae, ps_rmse (mean over solvents of any size), z_rmse and mape with their n.

    Two levels of aggregates over the same rows; only a row for each solvent is shuffled twice.
    """
    e = _error()
    ok, away = _usable_sigma(), F.abs(F.col("y_true")) >= MAPE_EPS
    one = pred.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(F.when(ok, F.pow(e / F.when(ok, F.col("sigma")), F.lit(2))))).alias("z_rmse"), F.count_if(ok).alias("z_n"),
        (100 * F.avg(F.when(away, F.abs(e / F.when(away, F.col("y_true")))))).alias("mape"), F.count_if(away).alias("mape_n"),
    )
    one = with_quantiles(one, pred, by, F.abs(e), {"medae": 0.5})
    each = pred.where("solvent is not null").groupBy(*by, "solvent").agg(F.sqrt(F.avg(e * e)).alias("r"))
    return one.join(each.groupBy(*by).agg(F.avg("r").alias("ps_rmse")), by, "left")


def metrics_sdk(pred: DataFrame, by: list[str]) -> DataFrame:
    """rmse, mae, r2, n, ps_rmse and ps_r2 (solvents of 2 rows or more), z_rmse (sigma clipped), f_aleatoric (unclipped)."""
    e = _error()
    ok = _usable_sigma()
    one = pred.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), _r2(F.sum(e * e), F.var_pop("y_true") * F.count("*")).alias("r2"), F.count("*").alias("n"),
        F.sqrt(F.avg(F.when(ok, F.pow(e / F.greatest("sigma", F.lit(SIGMA_CLIP)), F.lit(2))))).alias("z_rmse"),
        F.avg(F.when(ok, (F.abs(e) <= 2 * F.col("sigma")).cast("int"))).alias("f_aleatoric"),
    )
    each = pred.where("solvent is not null").groupBy(*by, "solvent").agg(F.count("*").alias("k"), F.sqrt(F.avg(e * e)).alias("r"), _r2(F.sum(e * e), F.var_pop("y_true") * F.count("*")).alias("q")).where("k >= 2")
    return one.join(each.groupBy(*by).agg(F.avg("r").alias("ps_rmse"), F.avg("q").alias("ps_r2")), by, "left")


AVAILABLE = {"module": metrics_module, "sdk": metrics_sdk, "simple": simple_metrics}


def evaluate_predictions(pred: DataFrame, by: list[str], variant: str = "module", include: list[str] | None = None) -> DataFrame:
    """The chosen metrics of a variant; metrics that lack their inputs are null columns."""
    if variant not in AVAILABLE:
        raise ValueError(f"unknown variant {variant!r}; known are {sorted(AVAILABLE)}")
    for name, kind in (("sigma", "double"), ("solvent", "string")):
        if name not in pred.columns:
            pred = pred.withColumn(name, F.lit(None).cast(kind))
    out = AVAILABLE[variant](pred, by)
    return out.select(*by, *include) if include else out


def distribution_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """n, mean, median, percentiles, rmse and max of a value."""
    v = F.col(value)
    out = rows.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rmse"), F.max(v).alias("max"))
    out = with_quantiles(out, rows, by, v, {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return out.select(*by, "n", "mean", "median", "p75", "p90", "p95", "p99", "rmse", "max")


def anova(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Sums of squares between and within groups, F over groups of 2 rows or more."""
    clean = rows.where(F.col(group).isNotNull() & F.col(value).isNotNull())
    g = clean.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ssw"))
    big = F.col("n") >= 2
    weighted = F.col("n") * F.col("m")
    means = g.agg(  # one row
        (F.sum(weighted) / F.sum("n")).alias("grand"), F.sum(F.when(big, F.col("n"))).alias("bn"), F.count_if(big).alias("bk"),
        F.try_divide(F.sum(F.when(big, weighted)), F.sum(F.when(big, F.col("n")))).alias("bg"),
    )
    parts = g.crossJoin(F.broadcast(means)).agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), F.lit(2))).alias("ss_between"), F.sum("ssw").alias("ss_within"), F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"),
        F.sum(F.when(big, F.col("n") * F.pow(F.col("m") - F.col("bg"), F.lit(2)))).alias("bb"), F.sum(F.when(big, F.col("ssw"))).alias("bw"), F.first("bn").alias("bn"), F.first("bk").alias("bk"),
    )
    f = F.try_divide(F.try_divide("bb", F.col("bk") - 1), F.try_divide("bw", F.col("bn") - F.col("bk")))
    return parts.select("n_groups", "n_rows", "ss_between", "ss_within", (F.col("ss_between") + F.col("ss_within")).alias("ss_total"), f.alias("f_value"))


def dummy_baseline(train: DataFrame, other: DataFrame, group: str = "solvent", value: str = "y") -> DataFrame:
    """other with y_pred: the training mean of its group, the grand mean where unseen."""
    means = train.groupBy(group).agg(F.avg(value).alias("_m"))
    grand = train.agg(F.avg(value).alias("_g"))
    out = other.join(means, group, "left").crossJoin(F.broadcast(grand))  # one row
    return out.withColumn("seen", F.col("_m").isNotNull()).withColumn("y_pred", F.coalesce("_m", "_g")).withColumn("y_true", F.col(value)).drop("_m", "_g")


def count_domination(rows: DataFrame, key: str, tops: tuple[int, ...] = (1, 5, 10, 25, 50)) -> DataFrame:
    """(top, share): the share of rows that the most frequent keys hold."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    most = counts.orderBy(F.desc("n"), key).limit(max(tops)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), key)))  # max(tops) rows
    at = most.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total")))).withColumn("top", F.explode(F.array(*map(F.lit, tops)))).where("r <= top")  # one row
    return at.groupBy("top").agg((F.sum("n") / F.max("total")).alias("share"))


def seed_aggregate(results: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation and n over seeds of results(..., metric, value); NaN is missing."""
    v = F.when(~F.isnan("value"), F.col("value"))
    return results.groupBy(*by).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def method_table(aggregated: DataFrame, columns: list[str], ordered: list[str]) -> DataFrame:
    """A row for each method (registered ones first, in order), a column for each split_metric of fixed names."""
    named = aggregated.withColumn("_c", F.concat_ws("_", "split", "metric"))
    order = F.coalesce(F.array_position(F.array(*map(F.lit, ordered)), F.col("method")), F.lit(0))
    wide = named.groupBy("method").pivot("_c", columns).agg(F.first("mean"))
    return wide.withColumn("ord", F.when(order > 0, order).otherwise(len(ordered) + 1).cast("long"))
