"""Curve fits of y over temperature for each (solute, solvent, source group)."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.operators.ordered import exact_quantiles
from quorumlab.session import cut

KEY = ["solute", "solvent", "src"]
#: Sums of squares below this are those of a constant curve.
FLAT = 1e-18
#: What of ln t's spread 1/t must leave unexplained for a third parameter; less is rounding.
SINGULAR = 1e-14


def average_duplicates(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One y for each temperature of a group: the mean. Rows with a null in any of them go."""
    return rows.dropna(subset=[*key, "t", "y"]).groupBy(*key, "t").agg(F.avg("y").alias("y"))


def fit_curves(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """key, n, t_min, t_max, y_min, y_max, model, a, b, c, r2, rmse of y = a + b / t + c ln t.

    3 or more distinct temperatures give three parameters (`apelblat`), 2 give a + b / t
    (`vanthoff`), 1 none (`single_point`). The normal equations of 1, 1/t and ln t are too ill
    conditioned to sum up, so both ln t and y are first freed of 1/t (Frisch-Waugh): all in one
    shuffle by the key, as a window and an aggregate over the same partitions. A constant y has r2 1.
    """
    w = Window.partitionBy(*key)
    x1, x2 = 1 / F.col("t"), F.log("t")
    pts = average_duplicates(rows, key).select(*key, "t", "y", x1.alias("x1"), x2.alias("x2"))
    pts = pts.select(
        "*",
        F.avg("x1").over(w).alias("m1"), F.avg("x2").over(w).alias("m2"), F.avg("y").over(w).alias("my"),
        F.regr_slope("x2", "x1").over(w).alias("s1"), F.regr_slope("y", "x1").over(w).alias("s2"),
    )
    d1 = F.col("x1") - F.col("m1")
    pts = pts.withColumn("r", (F.col("x2") - F.col("m2")) - F.col("s1") * d1).withColumn("q", (F.col("y") - F.col("my")) - F.col("s2") * d1)
    dev = F.col("y") - F.col("my")
    sums = pts.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"),
        *[F.first(c).alias(c) for c in ("m1", "m2", "my", "s1", "s2")],
        F.sum(F.col("q") * F.col("r")).alias("qr"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("q") * F.col("q")).alias("qq"), (F.var_pop("x2") * F.count("*")).alias("xx"), F.sum(dev * dev).alias("sst"),
    )
    n = F.col("n")
    c = F.when(n >= 3, F.when(F.col("rr") > SINGULAR * F.col("xx"), F.try_divide("qr", "rr"))).when(n == 2, F.lit(0.0))
    sums = sums.withColumn("c_", c).withColumn("b", F.col("s2") - F.col("c_") * F.col("s1"))
    sse = F.greatest(F.lit(0.0), F.col("qq") - 2 * F.col("c_") * F.col("qr") + F.col("c_") * F.col("c_") * F.col("rr"))
    fitted = F.col("c_").isNotNull()
    r2 = F.when(fitted, F.when(F.col("sst") < FLAT, F.lit(1.0)).otherwise(1 - sse / F.when(F.col("sst") >= FLAT, F.col("sst"))))
    return sums.select(
        *key, "n", "t_min", "t_max", "y_min", "y_max",
        F.when(n == 1, "single_point").when(n == 2, F.when(fitted, "vanthoff").otherwise("vanthoff_failed")).otherwise(F.when(fitted, "apelblat").otherwise("apelblat_failed")).alias("model"),
        F.when(fitted, F.col("my") - F.col("b") * F.col("m1") - F.col("c_") * F.col("m2")).alias("a"),
        F.when(fitted, F.col("b")).alias("b"), F.when(n >= 3, F.col("c_")).alias("c"), r2.alias("r2"), F.when(fitted, F.sqrt(sse / n)).alias("rmse"),
    )


def fit_curves_lstsq(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The same (key, n, a, b, c, r2, rmse) by least squares in each group, to hold fit_curves against."""
    pts = average_duplicates(rows, key)

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        t, y = g["t"].to_numpy(), g["y"].to_numpy()
        row = {k: g[k].iloc[0] for k in key} | {"n": len(g), "a": None, "b": None, "c": None, "r2": None, "rmse": None}
        if len(g) >= 2:
            x = np.stack([np.ones_like(t), 1 / t, np.log(t)][: min(len(g), 3)], axis=1)
            scale = np.abs(x).max(axis=0)
            beta = np.linalg.lstsq(x / scale, y, rcond=None)[0] / scale
            sse, sst = float(((y - x @ beta) ** 2).sum()), float(((y - y.mean()) ** 2).sum())
            row |= {"a": beta[0], "b": beta[1], "c": beta[2] if len(beta) > 2 else None, "r2": 1.0 if sst < FLAT else 1 - sse / sst, "rmse": (sse / len(g)) ** 0.5}
        return pd.DataFrame([row])

    kinds = dict(pts.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", n long, a double, b double, c double, r2 double, rmse double"
    return pts.groupBy(*key).applyInPandas(solve, schema)


def usable(fits: DataFrame, least_r2: float = 0.80, most_rmse: float = 0.30) -> DataFrame:
    """Fits good enough to be compared; a missing r2 counts as 0 and a missing rmse as 1."""
    return fits.where((F.coalesce("r2", F.lit(0.0)) >= least_r2) & (F.coalesce("rmse", F.lit(1.0)) <= most_rmse) & F.col("a").isNotNull())


def evaluate(t: Column, prefix: str = "") -> Column:
    """a + b / t + c ln t of a fit's columns; without c two parameters."""
    a, b, c = (F.col(prefix + x) for x in "abc")
    return a + b / t + F.coalesce(c, F.lit(0.0)) * F.log(t)


def grid(t0: Column, t1: Column, step: float = 1.0) -> Column:
    """Points t0, t0 + step, ... up to t1, as an array."""
    return F.transform(F.sequence(F.lit(0), F.floor((t1 - t0) / step).cast("int")), lambda i: t0 + i * step)


def monotonicity(rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """For groups of 3 or more temperatures: Spearman's rho, steps up and down, the worst drop."""
    w = Window.partitionBy(*key)
    pts = average_duplicates(rows, key)
    pts = pts.withColumn("rt", F.rank().over(w.orderBy("t")).cast("double"))
    ties = F.count("*").over(Window.partitionBy(*key, "y"))
    pts = pts.withColumn("ry", F.rank().over(w.orderBy("y")) + (ties - 1) / 2).withColumn("d", F.col("y") - F.lag("y").over(w.orderBy("t")))
    out = pts.groupBy(*key).agg(
        F.count("*").alias("n"), F.corr("rt", "ry").alias("spearman_rho"), F.count_if(F.col("d") > 0).alias("n_up"), F.count_if(F.col("d") < 0).alias("n_down"),
        F.least(F.lit(0.0), F.min("d")).alias("worst_drop"), (F.max("y") - F.min("y")).alias("y_range"),
    )
    return out.where("n >= 3").withColumn("monotone", F.col("n_down") == 0)


def fit_summary(fits: DataFrame) -> DataFrame:
    """One row: how good the fits are."""
    fitted = cut(fits.where("r2 is not null").select("r2", "rmse"))
    out = fitted.agg(
        F.count("*").alias("n_fits"), F.avg("r2").alias("r2_mean"), F.avg((F.col("r2") >= 0.95).cast("int")).alias("share_r2_95"),
        F.avg((F.col("r2") >= 0.99).cast("int")).alias("share_r2_99"), F.count_if((F.col("r2") < 0.8) | (F.col("rmse") > 0.3)).alias("n_bad"),
    )
    ends = exact_quantiles(fitted, "r2", {"r2_median": 0.5}).crossJoin(exact_quantiles(fitted, "rmse", {"rmse_median": 0.5, "rmse_p95": 0.95}))
    return out.crossJoin(F.broadcast(ends)).select("n_fits", "r2_median", "r2_mean", "share_r2_95", "share_r2_99", "rmse_median", "rmse_p95", "n_bad")  # one row


FITS_SQL = """avg_t AS (SELECT solute, solvent, src, t, avg(y) AS y FROM m WHERE y IS NOT NULL GROUP BY ALL),
g AS (SELECT *, 1 / t AS x1, ln(t) AS x2 FROM avg_t),
mom AS (SELECT solute, solvent, src, count(*) AS n, min(t) AS t_min, max(t) AS t_max, min(y) AS y_min, max(y) AS y_max,
  avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, CASE WHEN count(*) > 1 THEN regr_slope(x2, x1) END AS s1, CASE WHEN count(*) > 1 THEN regr_slope(y, x1) END AS s2 FROM g GROUP BY 1, 2, 3),
res AS (SELECT g.solute, g.solvent, g.src, (x2 - m2) - s1 * (x1 - m1) AS r, (y - my) - s2 * (x1 - m1) AS q, y - my AS dev FROM g JOIN mom USING (solute, solvent, src)),
sums AS (SELECT solute, solvent, src, sum(q * r) AS qr, sum(r * r) AS rr, sum(q * q) AS qq, sum(dev * dev) AS sst FROM res GROUP BY 1, 2, 3),
cc AS (SELECT *, CASE WHEN n >= 3 THEN qr / rr WHEN n = 2 THEN 0.0 END AS c_ FROM mom JOIN sums USING (solute, solvent, src)),
bb AS (SELECT *, s2 - c_ * s1 AS b, greatest(0.0, qq - 2 * c_ * qr + c_ * c_ * rr) AS sse FROM cc),
fits AS (SELECT solute, solvent, src, n, t_min, t_max, y_min, y_max,
  CASE WHEN n = 1 THEN 'single_point' WHEN n = 2 THEN 'vanthoff' ELSE 'apelblat' END AS model,
  CASE WHEN n > 1 THEN my - b * m1 - c_ * m2 END AS a, CASE WHEN n > 1 THEN b END AS b, CASE WHEN n >= 3 THEN c_ END AS c,
  CASE WHEN n = 1 THEN NULL WHEN sst < 1e-18 THEN 1.0 ELSE 1 - sse / sst END AS r2, CASE WHEN n > 1 THEN sqrt(sse / n) END AS rmse FROM bb),
good AS (SELECT * FROM fits WHERE coalesce(r2, 0) >= 0.8 AND coalesce(rmse, 1) <= 0.3 AND a IS NOT NULL)"""

