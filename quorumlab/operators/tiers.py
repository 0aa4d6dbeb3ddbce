"""Nested quality tiers, consensus labels and their uncertainty."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quorumlab.operators.fits import evaluate
from quorumlab.operators.ordered import with_quantiles
from quorumlab.session import cut

CUTS = {"gold": 0.10, "silver": 0.20, "bronze": 0.50}
SIGMA_FLOOR = 0.012


def assign_tiers(pair_mae: DataFrame, cuts: dict[str, float] = CUTS) -> DataFrame:
    """pair_mae with tier_<name> flags (at most the cut); pairs beyond every cut go."""
    out = pair_mae.withColumns({f"tier_{k}": F.col("pair_mae") <= v for k, v in cuts.items()})
    return out.where(F.col("pair_mae") <= max(cuts.values()))


def tier_points(measured: DataFrame, tiers: DataFrame) -> DataFrame:
    """(solute, solvent, t): each temperature measured for a tier pair, to 2 places."""
    return measured.select("solute", "solvent", F.bround("t", 2).alias("t")).distinct().join(tiers.select("solute", "solvent"), ["solute", "solvent"], "left_semi")


def tier_rows(measured: DataFrame, fits: DataFrame, tiers: DataFrame, floor: float = SIGMA_FLOOR) -> DataFrame:
    """(solute, solvent, t): consensus of the fits whose range holds t, and its sigma.

    t: each temperature measured for a tier pair, to 2 places. sigma is the sample deviation, not
    below the floor, and null with fewer than 2 fits. An equi-join on the pair with the range
    as residual predicate; temperatures without a fit keep no row.
    """
    at = tier_points(measured, tiers)
    f = fits.select(F.col("solute").alias("_s"), F.col("solvent").alias("_v"), "a", "b", "c", "t_min", "t_max")
    hit = at.join(f, (F.col("solute") == F.col("_s")) & (F.col("solvent") == F.col("_v")) & F.col("t").between(F.col("t_min"), F.col("t_max")))
    v = hit.withColumn("v", evaluate(F.col("t"))).groupBy("solute", "solvent", "t").agg(F.count("*").alias("n_groups"), F.avg("v").alias("consensus"), F.stddev_samp("v").alias("sd"))
    sigma = F.when(F.col("n_groups") >= 2, F.greatest("sd", F.lit(floor)))
    return v.select("solute", "solvent", "t", "n_groups", "consensus", sigma.alias("sigma"))


def tier_summary(rows: DataFrame, tiers: DataFrame, names: list[str]) -> DataFrame:
    """A row for each nested tier, from one pass over the rows exploded by the tiers they belong to."""
    mine = F.array_compact(F.array(*[F.when(F.col(f"tier_{x}"), x) for x in names]))
    joined = rows.join(tiers.select("solute", "solvent", mine.alias("tiers")), ["solute", "solvent"]).withColumn("tier", F.explode("tiers"))
    joined = cut(joined)
    out = joined.groupBy("tier").agg(
        F.count("*").alias("n_rows"), F.countDistinct("solute", "solvent").alias("n_pairs"), F.countDistinct("solute").alias("n_solutes"), F.countDistinct("solvent").alias("n_solvents"),
        (F.count("sigma") / F.count("*")).alias("sigma_coverage"), F.avg("sigma").alias("sigma_mean"),
    )
    return with_quantiles(out, joined, ["tier"], "sigma", {"sigma_median": 0.5, "sigma_p90": 0.9, "sigma_p95": 0.95})


def contributor_histogram(measured: DataFrame, tiers: DataFrame, rows: DataFrame) -> DataFrame:
    """(n_groups, n_rows): how many fits stand behind the temperatures measured for tier pairs; 0 where no fit's range holds one."""
    key = ["solute", "solvent", "t"]
    every = tier_points(measured, tiers).join(rows.select(*key, "n_groups"), key, "left")
    return every.groupBy(F.coalesce("n_groups", F.lit(0)).alias("n_groups")).agg(F.count("*").alias("n_rows"))
