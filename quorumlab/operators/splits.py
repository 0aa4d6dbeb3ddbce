"""Train, evaluation and out-of-distribution splits, samples and leakage checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.operators.ordered import global_running
from quorumlab.session import cut

#: Groups up to which a row for each is broadcast.
BROADCAST_GROUPS = 1 << 17


def head_by_share(rows: DataFrame, key: str, share: float = 0.85) -> DataFrame:
    """(key, n, cum_share) of the most frequent keys up to and with the first that reaches the share.

    The running sum is over a row for each key, ties by key; nulls are no key.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    run = global_running(counts, [F.desc("n"), F.col(key)], "n")
    out = run.crossJoin(F.broadcast(run.agg(F.sum("n").alias("total"))))  # one row
    return out.where((F.col("cum") - F.col("n")) / F.col("total") < share).select(key, "n", (F.col("cum") / F.col("total")).alias("cum_share"))


def draw(seed: int, *key: Column) -> Column:
    """A pseudo-random order that any engine with md5 reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *key))


def stratified_holdout(pairs: DataFrame, stratum: str, member: str, fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """pairs(stratum, member) with held_out: ceil(fraction * n), 1 at least, of each stratum."""
    distinct = pairs.select(stratum, member).where(F.col(stratum).isNotNull() & F.col(member).isNotNull()).distinct()
    w = Window.partitionBy(stratum)
    ranked = distinct.select("*", F.row_number().over(w.orderBy(draw(seed, F.col(stratum), F.col(member)), member)).alias("_r"), F.count("*").over(w).alias("_n"))
    return ranked.select(stratum, member, (F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.col("_n")))).alias("held_out"))


def first_drawn(rows: DataFrame, order: Column, key: Column, wanted: Callable[[Column], Column], by: list[str] | None = None) -> DataFrame:
    """The first wanted(n) of the n rows, or of each group of n, in the order of a draw (a hexadecimal text) and key; a null group is a group.

    A first pass counts draws by the four digits they begin with. Rows of all beginnings before the one that the wanted place falls
    on are taken where they lie; only those of that beginning, a 65,536th of a group, are ranked, range by range. So neither a task nor a
    shuffle holds the rows, or a group of them. rows are read several times and must come out alike.
    """
    by = by or []
    drawn = rows.withColumns({"_draw": order, "_key": key}).withColumn("_start", F.left("_draw", F.lit(4)))
    counts = drawn.groupBy(*by, "_start").agg(F.count("*").alias("_c"))
    groups = [f"_g{i}" for i in range(len(by))]
    places = counts.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.col("_start").alias("_edge"), "_c")
    w = Window.partitionBy(*groups)  # 65,536 rows of a group at most
    places = places.withColumns({"_n": F.sum("_c").over(w), "_cum": F.sum("_c").over(w.orderBy("_edge").rowsBetween(Window.unboundedPreceding, 0))}).withColumn("_k", F.least("_n", wanted(F.col("_n"))))
    at = places.where((F.col("_cum") >= F.col("_k")) & (F.col("_cum") - F.col("_c") < F.col("_k")))
    edges = cut(at.select(*groups, "_edge", (F.col("_k") - F.col("_cum") + F.col("_c")).alias("_rest"), F.when(F.col("_k") == F.col("_cum"), F.concat("_edge", F.lit("~"))).otherwise(F.col("_edge")).alias("_bound")))  # ~ comes after all digits
    if not by or edges.count() <= BROADCAST_GROUPS:
        edges = F.broadcast(edges)
    same = F.lit(True)
    for c, g in zip(by, groups, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(g))
    sure = drawn.join(edges, same & (F.col("_start") < F.col("_bound"))).select(*rows.columns)
    open_ = cut(drawn.join(edges, same & (F.col("_start") == F.col("_edge")) & (F.col("_bound") == F.col("_edge"))).select(*rows.columns, *groups, "_draw", "_key", "_rest"))
    ranked = global_running(open_, [*groups, "_draw", "_key"])
    on = F.lit(True)
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_of{g}"))
    before = ranked.groupBy(*[F.col(g).alias(f"_of{g}") for g in groups]).agg((F.min("rank") - 1).alias("_before"))
    return sure.unionAll(ranked.join(before, on).where(F.col("rank") - F.col("_before") <= F.col("_rest")).select(*rows.columns))


def subsample(rows: DataFrame, key: Column, n: int | None, fraction: float, seed: int, least: int = 32) -> DataFrame:
    """max(least, half-even rounded n * fraction) of the n rows (counted on the way if None), without replacement."""
    wanted = lambda of: F.greatest(F.lit(least), F.bround((of if n is None else F.lit(n)) * F.lit(float(fraction))).cast("long"))
    return first_drawn(rows, draw(seed, key), key, wanted)


def stratified_subsample(rows: DataFrame, stratum: str, key: Column, fraction: float, seed: int) -> DataFrame:
    """max(1, half-even rounded n * fraction) rows of each stratum."""
    return first_drawn(rows, draw(seed, key), key, lambda n: F.greatest(F.lit(1), F.bround(n * fraction).cast("long")), [stratum])


def make_splits(rows: DataFrame, tier_pairs: DataFrame, share: float = 0.85, fraction: float = 0.10, seed: int = 42) -> DataFrame:
    """rows with `split`: train and eval by pair within the head solvents, ood for the others.

    Solutes of any tier pair stay out of all three.
    """
    pool = rows.join(tier_pairs.select("solute").distinct(), "solute", "left_anti")
    head = head_by_share(pool, "solvent", share).select("solvent", F.lit(True).alias("_head"))
    held = stratified_holdout(pool.join(head, "solvent", "left_semi"), "solvent", "solute", fraction, seed)
    out = pool.join(head, "solvent", "left").join(held, ["solvent", "solute"], "left")
    split = F.when(F.col("_head").isNull(), "ood").when(F.col("held_out"), "eval").otherwise("train")
    return out.withColumn("split", split).drop("_head", "held_out")


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("solute").alias("n_solutes"), F.countDistinct("solvent").alias("n_solvents"), F.countDistinct("solute", "solvent").alias("n_pairs"))


def leakage(rows: DataFrame, tier_pairs: DataFrame) -> DataFrame:
    """(check, n_shared): what the splits share with the tiers and with each other, by set intersection."""
    pair = ["solute", "solvent"]
    of = lambda s, c: rows.where(F.col("split") == s).select(*c)
    checks = [
        ("train_tier_solutes", of("train", ["solute"]).intersect(tier_pairs.select("solute"))),
        ("eval_tier_solutes", of("eval", ["solute"]).intersect(tier_pairs.select("solute"))),
        ("ood_tier_solutes", of("ood", ["solute"]).intersect(tier_pairs.select("solute"))),
        ("train_eval_pairs", of("train", pair).intersect(of("eval", pair))),
        ("train_ood_solvents", of("train", ["solvent"]).intersect(of("ood", ["solvent"]))),
        ("train_eval_solutes", of("train", ["solute"]).intersect(of("eval", ["solute"]))),
    ]
    parts = [df.agg(F.count("*").alias("n_shared")).select(F.lit(name).alias("check"), "n_shared") for name, df in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def assign_by_priority(named: dict[str, DataFrame], pairs: DataFrame, default: str = "train") -> DataFrame:
    """pairs(solute, solvent) with the first split, in the dict's order, that has the pair."""
    parts = [df.select("solute", "solvent", F.lit(i).alias("_p"), F.lit(name).alias("split")) for i, (name, df) in enumerate(named.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionAll(p)
    best = every.groupBy("solute", "solvent").agg(F.min_by("split", "_p").alias("split"))
    return pairs.select("solute", "solvent").distinct().join(best, ["solute", "solvent"], "left").select("solute", "solvent", F.coalesce("split", F.lit(default)).alias("split"))
