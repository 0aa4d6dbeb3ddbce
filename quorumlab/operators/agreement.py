"""Agreement between source groups: pairs of fits on a common grid, reliability, grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quorumlab.operators.fits import grid
from quorumlab.operators.graph import components_at, connected_components, minimum_spanning_forest
from quorumlab.operators.ordered import global_running, with_quantiles
from quorumlab.session import cut

#: Overlap of two fits' temperature ranges, in kelvin, from which they are compared.
LEAST_OVERLAP = 5.0
#: Groups of one (solute, solvent) that meet each other in one task.
BLOCK = 512


def fit_pairs(fits: DataFrame, group: str = "src", least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """Each unordered pair of groups that share a (solute, solvent), with their overlap t0 to t1.

    An equi-join with gi < gj and the overlap as residual predicates, so only pairs that are
    compared are made. Groups of a (solute, solvent) are dealt into as many blocks as its number asks for, and each
    block meets each other under a key of its own: a pair is made once, and a hot (solute, solvent) is spread over its pairs of blocks.
    """
    cols = ["a", "b", "c", "t_min", "t_max"]
    blocks = fits.groupBy("solute", "solvent").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n")).where("_n > 1")  # hot ones only
    dealt = fits.join(blocks.withColumnsRenamed({"solute": "_s", "solvent": "_v"}), (F.col("solute") == F.col("_s")) & (F.col("solvent") == F.col("_v")), "left")
    dealt = dealt.withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_own", F.pmod(F.xxhash64(group), "_n").cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    a = dealt.select("solute", "solvent", F.col("_own").alias("_p"), F.col("_other").alias("_q"), F.col(group).alias("gi"), *[F.col(x).alias("i_" + x) for x in cols])
    b = dealt.select(F.col("solute").alias("_s"), F.col("solvent").alias("_v"), F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col(group).alias("gj"), *[F.col(x).alias("j_" + x) for x in cols])
    t0, t1 = F.greatest("i_t_min", "j_t_min"), F.least("i_t_max", "j_t_max")
    same = (F.col("solute") == F.col("_s")) & (F.col("solvent") == F.col("_v")) & (F.col("_p") == F.col("_x")) & (F.col("_q") == F.col("_y"))
    on = same & (F.col("gi") < F.col("gj")) & (t1 - t0 >= least_overlap)
    return a.join(b, on).withColumn("t0", t0).withColumn("t1", t1).drop("_s", "_v", "_p", "_q", "_x", "_y")


def _difference(t: Column) -> Column:
    """fit i minus fit j; the shared 1/t and ln t are factored out."""
    c = F.coalesce("i_c", F.lit(0.0)) - F.coalesce("j_c", F.lit(0.0))
    return (F.col("i_a") - F.col("j_a")) + (F.col("i_b") - F.col("j_b")) / t + c * F.log(t)


def atom_deltas(pairs: DataFrame) -> DataFrame:
    """(solute, solvent, gi, gj, t, delta) for each grid point: the largest intermediate, made only when asked for."""
    return pairs.withColumn("t", F.explode(grid(F.col("t0"), F.col("t1")))).select("solute", "solvent", "gi", "gj", "t", _difference(F.col("t")).alias("delta"))


def atom_sums(pairs: DataFrame) -> DataFrame:
    """(solute, solvent, gi, gj, n, sum_abs, sum_squares, most) of the differences at a pair's grid points, summed within its row: no grid row is made."""
    steps = F.floor(F.col("t1") - F.col("t0")).cast("int")
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("m"))

    def added(at: Column, i: Column) -> Column:
        d = F.abs(_difference(F.col("t0") + i))
        return F.struct((at["s"] + d).alias("s"), (at["q"] + d * d).alias("q"), F.greatest(at["m"], d).alias("m"))

    total = pairs.select("solute", "solvent", "gi", "gj", (steps + 1).cast("long").alias("n"), F.aggregate(F.sequence(F.lit(0), steps), zero, added).alias("x"))
    return total.select("solute", "solvent", "gi", "gj", "n", F.col("x.s").alias("sum_abs"), F.col("x.q").alias("sum_squares"), F.col("x.m").alias("most"))


def group_pair_mae(pairs: DataFrame) -> DataFrame:
    """(solute, solvent, gi, gj, n, sum_abs): summed within each row's own grid, so that no grid
    row is ever shuffled or even made: memory and network don't depend on the grid."""
    steps = F.floor(F.col("t1") - F.col("t0")).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), steps), F.lit(0.0), lambda s, i: s + F.abs(_difference(F.col("t0") + i)))
    return pairs.select("solute", "solvent", "gi", "gj", (steps + 1).cast("long").alias("n"), total.alias("sum_abs"))


def pair_mae(group_pairs: DataFrame) -> DataFrame:
    """(solute, solvent): the mean and the largest of the group pairs' means."""
    mean = F.col("sum_abs") / F.col("n")
    return group_pairs.groupBy("solute", "solvent").agg(F.count("*").alias("n_group_pairs"), F.avg(mean).alias("pair_mae"), F.max(mean).alias("pair_mae_max"))


def weighted_group_mae(group_pairs: DataFrame) -> DataFrame:
    """(gi, gj): mean absolute difference over all grid points that two groups share anywhere."""
    return group_pairs.groupBy("gi", "gj").agg(F.sum("n").alias("n_grid"), (F.sum("sum_abs") / F.sum("n")).alias("weighted_mae"))


def merge_groups(edges: DataFrame, nodes: DataFrame, theta: float, node: str = "src") -> DataFrame:
    """(node, component): nodes joined by edges(gi, gj, weighted_mae) below theta, strictly."""
    found = connected_components(edges.where(F.col("weighted_mae") < theta), "gi", "gj").withColumnRenamed("node", node)
    return nodes.select(node).distinct().join(found, node, "left").select(node, F.coalesce("component", node).alias("component"))


def number_by_size(members: DataFrame, component: str = "component", weight: Column | None = None) -> DataFrame:
    """(component, size, gid): dense ids from 0 by falling size, then by component."""
    size = F.sum(weight) if weight is not None else F.count("*")
    sizes = members.groupBy(component).agg(size.alias("size"))
    return global_running(sizes, [F.desc("size"), F.col(component)]).withColumn("gid", F.col("rank") - 1).drop("rank")


def best_representative(fits: DataFrame, group: str) -> DataFrame:
    """The fit of highest r2 for each (solute, solvent, group), the smallest src on ties."""
    w = Window.partitionBy("solute", "solvent", group).orderBy(F.desc_nulls_last("r2"), "src")
    return fits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def leave_one_out_curves(fits: DataFrame, least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """fits with da, db, dc: each fit less the mean of the other fits of its (solute, solvent), as a curve over t0 to t1.

    On the temperatures common to all groups of a (solute, solvent) with 2 groups at least. Curves are linear in their
    coefficients, so the mean of the others is the sum of coefficients less the own ones: one aggregate, without grid rows or a self-join.
    """
    key = ["solute", "solvent"]
    c = F.coalesce("c", F.lit(0.0))
    sums = fits.groupBy(*key).agg(F.count("*").alias("k"), F.max("t_min").alias("t0"), F.min("t_max").alias("t1"), F.sum("a").alias("_a"), F.sum("b").alias("_b"), F.sum(c).alias("_c"))
    joined = fits.join(sums.where((F.col("k") >= 2) & (F.col("t1") - F.col("t0") >= least_overlap)), key)
    return joined.withColumns(_from_others(F.col("_a"), F.col("_b"), F.col("_c"), F.col("k"))).drop("_a", "_b", "_c")


def _from_others(a: Column, b: Column, c: Column, k: Column) -> dict[str, Column]:
    own = {"a": F.col("a"), "b": F.col("b"), "c": F.coalesce("c", F.lit(0.0))}
    return {f"d{x}": own[x] - (total - own[x]) / (k - 1) for x, total in (("a", a), ("b", b), ("c", c))}


def _deviation(t: Column) -> Column:
    return F.abs(F.col("da") + F.col("db") / t + F.col("dc") * F.log(t))


def _grid_sums() -> tuple[Column, Column]:
    """How many grid points of 1 K lie in t0 to t1, and the sum of the deviations there."""
    steps = F.floor(F.col("t1") - F.col("t0")).cast("int")
    return (steps + 1).cast("long"), F.aggregate(F.sequence(F.lit(0), steps), F.lit(0.0), lambda s, i: s + _deviation(F.col("t0") + i))


def leave_one_out(fits: DataFrame, group: str = "src", least_overlap: float = LEAST_OVERLAP) -> DataFrame:
    """(group, dev): how far each group lies from the mean of the others, a row for each grid point, made only when asked for."""
    return leave_one_out_curves(fits, least_overlap).withColumn("t", F.explode(grid(F.col("t0"), F.col("t1")))).select(group, _deviation(F.col("t")).alias("dev"))


def source_reliability(fits: DataFrame, members: DataFrame, group: str = "src", threshold: float = 0.6) -> DataFrame:
    """For each group of members(group): deviation from the leave-one-out consensus; null where untested.

    flagged: a mean deviation of the threshold or more.
    """
    dev = cut(leave_one_out(fits, group))
    stats = dev.groupBy(group).agg(F.count("*").alias("n_grid"), F.avg("dev").alias("mean_dev"), F.max("dev").alias("max_dev"))
    out = members.select(group).distinct().join(with_quantiles(stats, dev, [group], "dev", {"median_dev": 0.5}), group, "left")
    return out.select(group, F.coalesce("n_grid", F.lit(0)).cast("long").alias("n_grid"), "mean_dev", "median_dev", "max_dev", F.coalesce(F.col("mean_dev") >= threshold, F.lit(False)).alias("flagged"))


def group_deviation(fits: DataFrame, members: DataFrame, group: str = "src", threshold: float = 0.6) -> DataFrame:
    """source_reliability without median and maximum: sums within each fit's own grid, so no grid row is made, written or sorted."""
    n, total = _grid_sums()
    sums = leave_one_out_curves(fits).select(group, n.alias("n"), total.alias("d")).groupBy(group).agg(F.sum("n").alias("n_grid"), (F.sum("d") / F.sum("n")).alias("mean_dev"))
    out = members.select(group).distinct().join(sums, group, "left")
    return out.select(group, F.coalesce("n_grid", F.lit(0)).cast("long").alias("n_grid"), "mean_dev", F.coalesce(F.col("mean_dev") >= threshold, F.lit(False)).alias("flagged"))


def exclusion_reasons(fits: DataFrame, good: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many (solute, solvent) are compared, or why not."""
    every = fits.groupBy("solute", "solvent").agg(F.count("*").alias("n_groups"))
    kept = good.groupBy("solute", "solvent").agg(F.count("*").alias("n_usable"))
    made = pairs.groupBy("solute", "solvent").agg(F.count("*").alias("n_pairs"))
    joined = every.join(kept, ["solute", "solvent"], "left").join(made, ["solute", "solvent"], "left")
    reason = F.when(F.coalesce("n_usable", F.lit(0)) < 2, "fewer_than_2_usable").when(F.coalesce("n_pairs", F.lit(0)) == 0, "no_overlap").otherwise("compared")
    return joined.groupBy(reason.alias("reason")).agg(F.count("*").alias("n_pairs"))


def group_pair_tally(fits: DataFrame, good: DataFrame, pairs: DataFrame) -> DataFrame:
    """(reason, n_group_pairs): how many pairs of groups of one (solute, solvent) are compared, or why not."""
    of = lambda df: df.groupBy("solute", "solvent").agg(F.count("*").alias("g")).agg(F.coalesce(F.sum(F.col("g") * (F.col("g") - 1) / 2), F.lit(0)).cast("long").alias("n"))
    every, usable, made = of(fits), of(good), pairs.agg(F.count("*").alias("n"))
    both = every.select(F.col("n").alias("e")).crossJoin(F.broadcast(usable.select(F.col("n").alias("u")))).crossJoin(F.broadcast(made.select(F.col("n").alias("m"))))  # one row each
    parts = F.array(*[F.struct(F.lit(k).alias("reason"), c.alias("n_group_pairs")) for k, c in (("unusable_fit", F.col("e") - F.col("u")), ("overlap_too_short", F.col("u") - F.col("m")), ("compared", F.col("m")))])
    return both.select(F.explode(parts).alias("r")).select("r.*")


def group_fits(fits: DataFrame, members: DataFrame) -> DataFrame:
    """Fits of final groups: the best fit of each (solute, solvent, component) of members(src, component)."""
    return best_representative(fits.join(members, "src"), "component")


def pair_agreement(fits: DataFrame, good: DataFrame, flagged: DataFrame, group: str) -> DataFrame:
    """(solute, solvent): pair_mae with the groups there are, the usable and compared ones, and any_flagged.

    flagged(group) are groups that don't agree with the others anywhere; any_flagged tells whether a compared pair has one.
    """
    pairs = fit_pairs(good, group)
    by_pair = pair_mae(group_pair_mae(pairs))
    ends = pairs.select("solute", "solvent", F.explode(F.array("gi", "gj")).alias(group)).distinct()
    marked = ends.join(flagged.select(group), group, "left_semi").select("solute", "solvent").distinct().withColumn("any_flagged", F.lit(True))
    count = lambda df, name: df.groupBy("solute", "solvent").agg(F.countDistinct(group).alias(name))
    out = by_pair.join(count(fits, "n_groups"), ["solute", "solvent"]).join(count(good, "n_usable"), ["solute", "solvent"]).join(marked, ["solute", "solvent"], "left")
    return out.withColumn("any_flagged", F.coalesce("any_flagged", F.lit(False)))


def representatives_until(fits: DataFrame, labels: DataFrame) -> DataFrame:
    """(solute, solvent, src, until): up to which threshold (a place in labels' components) each fit is its final group's best.

    Components only grow with the threshold, so a fit is the best of its group for the first thresholds or for none.
    """
    best = F.min(F.struct(F.negative("r2").alias("r"), "src"))["src"].alias("src")
    placed = fits.select("solute", "solvent", "r2", "src").join(labels, "src").select("solute", "solvent", "r2", "src", F.posexplode("components").alias("k", "component"))
    kept = placed.groupBy("solute", "solvent", "k", "component").agg(best)
    return kept.groupBy("solute", "solvent", "src").agg((F.max("k") + 1).alias("until"))


def theta_sweep(fits: DataFrame, pairs: DataFrame, nodes: DataFrame, thetas: list[float], threshold: float = 0.6) -> DataFrame:
    """For each theta: the final groups it makes, those flagged, and the agreement of pairs without the flagged ones.

    fits: of the groups src that the sweep starts from; pairs: their group_pair_mae; nodes(src): all of them. Columns: theta,
    n_final_groups, largest (in starting groups), n_flagged, n_pairs, and of the pairs' mean absolute differences mean, p90, median and rmse.

    One spanning forest of the groups' weighted differences gives the components at every theta. A fit is a final group's representative up to one
    threshold, and two fits differ by the same at each, so no fit and no pair of fits is made anew for a theta: a pair counts where both
    are representatives and neither is flagged.
    """
    thetas, key = sorted(set(map(float, thetas))), ["solute", "solvent"]
    pairs = cut(pairs)
    forest = minimum_spanning_forest(weighted_group_mae(pairs), "gi", "gj", "weighted_mae")
    labels = cut(components_at(forest, nodes, thetas, "src"))
    each = cut(fits.select(*key, "src", "a", "b", "c", "t_min", "t_max", "r2").join(representatives_until(fits, labels), [*key, "src"]))

    c = F.coalesce("c", F.lit(0.0))
    by_end = each.groupBy(*key, "until").agg(F.count("*").alias("n"), F.max("t_min").alias("t0"), F.min("t_max").alias("t1"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum(c).alias("sc"))
    at = by_end.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("until") - 1))).groupBy(*key, "k")
    at = at.agg(F.sum("n").alias("n"), F.max("t0").alias("t0"), F.min("t1").alias("t1"), F.sum("sa").alias("sa"), F.sum("sb").alias("sb"), F.sum("sc").alias("sc"))
    at = at.where((F.col("n") >= 2) & (F.col("t1") - F.col("t0") >= LEAST_OVERLAP)).groupBy(*key).agg(F.collect_list(F.struct("k", "n", "t0", "t1", "sa", "sb", "sc")).alias("s"))  # an entry for each theta
    tested = each.join(at, key).withColumn("s", F.explode(F.filter("s", lambda s: s["k"] < F.col("until")))).select("src", "a", "b", "c", "s.*")
    tested = tested.withColumns(_from_others(F.col("sa"), F.col("sb"), F.col("sc"), F.col("n")))
    n, total = _grid_sums()
    sums = tested.select("src", "k", n.alias("n"), total.alias("d")).groupBy("src", "k").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    placed = labels.select("src", F.posexplode("components").alias("k", "component"))
    flagged = sums.join(placed, ["src", "k"]).groupBy("k", "component").agg((F.sum("d") / F.sum("n")).alias("d")).where(F.col("d") >= threshold).select("k", "component")
    flagged = cut(flagged)
    out_of = placed.join(flagged, ["k", "component"], "left_semi").groupBy("src").agg(F.collect_set("k").alias("out"))  # an entry for each theta

    counted = F.array_except(F.sequence(F.lit(0), F.col("until") - 1), F.coalesce("out", F.array().cast("array<int>")))
    usable = each.join(out_of, "src", "left").select(*key, "src", counted.alias("ks"))
    both = pairs.select(*key, "gi", "gj", (F.col("sum_abs") / F.col("n")).alias("e"))
    for end in ("i", "j"):
        both = both.join(usable.withColumnsRenamed({"src": f"g{end}", "ks": f"ks_{end}"}), [*key, f"g{end}"])
    mae = cut(both.select(*key, "e", F.explode(F.array_intersect("ks_i", "ks_j")).alias("k")).groupBy(*key, "k").agg(F.avg("e").alias("pair_mae")))
    stats = mae.groupBy("k").agg(F.count("*").alias("n_pairs"), F.avg("pair_mae").alias("mean"), F.sqrt(F.avg(F.col("pair_mae") * F.col("pair_mae"))).alias("rmse"))
    stats = with_quantiles(stats, mae, ["k"], "pair_mae", {"median": 0.5, "p90": 0.9})
    sizes = placed.groupBy("k", "component").agg(F.count("*").alias("size")).groupBy("k").agg(F.count("*").alias("n_final_groups"), F.max("size").alias("largest"))
    out = sizes.join(stats, "k", "left").join(flagged.groupBy("k").agg(F.count("*").alias("n_flagged")), "k", "left")
    zero = F.lit(0).cast("long")
    theta = F.element_at(F.array(*map(F.lit, thetas)), F.col("k") + 1).alias("theta")
    return out.select(theta, "n_final_groups", "largest", F.coalesce("n_flagged", zero).alias("n_flagged"), F.coalesce("n_pairs", zero).alias("n_pairs"), "mean", "p90", "median", "rmse")


def bit_exact_groups(rows: DataFrame, member: str, key: list[str]) -> DataFrame:
    """(member, component): members that share any exact key are one group, over chains too.

    Every member of a key is linked to the key's smallest member, a star instead of all pairs;
    the smallest comes from a map-side combined aggregate joined back, so a hot key needs no
    task of its own.
    """
    keyed = rows.dropna(subset=[member, *key]).select(*key, F.col(member).alias("_m")).distinct()
    least = keyed.groupBy(*key).agg(F.min("_m").alias("_least"))
    star = keyed.join(least, key).select(F.col("_least").alias("a"), F.col("_m").alias("b"))
    found = connected_components(cut(star.where("a <> b").distinct())).withColumnRenamed("node", member)
    return rows.select(member).where(F.col(member).isNotNull()).distinct().join(found, member, "left").select(member, F.coalesce("component", member).alias("component"))
