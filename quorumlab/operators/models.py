"""Analytical and tree models, standardisation and feature filters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quorumlab.session import cut


def ridge_1d(rows: DataFrame, group: str, x: str, y: str, ridge: float = 1.0, least_rows: int = 30) -> DataFrame:
    """(group, slope, intercept, n) by closed form, only for groups of least_rows or more; the row of a null group is the fallback over all."""
    clean = rows.dropna(subset=[x, y])

    def solve(df: DataFrame, by: list[str]) -> DataFrame:
        out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.var_pop(x) * F.count("*")).alias("sxx"), (F.covar_pop(x, y) * F.count("*")).alias("sxy"))
        slope = F.col("sxy") / (F.col("sxx") + ridge)
        return out.select(*by, slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"), "n")

    own = solve(clean.where(F.col(group).isNotNull()), [group]).where(F.col("n") >= least_rows)
    every = solve(clean, []).select(F.lit(None).cast("string").alias(group), "slope", "intercept", "n")
    return own.unionByName(every)


def ridge_predict(rows: DataFrame, models: DataFrame, group: str, x: str) -> DataFrame:
    """rows with y_pred by the own group's model or else the fallback."""
    own = models.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    every = models.where(F.col(group).isNull()).select(F.col("slope").alias("_fs"), F.col("intercept").alias("_fi"))
    out = rows.join(own, F.col(group) == F.col("_g"), "left").crossJoin(F.broadcast(every))  # one row
    return out.withColumn("y_pred", F.coalesce(F.col("_s") * F.col(x) + F.col("_i"), F.col("_fs") * F.col(x) + F.col("_fi"))).drop("_g", "_s", "_i", "_fs", "_fi")


def ridge_by_group(rows: DataFrame, group: str, features: list[str], y: str, ridge: float, least_rows: int) -> DataFrame:
    """(group, n, coefficients, intercept) with any number of features and an intercept that isn't shrunk.

    Groups of least_rows or more have a row each; the row of a null group is the fallback over all rows. Moments are those
    of deviations from the mean (covar_pop merges them so), never raw products, which lose all digits where the mean is
    far from 0. They are d squared numbers for each group, so a hot group needs no task of its own; only these small
    matrices are solved in NumPy.
    """
    clean = rows.dropna(subset=[y, *features])
    d = len(features)
    moments = [F.covar_pop(a, b).alias(f"_{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
    moments += [F.covar_pop(a, y).alias(f"_y{i}") for i, a in enumerate(features)] + [F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)]
    kind = dict(rows.dtypes)[group]
    own = clean.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("_my"), *moments).where(F.col("n") >= least_rows)
    every = clean.agg(F.count("*").alias("n"), F.avg(y).alias("_my"), *moments).where("n > 0").withColumn(group, F.lit(None).cast(kind))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for r in g.to_dict("records"):
                n, m = r["n"], np.array([r[f"_m{i}"] for i in range(d)])
                xx = n * np.array([[r[f"_{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
                beta = np.linalg.solve(xx + ridge * np.eye(d), n * np.array([r[f"_y{i}"] for i in range(d)]))
                out.append({group: r[group], "n": n, "coefficients": beta.tolist(), "intercept": float(r["_my"] - beta @ m)})
            yield pd.DataFrame(out, columns=[group, "n", "coefficients", "intercept"])

    return own.unionByName(every).mapInPandas(solve, f"{group} {kind}, n long, coefficients array<double>, intercept double")


def ridge_predict_by_group(rows: DataFrame, models: DataFrame, group: str, features: list[str]) -> DataFrame:
    """rows with y_pred by the own group's coefficients or else the fallback's; null where a feature is null."""
    x = F.array(*[F.col(f).cast("double") for f in features])
    value = lambda c, i: F.aggregate(F.zip_with(F.col(c), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.col(i)
    own = models.where(F.col(group).isNotNull()).select(F.col(group).alias("_g"), F.col("coefficients").alias("_c"), F.col("intercept").alias("_i"))
    every = models.where(F.col(group).isNull()).select(F.col("coefficients").alias("_fc"), F.col("intercept").alias("_fi"))
    out = rows.join(own, F.col(group) == F.col("_g"), "left").crossJoin(F.broadcast(every))  # one row
    return out.withColumn("y_pred", F.coalesce(value("_c", "_i"), value("_fc", "_fi"))).drop("_g", "_c", "_i", "_fc", "_fi")


def standardize(rows: DataFrame, columns: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (population deviation + 1e-8); columns that hardly vary (below 1e-3) stay as they are."""
    stats = (fit_on if fit_on is not None else rows).agg(*[F.avg(c).alias("m_" + c) for c in columns], *[F.stddev_pop(c).alias("s_" + c) for c in columns])
    out = rows.crossJoin(F.broadcast(stats))  # one row
    return out.withColumns({c: F.when(F.col("s_" + c) < 1e-3, F.col(c)).otherwise((F.col(c) - F.col("m_" + c)) / (F.col("s_" + c) + 1e-8)) for c in columns}).drop(*["m_" + c for c in columns], *["s_" + c for c in columns])


def weighted_spread(rows: DataFrame, columns: list[str], weight: str) -> tuple[np.ndarray, np.ndarray]:
    """Population variances of the columns and their correlations, where each row counts `weight` times; rows with a null are left out of both."""
    rows = rows.dropna(subset=[weight, *columns])
    total = rows.agg(F.sum(weight).alias("w"), *[(F.sum(F.col(weight) * F.col(c)) / F.sum(weight)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    off = [F.col(c) - F.lit(total[f"m{i}"]) for i, c in enumerate(columns)]  # deviations, as raw products lose all digits
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    found = rows.agg(*[F.sum(F.col(weight) * off[i] * off[j]).alias(f"{i}_{j}") for i, j in pairs]).first()
    moments = np.array([[found[f"{min(i, j)}_{max(i, j)}"] for j in range(len(columns))] for i in range(len(columns))], dtype=float) / float(total["w"] or np.nan)
    deviation = np.sqrt(np.diag(moments))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.diag(moments), moments / np.outer(deviation, deviation)


def select_features(rows: DataFrame, columns: list[str], least_variance: float = 0.0, most_correlation: float = 0.95, weight: str | None = None) -> list[str]:
    """Columns above the variance, without the later one of any pair that correlates beyond the cut; with weight a row counts so many times."""
    if weight:
        variances, r = weighted_spread(rows, columns, weight)
        kept: list[int] = []
        for j in range(len(columns)):
            if variances[j] > least_variance and not any(abs(r[i, j]) > most_correlation for i in kept):
                kept.append(j)
        return [columns[j] for j in kept]
    v = rows.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    kept = [c for c in columns if v[c] is not None and v[c] > least_variance]
    if len(kept) < 2:
        return kept
    table = VectorAssembler(inputCols=kept, outputCol="_v", handleInvalid="skip").transform(rows).select("_v")
    r = np.abs(Correlation.corr(table, "_v").first()[0].toArray())
    dropped: set[int] = set()
    for i in range(len(kept)):
        if i not in dropped:
            dropped |= {j for j in range(i + 1, len(kept)) if j not in dropped and r[i, j] > most_correlation}
    return [c for i, c in enumerate(kept) if i not in dropped]


TREES = {
    "gradient_boosting": lambda seed, p: GBTRegressor(featuresCol="_v", labelCol="y", predictionCol="y_pred", seed=seed, **({"maxIter": 20, "maxDepth": 4} | p)),
    "random_forest": lambda seed, p: RandomForestRegressor(featuresCol="_v", labelCol="y", predictionCol="y_pred", seed=seed, **({"numTrees": 20, "maxDepth": 6} | p)),
    "decision_tree": lambda seed, p: DecisionTreeRegressor(featuresCol="_v", labelCol="y", predictionCol="y_pred", seed=seed, **({"maxDepth": 6} | p)),
}


#: Trees of a forest if its parameters don't say otherwise, and those of a resampled one that are trained at once.
FOREST, TREES_AT_ONCE = 20, 4


def condensed(rows: DataFrame, by: list[str], resamples: int = 0, seed: int = 42) -> DataFrame:
    """A row for each distinct value of by: n (its rows), w (those with a label y), y (their mean), spread (the sum of squares of deviations from it).

    Where by has all that features are made of, trees trained on these rows with w as weight are those of the rows themselves: what a split
    gains depends on counts and sums of labels on both sides, and so does what is left over after a stage of boosting. Training then
    grows with the distinct features instead of the rows, which are read once.

    resamples adds w0, y0, ...: the number of rows in each resample, and the mean there. A row is in it as often as a Poisson variable of mean 1 says,
    which is how Spark's forests draw from single rows.
    """
    most = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(13)]  # P(at most n); beyond lies 1e-10
    names = [f"_u{i}" for i in range(resamples)]
    # Seeds lie apart, as a partition's generator is seeded by the sum of seed and place.
    drawn = rows.select(*by, F.col("y").cast("double").alias("y"), *[F.rand(seed + 1_000_003 * i).alias(u) for i, u in enumerate(names)])
    aggregates = [F.count("*").alias("n"), F.count("y").alias("w"), F.avg("y").alias("y"), (F.var_pop("y") * F.count("y")).alias("spread")]
    for i, u in enumerate(names):
        times = F.expr("CASE WHEN y IS NULL THEN NULL " + " ".join(f"WHEN {u} < {p!r}D THEN {k}D" for k, p in enumerate(most)) + f" ELSE {len(most)}D END")
        aggregates += [F.sum(times).alias(f"w{i}"), F.sum(times * F.col("y")).alias(f"y{i}")]
    out = drawn.groupBy(*by).agg(*aggregates)
    return out.withColumns({f"y{i}": F.when(F.col(f"w{i}") > 0, F.col(f"y{i}") / F.col(f"w{i}")) for i in range(resamples)})


def made_of(spark: SparkSession, kind: type, like, trees: list, weights: list[float] | None = None):
    """A model of that kind of trees in the JVM, with their weights where it has such, and with the columns of `like`."""
    gateway = spark.sparkContext._gateway
    kinds = gateway.jvm.org.apache.spark.ml.regression
    kept = gateway.new_array(kinds.DecisionTreeRegressionModel, len(trees))
    for i, tree in enumerate(trees):
        kept[i] = tree
    more = []
    if weights is not None:
        more = [gateway.new_array(gateway.jvm.double, len(trees))]
        for i, w in enumerate(weights):
            more[0][i] = w
    model = kind(getattr(kinds, kind.__name__)(like.uid, kept, *more, like.numFeatures))
    model._java_obj.setFeaturesCol(like.getFeaturesCol()).setPredictionCol(like.getPredictionCol())
    model._transfer_params_from_java()
    if model.hasParam("numTrees"):  # a forest's predictions are divided by it
        model._set(numTrees=len(trees))
        model._transfer_params_to_java()
    return model


def fit_forest(rows: DataFrame, seed: int, **params) -> RandomForestRegressionModel:
    """A forest over condensed rows with resamples: tree i is trained on resample i, several at once."""
    params = {"maxDepth": 6} | params
    n = params.pop("numTrees", FOREST)
    if params.get("featureSubsetStrategy", "auto") == "auto":
        params["featureSubsetStrategy"] = "onethird" if n > 1 else "all"  # what auto is for a forest of n, not for one of a single tree

    @inheritable_thread_target(rows.sparkSession)
    def one(i: int) -> RandomForestRegressionModel:
        tree = RandomForestRegressor(featuresCol="_v", labelCol=f"y{i}", weightCol=f"w{i}", predictionCol="y_pred", seed=seed + i, numTrees=1, bootstrap=False, **params)
        return tree.fit(rows.where(F.col(f"w{i}") > 0))

    with ThreadPoolExecutor(max_workers=TREES_AT_ONCE) as threads:
        found = list(threads.map(one, range(n)))
    return made_of(rows.sparkSession, RandomForestRegressionModel, found[0], [m._java_obj.trees()[0] for m in found])


def fit_trees(name: str, train: DataFrame, columns: list[str], seed: int = 42, filtered: bool = False, weight: str | None = None, **params):
    """A fitted pipeline of a tree regressor; filtered first drops flat and correlated columns.

    With weight, train has condensed rows, each of which counts so many times; a random forest then needs a resample for each tree.
    """
    if weight:
        train = train.where(F.col(weight) > 0)
    if filtered:
        columns = select_features(train, columns, weight=weight)
    assembler = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="skip")
    if weight and name == "random_forest":
        return PipelineModel([assembler, fit_forest(assembler.transform(train), seed, **params)])
    return Pipeline(stages=[assembler, TREES[name](seed, params | ({"weightCol": weight} if weight else {}))]).fit(train)


def stop_early(model: PipelineModel, held: DataFrame, patience: int = 50, spread: str | None = None) -> tuple[PipelineModel, list[float]]:
    """A fitted pipeline of boosted trees cut after its best stage on held rows, and the squared error there after each stage that counts.

    The best stage has the least error, the first one on ties; stages beyond `patience` without a better one don't count. One
    pass over the held rows gives the errors of all stages; without held rows the model stays whole. Held rows of a model with
    weights are condensed, too; spread names what their labels' squared deviations sum up to, and is part of the error.
    """
    assembler, boosted = model.stages
    weight = boosted.getWeightCol() if boosted.isDefined(boosted.weightCol) else None
    held = held.dropna(subset=[*assembler.getInputCols(), "y"])
    rows = assembler.transform(held.where(F.col(weight) > 0) if weight else held)
    losses, best = (boosted.evaluateEachIteration(rows, "squared") if rows.limit(1).count() else []), 0
    if losses and spread:
        within = rows.agg((F.sum(spread) / F.sum(weight if weight else F.lit(1))).alias("s")).first()["s"]
        losses = [x + within for x in losses]
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            losses = losses[: i + 1]
            break
    if not losses:
        return model, []
    trees = boosted._java_obj.trees()
    return PipelineModel([assembler, made_of(held.sparkSession, GBTRegressionModel, boosted, [trees[i] for i in range(best + 1)], boosted.treeWeights[: best + 1])]), losses


def load_or_fit(path: str, force: bool, fit):
    """A saved pipeline, or a fitted one that is saved for the next time."""
    from py4j.protocol import Py4JError
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return PipelineModel.load(path)
        except (AnalysisException, Py4JError, ValueError):
            pass
    model = fit()
    model.write().overwrite().save(path)
    return model


def tanimoto(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tanimoto similarity of each row of a with each of b; two zero rows are alike."""
    dot = a @ b.T
    total = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - dot
    return np.where(total > 0, dot / np.where(total > 0, total, 1), 1.0)


def fit_tanimoto_process(train: DataFrame, features: str, y: str, key: str, most: int = 3000, noise: float = 0.1, seed: int = 42):
    """A Gaussian process with a Tanimoto kernel on at most `most` rows, drawn in the order of a seeded hash.

    Gives predict(df) -> df with y_pred, which scores any number of rows in Arrow batches; a null
    vector predicts the mean.
    """
    from quorumlab.operators.splits import draw

    rows = train.select(F.col(features).alias("x"), F.col(y).cast("double").alias("y"), F.col(key).cast("string").alias("k")).dropna()
    sample = rows.orderBy(draw(seed, F.col("k")), "k").limit(most).toPandas()
    x, target = np.array(sample["x"].tolist(), np.float64), sample["y"].to_numpy()
    mean = float(target.mean())
    weights = np.linalg.solve(tanimoto(x, x) + noise * np.eye(len(x)), target - mean)

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.full(len(v), mean)
        known = v.notna().to_numpy()
        if known.any():
            out[known] += tanimoto(np.array(v[known].tolist(), np.float64), x) @ weights
        return pd.Series(out)

    return lambda df: df.withColumn("y_pred", score(features))


def gradient_targets(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, t, y, g): second-order slopes of y over t as numpy.gradient gives them, kept if 0 < g < 1, else null."""
    w = Window.partitionBy(*key).orderBy("t")
    pts = rows.dropna(subset=[*key, "t", "y"]).groupBy(*key, "t").agg(F.avg("y").alias("y"))
    lag, lead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    pts = pts.select("*", (F.col("t") - lag("t")).alias("h0"), (lead("t") - F.col("t")).alias("h1"), (F.col("y") - lag("y")).alias("d0"), (lead("y") - F.col("y")).alias("d1"))
    h0, h1 = F.col("h0"), F.col("h1")
    inner = (h0 * h0 * F.col("d1") + h1 * h1 * F.col("d0")) / (h0 * h1 * (h0 + h1))
    g = F.coalesce(inner, F.col("d1") / h1, F.col("d0") / h0)
    return pts.select(*key, "t", "y", F.when((g > 0) & (g < 1), g).alias("g"))


#: Distinct values whose draws are made at once, and resamples.
VALUES_AT_ONCE, RESAMPLES_AT_ONCE = 1024, 500


def bootstrap_sums(rows: DataFrame, value: str, resamples: int = 5000, seed: int = 42) -> DataFrame:
    """(rep, s, w): for each resample the sum of its values, and its size, which is the number of values.

    Equal values are counted first and range partitioned. How many of a resample's draws fall into a range follows from a tree of
    conditional binomials over the ranges' sizes: a node's draws come from a generator of its own, so each task walks from the root to its range and all
    agree. Inside, the draws are dealt on in the same way to stretches of values, and to the values of a stretch, for all resamples at once. Tasks send back a row of two
    numbers for each resample, whatever the size of the table. Nulls are left out; no values give no rows.
    """
    counts = rows.select(F.col(value).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    ranged = cut(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("_range", F.spark_partition_id()))
    found = sorted(map(tuple, ranged.groupBy("_range").agg(F.sum("c")).collect()))  # a row for each range
    place = {r: i for i, (r, _) in enumerate(found)}
    ends = np.cumsum([0, *(n for _, n in found)])

    def of_range(i: int) -> np.ndarray:
        draws, lo, hi = np.full(resamples, ends[-1]), 0, len(found)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            left = np.random.default_rng([seed, lo, hi]).binomial(draws, (ends[mid] - ends[lo]) / (ends[hi] - ends[lo]))
            draws, lo, hi = (left, lo, mid) if i < mid else (draws - left, mid, hi)
        return draws

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = left = None
        for g in batches:
            for at in range(0, len(g), VALUES_AT_ONCE):
                some = g.iloc[at : at + VALUES_AT_ONCE]
                if sums is None:
                    i = place[int(some["_range"].iloc[0])]
                    sums, left, size = np.zeros((2, resamples)), of_range(i), int(ends[i + 1] - ends[i])
                    rng = np.random.default_rng([seed, i, len(found), 1])
                v, c = some["v"].to_numpy(np.float64), some["c"].to_numpy(np.int64)
                mine = rng.binomial(left, c.sum() / size)
                left, size = left - mine, size - int(c.sum())
                for r in range(0, resamples, RESAMPLES_AT_ONCE):
                    dealt = rng.multinomial(mine[r : r + RESAMPLES_AT_ONCE], c / c.sum())
                    sums[0, r : r + RESAMPLES_AT_ONCE] += dealt @ v
                    sums[1, r : r + RESAMPLES_AT_ONCE] += dealt.sum(1)
        if sums is not None:
            yield pd.DataFrame({"rep": np.arange(resamples), "s": sums[0], "w": sums[1].astype(np.int64)})

    return ranged.mapInPandas(draw, "rep int, s double, w long").groupBy("rep").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def bootstrap_mean_ci(rows: DataFrame, value: str, resamples: int = 5000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(n, mean, low, high): percentile interval of the mean over resamples of the table's size; nulls are left out."""
    every = rows.agg(F.count(value).alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    means = bootstrap_sums(rows, value, resamples, seed).select((F.col("s") / F.col("w")).alias("m"))
    ends = means.agg(F.expr(f"percentile(m, array({alpha / 2}, {1 - alpha / 2}))").alias("p"))  # a row for each resample
    return every.crossJoin(F.broadcast(ends)).select("n", "mean", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))


def digamma(x: float) -> float:
    total = 0.0
    while x < 6:
        total -= 1 / x
        x += 1
    f = 1 / (x * x)
    return total + math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def lower_gamma(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def lower_gamma_of(a: float, x: np.ndarray) -> np.ndarray:
    """lower_gamma of many x at once: the series below a + 1, the continued fraction above."""
    out = np.zeros(len(x))
    small = (x > 0) & (x < a + 1)
    if small.any():
        u, n = x[small], a
        term = total = np.full(len(u), 1 / a)
        while (np.abs(term) > np.abs(total) * 1e-15).any():
            n += 1
            term = term * u / n
            total = total + term
        out[small] = total * np.exp(-u + a * np.log(u) - math.lgamma(a))
    if (large := x >= a + 1).any():
        u = x[large]
        b, c = u + 1 - a, np.full(len(u), 1e300)
        d = h = 1 / b
        for i in range(1, 500):
            an = -i * (i - a)
            b = b + 2
            d = 1 / (an * d + b)
            c = b + an / c
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-15).all():
                break
        out[large] = 1 - np.exp(-u + a * np.log(u) - math.lgamma(a)) * h
    return out


def gamma_fit(rows: DataFrame, value: str, least: int = 100) -> DataFrame:
    """(n, shape, scale, ks): maximum likelihood with location 0 and the Kolmogorov-Smirnov distance; null below `least` positive values.

    The likelihood needs only the mean and the mean log; the distance is a maximum over ranks that
    a range partitioned order with the partitions' counts gives without a single sorted task.
    """
    v = rows.select(F.col(value).cast("double").alias("v")).where("v > 0")
    s = v.agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.avg(F.log("v")).alias("l")).first()
    spark = rows.sparkSession
    schema = "n long, shape double, scale double, ks double"
    gap = math.log(s["m"]) - s["l"] if s["n"] else 0.0
    if s["n"] <= least or gap <= 0:
        return spark.createDataFrame([(s["n"], None, None, None)], schema)
    k = (3 - gap + math.sqrt((gap - 3) ** 2 + 24 * gap)) / (12 * gap)
    for _ in range(50):
        e = 1e-5 * k
        slope = 1 / k - (digamma(k + e) - digamma(k - e)) / (2 * e)
        k -= (math.log(k) - digamma(k) - gap) / slope
    scale, n = s["m"] / k, s["n"]
    # Ranks: a count for each value, then a running sum within value ranges after the ranges before.
    counts = v.groupBy("v").agg(F.count("*").alias("c"))
    edges = v.stat.approxQuantile("v", [i / 64 for i in range(1, 64)], 0.01)
    part = sum((F.when(F.col("v") > e, 1).otherwise(0) for e in sorted(set(edges))), F.lit(0))
    counts = counts.withColumn("part", part)
    before = counts.groupBy("part").agg(F.sum("c").alias("pc")).select("part", (F.sum("pc").over(Window.orderBy("part")) - F.col("pc")).alias("pb"))
    w = Window.partitionBy("part").orderBy("v")
    ranked = counts.join(F.broadcast(before), "part").select("v", (F.col("pb") + F.sum("c").over(w)).alias("hi"), "c")

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        return pd.Series(lower_gamma_of(k, x.to_numpy(np.float64) / scale))

    d = ranked.withColumn("f", cdf("v")).agg(F.max(F.greatest(F.col("hi") / n - F.col("f"), F.col("f") - (F.col("hi") - F.col("c")) / n)).alias("ks"))
    return d.select(F.lit(n).cast("long").alias("n"), F.lit(k).alias("shape"), F.lit(scale).alias("scale"), "ks")


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F > f) by the incomplete beta function."""
    if f <= 0:
        return 1.0
    x, a, b = d2 / (d2 + d1 * f), d2 / 2, d1 / 2
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    flip = x >= (a + 1) / (a + b + 2)
    p, q, z = (b, a, 1 - x) if flip else (a, b, x)
    c, d = 1.0, 1 / (1 - (p + q) * z / (p + 1) or 1e-30)
    h = d
    for m in range(1, 500):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-30)
            c = (1 + num / c) or 1e-30
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    part = front * h / p
    return 1 - part if flip else part


def anova_p_value(table: DataFrame, f: str, d1: Column, d2: Column) -> DataFrame:
    """table with p_value of its F and degrees of freedom."""

    @F.pandas_udf("double")
    def p(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(u) else f_survival(u, v, w) for u, v, w in zip(x, a, b, strict=True)], dtype=float)

    return table.withColumn("p_value", p(F.col(f), d1.cast("double"), d2.cast("double")))
