"""Toxicity by non-negative positive-unlabelled learning on words and beginnings of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlab.llm.workers import release_kept
from quorumlab.session import cut

#: Bounds on the sample that is fitted: documents marked toxic, and unlabelled ones.
MOST_POSITIVE = 2000
MOST_UNLABELLED = 6000
#: Features that the classifier looks at, at most.
MOST_FEATURES = 2000
#: How many standard deviations a feature's share among toxic texts lies above that among all.
CONTRAST = 5.0
#: Distinct toxic texts that have such a feature, at least.
LEAST_TEXTS = 4
#: The smallest and largest class prior.
PRIOR_RANGE = (0.005, 0.6)
#: A feature is a word, or a beginning of words, that occurs this often at least.
LEVELS = (1, 2, 4)
BEGINNINGS = (4, 5, 6, 7)
#: Words remembered by a worker before it starts anew.
MEMO_WORDS = 200_000

_WORD = re.compile(r"\w+")


def stems(word: str) -> list[str]:
    """The word itself, marked as whole, and its beginnings."""
    return [word + "$", *[word[:k] for k in BEGINNINGS if len(word) > k]]


def features(text: str | None) -> list[str]:
    """All features of a whole text: each stem of its lower-cased words with each level it reaches."""
    counts: Counter[str] = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for stem in stems(word):
            counts[stem] += n
    return [f"{stem}|{level}" for stem, n in counts.items() for level in LEVELS if n >= level]


class FeatureFinder:
    """Finds a few given features in texts, remembering which words lead to any."""

    def __init__(self, names: list[str]) -> None:
        self.number = {x: i for i, x in enumerate(names)}
        self.wanted = {x.rpartition("|")[0] for x in names}
        self.hits: dict[str, list[str]] = {}
        self.seen: set[str] = set()

    def find(self, text: str | None) -> list[int]:
        listed = _WORD.findall((text or "").lower())
        distinct = set(listed)
        if fresh := distinct - self.seen:
            if len(self.seen) > MEMO_WORDS:
                self.seen, self.hits, fresh = set(), {}, distinct
            self.seen |= fresh
            self.hits |= {w: own for w in fresh if (own := [x for x in stems(w) if x in self.wanted])}
        if not (mine := distinct & self.hits.keys()):
            return []
        counts: Counter[str] = Counter()
        for word in listed:
            if word in mine:
                counts.update(self.hits[word])
        named = (self.number.get(f"{stem}|{level}") for stem, n in counts.items() for level in LEVELS if n >= level)
        return [i for i in named if i is not None]


@dataclass
class ToxicityModel:
    """Logistic weights of features; what a text scores is the chance that it is toxic."""

    names: list[str]
    weights: np.ndarray
    bias: float

    @cached_property
    def finder(self) -> FeatureFinder:
        return FeatureFinder(self.names)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.bias + self.weights[self.finder.find(t)].sum() for t in texts], np.float64)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


NOTHING_KNOWN = ToxicityModel([], np.zeros(0), -3.0)


def nnpu_fit(positive: np.ndarray, starts: np.ndarray, of: np.ndarray, size: int, prior: float, rounds: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative positive-unlabelled risk.

    Document i has the features of[starts[i]:starts[i + 1]]; positive marks the toxic ones, the
    others are unlabelled. The risk is prior * E+[l(g)] + max(0, Eu[l(-g)] - prior * E+[l(-g)])
    with the logistic loss l; where the second term, the share of clean texts, falls below 0,
    the step goes the other way, so that the classifier can't profit from fitting it.
    """
    doc = np.repeat(np.arange(len(positive)), np.diff(starts))
    w, b = np.zeros(size), np.log(prior / (1 - prior))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    n_pos, n_unl = positive.sum(), (~positive).sum()
    for step in range(1, rounds + 1):
        g = np.bincount(doc, w[of], minlength=len(positive)) + b
        p = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
        loss_negative = np.logaddexp(0, g)  # l(-g)
        clean = loss_negative[~positive].mean() - prior * loss_negative[positive].mean()
        toxic_part = np.where(positive, prior * (p - 1) / n_pos, 0.0)
        clean_part = np.where(positive, -prior * p / n_pos, p / n_unl)
        slope = toxic_part + clean_part if clean >= 0 else -clean_part
        grad = np.append(np.bincount(of, slope[doc], minlength=size) + decay * w, slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:size], b - move[size]
    return w, b


def _drawn(seed: str, share: float):
    return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED, prior: float | None = None) -> ToxicityModel:
    """Fits on docs(doc_id, text, ...) of which labels(doc_id, toxic) confirms some as toxic.

    About most_positive toxic and most_unlabelled unlabelled documents, chosen by a hash of
    doc_id, are the sample; the unlabelled ones are drawn from all of docs, whatever their label.
    Equal texts count once. Features are kept whose share among the toxic lies CONTRAST standard
    deviations or more above that among all (LEAST_TEXTS toxic texts at least, the MOST_FEATURES that
    lie highest), so that only features for toxicity count and none (of a language or topic) against it. The class prior is given, or else the share of toxic
    labels, or less: how often the unlabelled have any kept feature, over how often the toxic
    do, bounds it from above. Without toxic labels every score is a low constant. Null doc_ids
    and null labels are left out.
    """
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    seen = marked.agg(F.count("*").alias("n"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("p")).first()
    everything = docs.where("doc_id is not null").agg(F.count("*").alias("n")).first()["n"]
    if not seen["p"] or not everything:
        return NOTHING_KNOWN
    confirmed = marked.where((F.col("toxic") == 1) & _drawn("toxic", min(1.0, most_positive / seen["p"]))).select(F.col("doc_id").alias("__id"))
    both = docs.select("doc_id", "text").join(F.broadcast(confirmed), F.col("doc_id") == F.col("__id"), "left")  # bounded by most_positive
    unlabelled = _drawn("unlabelled", min(1.0, most_unlabelled / everything))
    kind = F.array(F.when(F.col("__id").isNotNull(), 1), F.when(unlabelled, 0))
    chosen = both.where(F.col("__id").isNotNull() | unlabelled).select(F.explode(F.array_compact(kind)).alias("positive"), "text")
    sample = cut(chosen.dropDuplicates(["positive", "text"]))
    sizes = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_unl = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_unl:
        return NOTHING_KNOWN

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
                part = batch.slice(at, 256)
                for positive, text in zip(part.column("positive").to_pylist(), part.column("text").to_pylist(), strict=True):
                    found[positive].update(features(text))
                for positive, counts in found.items():
                    cols = [list(counts), [n * positive for n in counts.values()], [n * (1 - positive) for n in counts.values()]]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["feature", "p", "u"])

    counted = sample.mapInArrow(count, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    rate = (F.col("p") + F.col("u") + 1) / (n_pos + n_unl + 2)
    z = (F.col("p") / n_pos - F.col("u") / n_unl) / F.sqrt(rate * (1 - rate) * (1 / n_pos + 1 / n_unl))
    table = counted.where(F.col("p") >= LEAST_TEXTS).select("feature", z.alias("z")).where(F.col("z") >= CONTRAST).orderBy(F.desc("z"), "feature").limit(MOST_FEATURES)
    names, share = sorted(r["feature"] for r in table.collect()), seen["p"] / seen["n"]
    if not names:
        share = float(np.clip(share if prior is None else prior, *PRIOR_RANGE))
        return ToxicityModel([], np.zeros(0), float(np.log(share / (1 - share))))

    @F.arrow_udf("array<int>")
    def numbered(batch: pa.Array) -> pa.Array:
        finder = FeatureFinder(names)
        return pa.array([finder.find(t) for t in batch.to_pylist()], pa.list_(pa.int32()))

    rows = sample.select("positive", numbered("text").alias("found")).toArrow()  # bounded by the sample and MOST_FEATURES
    found, positive = rows.column("found").combine_chunks(), rows.column("positive").to_numpy() == 1
    starts = np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))))
    any_mark = np.diff(starts) > 0
    bound = any_mark[~positive].mean() / any_mark[positive].mean() if any_mark[positive].any() else 1.0
    prior = float(np.clip(min(share, bound) if prior is None else prior, *PRIOR_RANGE))
    w, b = nnpu_fit(positive, starts, found.flatten().to_numpy().astype(np.int64), len(names), prior)
    return ToxicityModel(names, w, b)


def score_column(model: ToxicityModel, spark: SparkSession, text: str = "text"):
    """The toxicity score (double, 0 to 1) of a text column."""
    shared = spark.sparkContext.broadcast(model)  # MOST_FEATURES at most

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        release_kept()
        parts = [shared.value.scores(batch.slice(at, 1024).to_pylist()) for at in range(0, len(batch), 1024)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(F.col(text))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score, predicted) of each whole text, however long; null and empty texts score as texts without words.

    A score of 0.5 is predicted 1. Rows repeat as they come; other columns are ignored; an empty table gives no rows.
    """
    scored = docs.select("doc_id", score_column(model, docs.sparkSession).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """docs that score below the threshold; all columns, whatever their names, pass through.

    Null and empty texts score as texts without words; repeated rows stay or go together; an empty table gives none.
    """
    return docs.where(score_column(model, docs.sparkSession) < threshold)
