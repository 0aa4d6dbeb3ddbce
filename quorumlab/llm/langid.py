"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quorumlab.llm.workers import release_kept
from quorumlab.session import cut

ORDER = 5
SPACE = 32
UNKNOWN = "und"
#: Symbols handled at once; bounds memory for a text of any length.
SYMBOLS_AT_ONCE = 1 << 18
#: Bound on the labelled sample: about this many documents of each language fit the models.
SAMPLE_PER_LANGUAGE = 400
#: Share of clean documents of a language that calibration may let the rejection take.
REJECTED_SHARE = 0.001
#: Deviations of chance that a short text may lie further out, and the symbols of the pieces that show what a deviation is.
DEVIATIONS, SNIPPET = 3.0, 64
#: Labelled documents of a language from which a quarter calibrates; of a rarer one all are counted.
LEAST_TO_HOLD = 8


@cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or a space for any other."""
    out = np.full(1 << 16, SPACE, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def symbols(text: str | None) -> np.ndarray:
    """The letters of a text, lower-cased, with one space for what lies between, before and after.

    A text without a letter (or null) gives no symbols.
    """
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    wide = points >= (1 << 16)
    out = _letters()[np.where(wide, SPACE, points)]
    if wide.any():
        kinds, back = np.unique(points[wide], return_inverse=True)
        out[wide] = np.array([ord(chr(c).lower()) if chr(c).isalpha() else SPACE for c in kinds.tolist()], np.uint32)[back]
    letter = out != SPACE
    if not letter.any():
        return out[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of spaces only the first stays
    out = out[keep]
    return np.pad(out, (int(out[0] != SPACE), int(out[-1] != SPACE)), constant_values=SPACE)


def _scatter(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned integers."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


_FACTORS = _scatter(np.arange(1, ORDER + 2)) | np.uint64(1)


def _hash_ending(mixed: np.ndarray, ends: np.ndarray | slice, k: int) -> np.ndarray:
    """The hash of the k scattered symbols up to each of the positions `ends`."""
    total = None
    with np.errstate(over="ignore"):
        for j in range(k):
            at = slice(ends.start - j, ends.stop - j) if isinstance(ends, slice) else ends - j
            term = mixed[at] * _FACTORS[j]
            total = term if total is None else total + term
    return np.zeros(len(ends), np.uint64) if total is None else total


@dataclass
class HashArray:
    """Sorted hashes with a row of values each; the upper bits of a hash find its neighbourhood."""

    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray = field(init=False)
    shift: np.uint64 = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        bits = max(1, int(2 * len(self.keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        bounds = np.searchsorted(self.keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.first, self.longest = bounds[:-1].astype(np.int32), int(np.diff(bounds).max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        last = len(self.keys) - 1
        at = np.minimum(self.first[hashes >> self.shift], last)
        found = self.keys[at] == hashes
        open_ = np.flatnonzero(~found)
        out = np.where(found, at, -1)
        for step in range(1, self.longest):
            if not len(open_):
                break
            place = np.minimum(at[open_] + step, last)
            seen = self.keys[place]
            out[open_[seen == hashes[open_]]] = place[seen == hashes[open_]]
            open_ = open_[seen < hashes[open_]]
        return out


def _ids(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows and the number of each row's."""
    return np.unique(rows, axis=0, return_inverse=True)


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Interpolated Kneser-Ney of one language from its distinct ORDER-grams and their counts.

    For each order from 1: the grams, the discounted share of each in its context, the contexts
    (grams of one symbol less), and the weight that each leaves to the order below. Below the
    highest order a gram counts once for every distinct symbol seen before it.
    """
    levels = []
    for k in range(ORDER, 0, -1):
        contexts, of = _ids(grams[:, :-1]) if k > 1 else (np.zeros((1, 0), np.uint32), np.zeros(len(grams), np.int64))
        of = of.reshape(-1)
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        discount = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.1))
        total = np.bincount(of, counts)
        kinds = np.bincount(of)
        levels.append((grams, (counts - discount) / total[of], contexts, discount * kinds / total))
        grams, back = _ids(grams[:, 1:])
        counts = np.bincount(back.reshape(-1)).astype(np.float64)
    return levels[::-1]


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    """The hash that gram_keys gives to these symbols; the last symbol is the nearest."""
    total = np.zeros(len(rows), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(rows.shape[1]):
            total = total + _scatter(rows[:, rows.shape[1] - 1 - k]) * _FACTORS[k]
    return total


class LanguageModels:
    """One Kneser-Ney model for each language over shared sorted hash arrays.

    A gram's row holds its log probability in every language, so that one look-up serves all;
    a gram that no language has falls to the order below, with each language's weight for its context.
    """

    def __init__(self, by_language: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.languages = sorted(by_language)
        levels = [kneser_ney(*by_language[x]) for x in self.languages]
        symbols_seen = len(np.unique(np.concatenate([g[:, -1] for g, _ in by_language.values()]))) + 1
        self.floor = -np.log(symbols_seen)
        self.grams: list[HashArray] = []
        self.weights: list[HashArray] = []
        for k in range(ORDER):
            parts = [lv[k] for lv in levels]
            self.weights.append(self._contexts([(_hash_rows(p[2]), np.log(p[3])) for p in parts]))
            rows, _ = _ids(np.concatenate([p[0] for p in parts]))
            keys, lower, ctx = _hash_rows(rows), _hash_rows(rows[:, 1:]), _hash_rows(rows[:, :-1])
            below = self._lower(k, lower) + self._weight(k, ctx)
            share = np.zeros((len(rows), len(parts)))
            order = np.argsort(keys, kind="stable")
            for j, p in enumerate(parts):
                share[order[np.searchsorted(keys, _hash_rows(p[0]), sorter=order)], j] = p[1]
            values = np.log(share + np.exp(below))[order].astype(np.float32)
            self.grams.append(HashArray(keys[order], values))
        # Set by calibration: see calibrate().
        n = len(self.languages)
        self.mean, self.noise, self.within = np.zeros(n), np.full(n, np.inf), np.ones(n)
        self.most, self.temperature = 0.5, 1.0

    def _contexts(self, parts: list[tuple[np.ndarray, np.ndarray]]) -> HashArray:
        keys = np.unique(np.concatenate([h for h, _ in parts]))
        values = np.zeros((len(keys), len(parts)), np.float32)  # an unseen context leaves all to the order below
        for j, (h, w) in enumerate(parts):
            values[np.searchsorted(keys, h), j] = w
        return HashArray(keys, values)

    def _weight(self, k: int, ctx: np.ndarray) -> np.ndarray:
        at = self.weights[k].find(ctx)
        return np.where(at[:, None] < 0, 0.0, self.weights[k].values[at])

    def _lower(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Log probabilities, of the order below k, of grams that every such order's array has."""
        return self.grams[k - 1].values[self.grams[k - 1].find(keys)].astype(np.float64) if k else np.full((len(keys), len(self.languages)), self.floor)

    def log_probabilities(self, s: np.ndarray) -> np.ndarray:
        """Of each symbol from the ORDER-th on, in each language."""
        mixed, n = _scatter(s), len(s) - ORDER + 1
        out = np.zeros((n, len(self.languages)), np.float32)
        left = np.arange(n)
        for k in range(ORDER, 0, -1):
            ends = left + ORDER - 1
            at = self.grams[k - 1].find(_hash_ending(mixed, slice(ORDER - 1, len(s)) if len(left) == n else ends, k))
            hit = at >= 0
            out[left[hit]] += self.grams[k - 1].values[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            ctx = self.weights[k - 1].find(_hash_ending(mixed, left + ORDER - 2, k - 1))
            seen = ctx >= 0
            out[left[seen]] += self.weights[k - 1].values[ctx[seen]]
        out[left] += np.float32(self.floor)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats a symbol in each language (texts x languages), and each text's number of symbols."""
        total = np.zeros((len(texts), len(self.languages)))
        size = np.zeros(len(texts), np.int64)
        lead = np.full(ORDER - 1, SPACE, np.uint32)
        queue: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if queue:
                p = self.log_probabilities(np.concatenate([x for _, x in queue]))
                at = 0
                for i, x in queue:
                    n = len(x) - len(lead)
                    total[i] += p[at : at + n].sum(axis=0, dtype=np.float64)
                    at += len(x)
                queue.clear()

        held = 0
        for i, text in enumerate(texts):
            s = symbols(text)
            size[i] = max(0, len(s) - 1)  # the space before the first letter is given
            if size[i]:
                s = np.concatenate((lead, s[1:]))
                for at in range(0, len(s) - len(lead), SYMBOLS_AT_ONCE):
                    piece = s[at : at + SYMBOLS_AT_ONCE + len(lead)]
                    queue.append((i, piece))
                    held += len(piece)
                    if held >= SYMBOLS_AT_ONCE:
                        flush()
                        held = 0
        flush()
        return -total / np.maximum(size, 1)[:, None], size

    def calibrate(self, texts: list[str], languages: list[str], share: float = REJECTED_SHARE) -> None:
        """Sets temperature and rejection from labelled texts that the counts have not seen.

        A language's labelled texts lie at its mean cross-entropy, and the same texts with their letters in random order
        at its noise. How far a text lies on the way from one to the other decides: it is rejected beyond what
        all but the given share of labelled texts reach, halfway at least, with DEVIATIONS of chance
        for its length on top, as pieces of SNIPPET symbols of labelled texts show it.
        """
        h, n = self.cross_entropies(texts)
        y = np.array([self.languages.index(x) for x in languages], np.int64)
        own = h[np.arange(len(y)), y] if len(y) else np.zeros(0)
        usable = n > 0
        if not usable.any():
            return
        draw = np.random.default_rng(5)
        letters = ["".join(map(chr, draw.permutation(symbols(t)).tolist())) for t in texts]
        disordered = self.cross_entropies(letters)[0].min(axis=1)
        pieces = ["".join(map(chr, symbols(t)[:SNIPPET].tolist())) for t in texts]
        short, m = self.cross_entropies(pieces)
        short = short[np.arange(len(y)), y]
        for j in range(len(self.languages)):
            mine = usable & (y == j)
            if not mine.any():
                mine = usable
            w = n[mine].astype(float)
            self.mean[j] = np.average(own[mine], weights=w)
            self.noise[j] = max(self.mean[j] + 0.1, np.average(disordered[mine], weights=w))
            apart = np.abs(short[mine] - np.median(short[mine])) * np.sqrt(m[mine])
            self.within[j] = max(0.1, 1.4826 * float(np.median(apart))) ** 2  # the deviation of a normal spread
        way = (own - self.mean[y]) / (self.noise - self.mean)[y]
        self.most = float(np.clip(np.quantile(way[usable], 1 - share) + 0.1, 0.5, 0.9))
        grid = 2.0 ** np.arange(0, 9)
        loss = []
        for t in grid:
            logits = -(h - h.min(axis=1, keepdims=True)) * n[:, None] / t
            loss.append(np.mean((np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(y)), y])[usable]))
        self.temperature = float(grid[np.flatnonzero(np.array(loss) <= min(loss) + 0.001)[-1]])  # the mildest of the best

    def _rejects(self, best: np.ndarray, lowest: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether a text lies nearer to letters without any order than calibration allows for its language and length."""
        chance = DEVIATIONS * np.sqrt(self.within[best] / np.maximum(n, 1))
        return (n == 0) | (lowest - self.mean[best] > self.most * (self.noise - self.mean)[best] + chance)

    def identify(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (its calibrated probability), cross-entropy, and whether it is rejected."""
        h, n = self.cross_entropies(texts)
        best = h.argmin(axis=1) if len(texts) else np.zeros(0, np.int64)
        lowest = h[np.arange(len(best)), best]
        score = 1 / np.exp(-(h - lowest[:, None]) * n[:, None] / self.temperature).sum(axis=1)
        names = [self.languages[j] if m else UNKNOWN for j, m in zip(best.tolist(), n.tolist(), strict=True)]
        return names, np.where(n > 0, score, 0.0), np.where(n > 0, lowest, 0.0), self._rejects(best, lowest, n)


def gram_strings(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct ORDER-grams (rows of symbols) of texts and their counts, a batch at a time."""
    for at in range(0, len(texts), 64):
        rows = []
        for text in texts[at : at + 64]:
            s = symbols(text)
            if len(s) > 1:
                s = np.concatenate((np.full(ORDER - 1, SPACE, np.uint32), s[1:]))
                rows.append(np.lib.stride_tricks.sliding_window_view(s, ORDER))
        if rows:
            yield np.unique(np.concatenate(rows), axis=0, return_counts=True)


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModels | None:
    """Fits and calibrates models from labelled(doc_id, text, lang); None if nothing is labelled.

    About per_language documents of each language, chosen by a hash of doc_id, are the sample:
    three quarters give the counts, gathered by Spark, and the rest calibrates. Of a language with fewer than
    LEAST_TO_HOLD documents all are counted and the other languages' texts calibrate it; where every language is so rare,
    the counted texts do. The driver holds the sample's grams and calibration texts: bounded by languages, documents
    of each and their lengths. Repeated rows count as often as they come; rows without text, letter or lang take no part.
    """
    usable = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, min(1.0, per_language / n))])
    part = F.pmod(F.xxhash64("doc_id", F.lit("language part")), F.lit(4))
    sample = cut(usable.where(draw < share[F.col("lang")]).withColumn("part", part))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(languages)):
                texts = batch.filter(pa.array(languages == lang)).column("text").to_pylist()
                for grams, counts in gram_strings(texts):
                    cells = [g.tobytes() for g in np.ascontiguousarray(grams)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells, pa.binary()), pa.array(counts)], names=["lang", "gram", "n"])

    parts = sample.groupBy("lang").agg(F.sum((F.col("part") == 0).cast("int")).alias("held"), F.count("*").alias("n")).collect()
    rare = [r["lang"] for r in parts if r["n"] < LEAST_TO_HOLD or r["held"] == r["n"]]
    counted = sample.where((F.col("part") != 0) | F.col("lang").isin(rare))
    grams = counted.select("lang", "text").mapInArrow(count, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    by_language = {}
    names = np.array(grams.column("lang").to_pylist(), object)
    for lang in sorted(set(names)):
        mine = grams.filter(pa.array(names == lang))
        rows = np.frombuffer(b"".join(mine.column("gram").to_pylist()), np.uint32).reshape(-1, ORDER)
        by_language[lang] = (rows, mine.column("n").to_numpy().astype(np.float64))
    if not by_language:
        return None
    models = LanguageModels(by_language)
    held = sample.where("part = 0").where(~F.col("lang").isin(rare) & F.col("lang").isin(models.languages)).select("text", "lang")
    held = held if len(rare) < len(parts) else sample.where(F.col("lang").isin(models.languages)).select("text", "lang")
    held = held.orderBy("lang", F.xxhash64("text"), "text").toArrow()
    models.calibrate(held.column("text").to_pylist(), held.column("lang").to_pylist())
    return models


def identify_column(models: LanguageModels | None, spark, text: str = "text"):
    """A struct column (lang string, score double, cross_entropy double, rejected boolean)."""
    shared = spark.sparkContext.broadcast(models)  # bounded by the sample

    @F.arrow_udf("lang string, score double, cross_entropy double, rejected boolean")
    def identify(batch: pa.Array) -> pa.Array:
        release_kept()
        names, score, entropy, rejected = [], [], [], []
        for at in range(0, len(batch), 256):
            texts = batch.slice(at, 256).to_pylist()
            if shared.value is None:
                found = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                found = shared.value.identify(texts)
            names += found[0]
            for to, x in zip((score, entropy, rejected), found[1:], strict=True):
                to.append(x)
        cols = [np.concatenate(x) if x else np.zeros(0) for x in (score, entropy, rejected)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(bool))], names=["lang", "score", "cross_entropy", "rejected"])

    return identify(F.col(text))


def identify_documents(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of each whole text.

    Null texts and those without a letter are `und`, score 0, rejected. Without a model all are.
    Ties go to the language first in alphabetical order. Texts of any length are scored whole, in pieces of bounded memory;
    rows repeat as they come, an empty table gives no rows. Other columns are ignored.
    """
    got = docs.select("doc_id", identify_column(models, docs.sparkSession).alias("r"))
    return got.select("doc_id", F.col("r.lang").alias("lang_pred"), "r.score", "r.cross_entropy", "r.rejected")


def keep_identified(docs: DataFrame, models: LanguageModels | None) -> DataFrame:
    """docs without the rejected ones; all columns, whatever their names, pass through.

    Repeated rows stay or go together, an empty table gives an empty one.
    """
    return docs.where(~identify_column(models, docs.sparkSession)["rejected"])
