"""The near-copy stage against brute-force Jaccard of five-word shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quorumlab.llm import nearcopies


def shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_groups(texts, similarity=0.8):
    """Smallest id of each id's chain of similar texts; equal sets are copies, also empty ones."""
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, parent = sorted(texts), {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            both = len(a & b)
            if a == b or both and both >= similarity * (len(a) + len(b) - both) - 1e-9:
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def edited(words, share, rng):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def planted():
    """Copies at all similarities from 0.6 to 1, and groups far larger than a run whose pairs are all compared."""
    rng, texts = random.Random(3), {}
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    for _ in range(150):
        base = new(rng.choice([8, 40, 200, 400]))
        for share in (0, rng.uniform(0.01, 0.06), rng.uniform(0.01, 0.06)):
            texts[len(texts)] = " ".join(edited(base, share, rng))
    for share in (0.005, 0.02, 0.03):
        base = new(150)
        for _ in range(80):
            texts[len(texts)] = " ".join(edited(base, share, rng))
    passage = new(30)
    for n in [10, 40] * 40:
        texts[len(texts)] = " ".join(passage + new(n))
    for t in (None, "", "  ", "one", "one", "one two"):
        texts[len(texts)] = t
    return texts


def test_planted_copies_equal_brute_force_jaccard(spark, planted):
    docs = spark.createDataFrame(list(planted.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nearcopies.jaccard_groups(docs).collect()}
    assert found == brute_groups(planted)


def test_documents_equal_brute_force_jaccard(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = brute_groups(texts)
    assert {r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, sf_dir).collect()} == {i for i in want if want[i] == i}


def test_one_row_stays_of_repeated_rows_and_null_ids(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(7, a, "y"), (7, a, "x"), (9, a, "w"), (7, b, "v"), (None, b, "u"), (None, c, "t"), (None, c, "s"), (None, None, "r"), (None, "", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = sorted(((r.doc_id, r.text, r.source) for r in nearcopies.drop_jaccard_copies(docs).collect()), key=str)
    assert [k for k in kept if k[1]] == sorted([(7, a, "x"), (7, b, "v"), (None, c, "s")], key=str)
    assert len(kept) == 4


def test_a_round_gives_few_pairs_of_sets_apart():
    """A run of 400 sets in 40 groups: two pairs a row at most, none within a group or a run of its own, other ones at the next turn."""
    run = np.repeat(np.array([3, 9, 11]), [400, 1, 200])
    node = np.arange(len(run)) * 7919
    n, place, label = np.full(len(run), 100), np.arange(len(run)) % 20, np.arange(len(run)) % 40
    turns = []
    for turn in (0, 1):
        x, y = nearcopies._few_pairs(run, n, place, node, label, turn, 0.8)
        assert 0 < len(x) <= 2 * len(run)
        assert (run[x] == run[y]).all() and (label[x] != label[y]).all()
        turns.append({frozenset(p) for p in zip(x.tolist(), y.tolist(), strict=True)})
    assert len(turns[0] & turns[1]) < len(turns[0]) / 2


def test_other_columns_of_any_name_and_type(spark):
    from pyspark.sql import functions as F

    rows = [(7, "a b c d e f g"), (7, "a b c d e f g"), (8, "a b c d e f g"), (9, "h i j k l m n"), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    wide = docs.withColumn("a.b", F.lit(1)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("node", F.lit("n")).withColumn("__id", F.lit(5)).withColumn("kept", F.lit(2.0))
    found = nearcopies.drop_jaccard_copies(wide)
    assert found.columns == wide.columns
    assert sorted(((r["doc_id"], r["text"], r["a.b"], r["m"], r["node"], r["__id"], r["kept"]) for r in found.collect()), key=str) == sorted(
        [(7, "a b c d e f g", 1, {"k": 7}, "n", 5, 2.0), (9, "h i j k l m n", 1, {"k": 9}, "n", 5, 2.0), (None, None, 1, {"k": None}, "n", 5, 2.0)], key=str
    )
    assert nearcopies.drop_jaccard_copies(wide.limit(0)).count() == 0 and nearcopies.jaccard_groups(wide.limit(0)).count() == 0


def test_sketches_differ_in_no_more_bits_than_sets_in_elements():
    rng = np.random.default_rng(5)
    sets = []
    for n in (0, 1, 3, 60, 64, 65, 90, 400, 500, 520, 3000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets += [np.unique(np.concatenate((base[int(n * share) :], rng.integers(0, 2**64, int(n * share), dtype=np.uint64)))) for share in (0, 0.05, 0.1, 0.5, 1)]
    x, y = zip(*[(a, b) for a in sets for b in sets], strict=True)
    apart = nearcopies._bits_apart([nearcopies._sketch(s) for s in x], [nearcopies._sketch(s) for s in y])
    differ = np.array([len(np.setxor1d(a, b)) for a, b in zip(x, y, strict=True)])
    assert (apart <= differ).all()
    n = np.array([len(a) + len(b) for a, b in zip(x, y, strict=True)])
    near = np.array([min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) for a, b in zip(x, y, strict=True)])
    far = (differ >= n / 2) & (n > 700) & near  # a similarity of 1/3 or less, and sizes that allow one of 0.8
    assert far.any() and (apart[far] * 1.8 > 0.2 * n[far]).all()


def test_texts_that_share_a_passage_are_not_compared_whole(spark, monkeypatch):
    """Texts that meet in a bucket of a passage whose commonness no sample has told don't make pairs by the square of its size."""
    rng, texts = random.Random(11), {}
    new = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    passage = new(40)
    for i in range(300):
        texts[i] = " ".join(new(60) + passage)
    for i in range(300, 320):
        texts[i] = " ".join(edited(texts[i - 300].split(), 0.01, rng))
    compared, whole = [], nearcopies._similar_pairs

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(nearcopies, "SAMPLE", 0)
    monkeypatch.setattr(nearcopies, "SHARE", 0, raising=False)
    monkeypatch.setattr(nearcopies, "_similar_pairs", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nearcopies.jaccard_groups(docs).collect()}
    assert found == brute_groups(texts)
    assert sum(compared) <= 60, compared


def test_what_is_remembered_of_a_sample_grows_with_the_table_up_to_a_bound(spark, monkeypatch):
    """Of more common shingles than are remembered, the most frequent stay."""
    from quorumlab.session import Scratch

    monkeypatch.setattr(nearcopies, "MOST_COMMON", 10)
    rows = [(i, " ".join(f"p{j}" for j in range(8 if i % 2 else 24))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    with Scratch(spark, "test") as scratch:
        known, often = nearcopies._most_common(docs, 5, scratch)
    assert len(known) == 4 and set(often.tolist()) == {20}


def test_scratch_tables_go(spark):
    import os

    from quorumlab.session import Scratch, shared_folder

    with Scratch(spark, "test") as scratch:
        kept = scratch.keep(spark.range(7).selectExpr("id", "array(id) AS a"))
        assert sorted(r.id for r in kept.collect()) == list(range(7)) and os.path.isdir(scratch.folder)
    assert not os.path.exists(scratch.folder) and os.path.isdir(shared_folder(spark).removeprefix("file:"))
