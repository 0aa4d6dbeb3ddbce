import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from quorumlab.llm import bytebpe, langid, licenses, packing, sharding, tokencount, toxicity
from quorumlab.llm.chunks import read_ranks

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- Language ID ---------------------------------------------------------------------------


def brute_kneser_ney(texts):
    """Interpolated Kneser-Ney by its textbook definition over strings."""
    from collections import Counter, defaultdict

    padded = [" " * (langid.ORDER - 1) + "".join(map(chr, langid.symbols(t)[1:])) for t in texts]
    top = Counter(p[i : i + langid.ORDER] for p in padded for i in range(len(p) - langid.ORDER + 1))
    counts = {langid.ORDER: top}
    for k in range(langid.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    context, kinds, discount = defaultdict(float), defaultdict(int), {}
    for k, c in counts.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[k] = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.1))
        for g, v in c.items():
            context[k, g[:-1]] += v
            kinds[k, g[:-1]] += 1

    def p(gram, uniform):
        k = len(gram)
        if not k:
            return uniform
        low = p(gram[1:], uniform)
        if (k, gram[:-1]) not in context:
            return low
        c, d = counts[k].get(gram, 0), discount[k]
        return max(c - d, 0) / context[k, gram[:-1]] + d * kinds[k, gram[:-1]] / context[k, gram[:-1]] * low

    return p


def test_models_give_kneser_ney_probabilities():
    by = {"en": ["the cat sat on the mat", "a dog and the cat ran to the hat"], "de": ["der hund und die katze", "die katze sitzt auf der matte"]}
    grams = {}
    for lang, texts in by.items():
        parts = list(langid.gram_strings(texts))
        grams[lang] = (parts[0][0], parts[0][1].astype(float))
    models = langid.LanguageModels(grams)
    for j, lang in enumerate(models.languages):
        p = brute_kneser_ney(by[lang])
        for text in ("the cat and der hund", "xyz on qat", "matte"):
            s = " " * (langid.ORDER - 1) + "".join(map(chr, langid.symbols(text)[1:]))
            want = -sum(np.log(p(s[i : i + langid.ORDER], np.exp(models.floor))) for i in range(len(s) - langid.ORDER + 1)) / (len(s) - langid.ORDER + 1)
            assert models.cross_entropies([text])[0][0, j] == pytest.approx(want, rel=1e-4)


def test_whole_texts_do_not_depend_on_their_batch(monkeypatch):
    texts = ["the cat sat on the mat " * 50, None, "", "über die straße", "x"]
    grams = {"en": next(iter(langid.gram_strings(texts[:1])))}
    models = langid.LanguageModels({k: (g, c.astype(float)) for k, (g, c) in grams.items()})
    together = models.cross_entropies(texts)[0]
    monkeypatch.setattr(langid, "SYMBOLS_AT_ONCE", 7)
    assert np.allclose(together, models.cross_entropies(texts)[0])
    assert np.allclose(together, np.concatenate([models.cross_entropies([t])[0] for t in texts]))


def test_language_id_accuracy_and_odd_rows(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = langid.fit(docs.where("doc_id % 2 = 0"))
    held = langid.identify_documents(docs.where("doc_id % 2 = 1"), models).join(docs.select("doc_id", "lang"), "doc_id")
    assert held.where("lang = lang_pred").count() >= 0.95 * held.count()
    found = {r["doc_id"]: r for r in rows(langid.identify_documents(odd_docs, models))}
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] and found[i]["score"] == 0 for i in (3, 4, 5, 8))
    assert found[1]["lang_pred"] == "en" and not found[1]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert langid.identify_documents(no_docs, models).count() == 0
    assert langid.fit(no_docs) is None
    assert {r["lang_pred"] for r in rows(langid.identify_documents(odd_docs, None))} == {"und"}
    assert langid.keep_identified(docs, models).count() >= 0.99 * docs.count()
    assert langid.keep_identified(docs, models).columns == docs.columns


def test_noise_is_rejected_and_short_texts_are_not(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = langid.fit(docs)
    rng = np.random.default_rng(2)
    letters = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), k))
    text = next(r["text"] for r in rows(docs) if r["lang"] == "en" and len(r["text"]) > 500)
    shuffled = "".join(rng.permutation(list(text)))
    noise = [letters(60), letters(2000), shuffled, "日本語の文章がここにあります", "Привет, как у тебя дела сегодня", "$$$ ### 1 2 3", None, ""]
    assert models.identify(noise)[3].all()
    cjk = models.identify([text + " 日本語", *(" ".join(text.split()[i : i + 2]) for i in range(0, 40, 2)), text[:200]])
    assert not cjk[3].any()
    kept = langid.keep_identified(docs.withColumn("__language", docs["lang"]), models)
    assert kept.count() >= 0.99 * docs.count() and "__language" in kept.columns


def test_a_rare_language_gets_a_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    for i in range(4):
        rare = spark.createDataFrame([(10**6 + i, "zaxo quvi zaxo mopru quvi zaxo lenta mopru zaxo quvi " * 5, "xx")], "doc_id long, text string, lang string")
        models = langid.fit(docs.unionAll(rare))
        assert "xx" in models.languages and models.identify(["quvi zaxo mopru zaxo"])[0] == ["xx"]


# --- Toxicity ------------------------------------------------------------------------------


def plain_risk(w, b, x, positive, prior):
    """The non-negative risk and the part that steps backwards, document by document."""
    loss = lambda z: np.logaddexp(0, -z)
    g = x @ w + b
    clean = loss(-g[~positive]).mean() - prior * loss(-g[positive]).mean()
    return prior * loss(g[positive]).mean(), clean


def test_nnpu_steps_follow_the_risk():
    rng = np.random.default_rng(0)
    x = (rng.random((60, 5)) < 0.4).astype(float)
    positive = rng.random(60) < 0.4
    starts, of = np.concatenate(([0], np.cumsum(x.sum(axis=1).astype(int)))), np.nonzero(x)[1]
    for prior in (0.1, 0.5):
        b0 = np.log(prior / (1 - prior))
        w, b = toxicity.nnpu_fit(positive, starts, of, 5, prior, rounds=1, rate=1e-3, decay=0.0)
        at = np.append(np.zeros(5), b0)

        def goal(v, prior=prior, at=at):
            now = plain_risk(at[:5], at[5], x, positive, prior)[1]
            toxic, clean = plain_risk(v[:5], v[5], x, positive, prior)
            return toxic + clean if now >= 0 else -clean

        numeric = np.array([(goal(at + e) - goal(at - e)) / 2e-5 for e in 1e-5 * np.eye(6)])
        moved = np.append(w, b) - at  # a first step of this kind has the gradient's signs and the rate's size
        assert np.allclose(moved, -1e-3 * numeric / (np.abs(numeric) + 1e-8), rtol=1e-2, atol=1e-7)
    w, b = toxicity.nnpu_fit(positive, starts, of, 5, 0.3, rounds=400)
    before, after = (plain_risk(v, c, x, positive, 0.3) for v, c in ((np.zeros(5), np.log(3 / 7)), (w, b)))
    assert after[0] + max(0, after[1]) < before[0] + max(0, before[1])


def test_toxicity_finds_marked_texts(spark, odd_docs, no_docs):
    rng = random.Random(1)
    plain = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud"]
    docs, labels = [], []
    for i in range(600):
        text = " ".join(rng.choice(plain) for _ in range(30)) + f" token{i}"
        bad = i % 8 == 0
        docs.append((i, text + (" vilespeak you " if bad else "")))
        if i % 2 == 0:
            labels.append((i, int(bad)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    found = {r["doc_id"]: r["predicted"] for r in rows(toxicity.score_documents(d, model))}
    assert all(found[i] == (i % 8 == 0) for i in range(600))
    assert toxicity.drop_toxic(d, model).count() == 525
    odd = toxicity.score_documents(odd_docs, model)
    assert odd.count() == odd_docs.count() and odd.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_documents(no_docs, model).count() == 0
    assert toxicity.fit(no_docs, y) is toxicity.NOTHING_KNOWN
    assert toxicity.fit(d, y.where("toxic = 0")) is toxicity.NOTHING_KNOWN


def test_finder_agrees_with_features():
    names = ["bad$|1", "badl|2", "badly|1", "x$|4"]
    for text in ("bad badly badlands", "x x x x y", "", None, "BAD"):
        got = {names[i] for i in toxicity.FeatureFinder(names).find(text)}
        assert got == set(names) & set(toxicity.features(text))


# --- Token counts --------------------------------------------------------------------------


def greedy(word, pieces):
    total = 0
    while word:
        size = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not size:
            return 1
        total, word = total + 1, word[size:]
    return total


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5).map(str.encode), min_size=1, max_size=12), st.lists(st.text("abcd", max_size=12).map(str.encode), max_size=20))
def test_automaton_counts_as_greedy_matching(pieces, listed):
    counter = tokencount.PieceCounter(pieces)
    assert [counter.count(w) for w in listed] == [greedy(w, pieces) for w in listed]


def test_token_counts_of_documents(spark, sf_dir, odd_docs, no_docs):
    pieces = set(read_ranks(RANKS))
    found = {r["doc_id"]: r for r in rows(tokencount.count_tokens(odd_docs, RANKS))}
    for r in rows(odd_docs):
        each = [greedy(b" " + w.encode(), pieces) for w in (r["text"] or "").split()]
        assert (found[r["doc_id"]]["n_words"], found[r["doc_id"]]["n_tokens"], found[r["doc_id"]]["most_tokens_in_word"]) == (len(each), sum(each), max(each, default=0))
    assert tokencount.count_tokens(no_docs, RANKS).count() == 0


# --- Byte-level BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab é\n\t 1,.'sltmd"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_bpe_ids_equal_tiktoken(text):
    own = bytebpe.codec(RANKS, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={}) if not hasattr(test_bpe_ids_equal_tiktoken, "enc") else test_bpe_ids_equal_tiktoken.enc
    test_bpe_ids_equal_tiktoken.enc = enc
    ids = own.encode([text])[0]
    assert ids.tolist() == enc.encode_ordinary(text)
    assert own.decode_bytes(ids) == text.encode()
    start, first, last = own.offsets(text, ids)
    assert b"".join(text.encode()[i : i + own.sizes[t]] for i, t in zip(start, ids, strict=True)) == text.encode()
    assert len(ids) == 0 or (first[0] == 0 and last[-1] == len(text))
    stream = bytebpe.StreamDecoder(own)
    assert "".join(stream.feed(ids[i : i + 1]) for i in range(len(ids))) + stream.finish() == text


def test_round_trip_of_documents(odd_docs, no_docs, reference):
    found = rows(bytebpe.round_trip_digests(odd_docs, RANKS, P.PATTERN))
    assert len(found) == odd_docs.count()
    text = {r["doc_id"]: r["text"] or "" for r in rows(odd_docs)}
    for r in found:
        ids = np.array(reference.encode_ordinary(text[r["doc_id"]]), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())
    back = {r["doc_id"]: r["text"] for r in rows(bytebpe.decode_documents(bytebpe.encode_documents(odd_docs, RANKS, P.PATTERN), RANKS, P.PATTERN))}
    assert back == text
    assert bytebpe.round_trip_digests(no_docs, RANKS, P.PATTERN).count() == 0


# --- Packing -------------------------------------------------------------------------------


def test_complements_fill_exactly():
    available = np.zeros(101, np.int64)
    available[[10, 20, 70]] = [2, 1, 1]
    index = packing.ComplementIndex(available)
    assert index.single(20) == (20,) and index.single(30) is None
    assert sorted(index.pair(30)) == [10, 20] and sorted(index.pair(20)) == [10, 10] and index.pair(40) is None
    assert sorted(index.triple(40)) == [10, 10, 20] and index.triple(60) is None


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_plan_uses_all_counts_within_capacity(counts):
    plan = packing.plan_sequences(counts, 64)
    used = {}
    for items, times in plan:
        assert sum(items) <= 64 and times > 0
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for _, t in plan) <= 2 * -(-total // 64)


def check_packing(found, docs, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    want = []
    for r in docs:
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for i, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((r["doc_id"], i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == sorted(want)
    spans = {}
    for r in found:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in spans.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= capacity
    return len(spans), -(-sum(r["length"] for r in found) // capacity)


def test_packing_of_documents(spark, sf_dir, odd_docs, no_docs):
    check_packing(rows(packing.pack_documents(odd_docs, WORDS, 1, 4096)), rows(odd_docs), 4096)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n, least = check_packing(rows(packing.pack_documents(docs, WORDS, 1, 4096)), rows(docs), 4096)
    assert n <= least + 1
    assert packing.pack_documents(no_docs, WORDS, 1, 4096).count() == 0


# --- Sharding ------------------------------------------------------------------------------


def test_shards_are_near_equal_and_gapless(spark, sf_dir, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = rows(sharding.shard_by_bytes(docs, shards=8))
    texts = {r["doc_id"]: r["text"] or "" for r in rows(docs)}
    assert len(found) == docs.count()
    size, slots = {}, {}
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(size) <= set(range(8))
    mean, largest = sum(size.values()) / 8, max(r["size"] for r in found)
    assert all(abs(s - mean) <= largest for s in size.values())
    odd = rows(sharding.shard_by_bytes(odd_docs, shards=4))
    assert sorted(r["doc_id"] for r in odd) == sorted(r["doc_id"] for r in rows(odd_docs))
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_equal_texts_stay_whole_and_shards_level(spark):
    """At sf0.01 a document is up to a 25th of a shard's bytes; no group is larger than a shard."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = rows(sharding.shard_by_bytes(docs, shards=40))
    size, where = Counter(), defaultdict(set)
    for r in found:
        size[r["shard"]] += r["size"]
        where[r["text_crc32"]].add(r["shard"])
    mean = sum(size.values()) / 40
    assert all(len(x) == 1 for x in where.values()) and max(abs(s - mean) for s in size.values()) <= 0.01 * mean
    # The same as placing every group by size on the driver: the largest shard is no larger than that by more than a boundary's error.
    groups = Counter()
    for r in found:
        groups[r["text_crc32"]] += r["size"]
    loads = sharding.place_largest_first(sorted(groups.values(), reverse=True), 40)[1]
    assert max(size.values()) <= max(loads) + mean / sharding.UNITS_PER_SHARD


def test_repeated_rows_of_one_document_are_divided(spark):
    docs = spark.createDataFrame([(1, "same text")] * 400 + [(i, f"text {i}") for i in range(2, 200)], "doc_id long, text string")
    found = rows(sharding.shard_by_bytes(docs, shards=10))
    size, slots = Counter(), defaultdict(list)
    for r in found:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    mean = sum(size.values()) / 10
    assert len(found) == 598 and all(abs(s - mean) <= 30 for s in size.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=8), st.integers(1, 500))
def test_levels_fill_the_least_loaded(loads, rest):
    part = np.diff(sharding.fill_levels(loads, rest), prepend=0)
    full = np.array(loads) + part
    assert part.sum() == pytest.approx(rest) and (part > -1e-9).all()
    assert all(full[i] <= full.min() + 1e-6 for i in range(len(loads)) if part[i] > 1e-9)


def test_a_hot_group_is_divided(spark):
    docs = spark.createDataFrame([(i, "same text" if i % 2 else f"text {i} " * 3) for i in range(4000)], "doc_id long, text string")
    found = rows(sharding.shard_by_bytes(docs, shards=10))
    size = {}
    for r in found:
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    mean = sum(size.values()) / 10
    assert len(size) == 10 and all(abs(s / mean - 1) < 0.02 for s in size.values())


# --- Licences ------------------------------------------------------------------------------

MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy of this software.

The above copyright notice and this permission notice shall be included in all copies.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted:
 * Redistributions of source code must retain the above copyright notice.
 * Redistributions in binary form must reproduce the above copyright notice.
 * Neither the name may be used to endorse or promote products derived from this software."""


def test_licence_rules(spark, odd_docs, no_docs):
    texts = [MIT, BSD3, "Prose.\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License. Later: licensed under CC BY-NC 4.0.", "A licence of my own.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in rows(licenses.scan_licenses(docs))}
    assert [found[i]["licenses"] for i in range(7)] == ["MIT", "BSD-3-Clause", "Apache-2.0", "MIT|CC-BY-NC-4.0", "", "", ""]
    assert found[4]["unmatched"] == 1 and found[5]["n_sentences"] == 0
    assert licenses.scan_licenses(odd_docs).count() == odd_docs.count() and licenses.scan_licenses(no_docs).count() == 0


def test_licence_scan_equals_its_sql(spark, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = c.sql(licenses.oracle()).fetchall()
    got = licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
