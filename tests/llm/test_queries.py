"""The registered queries themselves: columns, folds and digests that their contracts fix."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from quorumlab.llm import queries
from quorumlab.llm.chunks import read_ranks


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def fold(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def test_op1_folds_and_accuracy(spark, sf_dir, docs):
    found = queries.op1_language_id(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.held_out and docs[r.doc_id].lang]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)


def test_op2_folds_and_scores(spark, sf_dir, docs):
    found = queries.op2_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)


def test_op4_law_and_slots(spark, sf_dir, docs):
    found = queries.op4_sharding(spark, sf_dir).collect()
    slots = {}
    for r in found:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None) and 0 <= r.shard < 40
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(found) == len(docs) and all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_op5_digests_equal_tiktoken(spark, sf_dir, docs):
    ranks = read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in queries.op5_byte_bpe(spark, sf_dir).collect():
        ids = own.encode_ordinary(docs[r.doc_id].text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(own.decode_bytes(ids)).hexdigest()


def test_op6_pieces_equal_the_tokenizer(spark, sf_dir, docs):
    own, spans = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    pieces = {}
    for r in queries.op6_packing(spark, sf_dir).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(docs)
    for doc_id, mine in pieces.items():
        ids = np.array([*own.encode(docs[doc_id].text or "", add_special_tokens=False).ids, 1], "<u4")
        want = [(i, lo, len(ids[lo : lo + 4096]), zlib.crc32(ids[lo : lo + 4096].tobytes())) for i, lo in enumerate(range(0, len(ids), 4096))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in mine) == want
    for s in spans.values():
        s.sort()
        assert [o for o, _ in s] == np.cumsum([0, *(n for _, n in s)])[:-1].tolist() and sum(n for _, n in s) <= 4096


def test_op7_fingerprints_are_hex(spark, sf_dir, docs):
    for r in queries.op7_simhash(spark, sf_dir).collect():
        w = (docs[r.doc_id].text or "").encode().lower().split()
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fingerprint == f"{want:016x}" and r.component_id <= r.doc_id


def test_op10_recall_and_scores(spark, sf_dir):
    got = {}
    for r in queries.op10_ann(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r)
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    assert set(got) == {i for i in rows if i % 100 == 0}
    hits = wanted = 0
    for q, found in got.items():
        d = sorted((float(np.sqrt(((v - rows[q]) ** 2).sum())), i) for i, v in rows.items() if i != q)[:10]
        assert [r.rank for r in found] == list(range(1, len(d) + 1))
        assert all(r.score == pytest.approx(float(np.sqrt(((rows[r.vec_id] - rows[q]) ** 2).sum())), abs=1e-12) for r in found)
        hits, wanted = hits + len({r.vec_id for r in found} & {i for _, i in d}), wanted + len(d)
    assert hits >= 0.9 * wanted


def test_the_other_queries_cover_their_tables(spark, sf_dir, docs):
    assert queries.op3_token_counts(spark, sf_dir).count() == queries.op9_licenses(spark, sf_dir).count() == len(docs)
