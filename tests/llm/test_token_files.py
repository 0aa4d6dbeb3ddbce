"""Token ids in ORC files: the tokenizer's ids, order, starts, pruning, odd tables."""

import zlib

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quorumlab.llm import orcids, packing, queries

WORDS = P.path("word_bpe_49k.json")


def plain_ids(text):
    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_query_equals_the_tokenizer(spark, sf_dir):
    own, at, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = [*own.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.append((r.doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, queries.op11_token_files(spark, sf_dir).collect())) == want


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path / "odd")
    with_null = odd_docs.unionAll(odd_docs.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    orcids.write_token_ids(with_null, WORDS, path)
    found = sorted(orcids.read_token_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9]
    texts = {r.doc_id: r.text for r in odd_docs.collect()} | {None: odd_docs.where("doc_id = 1").first().text}
    at = 0
    for r in found:
        assert r.ids == plain_ids(texts[r.doc_id]) and (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    orcids.write_token_ids(no_docs, WORDS, str(tmp_path / "none"))
    assert orcids.token_digests(spark, str(tmp_path / "none")).count() == 0


def test_added_tokens_are_as_in_the_plain_call(spark, tmp_path):
    texts = ["hello <|endoftext|> world", "a<|startoftext|>b <|ENDOFTEXT|> c", "<|EndOfText|><|endoftext|>", "tail <|startoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    orcids.write_token_ids(docs, WORDS, str(tmp_path / "added"))
    assert {r.doc_id: r.ids for r in orcids.read_token_ids(spark, str(tmp_path / "added")).collect()} == {i: plain_ids(t) for i, t in enumerate(texts)}
    packed = packing.cut_pieces(docs, WORDS, 1, 4096).collect()
    assert {r.doc_id: (r.length, r.ids_crc32) for r in packed} == {i: (len(plain_ids(t)), crc(plain_ids(t))) for i, t in enumerate(texts)}


def test_a_wanted_id_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "many")
    docs = spark.range(0, 200_000, 10).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of "), F.col("id").cast("string")).alias("text"))
    orcids.write_token_ids(docs, WORDS, path, stripe_bytes=1 << 16, index_rows=1000)

    def scanned(doc_ids):
        found = orcids.read_token_ids(spark, path, doc_ids)
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        text = plan.toString()
        nodes, counts = [plan.finalPhysicalPlan() if text.startswith("AdaptiveSparkPlan") else plan], []
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Scan orc") and "ids" in node.simpleString(1000).split("ReadSchema")[1]:
                counts.append(node.metrics().apply("numOutputRows").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if "QueryStage" in node.nodeName():
                nodes.append(node.plan())
        return rows, counts, text

    rows, counts, text = scanned([77_770])
    assert [r.doc_id for r in rows] == [77_770] and rows[0].start > 0 and "PushedFilters: [In(doc_id" in text or "EqualTo(doc_id,77770)" in text
    assert counts and counts[0] <= 2000
    absent, none, _ = scanned([77_775])  # within the statistics' bounds, but not in any Bloom filter but by chance
    assert absent == [] and none[0] <= 1000
