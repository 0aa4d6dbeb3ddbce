"""The registered queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quorumlab.llm import annforest, bytebpe, hamming, langid, licenses, orcids, packing, sharding, simhash, tokencount, toxicity, vectorcodes, whitening
from quorumlab.llm.chunks import vocabulary_path
from quorumlab.llm.vectors import release
from quorumlab.session import cut, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: int):
    """crc32 of doc_id as text, modulo `of`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify_documents(docs, langid.fit(docs.where(fold(4) != 2)))
    return found.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score_documents(docs, toxicity.fit(docs.where(fold(5) != 0), labels.where(fold(5) != 0)))
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    return bytebpe.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_multi_50k.tiktoken"), PATTERN)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op8_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    asked = codes.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "code")
    return hamming.hamming_top_k(codes, asked, k=10)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return annforest.nearest(vectors, asked, k=10)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark).rstrip('/')}/token-ids-{uuid.uuid4().hex}"
    orcids.write_token_ids(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), path, end_id=1)
    found = cut(orcids.token_digests(spark, path))
    release(found, path)
    return found


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return whitening.whiten(rows, whitening.fit_whitening(rows, most=16))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress_vectors(table(spark, sf_dir, "embeddings"), label="label", parts=4, entries=256, rounds=4)
    found = vectorcodes.with_label_error(coded).withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
    return found.select(F.col("id").alias("vec_id"), vectorcodes.hex_code(F.col("code")).alias("code"), "error", "label_error", "codebooks_sha256")


REGISTERED = (
    op1_language_id, op2_toxicity, op3_token_counts, op4_sharding, op5_byte_bpe, op6_packing, op7_simhash, op8_hamming_top_k, op9_licenses, op10_ann,
    op11_token_files, op12_whitening, op13_vector_codes,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in REGISTERED}


#: Codes of 64 components are their signs, so a distance counts the components whose signs differ.
HAMMING_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS s FROM embeddings WHERE embedding IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_sum(list_transform(range(1, len(e.s) + 1), lambda i: abs(q.s[i] - e.s[i])))::INT AS distance
  FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM r WHERE rank <= 10"""


def codes_sql(rounds: int = 4) -> str:
    """The rounds of operator 13 written out: a table of codebooks b and one of assignments a for each."""
    sql = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS v FROM e, (SELECT unnest(range(4)) AS part)),
b0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < 256)"""
    for k in range(rounds + 1):
        sql += f""",
a{k} AS MATERIALIZED (SELECT vec_id, label, part, any_value(v) AS v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT p.*, entry, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{k} b USING (part)) GROUP BY vec_id, label, part),
s{k} AS (SELECT part, entry, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{k}) GROUP BY ALL),
u{k} AS (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(u{k}.v, b{k}.v) AS v FROM b{k} LEFT JOIN u{k} USING (part, entry))"""
    return sql + f""",
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r, h"""


def oracle_sql() -> dict[str, str]:
    return {"op8_hamming_top_k": HAMMING_SQL, "op9_licenses": licenses.oracle(), "op13_vector_codes": codes_sql()}
