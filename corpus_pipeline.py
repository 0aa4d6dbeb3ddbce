"""The corpus pipeline: identified, not toxic, without near copies, packed.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a DataFrame, which run()
writes as Parquet and reads again as the next one's docs. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quorumlab.llm import langid, nearcopies, packing, toxicity
from quorumlab.llm.chunks import vocabulary_path
from quorumlab.session import bound_batches, remove_folder, shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; texts without a letter and those unlike any language go."""
    bound_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier doesn't find toxic."""
    bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group of near copies: Jaccard similarity of five-word shingles from 0.8, chained.

    SimHash blocks give the first candidates; see nearcopies for those that no blocks can give.
    """
    bound_batches(spark)
    return nearcopies.drop_jaccard_copies(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of 4096 tokens."""
    bound_batches(spark)
    return packing.pack_documents(docs, vocabulary_path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", remove_toxic),
    ("near_copies", remove_near_copies),
    ("packing", pack_sequences),
]

#: Trained models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet in the shared folder and read again.

    A stage's table is removed once the next one has been written; the last one stays, as it is the result.
    """
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
