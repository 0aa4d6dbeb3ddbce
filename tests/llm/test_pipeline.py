import corpus_pipeline
from quorumlab.llm import queries


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(packed.columns)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert 0.5 * before < len(ids) < before and len({texts[i] for i in ids}) == len(ids)


def test_packing_of_the_pipeline_is_whole(spark, sf_dir):
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    spans = {}
    for r in packed:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in spans.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 4096


def test_pipeline_over_odd_and_no_documents(spark, tmp_path, odd_docs, no_docs):
    for i, docs in enumerate((odd_docs, no_docs)):
        folder = f"{tmp_path}/{i}"
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder)
        assert {r.doc_id for r in packed.collect()} <= {r.doc_id for r in docs.collect()}


def test_every_operator_has_a_query():
    names = sorted(queries.queries(), key=lambda x: int(x[2:].split("_")[0]))
    assert [int(x[2:].split("_")[0]) for x in names] == list(range(1, 14))
