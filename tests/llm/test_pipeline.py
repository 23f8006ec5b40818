"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline as cp
from lumenframe.llm import decontaminate, ngram_join, pii, toxicity


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf_dir)
        assert docs.columns == before.columns, name
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        was = {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.train(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert ids == {r["doc_id"] for r in toxicity.score(before, model).where("predicted = 0").collect()}
        elif name == "near duplicates":
            assert ids == {r["component_id"] for r in ngram_join.jaccard_components(before).collect()}
        elif name == "benchmark leaks":
            assert was - ids == {r["doc_id"] for r in decontaminate.leaks(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
        else:
            old = {r["doc_id"]: r["text"] for r in before.collect()}
            assert all(r["text"] == pii.redacted(old[r["doc_id"]], pii.spans(old[r["doc_id"]])) and r["n_chars"] == len(r["text"]) for r in docs.collect())
    last = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in last.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_rows_without_ids_and_repeats(spark, sf_dir):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0) for r in cp.drop_near_duplicates(spark, docs, sf_dir).collect())
    assert got == [0, 1, 3]
