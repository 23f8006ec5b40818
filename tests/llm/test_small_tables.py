"""Every operator on nulls, empty and long texts, ties, repeated rows, extra columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import additive_ann, bloom_lm, decontaminate, html_text, ngram_join, packing, pii, substring_dedup, token_files, toxicity

WORDS = " ".join(f"word{i}" for i in range(70))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ROWS = [(1, WORDS), (2, WORDS), (2, WORDS), (3, None), (4, ""), (5, " \n\t "), (None, "a null id"), (6, LONG), (7, "one two"), (8, "One  TWO"), (9, "x" * 3000)]
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use themselves
    clash = {c: F.lit("own") for c in ("score", "predicted", "node", "label", "part", "length", "rank", "key", "bucket", "chunk", "train", "pii", "a", "b", "start", "count")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_ngram_join(docs, none):
    got = sorted(ngram_join.jaccard_components(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got] == [
        (1, 66, 1), (2, 66, 1), (2, 66, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 19_996, 6), (7, 1, 7), (8, 1, 7), (9, 1, 9), (None, 1, None)
    ]
    assert ngram_join.jaccard_components(none).count() == 0


def test_substring_dedup(docs, none):
    got = {(r["doc_id"], r["other_id"], r["first_word"], r["last_word"]) for r in substring_dedup.passages(docs).collect()}
    assert got == {(2, 1, 0, 69)}
    assert substring_dedup.passages(none).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(WORDS.split()[10:30])), (2, None), (3, "..."), (None, WORDS), (4, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (7, 4), (8, 4)}
    assert decontaminate.leaks(none, bench).count() == decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench).where("doc_id in (1, 2, 7, 8)").count() == 0
    assert decontaminate.without_leaks(docs, bench).where("doc_id is null").count() == 1


def test_language_model(docs, none):
    got = {(r["doc_id"], r["n_tokens"]) for r in bloom_lm.score_texts(docs).collect()}
    assert got == {(1, 71), (2, 71), (3, 1), (4, 1), (5, 1), (6, 20_001), (7, 3), (8, 3), (9, 2), (None, 4)}
    assert bloom_lm.score_texts(none).count() == 0


def test_toxicity(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (4, None), (77, 1)], "doc_id long, toxic int")
    for d in (docs, none):
        for y in (labels, labels.limit(0)):
            got = toxicity.score(d, toxicity.train(d, y))
            assert got.where("score between 0 and 1 and predicted = cast(score >= 0.7 as int)").count() == d.count()


def test_pii(docs, none):
    got = pii.digest(docs)
    assert got.count() == len(ROWS) and got.where("spans != ''").count() == 0
    assert pii.digest(none).count() == 0
    kept = pii.with_spans(docs, redact=True)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1


def test_token_files(docs, none):
    manifest = token_files.write_tokens(docs, "byte_bpe_50k.json")
    got = token_files.read_tokens(manifest).orderBy("start").collect()
    assert len(got) == len(ROWS) and got[0]["doc_id"] is None and got[0]["start"] == 0
    assert [r["start"] for r in got[1:]] == [r["start"] + r["n_tokens"] for r in got[:-1]]
    index = token_files.Index(manifest)
    assert len(index.get(2)) == 2 and index.get(4)[0].tolist() == [2] and index.get(12345) == []
    assert token_files.read_tokens(token_files.write_tokens(none, "byte_bpe_50k.json")).count() == 0


def test_packing(docs, none):
    got = packing.pack(docs, "word_bpe_49k.json", capacity=64, keep_ids=True).collect()
    fill = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0) and len(r["ids"]) == 4 * r["length"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 64 and len({(r["doc_id"]) for r in got}) == 10
    assert packing.pack(none, "word_bpe_49k.json").count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hi <b>there</b>"), (1, "u", "<p>Hi <b>there</b>"), (2, None, None), (3, "u", ""), (None, "u", "<div>"), (4, "u", "<p>" * 5000 + "deep")], "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(0, "", 0), (1, "Hi there", 8), (1, "Hi there", 8), (2, "", 0), (3, "", 0), (4, "deep", 4)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_nearest(spark):
    bad = [(20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 5.0]), (2, [1.0, 5.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, []), (None, [9.0, 9.0]), (9, [2.0, 3.0]), (40, None)]
    v = spark.createDataFrame(bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in additive_ann.nearest(v).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 2.0), (20, 2, 9, 2.0), (20, 3, 2, 1.0)]
    assert additive_ann.nearest(v.limit(0)).count() == 0
