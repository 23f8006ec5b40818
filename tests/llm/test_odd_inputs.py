"""Inputs that once broke an operator, and queries held against plain versions of themselves."""

import html
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import additive_ann, bloom_lm, ngram_join, packing, queries, substring_dedup
from lumenframe.llm.html_text import main_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>a<![foo[x]]>b", "ab"), ("<p>a<!&b>c", "ac"), ("<!DOCTYPE x [<!FOO>]><p>t", "t"), ("<p>x<!", "x"), ("<p>x<!--", "x"), ("<p>x<!--y-->z<!-->w<!--->v", "xzwv"), ("<p>x<a href='", "x"),
        ("<p>x</", "x"), ("<p>a < b &amp; c &#x41; <3", "a < b & c A <3"), ("<script>'<p>no'</script><p>yes", "yes"),
        ("<article><header><h1>T</h1></header><p>Words of an article.<p class=share-prices>Prices of shares fell.<div class=social-history><p>Its history is long.</div><div class=share-links><a>x</a></div><div id=comments><p>A reader says many words.</div></article>", "T\nWords of an article.\nPrices of shares fell.\nIts history is long."),
    ],
)
def test_malformed_and_marked_pages(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize("part", ["<a ", "<!--", "<![CDATA[", "<", "</", '<a href="', "<!doctype [", "<?", "&", "<p>", "<div>x", "<b><i>", "<b></i>", "<i><div><b></i>", "<li><address>"])
def test_long_markup_takes_linear_time(part):
    began = time.process_time()
    main_text(part * 20_000 + "<p>end")
    assert time.process_time() - began < 10


def test_pages_hold_their_articles(spark, sf_dir):
    """The test pages are regular: an article's headings and paragraphs are its text."""
    got = {r["page_id"]: r["text"] for r in queries.op10_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    for r in pages:
        article = re.search("(?s)<article[^>]*>(.*?)</article>", r["html"])[1]
        blocks = re.split(r"</?(?:h\d|p|li|ul|div)\b[^>]*>", article)  # some paragraphs have no end
        plain = [" ".join(html.unescape(re.sub("<[^>]*>", "", re.sub("<br[^>]*>", " ", b))).split()) for b in blocks]
        assert got[r["page_id"]] == "\n".join(p for p in plain if p), r["page_id"]
    assert len(got) == len(pages)


def test_language_model_of_many_short_texts(spark, tmp_path):
    path = str(tmp_path / "short")
    text = F.concat_ws(" ", *[F.concat(F.lit(f"w{i}x"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(400_000))) for i in range(6)], F.lit("and some words that all of them share"))
    spark.range(200_000).select(F.col("id").alias("doc_id"), text.alias("text")).coalesce(1).write.parquet(path)
    got = bloom_lm.score_texts(spark.read.parquet(path)).agg(F.count("*"), F.sum("n_tokens"), F.max("score")).first()
    assert got[0] == 200_000 and got[1] == 200_000 * 15 and got[2] < 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_neighbours_do_not_depend_on_batches(spark):
    rng = np.random.default_rng(1)
    table = vectors(spark, [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(1500, 8)))])
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    try:
        for rows in ("10000", "37"):
            spark.conf.set(key, rows)
            found.append(sorted(tuple(r) for r in additive_ann.nearest(table).collect()))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and len(found[0]) == 75 * 20


def test_neighbours_by_distance_and_of_unequal_lengths(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 2.0]), (1020, [3.0])]
    got = {}
    for r in additive_ann.nearest(vectors(spark, rows), k=5, measure="distance").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:5].tolist()) & {v for _, v, _ in found})
        assert all(abs(-s - d[v]) < 1e-9 for _, v, s in found)
    assert hits >= 0.9 * 5 * len(got)


WORDS = [" ".join(f"{c}{i}" for i in range(80)) for c in "pq"]


def test_passages_of_an_id_with_several_texts(spark):
    docs = spark.createDataFrame([(1, WORDS[0]), (1, WORDS[1]), (2, WORDS[0]), (3, WORDS[1])], "doc_id long, text string")
    for order in ("text", F.desc("text")):
        got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.passages(docs.coalesce(1).sortWithinPartitions("doc_id", order)).collect()}
        assert got == {(2, 1), (3, 1)}


def test_near_copies_without_ids_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:-1], "other"]
    lone = [f"v{i}" for i in range(60)]
    docs = spark.createDataFrame([(None, " ".join(near)), (5, " ".join(words)), (None, " ".join(lone)), (None, " ".join([*lone[:-1], "else"]))], "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect())
    assert got == {(None, 5): 1, (5, 5): 1, (None, None): 2}


def library_ids(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [[*e.ids, end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark, sf_dir):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    start, want = 0, set()
    for (i, _), ids in zip(docs, library_ids("byte_bpe_50k.json", [t for _, t in docs], 2), strict=True):
        want.add((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op5_token_files(spark, sf_dir).collect()} == want


def test_packing_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want, total = set(), 0
    for (i, _), ids in zip(docs, library_ids("word_bpe_49k.json", [t for _, t in docs], 0), strict=True):
        total += len(ids)
        want |= {(i, k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), crc(ids[2048 * k : 2048 * k + 2048])) for k in range(-(-len(ids) // 2048))}
    got = queries.op6_packing(spark, sf_dir).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    fill = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * -(-total // 2048) + 1


def test_pipeline_runs_whole(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        df = df.withColumns({c: F.lit("own") for c in ("score", "node", "component_id", "piece", "length", "pii", "item")}) if t == "documents" else df
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
        df.limit(0).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    plain = Counter(map(str, corpus_pipeline.run(spark, sf_dir).drop("sequence_id", "offset").collect()))
    clash = Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()))
    assert plain == clash and plain
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
