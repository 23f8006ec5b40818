"""A corpus pipeline of five stages: toxicity, near duplicates, benchmark leaks, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, ngram_join, packing, pii, toxicity
from lumenframe.llm.common import small_batches, without_ids, written
from lumenframe.llm.queries import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labels of these documents, does not reject."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Rows with a null id stay. Of rows that repeat both id and text one stays; rows of one id with
    different texts go together, if one of them belongs to another group.
    """
    small_batches(spark)
    groups = written(ngram_join.jaccard_components(docs), "groups")
    gone = groups.where("doc_id is not null and component_id != doc_id").select("doc_id").distinct()
    kept = without_ids(docs, gone)
    repeated = groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without_ids(kept, repeated).unionByName(again)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    small_batches(spark)
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind, and ``n_chars`` of the new text."""
    small_batches(spark)
    return pii.with_spans(docs, redact=True).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 ids."""
    small_batches(spark)
    return packing.pack(docs, "word_bpe_49k.json", end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("benchmark leaks", drop_leaks),
    ("personal data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The stages hash, tokenize and learn; tests hold them against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
