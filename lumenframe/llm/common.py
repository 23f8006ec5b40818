"""Shared folder, materialisation and small column helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.wordhash import release

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset a folder of our own, in local mode only, as other executors would not see it."""
    path = spark.conf.get(CHECKPOINT_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set(CHECKPOINT_KEY, path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    release()  # what the driver took for sending and collecting before
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session hold at most BATCH_ROWS rows: buffers of whole texts stay small on both sides, and allocators keep what was once taken."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 1_000_000  # ids of 8 bytes; more of them are joined by a shuffle


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids(doc_id)``; null ids stay. The ids are broadcast up to BROADCAST_ROWS."""
    ids = written(ids.select(F.col("doc_id").cast("long").alias("doc_id")), "ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_anti").select(docs.columns)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read; null text becomes empty, other columns are ignored."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
