"""Objects that arrive over time: windowed summaries, and a result table that holds each object once, whenever and however often it comes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def object_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_summary(objects: DataFrame, time: str, value: str, by: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """n, mean and sum of a value by time window; rows later than ``late`` are left out."""
    w = F.window(time, window)
    return objects.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *by, "n", "mean", "total")


def stored(spark: SparkSession, results: str) -> DataFrame | None:
    """The result table, if there is one yet."""
    try:
        return spark.read.parquet(results)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def ingest(objects: DataFrame, results: str, checkpoint: str, key: Sequence[str] | None = None) -> StreamingQuery:
    """Add a stream's objects to ``results``, each once.

    An object is known by ``key`` (by default all its columns); later files may bring further objects of
    a sample, and what comes again, in the same batch, in another or after a restart without a
    checkpoint, adds nothing. A batch writes its own partition and replaces it when it is run again,
    so a batch that broke off leaves nothing behind. Null keys equal each other.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark, columns = batch.sparkSession, list(key or batch.columns)
        name = F.xxhash64(*columns).alias("_hash")
        new = batch.dropDuplicates(columns)
        known = stored(spark, results)
        run = f"{spark.sparkContext.applicationId}-{checkpoint_name(checkpoint)}-{number}"
        if known is not None:
            have = known.where(F.col(BATCH) != run).select(name, *[F.col(c).alias(f"_{c}") for c in columns])
            same = F.col("_hash") == F.xxhash64(*columns)
            for c in columns:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            new = new.join(have, same, "left_anti")
        writer = new.withColumn(BATCH, F.lit(run)).write.mode("overwrite").partitionBy(BATCH).option("partitionOverwriteMode", "dynamic")
        writer.parquet(results)

    return objects.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def checkpoint_name(checkpoint: str) -> str:
    """A checkpoint's own name, which batches of one stream share."""
    return checkpoint.rstrip("/").rsplit("/", 1)[-1].replace("=", "-")


def completed(results: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(sample_id) of samples of results(sample_id, channel, ...) all of whose ``channels`` have come; others wait for theirs."""
    met = results.where(F.col("channel").isin(list(channels))).groupBy("sample_id").agg(F.countDistinct("channel").alias("n"))
    return met.where(F.col("n") == len(set(channels))).select("sample_id")


def release(results: str, released: str, spark: SparkSession, channels: Sequence[str]) -> DataFrame:
    """Add to ``released`` the samples that are complete and not in it yet; the samples added, for a run to take up."""
    arrived = stored(spark, results)
    if arrived is None:
        return spark.createDataFrame([], "sample_id string")
    ready, known = completed(arrived, channels), stored(spark, released)
    new = ready if known is None else ready.join(known, "sample_id", "left_anti")
    before = [] if known is None else [r["at"] for r in known.agg(F.max("batch").alias("at")).collect()]  # one row
    number = (before[0] if before and before[0] is not None else 0) + 1
    new.withColumn("batch", F.lit(number)).write.mode("append").parquet(released)
    return spark.read.parquet(released).where(F.col("batch") == number).select("sample_id")
