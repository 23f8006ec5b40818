"""Samples and channels from a listing of files (path, as Spark's readers list them)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.config import Config
from lumenframe.sources import readers

RESULTS = "Analysis"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")


def images(files: DataFrame) -> DataFrame:
    """(dir, name, stem, ext, path) of image files; a name's extension counts in any case."""
    parts = files.select("path", F.regexp_extract("path", "^(.*)/([^/]*)$", 1).alias("dir"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"))
    return parts.select("path", "dir", "name", F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("ext")).where(F.col("ext").isin(*readers.extensions()))


def channels(files: DataFrame) -> DataFrame:
    """One image for each folder and stem: by the order of the readers' extensions (.tif before .tiff), then by name."""
    w = Window.partitionBy("dir", "stem").orderBy(F.array_position(F.array(*[F.lit(e) for e in readers.extensions()]), F.col("ext")), "name")
    return images(files).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def folder_samples(files: DataFrame, config: Config) -> DataFrame:
    """(sample_id, dir): folders that hold the primary channel, result folders left out."""
    return samples_of(channels(files).withColumnRenamed("stem", "channel"), config)


def samples_of(found: DataFrame, config: Config) -> DataFrame:
    """(sample_id, dir): folders of found(dir, channel) that hold the primary channel, result folders left out."""
    primary = found.where((F.col("channel") == F.lit(config.primary_stem())) & (F.regexp_extract("dir", "([^/]*)$", 1) != RESULTS)).select("dir").distinct()
    return primary.select(F.regexp_extract("dir", "([^/]*)$", 1).alias("sample_id"), "dir")


def file_samples(files: DataFrame) -> DataFrame:
    """(sample_id, dir, path): each image is a sample with its results beside it."""
    found = channels(files).where(F.regexp_extract("dir", "([^/]*)$", 1) != RESULTS)
    return found.select(F.col("stem").alias("sample_id"), F.concat_ws("/", "dir", "stem").alias("dir"), "path")


def samples(files: DataFrame, config: Config) -> DataFrame:
    """Samples in the configured input mode; ``auto`` tries folders first."""
    if config.input_mode == "file_per_sample":
        return file_samples(files)
    found = folder_samples(files, config)
    if config.input_mode == "folder_per_sample" or not found.isEmpty():
        return found
    return file_samples(files)
