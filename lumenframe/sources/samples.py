"""Samples from a folder of image files: their pixels, labels made elsewhere, calibration and unreadable files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.config import Config
from lumenframe.runtime import written
from lumenframe.sources import discovery, readers


class Samples(NamedTuple):
    pixels: DataFrame
    calibration: DataFrame
    unreadable: DataFrame


def load(spark: SparkSession, root: str, config: Config) -> Samples:
    """All samples below ``root`` in the configured input mode.

    ``sample_id`` is the sample's folder (for a file, its path without extension), which no other
    sample has; ``calibration`` adds its name, the first pixel size, plane distance and unit that its files
    state, by channel name, and whether any is a stack; ``batch.analyse`` takes it as it is. Each image stem of a folder is a
    channel, or several where the file bundles them (stem_c0, stem_c1); an image that is a sample by
    itself has the channels c0, c1. Only headers are read to find samples, and only their
    own blocks for pixels. Files that cannot be read give no pixels and are in ``unreadable`` with their error.
    """
    files = written(discovery.channels(discovery.listing(spark, root)), "images")
    heads = written(readers.headers(files).join(files.select("path", "dir", "stem"), "path"), "headers")
    virtual = heads.select("path", "dir", "stem", "error", F.explode_outer("channels").alias("suffix"))
    by_folder = virtual.select("*", F.concat("stem", F.coalesce("suffix", F.lit(""))).alias("channel"))
    roots = written(discovery.samples_of(by_folder, config), "samples")
    if config.input_mode == "folder_per_sample" or config.input_mode != "file_per_sample" and not roots.isEmpty():
        named = by_folder.join(roots, "dir").select(F.col("dir").alias("sample_id"), F.col("sample_id").alias("name"), "channel", "path", "suffix", "error")
    else:
        own = virtual.where(F.regexp_extract("dir", "([^/]*)$", 1) != discovery.RESULTS)
        bare = F.when(F.coalesce("suffix", F.lit("")) == "", F.lit("c0")).otherwise(F.regexp_replace("suffix", "^_", ""))
        named = own.select(F.concat_ws("/", "dir", "stem").alias("sample_id"), F.col("stem").alias("name"), bare.alias("channel"), "path", "suffix", "error")
    first = Window.partitionBy("sample_id", "channel").orderBy("path")
    named = written(named.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n"), "channels")
    rows = readers.pixels(heads.drop("dir", "stem").join(named.where("error is null").select("path").distinct(), "path", "left_semi"))
    pixels = rows.join(named.select("sample_id", "channel", "path", "suffix"), ["path", "suffix"]).select("sample_id", "channel", "z", "y", "x", "v")
    known = named.join(heads.select("path", "px", "pz", "unit", "is_3d"), "path")
    of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("channel"))).alias(c)
    calibration = known.groupBy("sample_id", "name").agg(of("px"), of("pz"), of("unit"), F.coalesce(F.bool_or("is_3d"), F.lit(False)).alias("is_3d"))
    return Samples(pixels, calibration, named.where("error is not null").select("sample_id", "channel", "path", "error"))


def labels(spark: SparkSession, root: str, stem: str) -> DataFrame:
    """Label relation (sample_id, z, y, x, label) of the image ``stem`` of each folder, or of its folder of results; sample_id is the folder, 0 is no object."""
    files = written(discovery.channels(discovery.listing(spark, root)).where(F.col("stem") == stem), "label-files")
    inner = F.regexp_extract("dir", "([^/]*)$", 1) == discovery.RESULTS
    owner = F.when(inner, F.regexp_replace("dir", "/[^/]*$", "")).otherwise(F.col("dir"))
    best = Window.partitionBy("sample_id").orderBy("inner", "path")
    chosen = files.select("path", owner.alias("sample_id"), inner.alias("inner")).withColumn("_n", F.row_number().over(best)).where("_n = 1").select("path", "sample_id")
    rows = readers.pixels(readers.headers(chosen).where("error is null"))
    return rows.where("v > 0").join(chosen, "path").select("sample_id", "z", "y", "x", F.col("v").cast("long").alias("label"))
