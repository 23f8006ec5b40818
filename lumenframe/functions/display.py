"""Values for showing images: greys of an intensity range and colours of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLOURS = 255


def normalised(pixels: DataFrame, by: tuple[str, ...] = ("sample_id", "channel")) -> DataFrame:
    """``pixels`` with ``grey``, 0 to 255 over the range of each image; 0 where it has one value."""
    ends = pixels.groupBy(*by).agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    grey = F.when(hi > lo, F.floor((F.col("v") - lo) * 255 / (hi - lo))).otherwise(0)
    return pixels.join(ends, list(by)).withColumn("grey", grey.cast("int")).drop("_lo", "_hi")


def colour(label: Column) -> Column:
    """Place of a label in a table of 256 colours; the background has the first."""
    return F.when(label == 0, 0).otherwise(label % COLOURS + 1).cast("int")
