"""Touching objects of flat images: their score, their parts, and segmentation that splits them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import features, hull, segmentation
from lumenframe.operators.quantiles import with_median
from lumenframe.operators.segmentation import OBJECT, PLACE
from lumenframe.runtime import written


def scores(labels: DataFrame) -> DataFrame:
    """(sample_id, label, area, score) of flat objects; areas compare with the median of the sample's objects."""
    shape = features.ellipse(labels, OBJECT).join(features.perimeter(labels, OBJECT).hint("merge"), OBJECT, "left").join(hull.convexity(labels).hint("merge"), OBJECT)
    shape = with_median(written(shape, "shapes"), ["sample_id"], F.col("area"), "median_area")
    circ = features.circularity(F.col("area"), F.col("perimeter"))
    return shape.select(*OBJECT, "area", features.doublet_score(circ, F.col("solidity"), F.col("eccentricity"), F.col("area"), F.col("median_area")).alias("score"))


def split(labels: DataFrame, frame: DataFrame, threshold: float, min_distance: int = 80, min_size: int = 0) -> DataFrame:
    """``labels`` of flat images with dense ones: whole objects first, by label, then those scored above ``threshold``, by label and part.

    Parts under ``min_size`` pixels vanish; an object above the threshold that does not come apart stays whole.
    """
    labels = written(labels.select(*PLACE, "label"), "whole")
    scored = written(scores(labels).select(*OBJECT, (F.col("score") > threshold).alias("twin")), "scores")
    twins = scored.where("twin")
    parts = labels.join(scored.where("not twin").hint("merge"), OBJECT, "left_semi").withColumns({"twin": F.lit(0), "part": F.lit(1).cast("long")})
    if not twins.isEmpty():
        cut = segmentation.split_doublets(labels.join(twins.hint("merge"), OBJECT, "left_semi"), frame, min_distance)
        parts = parts.unionByName(cut.select(*PLACE, "label", F.lit(1).alias("twin"), F.col("part").cast("long").alias("part")))
    parts = written(parts, "parts")
    key = [*OBJECT, "twin", "part"]
    size = parts.groupBy(*key).agg(F.count("*").alias("n")).withColumn("several", F.count("*").over(Window.partitionBy(*OBJECT)) > 1)
    kept = size.where(~F.col("several") | (F.col("n") >= min_size))
    dense = kept.select(*key, F.row_number().over(Window.partitionBy("sample_id").orderBy("twin", "label", "part")).cast("long").alias("new"))
    return parts.join(dense.hint("merge"), key).select(*PLACE, F.col("new").alias("label"))


def segment(pixels: DataFrame, low: float, high: float, connectivity: int, min_size: int = 0, margin: int = 0, flat: bool = True, threshold: float = 0.7, min_distance: int = 80) -> DataFrame:
    """Objects of a band, filled, filtered by size and border, in flat images split where they touch; labels are dense from 1."""
    found = segmentation.candidates(pixels, low, high, connectivity, min_size, margin, flat)
    if flat:
        return split(found, pixels, threshold, min_distance, min_size)
    return segmentation.relabelled(found, found.select(*OBJECT).distinct())
