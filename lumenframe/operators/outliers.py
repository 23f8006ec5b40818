"""Size outliers by robust z of the log size, with one vote a channel, and the tiers they make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.quantiles import with_median

NORMAL = 0.6745  # fixed value: quartile of the standard normal
MAD_SIGMA = 1.4826  # fixed value: its inverse


def robust_z(objects: DataFrame, by: list[str], size: str = "size") -> DataFrame:
    """``objects`` with lg, med, mad and z; null for sizes of 0 or less and where the deviation is 0."""
    s = F.col(size).cast("double")
    d = with_median(objects.withColumn("lg", F.when(s > 0, F.log10(s))), by, F.col("lg"), "med")
    d = with_median(d, by, F.abs(F.col("lg") - F.col("med")), "mad")
    return d.withColumn("z", NORMAL * (F.col("lg") - F.col("med")) / F.nullif("mad", F.lit(0.0)))


def screened(objects: DataFrame, by: list[str], threshold: float = 4.0, size: str = "size") -> DataFrame:
    return robust_z(objects, by, size).withColumn("flagged", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def screen_summary(flagged: DataFrame, by: list[str], owner: str) -> DataFrame:
    """Per channel: objects, flagged ones, their rate, cells they flag, median size, deviation and range of z."""
    f = F.col("flagged")
    return flagged.groupBy(*by).agg(
        F.count("*").alias("n_objects"), F.sum(f.cast("long")).alias("n_objects_flagged"), F.avg(f.cast("int")).alias("flag_rate"),
        F.countDistinct(F.when(f, F.col(owner))).alias("n_cells_flagged"), F.pow(F.lit(10.0), F.first("med")).alias("median_size"), F.first("mad").alias("mad_log10"),
        F.min("z").alias("z_min"), F.max("z").alias("z_max"),
    )


def votes(flagged: DataFrame, owner: list[str]) -> DataFrame:
    """Cells that any channel flags."""
    return flagged.where("flagged").select(*owner).where(F.col(owner[-1]).isNotNull()).distinct()


def outlier_tier(kept: DataFrame, flagged: DataFrame, owner: list[str]) -> DataFrame:
    """The filtered cells without flagged ones; the screen's statistics are those of all objects."""
    return kept.join(votes(flagged, owner), owner, "left_anti")


def removed_by_channel(kept: DataFrame, flagged: DataFrame, by: list[str], owner: list[str]) -> DataFrame:
    """(by, n): of the filtered cells, those that each channel flags; channels overlap, so the numbers need not add up to the removals."""
    own = flagged.where("flagged").join(kept.select(*owner), owner, "left_semi")
    return own.groupBy(*by).agg(F.countDistinct(owner[-1]).alias("n"))


def batch_flags(samples: DataFrame, rate: str = "rate") -> DataFrame:
    """Samples with the batch limit of the rate, median + 3 scaled deviations, and whether each exceeds it; null limits under 3 rates or without spread."""
    d = with_median(samples, [], F.col(rate), "med").crossJoin(samples.agg(F.count(rate).alias("n")))  # one row
    d = with_median(d, [], F.abs(F.col(rate) - F.col("med")), "mad")
    limit = F.when((F.col("n") >= 3) & (F.col("mad") > 0), F.col("med") + 3 * MAD_SIGMA * F.col("mad"))
    return d.withColumn("limit", limit).withColumn("high", F.coalesce(F.col(rate) > F.col("limit"), F.lit(False))).drop("med", "n", "mad")
