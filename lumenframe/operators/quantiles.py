"""Exact quantiles of groups of any size: counts of values, then histograms over ever smaller ranges around the asked ranks. No group is sorted whole in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.runtime import written

SORTED = 10_000  # distinct values of a group that one task may sort
FEW = 50_000  # so many rows about groups are sent to every task; a join by few groups would sort each group's rows in one
BINS = 4096


def matched(d: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join in which null groups match. A written ``other`` of up to FEW rows is broadcast, so that the rows of ``d`` stay where they are."""
    hint = ("broadcast" if other.count() <= FEW else "merge") if hasattr(other, "_written_to") else None
    renamed = other.select(*[F.col(c).alias(f"_{c}_") if c in on else F.col(c) for c in other.columns])
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return d.join(renamed.hint(hint) if hint else renamed, condition, how).drop(*[f"_{c}_" for c in on])


def quantiles(d: DataFrame, by: list[str], value: Column, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``shares``): quantiles of the non-null values of each group, linear between ranks. Groups may be null, and any share of the rows; one without values is absent.

    Groups of few distinct values are ranked as they are. Of others each asked rank keeps a range of
    values that holds it: a round counts the range's values by BINS bins and goes on with the bin of
    the rank, from its least to its greatest value, until these are one.
    """
    counts = written(d.select(*by, value.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n")), "values")
    sizes = counts.groupBy(*by).agg(F.sum("_n").alias("_all"), F.count("*").alias("_kinds"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    sizes = written(sizes, "sizes")
    place = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), ((F.col("_all") - 1) * F.lit(float(p))).alias("at")) for n, p in shares.items()])).alias("_q")
    asked = sizes.select("*", place).select(*by, "_kinds", "_lo", "_hi", F.col("_q.name").alias("_name"), F.col("_q.at").alias("_at"))
    asked = asked.select("*", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    asked = written(asked, "ranks")
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_v"))
    few = written(sizes.where(F.col("_kinds") <= SORTED).select(*by, "_kinds"), "few")
    ranked = matched(counts, few, by).withColumn("_upto", upto)
    ranks = written(asked.select(*by, "_rank").distinct(), "ranks")
    found = matched(ranked, ranks, by).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))).select(*by, "_rank", "_v")
    open_ = asked.where(F.col("_kinds") > SORTED).select(*by, "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below")).distinct()
    open_ = written(open_, "ranges")
    while not open_.isEmpty():
        inside = matched(counts, open_, by).where("_v between _lo and _hi")
        bin_ = F.least(F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS), F.lit(BINS - 1))
        bins = inside.groupBy(*by, "_rank", "_below", bin_.alias("_bin")).agg(F.sum("_n").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        bins = bins.withColumn("_upto", F.col("_below") + F.sum("_n").over(Window.partitionBy(*by, "_rank").orderBy("_bin")))
        hit = bins.where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n"))).select(*by, "_rank", "_lo", "_hi", (F.col("_upto") - F.col("_n")).alias("_below"))
        hit = written(hit, "ranges")
        found = found.unionByName(hit.where("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_v")))
        open_ = written(hit.where("_lo < _hi"), "ranges")
    both = matched(asked.select(*by, "_name", "_at", "_rank"), found, [*by, "_rank"])
    part = F.col("_at") - F.floor("_at")
    low, high = F.min("_v"), F.max("_v")
    one = both.groupBy(*by, "_name").agg((low + (high - low) * F.first(part)).alias("_value"))
    return written(one.groupBy(*by).pivot("_name", list(shares)).agg(F.first("_value")), "quantiles")


def with_median(d: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """``d`` with the exact median of a value over the rows of each group; nulls don't count, groups may be null."""
    return matched(d, quantiles(d, by, value, {name: 0.5}), by, "left")
