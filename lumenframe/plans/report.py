"""Views of a batch's quality report, a table each, over the tables of a run or of saved runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import metrics, outliers

TIERS = {"n_cells": "cells", "n_filtered": "cells_filtered", "n_kept": "cells_outlier_removed"}


def samples(run: dict[str, DataFrame]) -> DataFrame:
    """One row a sample: its calibration, the cells of each tier, and the share of rows with a cytoplasm where the run has one."""
    out = run["scales"]
    for name, tier in TIERS.items():
        if tier in run:
            out = out.join(run[tier].groupBy("sample_id").agg(F.count("*").alias(name)), "sample_id", "left").fillna(0, [name])
    if "cells" in run and "C_intensity_mean" in run["cells"].columns:
        out = out.join(metrics.completeness(run["cells"], ["sample_id"], F.col("nuclei_in_cell").isNotNull()).select("sample_id", "complete"), "sample_id", "left")
    return out


def acquisition(run: dict[str, DataFrame]) -> DataFrame:
    """Each channel's quality by sample, against the channel's median over the batch."""
    from lumenframe.operators.quantiles import with_median

    d = with_median(run["qc"], ["channel"], F.col("mean"), "batch_median")
    return d.withColumn("relative", F.col("mean") / F.nullif("batch_median", F.lit(0.0)))


def removal(run: dict[str, DataFrame]) -> DataFrame:
    """(sample_id, rate, limit, high): percentage of the filtered cells that the size screen removes, and whether it is high for the batch."""
    s = samples(run)
    rate = 100.0 * (F.col("n_filtered") - F.col("n_kept")) / F.nullif("n_filtered", F.lit(0))
    return outliers.batch_flags(s.select("sample_id", rate.alias("rate")))


def cell_boxes(run: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Quartiles and whiskers of columns of cells by sample: (sample_id, column, q1, median, q3, low, high)."""
    long = metrics.long_metrics(run["cells"], ["sample_id"], columns)
    return metrics.box(long, ["sample_id", "metric"], "value").withColumnRenamed("metric", "column")


def depth(run: dict[str, DataFrame]) -> DataFrame:
    """Depth curves of stacks, each against its own greatest value."""
    most = run["depth"].groupBy("sample_id", "series").agg(F.max("value").alias("most"))
    return run["depth"].join(most, ["sample_id", "series"]).withColumn("relative", F.col("value") / F.nullif("most", F.lit(0.0))).drop("most")


def views(run: dict[str, DataFrame], box_columns: list[str] | None = None) -> dict[str, DataFrame]:
    """All views that the run's tables allow."""
    out = {"samples": samples(run), "acquisition": acquisition(run), "outliers": run["outliers"]}
    if "cells_outlier_removed" in run:
        out |= {"removal": removal(run), "votes": run["outlier_votes"]}
    if "cells" in run:
        out["boxes"] = cell_boxes(run, box_columns or [c for c in ("N_area_um2", "N_volume_um3", "N_intensity_mean") if c in run["cells"].columns])
    if "depth" in run:
        out["depth"] = depth(run)
    return out
