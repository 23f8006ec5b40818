"""Runs without nuclei: the objects of each stain channel are the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.config import Config, StainConfig
from lumenframe.operators import features, metrics, outliers, segmentation, spatial
from lumenframe.runtime import written

PARTICLE = ["sample_id", "stain", "label_id"]


def sample_metrics(particles: DataFrame, images: DataFrame, axes: DataFrame, word: str, unit: str, flat: bool = True) -> DataFrame:
    """(sample_id, metric, value): ``stain_<stem>_<measure>`` of particles; axes(sample_id, stain, label_id, ...) are theirs, and the alignment is null below two."""
    m = metrics.particle_measures(particles, images, f"{word}_{unit}")
    names = {"particle_count": "particle_count", "total": f"{word}_total_{unit}", "mean": f"{word}_mean_{unit}", "sem": f"{word}_mean_{unit}_sem", "coverage": "coverage_fraction_image", "nuclear_alignment": "alignment"}
    aligned = spatial.order(axes.join(particles.select(*PARTICLE), PARTICLE, "left_semi"), flat, ("sample_id", "stain"))
    wide = m.join(aligned, ["sample_id", "stain"], "left").select("sample_id", "stain", *[F.col(c).alias(n) for c, n in names.items()])
    long = metrics.long_metrics(wide, ["sample_id", "stain"], list(names.values()))
    return long.select("sample_id", F.concat(F.lit("stain_"), "stain", F.lit("_"), "metric").alias("metric"), "value")


def analyse_particles(
    pixels: DataFrame, config: Config, flat: bool = True, type_max: Mapping[str, float] | None = None, given: Mapping[str, DataFrame] | None = None, calibration: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Tables of a run over pixels(sample_id, channel, z, y, x, v) by the configuration's active stains.

    ``particles`` numbers the objects of a sample through its stains in the order of the roles
    (cell_id) and in each stain by place (label_id), with the format's columns in its order. A sample
    that lacks a stain's channel has no row for it; size outliers drop themselves from the second tier.
    """
    from lumenframe.plans.batch import scales, stain_objects

    stems, given = config.stain_stems(), given or {}
    if not stems:
        raise ValueError("a run needs a nuclear or a stain channel")
    scale = written(scales(pixels, config, calibration, flat), "scales")
    word, unit = ("area", "um2") if flat else ("volume", "um3")
    channels = list(config.channel_roles)
    out, every, axes = {}, None, None
    for order, stem in enumerate(stems):
        s, own = config.stains.get(stem, StainConfig()), pixels.where(F.col("channel") == stem)
        found = given[f"stain:{stem}"].select(*segmentation.PLACE, "label") if f"stain:{stem}" in given else stain_objects(own, s, config.edge_margin, flat)
        labels = written(segmentation.relabelled(found, found.select("sample_id", "label").distinct()), "particles")
        out[f"labels_stain_{stem}"] = labels
        rows = features.object_features(labels, pixels, stem, channels, scale, flat, integer=True if stem in (type_max or {}) else None)
        names = features.shown(rows.columns, channels, stem)
        rows = rows.select("sample_id", F.col("label").alias("label_id"), F.lit(stem).alias("stain"), F.lit(order).alias("_order"), "n_px", *[F.col(f"`{c}`") for c in names])
        every = rows if every is None else every.unionByName(rows, allowMissingColumns=True)
        one = spatial.axes(labels, flat, scale).withColumnRenamed("label", "label_id").withColumn("stain", F.lit(stem))
        axes = one if axes is None else axes.unionByName(one)
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("_order", "label_id")).cast("long")
    listed = features.shown(every.columns, channels, None)
    every = written(every.withColumn("cell_id", number).select("sample_id", "cell_id", "stain", "label_id", "n_px", *[f"`{c}`" for c in listed]), "particle-rows")
    particles, axes = every.drop("n_px"), written(axes, "axes")
    images = pixels.where(F.col("channel").isin(stems)).groupBy("sample_id", F.col("channel").alias("stain")).agg(F.count("*").alias("image_px"))
    sizes = every.select("sample_id", F.concat(F.lit("stain:"), "stain").alias("channel"), "cell_id", F.col(f"{word}_{unit}").alias("size"))
    screened = written(outliers.screened(sizes, ["sample_id", "channel"], config.outlier_mad_threshold), "screened")
    tiers = {"all": every}
    if config.remove_outliers:
        tiers["outlier_removed"] = written(outliers.outlier_tier(every, screened, ["sample_id", "cell_id"]), "outlier-removed")
        out["particles_outlier_removed"] = tiers["outlier_removed"].drop("n_px")
    qc, long = metrics.channel_qc_bands(pixels, config.bands(), type_max), None
    for tier, t in tiers.items():
        m = sample_metrics(t, images, axes, word, unit, flat).unionByName(metrics.qc_rows(qc)).withColumn("tier", F.lit(tier))
        long = m if long is None else long.unionByName(m)
    summary = outliers.screen_summary(screened, ["sample_id", "channel"], "cell_id")
    if not flat:
        out["depth"] = features.depth_profiles(pixels, {f"stain_coverage:{s}": out[f"labels_stain_{s}"] for s in stems}, scale)
    return {"particles": particles, "metrics": long, "outliers": summary, "qc": qc, "scales": scale} | out
