"""A whole run: pixels of all samples to cells, tiers, metrics, quality views and folder summaries."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.config import Config, CytoplasmConfig, StainConfig
from lumenframe.functions import calibration as C
from lumenframe.operators import compartments, doublets, features, metrics, outliers, segmentation, spatial
from lumenframe.plans import particles
from lumenframe.runtime import written
from lumenframe.sources.pixels import from_arrays

__all__ = ["analyse", "from_arrays", "save", "scales", "summaries"]

CELL = ["sample_id", "cell_id"]


def scales(pixels: DataFrame, config: Config, calibration: DataFrame | None = None, flat: bool = True) -> DataFrame:
    """(sample_id, px, pz, px_source, pz_source): each sample's pixel size and, of stacks, plane distance.

    The configuration wins, then the file's of calibration(sample_id, px, pz), then 1 for a pixel and the pixel size for a plane.
    """
    samples = pixels.select("sample_id").distinct()
    if calibration is None:
        found = samples.withColumns({"f_px": F.lit(None).cast("double"), "f_pz": F.lit(None).cast("double")})
    else:
        found = samples.join(calibration.select("sample_id", F.col("px").cast("double").alias("f_px"), F.col("pz").cast("double").alias("f_pz")), "sample_id", "left")
    own, deep = F.lit(config.pixel_size_um).cast("double"), F.lit(config.z_size_um).cast("double")
    px = C.pixel_size(own, F.col("f_px"))
    pz = C.plane_distance(deep, F.col("f_pz"), px, F.lit(not flat))
    return found.select("sample_id", px.alias("px"), pz.alias("pz"), C.source(own, F.col("f_px")).alias("px_source"), F.when(F.lit(not flat), C.source(deep, F.col("f_pz"))).alias("pz_source"))


def cytoplasm_by_flood(nuclei: DataFrame, pixels: DataFrame, c: CytoplasmConfig, flat: bool = True, scale: DataFrame | None = None) -> DataFrame:
    """Cytoplasm of each nucleus, whose label it has: the filled band and the nuclei, flooded from the nuclei, without them.

    A membrane floods over the intensity, any other channel over the distance to the nearest nucleus,
    with planes as far apart as ``scale`` (sample_id, px, pz) says.
    """
    place = segmentation.PLACE
    band = segmentation.holes_filled(pixels.where(F.col("v").between(c.threshold_min, c.threshold_max)), pixels, flat)
    foreground = band.select(*place).unionByName(nuclei.select(*place)).distinct()
    if c.source == "membrane":
        height = pixels.select(*place, F.col("v").alias("height"))
    else:
        frame = pixels.select(*place).withColumn("aniso", F.lit(1.0))
        if scale is not None and not flat:
            frame = pixels.select(*place).join(scale.select("sample_id", (F.coalesce("pz", "px") / F.col("px")).alias("aniso")), "sample_id")
        off = pixels.select(*place).join(nuclei.select(*place), place, "left_anti")
        far = segmentation.distance(off, frame, flat, F.col("aniso"))
        height = pixels.select(*place).join(far, place, "left").select(*place, F.coalesce("d2", F.lit(0)).alias("height"))
    labels = segmentation.flooded(nuclei, foreground.join(height, place), "height", flat).join(nuclei.select(*place), place, "left_anti")
    if c.min_object_size > 0:
        labels = labels.join(segmentation.kept_objects(labels, pixels, c.min_object_size), segmentation.OBJECT, "left_semi")
    return labels


def stain_objects(pixels: DataFrame, s: StainConfig, margin: int, flat: bool) -> DataFrame:
    """Objects of a stain channel: pieces of its filled band, split where they touch if its output is labelled."""
    if s.output == "labeled":
        return doublets.segment(pixels, s.threshold_min, s.threshold_max, 2, s.min_object_size, margin, flat, s.doublet_threshold, s.watershed_min_distance)
    return segmentation.stain(pixels, s.threshold_min, s.threshold_max, s.min_object_size, margin, flat)


def analyse(
    pixels: DataFrame, config: Config, flat: bool = True, labels: dict[str, DataFrame] | None = None, type_max: dict[str, float] | None = None, calibration: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Tables of a run over pixels(sample_id, channel, z, y, x, v) of all samples at once.

    Without a nuclear channel or labels, those of ``particles.analyse_particles``. ``type_max`` holds
    the largest value of each integer channel's type, for the share of saturated pixels and for
    whole-number textures; ``calibration`` the pixel sizes that files state (see ``scales``).

    ``labels`` holds label relations made elsewhere, as ``nuclear``, ``cytoplasm`` or ``stain:<stem>``; a sample they
    lack is segmented here only if they are not given at all.

    ``cells`` and its tiers have cell_id, then the columns of nuclei (N_) and cytoplasm (C_) in the
    format's order, nuclei_in_cell and twelve columns a stain; ``objects`` all features of each
    object. Samples without a nucleus give no cells. An active stain whose channel a sample lacks gives zeros and false flags.
    """
    of = lambda stem: pixels.where(F.col("channel") == stem)
    given = labels or {}
    whole = lambda stem: True if stem in (type_max or {}) else None
    if config.stem("nuclear") is None and "nuclear" not in given:
        return particles.analyse_particles(pixels, config, flat, type_max, given, calibration)
    scale = written(scales(pixels, config, calibration, flat), "scales")
    word, unit = ("area", "um2") if flat else ("volume", "um3")
    voxel = F.col("px") * F.col("px") * (F.lit(1.0) if flat else F.coalesce("pz", "px"))
    place, channels = segmentation.PLACE, list(config.channel_roles)
    found = given["nuclear"].select(*place, "label") if "nuclear" in given else doublets.segment(
        of(config.stem("nuclear")), config.threshold_min, config.threshold_max, config.connectivity, config.min_object_size, config.edge_margin, flat, config.doublet_threshold, config.watershed_min_distance
    )
    nuclei = written(found, "nuclei")
    cyto_stem = config.cytoplasm_stem()
    cyto = None
    if "cytoplasm" in given:  # nuclei are cut out, labels stay
        cyto = written(given["cytoplasm"].select(*place, "label").join(nuclei, place, "left_anti"), "cytoplasm")
    elif cyto_stem:
        cyto = written(cytoplasm_by_flood(nuclei, of(cyto_stem), config.cytoplasm, flat, scale), "cytoplasm")
    mapping = compartments.adjacent_cytoplasm(nuclei, cyto, flat=flat) if cyto is not None else nuclei.select("sample_id", F.col("label").alias("nuc_id"), F.lit(None).cast("long").alias("cyto_id")).distinct()
    mapping = written(mapping, "mapping")

    described = {}
    for mark, part, stem in [("N", nuclei, config.stem("nuclear")), ("C", cyto, cyto_stem or config.stem("nuclear"))]:
        if part is not None:
            textured = mark == "N" or config.cytoplasm.source != "membrane"
            described[mark] = written(features.object_features(part, pixels, stem or "", channels, scale, flat, textured, whole(stem)), "features")
    size = f"{word}_{unit}"
    sized = {mark: f.select("sample_id", F.col("label").alias("id"), F.col(size).alias("size")) for mark, f in described.items()}

    objects = [sized["N"].select("sample_id", F.lit("nuclear").alias("channel"), F.col("id").alias("cell_id"), "size")]
    last = mapping.groupBy("sample_id", "cyto_id").agg(F.max("nuc_id").alias("cell_id"))
    if cyto is not None:
        objects.append(sized["C"].withColumnRenamed("id", "cyto_id").join(last, ["sample_id", "cyto_id"]).select("sample_id", F.lit("cytoplasm").alias("channel"), "cell_id", "size"))
    territory = written(compartments.territories(nuclei, cyto, mapping) if cyto is not None else nuclei.withColumnRenamed("label", "cell_id"), "territories")

    stems = config.stain_stems()
    stains, thresholds, arranged, masks = {}, {}, {}, {}
    for stem in stems:
        s = config.stains.get(stem, StainConfig())
        mask = written(given[f"stain:{stem}"].select(*place, "label") if f"stain:{stem}" in given else stain_objects(of(stem), s, config.edge_margin, flat), "stain")
        pieces = mask if s.output == "binary" and f"stain:{stem}" not in given else written(segmentation.components(mask, 2, flat), "pieces")
        regions = compartments.stain_by_regions(mask, {"N": nuclei} | ({"C": cyto} if cyto is not None else {}), flat=flat).join(scale, "sample_id")
        regions = written(regions.select("layer", "sample_id", "id", (F.col("stain_px") * voxel).alias("size"), F.col("pieces").alias("count"), F.col("stain_px").alias("px")), "regions")
        stains[stem] = tuple(regions.where(F.col("layer") == m).drop("layer") for m in "NC")
        thresholds[stem] = compartments.mean_particle_area(pieces, nuclei)
        arranged[stem] = written(spatial.stain_spatial(mask, nuclei, 1.0, flat), "arranged")
        owned = compartments.owners(pieces, territory).join(scale, "sample_id")
        objects.append(owned.select("sample_id", F.lit(f"stain:{stem}").alias("channel"), F.col("owner").alias("cell_id"), (F.col("size") * voxel).alias("size")))
        masks[stem] = mask
    every = objects[0]
    for o in objects[1:]:
        every = every.unionByName(o)
    every = written(every, "objects")

    table = compartments.cells(sized["N"], sized.get("C"), mapping, stains, thresholds, word, unit)
    table = table.withColumnsRenamed({"nuc_id": "cell_id"})
    columns = []
    for mark, key in (("N", "cell_id"), ("C", "cyto_id")):
        if mark in described:
            f = described[mark]
            names = features.shown(f.columns, channels, config.stem("nuclear") if mark == "N" else cyto_stem or config.stem("nuclear"))
            columns += [f"{mark}_{c}" for c in names]
            table = table.join(f.select("sample_id", F.col("label").alias(key), *[F.col(f"`{c}`").alias(f"{mark}_{c}") for c in names]), ["sample_id", key], "left")
    measured = [c for c in table.columns if c.startswith("stain_")]
    cells = written(table.select(*CELL, *[f"`{c}`" for c in columns], "nuclei_in_cell", *[f"`{c}`" for c in measured]), "cells")

    screened = written(outliers.screened(every, ["sample_id", "channel"], config.outlier_mad_threshold), "screened")
    kept = compartments.filtered(cells, config.filter_stain, config.filter_condition)
    tiers, votes = {"all": cells, "filtered": kept}, {}
    if config.remove_outliers:
        tiers["outlier_removed"] = written(outliers.outlier_tier(kept, screened, CELL), "outlier-removed")
        votes = {"outlier_votes": outliers.removed_by_channel(kept, screened, ["sample_id", "channel"], CELL)}
    qc = metrics.channel_qc_bands(pixels, {s: b for s, b in config.bands().items() if "nuclear" not in given or s != config.stem("nuclear")}, type_max)
    axes = written(spatial.axes(nuclei, flat, scale).withColumnRenamed("label", "cell_id"), "axes")
    long = None
    for tier, t in tiers.items():
        alive = t.select(*CELL)
        m = metrics.long_metrics(t.groupBy("sample_id").agg(F.count("*").alias("cell_count")), ["sample_id"], ["cell_count"])
        m = m.unionByName(metrics.long_metrics(spatial.order(axes.join(alive, CELL, "left_semi"), flat), ["sample_id"], ["nuclear_alignment"]))
        if cyto is not None:
            living = mapping.join(alive.withColumnRenamed("cell_id", "nuc_id"), ["sample_id", "nuc_id"], "left_semi")
            names = {"mono": "mononucleated_cell_count", "poly": "polynucleated_cell_count", "poly_fraction": "polynucleated_cell_fraction"}
            m = m.unionByName(metrics.long_metrics(metrics.nucleation(living).withColumnsRenamed(names), ["sample_id"], list(names.values())))
        if stems:
            m = m.unionByName(metrics.stain_metrics(t, ["sample_id"], stems, word, unit))
        for stem, a in arranged.items():
            own = a.withColumnRenamed("label", "cell_id").join(alive, CELL, "left_semi").join(scale.select("sample_id", "px"), "sample_id")
            own = own.withColumns({f"freq_{x}_axis": F.col(f"freq_{x}_axis") / F.col("px") for x in ("major", "minor")})
            m = m.unionByName(metrics.spatial_metrics(own, ["sample_id"], stem))
        m = m.unionByName(metrics.qc_rows(qc)).withColumn("tier", F.lit(tier))
        long = m if long is None else long.unionByName(m)
    out = {"cells": cells, "metrics": long, "outliers": outliers.screen_summary(screened, ["sample_id", "channel"], "cell_id"), "qc": qc, "scales": scale, "mapping": mapping, "objects": all_objects(described)}
    out |= {f"cells_{k}": v for k, v in tiers.items() if k != "all"} | {"labels_nuclear": nuclei} | ({"labels_cytoplasm": cyto} if cyto is not None else {}) | {f"labels_stain_{s}": m for s, m in masks.items()}
    out |= {f"spatial_{s}": a for s, a in arranged.items()} | votes
    if not flat:
        out["depth"] = features.depth_profiles(pixels, {"nuclear_foreground": nuclei} | {f"stain_coverage:{s}": m for s, m in masks.items()}, scale)
        out["depth_objects"] = features.truncated(nuclei, pixels.groupBy("sample_id").agg(F.max("z").alias("z_max")))
    return out


def all_objects(described: dict[str, DataFrame]) -> DataFrame:
    """All features of all objects, with their compartment."""
    out = None
    for mark, f in described.items():
        f = f.withColumn("compartment", F.lit({"N": "nuclear", "C": "cytoplasm"}[mark]))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def summaries(run: dict[str, DataFrame], paths: DataFrame) -> DataFrame:
    """Folder summaries of each tier; paths(sample_id, path)."""
    m = run["metrics"].join(paths, "sample_id").withColumn("metric", F.concat_ws(":", "tier", "metric"))
    return metrics.folder_rollup(m).where(~F.isnan(F.coalesce("mean", F.lit(math.pi))))


def sidecar(run: dict[str, DataFrame], config: Config, at: str | None = None) -> DataFrame:
    """One record a sample: time of the run, configuration as JSON, calibration with its sources, cells of each tier, channel quality and the outlier screen."""
    count = lambda name: run[name].groupBy("sample_id").agg(F.count("*").alias(f"n_{name}"))
    tiers = [t for t in ("cells", "cells_filtered", "cells_outlier_removed", "particles", "particles_outlier_removed") if t in run]
    rows = lambda name, label: run[name].groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("channel", *[c for c in run[name].columns if c not in ("sample_id", "channel")]))).alias(label))
    out = run["scales"]
    for t in tiers:
        out = out.join(count(t), "sample_id", "left").fillna(0, [f"n_{t}"])
    out = out.join(rows("qc", "channels"), "sample_id", "left").join(rows("outliers", "outlier_screen"), "sample_id", "left")
    time = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    return out.withColumns({"config": F.lit(json.dumps(asdict(config), sort_keys=True, default=dict)), "written_at": F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")})


def save(run: dict[str, DataFrame], folder: str, config: Config, at: str | None = None) -> None:
    """Each table as Parquet, metrics partitioned by tier, and the sidecar as JSON partitioned by sample."""
    for name, df in run.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("tier") if name == "metrics" else writer).parquet(f"{folder}/{name}")
    sidecar(run, config, at).write.mode("overwrite").json(f"{folder}/sidecar")
