"""Joins between label layers: nucleus and cytoplasm, particles and their owners, stains and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import ratio
from lumenframe.operators.segmentation import PLACE, ball, components, shifted


def majority(votes: DataFrame, by: list[str], choice: str, name: str) -> DataFrame:
    """The most frequent choice of each group; ties go to the least."""
    n = votes.groupBy(*by, choice).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.max_by(choice, F.struct(F.col("n"), -F.col(choice))).alias(name))


def adjacent_cytoplasm(nuclei: DataFrame, cytoplasm: DataFrame, radius: int = 2, flat: bool = True) -> DataFrame:
    """(sample_id, nuc_id, cyto_id): the cytoplasm that most of the ring around a nucleus lies on; a nucleus without any is absent."""
    ring = shifted(nuclei.select(*PLACE, F.col("label").alias("nuc_id")), ball(radius, flat), ["nuc_id"]).distinct()
    ring = ring.join(nuclei.select(*PLACE, F.col("label").alias("nuc_id")).hint("merge"), [*PLACE, "nuc_id"], "left_anti")
    votes = ring.join(cytoplasm.select(*PLACE, F.col("label").alias("cyto")).hint("merge"), PLACE)
    return majority(votes, ["sample_id", "nuc_id"], "cyto", "cyto_id")


def territories(nuclei: DataFrame, cytoplasm: DataFrame, mapping: DataFrame) -> DataFrame:
    """Pixels by cell: nuclei first, then mapped cytoplasm; one that several nuclei share belongs to the last of them."""
    last = mapping.groupBy("sample_id", "cyto_id").agg(F.max("nuc_id").alias("cell_id"))
    of_cyto = cytoplasm.withColumnRenamed("label", "cyto_id").join(last.hint("merge"), ["sample_id", "cyto_id"]).select(*PLACE, "cell_id")
    of_nuc = nuclei.select(*PLACE, F.col("label").alias("cell_id"))
    return of_nuc.unionByName(of_cyto.join(of_nuc.hint("merge"), PLACE, "left_anti"))


def stain_by_region(stain: DataFrame, regions: DataFrame, px_area: float = 1.0, connectivity: int = 2, flat: bool = True) -> DataFrame:
    """Per region: area, stain area, number of separate stain pieces within it, and coverage. Regions without stain have zeros."""
    inside = regions.select(*PLACE, F.col("label").alias("region")).join(stain.select(*PLACE).hint("merge"), PLACE)
    # pieces of two regions never join, so each region is an image of its own
    own = inside.select(F.struct("sample_id", "region").alias("sample_id"), "z", "y", "x")
    pieces = components(own, connectivity, flat).groupBy("sample_id").agg(F.countDistinct("label").alias("pieces"), F.count("*").alias("stain_px"))
    pieces = pieces.select("sample_id.sample_id", "sample_id.region", "pieces", "stain_px")
    area = regions.groupBy("sample_id", F.col("label").alias("region")).agg(F.count("*").alias("region_px"))
    out = area.join(pieces.hint("merge"), ["sample_id", "region"], "left").fillna(0, ["pieces", "stain_px"])
    return out.select("sample_id", "region", "region_px", (F.col("region_px") * px_area).alias("area"), "stain_px", (F.col("stain_px") * px_area).alias("stain_area"), "pieces", ratio(F.col("stain_px").cast("double"), F.col("region_px")).alias("coverage"))


def stain_by_regions(stain: DataFrame, regions: dict[str, DataFrame], connectivity: int = 2, flat: bool = True) -> DataFrame:
    """(layer, sample_id, id, stain_px, pieces): stain pixels and separate pieces in each region of several layers of labels, found in one go; regions without stain are absent."""
    parts = None
    for layer, labels in regions.items():
        own = labels.select(F.struct("sample_id", F.lit(layer).alias("layer"), F.col("label").alias("id")).alias("region"), *PLACE)
        parts = own if parts is None else parts.unionByName(own)
    inside = parts.join(stain.select(*PLACE).hint("merge"), PLACE).select(F.col("region").alias("sample_id"), "z", "y", "x")
    found = components(inside, connectivity, flat).groupBy("sample_id").agg(F.count("*").alias("stain_px"), F.countDistinct("label").alias("pieces"))
    return found.select("sample_id.layer", "sample_id.sample_id", "sample_id.id", "stain_px", "pieces")


def particles(stain: DataFrame, territory: DataFrame, connectivity: int = 2, flat: bool = True) -> DataFrame:
    """Stain particles of the binary mask with size and the cell that most of each lies on; unowned ones are left out."""
    return owners(components(stain, connectivity, flat), territory)


def owners(labels: DataFrame, territory: DataFrame) -> DataFrame:
    """(sample_id, label, size, owner): size of each object and the cell that most of it lies on, ties to the least; unowned ones are left out."""
    size = labels.groupBy("sample_id", "label").agg(F.count("*").alias("size"))
    owner = majority(labels.join(territory.hint("merge"), PLACE), ["sample_id", "label"], "cell_id", "owner")
    return size.join(owner.hint("merge"), ["sample_id", "label"])


def mean_particle_area(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """Stain pixels of a sample over its number of particles; 0 without any."""
    found = labels.groupBy("sample_id").agg((F.count("*") / F.countDistinct("label")).alias("mean_area"))
    return samples.select("sample_id").distinct().join(found, "sample_id", "left").fillna(0.0, ["mean_area"])


def cells(nuclei: DataFrame, cytoplasm: DataFrame | None, mapping: DataFrame, stains: dict[str, tuple[DataFrame, DataFrame]], positive_px: dict[str, DataFrame], word: str = "area", unit: str = "um2") -> DataFrame:
    """One row a nucleus with its compartments' stains.

    nuclei and cytoplasm hold (sample_id, id, size); stains map a stem to its measures by nucleus
    and by cytoplasm: (sample_id, id, size, count, px), and positive_px to the stain's mean particle area
    in each sample, from which on a cell has it. A nucleus without cytoplasm is incomplete
    where the run has cytoplasm at all: its cell measures are null, its has-stain flag is not.
    """
    key = ["sample_id", "nuc_id"]
    out = nuclei.select("sample_id", F.col("id").alias("nuc_id"), F.col("size").alias("nuc_size")).join(mapping, key, "left")
    if cytoplasm is not None:
        out = out.join(cytoplasm.select("sample_id", F.col("id").alias("cyto_id"), F.col("size").alias("cyto_size")), ["sample_id", "cyto_id"], "left")
        shared = F.count("*").over(Window.partitionBy("sample_id", "cyto_id"))
        out = out.withColumn("nuclei_in_cell", F.when(F.col("cyto_size").isNotNull(), shared))
        incomplete = F.col("cyto_size").isNull()
    else:
        out = out.withColumn("cyto_size", F.lit(None).cast("double")).withColumn("nuclei_in_cell", F.lit(None).cast("long"))
        incomplete = F.lit(False)
    for s, (by_nuc, by_cyto) in stains.items():
        named = lambda df, i, p: df.select("sample_id", F.col("id").alias(i), *[F.col(c).alias(f"{p}_{c}") for c in ("size", "count", "px")])
        out = out.join(named(by_nuc, "nuc_id", "n"), key, "left").join(named(by_cyto, "cyto_id", "c"), ["sample_id", "cyto_id"], "left")
        out = out.fillna(0, [f"{p}_{c}" for p in "nc" for c in ("size", "count", "px")])
        whole = lambda x: F.when(~incomplete, x)
        size, count, px = (F.col(f"n_{c}") + F.col(f"c_{c}") for c in ("size", "count", "px"))
        has = F.col("cyto_size").isNotNull()
        threshold = F.lit(0.0)
        if s in positive_px:
            out = out.join(positive_px[s].select("sample_id", F.col("mean_area").alias("n_least")), "sample_id", "left")
            threshold = F.coalesce("n_least", F.lit(0.0))
        p = f"stain_{s}"
        out = out.select(
            *[c for c in out.columns if c[:2] not in ("n_", "c_")],
            F.col("n_size").alias(f"{p}_{word}_nuc_{unit}"), F.when(has, F.col("c_size")).alias(f"{p}_{word}_cyto_{unit}"), whole(size).alias(f"{p}_{word}_cell_{unit}"),
            whole(count).alias(f"{p}_particle_count_cell"), F.coalesce(ratio(F.col("n_size"), F.col("n_count")), F.lit(0.0)).alias(f"{p}_particle_avg_{word}_nuc_{unit}"),
            whole(F.coalesce(ratio(size, count), F.lit(0.0))).alias(f"{p}_particle_avg_{word}_cell_{unit}"),
            ratio(F.col("n_size"), F.col("nuc_size")).alias(f"{p}_coverage_fraction_nuc"), ratio(F.when(has, F.col("c_size")), F.col("cyto_size")).alias(f"{p}_coverage_fraction_cyto"),
            whole(ratio(size, F.col("nuc_size") + F.coalesce("cyto_size", F.lit(0.0)))).alias(f"{p}_coverage_fraction_cell"), whole(px).alias(f"{p}_cell_stain_area_px"),
            (F.col("n_size") > 0).alias(f"{p}_nuc_has_stain"), ((px > 0) & (px >= threshold)).alias(f"{p}_cell_has_stain"),
        )
    return out


def filtered(table: DataFrame, stain: str | None, condition: str = "contains") -> DataFrame:
    """Cells that contain the stain, or for any other condition those that do not; all cells without a stain or its column."""
    flag = f"stain_{stain}_cell_has_stain"
    if not stain or flag not in table.columns:
        return table
    return table.where(F.col(flag) if condition == "contains" else ~F.coalesce(F.col(flag), F.lit(False)))
