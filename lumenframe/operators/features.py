"""Features of labelled objects, each one grouped aggregate over pixels(sample_id, label, z, y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.geometry import clamp, eigen2, eigen3, ratio, sem
from lumenframe.operators import hull, surface
from lumenframe.operators.quantiles import matched, quantiles
from lumenframe.runtime import written

OBJECT = ["sample_id", "label"]


def in_band(v: Column, low: float, high: float) -> Column:
    return v.between(low, high)


def intensity(pixels: DataFrame, by: list[str]) -> DataFrame:
    """n, mean, population deviation, median, 10th and 90th percentile and sum of v."""
    v = F.col("v").cast("double")
    plain = pixels.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.sum("v").alias("total"))
    ranked = quantiles(pixels, by, v, {"median": 0.5, "p10": 0.1, "p90": 0.9})
    return matched(plain, ranked, by, "left").select(*by, "n", "mean", "sd", "median", "p10", "p90", "total")


def channel_means(pixels: DataFrame, channels: list[str]) -> DataFrame:
    """Mean and sum of every channel within each object, a pair of columns a channel."""
    wide = pixels.groupBy(*OBJECT).pivot("channel", channels)
    return wide.agg(F.avg("v").alias("mean"), F.sum("v").alias("integrated"))


def ellipse(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Centroid, area and the axes, eccentricity and orientation of the ellipse of equal second moments."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    m = pixels.groupBy(*by).agg(F.count("*").alias("area"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.var_pop(y).alias("myy"), F.var_pop(x).alias("mxx"), F.covar_pop(y, x).alias("mxy"))
    a, c, b = F.col("myy"), F.col("mxx"), F.col("mxy")
    big, small = eigen2(a, b, c)
    return m.select(
        *by, "area", "cy", "cx", (4 * F.sqrt(big)).alias("major"), (4 * F.sqrt(small)).alias("minor"),
        F.sqrt(clamp(1 - ratio(small, big))).alias("eccentricity"), orientation(a, b, c).alias("orientation"),
    )


def orientation(a: Column, b: Column, c: Column) -> Column:
    """Angle of the longest axis of second moments [[a, b], [b, c]] of rows and columns; of an object without one, -π/4."""
    even = (F.abs(a - c) <= 1e-12 * (a + c)) & (F.abs(b) <= 1e-12 * (a + c))
    return F.when(even, F.lit(-math.pi / 4)).otherwise(0.5 * F.atan2(2 * b, a - c))


def ellipsoid(pixels: DataFrame, by: list[str], aniso: float | Column = 1.0) -> DataFrame:
    """Full axes, in pixels, of the solid ellipsoid of equal second moments, elongation and flatness; z is scaled by ``aniso``."""
    aniso = aniso if isinstance(aniso, Column) else F.lit(float(aniso))
    z, y, x = F.col("z") * aniso, F.col("y").cast("double"), F.col("x").cast("double")
    m = pixels.groupBy(*by).agg(
        F.count("*").alias("voxels"), F.var_pop(z).alias("zz"), F.var_pop(y).alias("yy"), F.var_pop(x).alias("xx"),
        F.covar_pop(z, y).alias("zy"), F.covar_pop(z, x).alias("zx"), F.covar_pop(y, x).alias("yx"),
    )
    values = eigen3(F.col("xx"), F.col("yy"), F.col("zz"), F.col("yx"), F.col("zx"), F.col("zy"))
    axes = m.select(*by, "voxels", *[(2 * F.sqrt(5 * clamp(v))).alias(n) for n, v in zip(("major", "mid", "minor"), values, strict=True)])
    return axes.withColumn("elongation", 1 - ratio(F.col("mid"), F.col("major"))).withColumn("flatness", 1 - ratio(F.col("minor"), F.col("mid")))


def perimeter(pixels: DataFrame, by: list[str]) -> DataFrame:
    """Border length by neighbour patterns: a border pixel with neighbours on a side counts 1, across a corner √2, or half of both."""
    key = [*by, "y", "x"]
    cells = pixels.select(*key).distinct()
    side = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("d")
    near = lambda d: cells.select("*", d).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    inner = near(side).groupBy(*key).count().where("count = 4").select(*key)
    border = cells.join(inner.hint("merge"), key, "left_anti")
    around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
    every = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(10 if dy and dx else 2).alias("w")) for dy, dx in around])).alias("d")
    votes = border.select("*", every).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), F.col("d.w").alias("w"))
    code = border.join(votes.groupBy(*key).agg(F.sum("w").alias("w")).hint("merge"), key, "left").withColumn("code", 1 + F.coalesce("w", F.lit(0)))
    # fixed values: codes of border neighbours (1 for the pixel, 2 a side, 10 a corner) and their weights
    straight, diagonal, both = [5, 7, 15, 17, 25, 27], [21, 33], [13, 23]
    weight = F.when(F.col("code").isin(straight), 1.0).when(F.col("code").isin(diagonal), math.sqrt(2)).when(F.col("code").isin(both), (1 + math.sqrt(2)) / 2).otherwise(0.0)
    return code.groupBy(*by).agg(F.sum(weight).alias("perimeter"))


def circularity(area: Column, perimeter: Column) -> Column:
    return F.coalesce(ratio(4 * math.pi * area, perimeter * perimeter), F.lit(0.0))


def doublet_score(circ: Column, solidity: Column, eccentricity: Column, area: Column, median_area: Column) -> Column:
    """Mean of four signs of touching objects, at most 1."""
    excess = F.least(F.greatest(area / median_area - 1, F.lit(0.0)), F.lit(1.0))
    return F.least(((1 - circ) + (1 - solidity) + eccentricity + excess) / 4, F.lit(1.0))


def texture(pixels: DataFrame, by: list[str], levels: int = 256, integer: bool | None = None, box: DataFrame | None = None) -> DataFrame:
    """Contrast, homogeneity, energy and correlation of grey-level co-occurrences at distance 1, means over four directions.

    Values are quantised over each object's range; objects with one value, or a side under 2, get
    nulls. Pixels of the object's box outside it take its mean, truncated where the image holds
    whole numbers (``integer``; by default, where v does). Give objects with their holes filled.
    ``box`` (by, y0, y1, x0, x1) sets other boxes, as those of a stack's object for each of its planes.
    """
    if integer is None:
        integer = pixels.schema["v"].dataType.typeName() in ("byte", "short", "integer", "long")
    mean = F.avg("v")
    stats = pixels.groupBy(*by).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), (mean.cast("long") if integer else mean).cast("double").alias("fill"),
        F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    if box is not None:
        stats = stats.drop("y0", "y1", "x0", "x1").join(box.hint("merge"), [c for c in by if c in box.columns])
    fits = (F.col("hi") > F.col("lo")) & (F.col("y1") > F.col("y0")) & (F.col("x1") > F.col("x0"))
    grid = stats.where(fits).withColumn("y", F.explode(F.sequence("y0", "y1"))).withColumn("x", F.explode(F.sequence("x0", "x1")))
    whole = grid.join(pixels.select(*by, "y", "x", F.col("v").cast("double").alias("v")).hint("merge"), [*by, "y", "x"], "left")
    q = whole.select(*by, "y", "x", F.floor((F.coalesce("v", "fill") - F.col("lo")) / (F.col("hi") - F.col("lo")) * (levels - 1)).cast("long").alias("g"))
    offsets = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(((0, 1), (-1, 1), (-1, 0), (-1, -1)))])).alias("d")
    left = q.select(*by, "y", "x", F.col("g").alias("i"), offsets).select(*by, (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"), "i", F.col("d.k").alias("k"))
    pairs = left.join(q.withColumnRenamed("g", "j").hint("merge"), [*by, "y", "x"])
    both = pairs.select(*by, "k", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("p")).select(*by, "k", "p.i", "p.j")
    n = both.groupBy(*by, "k", "i", "j").agg(F.count("*").alias("n"))
    d = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    s = n.groupBy(*by, "k").agg(
        F.sum("n").alias("t"), F.sum(F.col("n") * d).alias("contrast"), F.sum(F.col("n") / (1 + d)).alias("homogeneity"), F.sum(F.col("n") * F.col("n")).alias("squares"),
        F.sum(F.col("n") * F.col("i")).alias("si"), F.sum(F.col("n") * F.col("i") * F.col("i")).alias("sii"), F.sum(F.col("n") * F.col("i") * F.col("j")).alias("sij"),
    )
    var, cov = F.col("t") * F.col("sii") - F.col("si") * F.col("si"), F.col("t") * F.col("sij") - F.col("si") * F.col("si")
    one = s.select(*by, (F.col("contrast") / F.col("t")).alias("contrast"), (F.col("homogeneity") / F.col("t")).alias("homogeneity"), (F.sqrt(F.col("squares").cast("double")) / F.col("t")).alias("energy"), F.when(var == 0, 1.0).otherwise(cov / F.nullif(var, F.lit(0))).alias("correlation"))
    return stats.select(*by).join(one.groupBy(*by).agg(*[F.avg(c).alias(c) for c in TEXTURES]).hint("merge"), by, "left")


TEXTURES = ("contrast", "homogeneity", "energy", "correlation")


def object_texture(labels: DataFrame, pixels: DataFrame, flat: bool = True, integer: bool | None = None) -> DataFrame:
    """Texture of labelled objects with their holes filled; of a stack's object, the mean over its planes that have one."""
    whole = hull.filled(labels, flat).join(pixels.select("sample_id", "z", "y", "x", "v").hint("merge"), ["sample_id", "z", "y", "x"])
    if flat:
        return texture(whole, OBJECT, integer=integer)
    whole = written(whole, "filled")
    box = whole.groupBy(*OBJECT).agg(*[f(c).alias(f"{c}{n}") for c in "yx" for n, f in ((0, F.min), (1, F.max))])
    planes = texture(whole, [*OBJECT, "z"], integer=False, box=box)
    return planes.groupBy(*OBJECT).agg(*[F.avg(c).alias(c) for c in TEXTURES])


#: Columns of an object's row in tables for users, in order; fixed names of the format. Others are kept to internal tables.
MORPHOLOGY = ("area_um2", "volume_um3", "circularity", "sphericity", "solidity", "eccentricity", "elongation", "flatness", "major_axis_length_um", "minor_axis_length_um", "convexity_defects", "perimeter_um", "surface_area_um2")
SHOWN = (*MORPHOLOGY, "intensity_mean", "intensity_sd", *(f"texture_{t}" for t in TEXTURES))


def shown(features: list[str], channels: list[str], own: str | None) -> list[str]:
    """Of an object's feature columns those that users see, in order: morphology, intensity, texture, means of the other channels by name."""
    return [c for c in SHOWN if c in features] + [f"{c}_mean" for c in sorted(channels) if c != own and f"{c}_mean" in features]


def object_features(labels: DataFrame, pixels: DataFrame, stem: str, channels: list[str], scale: DataFrame, flat: bool = True, textured: bool = True, integer: bool | None = None) -> DataFrame:
    """Features of labelled objects, a row each: n_px, calibrated morphology, intensity and texture in channel ``stem``, mean and sum of every other channel.

    scale(sample_id, px, pz) holds each sample's pixel size and, of stacks, plane distance. Stacks
    have volume, surface area, sphericity, the ellipsoid's axes, elongation and flatness in place of
    area, perimeter, circularity, eccentricity, orientation, solidity and defects. An object of which the
    channel has no pixel has null intensities.
    """
    place = ["sample_id", "z", "y", "x"]
    on = labels.select(*place, "label").join(pixels.select(*place, "channel", "v"), place)
    own = on.where(F.col("channel") == stem)
    px = F.col("px")
    if flat:
        shape = ellipse(labels, OBJECT).join(perimeter(labels, OBJECT), OBJECT, "left").join(hull.convexity(labels), OBJECT, "left").join(scale.select("sample_id", "px"), "sample_id").select(
            *OBJECT, F.col("area").alias("n_px"), (F.col("area") * px * px).alias("area_um2"), (F.col("perimeter") * px).alias("perimeter_um"), circularity(F.col("area"), F.col("perimeter")).alias("circularity"), "eccentricity", "solidity", "convexity_defects",
            (F.col("major") * px).alias("major_axis_length_um"), (F.col("minor") * px).alias("minor_axis_length_um"), F.col("cx").alias("centroid_x"), F.col("cy").alias("centroid_y"), "orientation",
        )
    else:
        deep = F.coalesce("pz", "px")
        voxel = px * px * deep
        sized = labels.select(*place, "label").join(scale.select("sample_id", (deep / px).alias("aniso")), "sample_id")
        centre = labels.groupBy(*OBJECT).agg(*[F.avg(c).alias(f"centroid_{c}") for c in "zyx"])
        area = surface.surface_area(labels, scale)
        shape = ellipsoid(sized, OBJECT, F.col("aniso")).join(centre, OBJECT).join(area, OBJECT, "left").join(scale, "sample_id").select(
            *OBJECT, F.col("voxels").alias("n_px"), (F.col("voxels") * voxel).alias("volume_um3"), F.col("surface_area").alias("surface_area_um2"), surface.sphericity(F.col("voxels") * voxel, F.col("surface_area")).alias("sphericity"), "elongation", "flatness",
            (F.col("major") * px).alias("major_axis_length_um"), (F.col("minor") * px).alias("minor_axis_length_um"), "centroid_z", "centroid_y", "centroid_x",
        )
    names = {"mean": "intensity_mean", "sd": "intensity_sd", "median": "intensity_median", "p10": "intensity_p10", "p90": "intensity_p90", "total": "integrated_intensity"}
    out = shape.join(intensity(own, OBJECT).select(*OBJECT, *[F.col(c).alias(n) for c, n in names.items()]), OBJECT, "left")
    if textured:
        grey = object_texture(labels, pixels.where(F.col("channel") == stem), flat, integer)
        out = out.join(grey.select(*OBJECT, *[F.col(c).alias(f"texture_{c}") for c in TEXTURES]), OBJECT, "left")
    if others := sorted(set(channels) - {stem}):
        means = on.groupBy(*OBJECT).pivot("channel", others).agg(F.avg("v").alias("mean"), F.sum("v").alias("integrated"))
        out = out.join(means.select(*OBJECT, *[F.col(f"`{c}_{m}`") for c in others for m in ("mean", "integrated")]), OBJECT, "left")
    return out


def depth_profile(pixels: DataFrame) -> DataFrame:
    """Mean intensity of each plane of each sample and channel."""
    return pixels.groupBy("sample_id", "channel", "z").agg(F.avg("v").alias("mean"))


def depth_profiles(pixels: DataFrame, masks: dict[str, DataFrame], scale: DataFrame) -> DataFrame:
    """(sample_id, z, z_um, series, value) of stacks: ``intensity:<channel>``, each plane's mean, and for each of ``masks`` by name the share of each plane that it covers.

    Planes without a pixel of a mask have 0. ``z_um`` counts from the first plane; values are rounded as the format's reports are.
    """
    size = pixels.groupBy("sample_id", "z").agg(((F.max("y") + 1) * (F.max("x") + 1)).alias("plane"))
    means = depth_profile(pixels).select("sample_id", "z", F.concat(F.lit("intensity:"), "channel").alias("series"), F.round("mean", 3).alias("value"))
    for name, mask in masks.items():
        n = mask.groupBy("sample_id", "z").agg(F.count("*").alias("n"))
        cover = size.join(n, ["sample_id", "z"], "left").select("sample_id", "z", F.lit(name).alias("series"), F.round(F.coalesce("n", F.lit(0)) / F.col("plane"), 6).alias("value"))
        means = means.unionByName(cover)
    return means.join(scale, "sample_id").select("sample_id", "z", F.round(F.col("z") * F.coalesce("pz", "px"), 4).alias("z_um"), "series", "value")


def truncated(objects: DataFrame, planes: DataFrame) -> DataFrame:
    """Objects of each sample that touch its first or last plane; planes(sample_id, z_max)."""
    ends = objects.groupBy("sample_id", "label").agg(F.min("z").alias("z0"), F.max("z").alias("z1")).join(planes, "sample_id")
    cut = (F.col("z0") == 0) | (F.col("z1") == F.col("z_max"))
    return ends.groupBy("sample_id").agg(F.count("*").alias("n"), F.sum(cut.cast("long")).alias("truncated"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean and standard error of a column's non-null values."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), sem(F.col(value)).alias("sem"))
