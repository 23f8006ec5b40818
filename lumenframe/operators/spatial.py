"""Arrangement of particles within objects: directors, projections on an axis, their peaks, and order parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.geometry import axial_order, axis3, eigen3
from lumenframe.operators.features import OBJECT, ellipse
from lumenframe.operators.segmentation import PLACE, components
from lumenframe.runtime import written

PEAK_HEIGHT = 0.5
SMOOTHED_SHARE = 0.05


def smoothed_sums(counts: Column, size: Column) -> Column:
    """Sums over windows of ``size`` of an array mirrored beyond its ends; an even window reaches one place further back than ahead."""
    before = F.floor(size / 2).cast("int")
    after = size - before - 1
    n = F.size(counts)
    mirrored = F.concat(F.reverse(F.slice(counts, F.lit(1), before)), counts, F.reverse(F.slice(counts, n - after + 1, after)))
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(1), n), lambda i: total(F.slice(mirrored, i, size)))


def peak_count(values: Column, least: Column) -> Column:
    """Places of an array, plateaus as one, that are above what is on either side and at least ``least``; its ends are none."""
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(False).alias("rose"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        top = a["rose"] & (x < a["last"]) & (a["last"] >= least)
        rose = F.when(x > a["last"], F.lit(True)).when(x < a["last"], F.lit(False)).otherwise(a["rose"])
        return F.struct(x.alias("last"), F.coalesce(rose, F.lit(False)).alias("rose"), (a["n"] + F.coalesce(top, F.lit(False)).cast("int")).alias("n"))

    return F.aggregate(values, start, step, lambda a: a["n"])


def axis_profile_peaks(pixels: DataFrame, by: list[str], position: Column, px: float | Column = 1.0) -> DataFrame:
    """(by, n_peaks, frequency) of pixels projected on an axis.

    Unit bins that begin half a unit before the least position are counted, as many as reach half a
    unit past the greatest, and summed over windows of a twentieth of them, 3 at least. A sum of
    which the window's mean is PEAK_HEIGHT or more, above what is on either side, is a peak, a
    plateau counts once. Fewer than 3 pixels or a span under 2 give no peaks and a null frequency.
    A profile is as long as its image's diagonal at most, and one array; a group's pixels may be any share of the rows.
    """
    p = pixels.select(*by, position.cast("double").alias("p"))
    ends = p.groupBy(*by).agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi")).withColumn("span", F.col("hi") - F.col("lo"))
    first = F.col("lo") - 0.5
    near = F.floor(F.col("p") - first)
    bin_ = near - (F.col("p") < first + near).cast("int") + (F.col("p") >= first + near + 1).cast("int")  # edges are rounded sums, not exact ones
    counts = p.join(ends.where("n >= 3 and span >= 2"), by).groupBy(*by, "span", bin_.cast("int").alias("bin")).agg(F.count("*").alias("c"))
    profile = counts.groupBy(*by, "span").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("at"))
    bins = F.ceil("span").cast("int") + 1
    profile = profile.select(*by, "span", bins.alias("bins"), F.transform(F.sequence(F.lit(0), bins - 1), lambda i: F.coalesce(F.try_element_at("at", i), F.lit(0))).alias("counts"))
    size = F.greatest(F.lit(3), F.floor(F.col("bins") * SMOOTHED_SHARE).cast("int"))
    found = profile.select(*by, "span", size.alias("size"), smoothed_sums(F.col("counts"), size).alias("sums"))
    found = found.select(*by, "span", peak_count(F.col("sums"), PEAK_HEIGHT * F.col("size")).alias("n_peaks"))
    out = ends.select(*by).join(found, by, "left")
    px = px if isinstance(px, Column) else F.lit(float(px))
    return out.select(*by, F.coalesce("n_peaks", F.lit(0)).alias("n_peaks"), (F.col("n_peaks") / (F.col("span") * px)).alias("frequency"))


def directors(labels: DataFrame, by: list[str], aniso: float | Column = 1.0) -> DataFrame:
    """(by, cz, cy, cx, long, short): centroid in pixels, and unit vectors (z, y, x) of the longest and the shortest axis of each object; z is scaled by ``aniso`` for the axes."""
    aniso = aniso if isinstance(aniso, Column) else F.lit(float(aniso))
    z, y, x = F.col("z") * aniso, F.col("y").cast("double"), F.col("x").cast("double")
    m = labels.groupBy(*by).agg(
        *[F.avg(c).alias(f"c{c}") for c in "zyx"], F.var_pop(z).alias("zz"), F.var_pop(y).alias("yy"), F.var_pop(x).alias("xx"),
        F.covar_pop(z, y).alias("zy"), F.covar_pop(z, x).alias("zx"), F.covar_pop(y, x).alias("yx"),
    )
    moments = [F.col(c) for c in ("zz", "yy", "xx", "zy", "zx", "yx")]
    top, _, low = eigen3(*moments)
    # written in between: the closed forms are long, and would be put into one another where they are used
    m = written(m.withColumns({"top": top, "low": low}), "moments")
    return written(m.select(*by, "cz", "cy", "cx", axis3(*moments, F.col("top"), 2).alias("long"), axis3(*moments, F.col("low"), 0).alias("short")), "directors")


def nematic_order(directors: DataFrame, by: list[str]) -> DataFrame:
    """Largest eigenvalue of the mean of 1.5 n nᵀ - 0.5 I over unit directors (nx, ny, nz); null below two of them."""
    d = directors.where("nx is not null")
    mean = lambda a, b: F.avg(F.col(a) * F.col(b)) * 1.5
    m = d.groupBy(*by).agg(F.count("*").alias("k"), *[mean(a, b).alias(a[1] + b[1]) for a, b in (("nx", "nx"), ("ny", "ny"), ("nz", "nz"), ("nx", "ny"), ("nx", "nz"), ("ny", "nz"))])
    top, _, _ = eigen3(F.col("xx") - 0.5, F.col("yy") - 0.5, F.col("zz") - 0.5, F.col("xy"), F.col("xz"), F.col("yz"))
    return m.select(*by, F.when(F.col("k") > 1, top).alias("order"))


def axes(labels: DataFrame, flat: bool = True, scale: DataFrame | None = None) -> DataFrame:
    """(sample_id, label, orientation) of flat objects, (sample_id, label, nz, ny, nx) of stacks': the longest axis, with planes as far apart as scale(sample_id, px, pz) says."""
    if flat:
        return ellipse(labels, OBJECT).select(*OBJECT, "orientation")
    sized = labels.withColumn("aniso", F.lit(1.0)) if scale is None else labels.join(scale.select("sample_id", (F.coalesce("pz", "px") / F.col("px")).alias("aniso")), "sample_id")
    return directors(sized, OBJECT, F.col("aniso")).select(*OBJECT, *[F.col("long")[i].alias(n) for i, n in enumerate(("nz", "ny", "nx"))])


def order(axes: DataFrame, flat: bool = True, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """(by, nuclear_alignment) of ``axes``: the axial order of orientations, of stacks the nematic order; null below two objects."""
    if flat:
        return axes.groupBy(*by).agg(axial_order(F.col("orientation")).alias("nuclear_alignment"))
    return nematic_order(axes, list(by)).withColumnRenamed("order", "nuclear_alignment")


def stain_spatial(stain: DataFrame, nuclei: DataFrame, px: float | Column = 1.0, flat: bool = True) -> DataFrame:
    """How a stain's pixels lie within each nucleus: (sample_id, label, n_stain_particles, particle_alignment, peak_count_major, freq_major_axis, peak_count_minor, freq_minor_axis).

    Particles are the stain's pieces within the nucleus, by corners too; their alignment is null
    below two. The stain's pixels are projected on the nucleus's own axes, in pixels from its
    centroid. A nucleus without stain has zeros and nulls. ``px`` is the pixel size, a number or a column of ``nuclei``.
    """
    inside = nuclei.select(*PLACE, "label").join(stain.select(*PLACE), PLACE)
    pieces = components(inside.select(F.struct(*OBJECT).alias("sample_id"), "z", "y", "x"), 2 if flat else 3, flat).withColumnRenamed("label", "piece")
    pieces = pieces.select("sample_id.sample_id", "sample_id.label", "z", "y", "x", "piece")
    number = pieces.groupBy(*OBJECT).agg(F.countDistinct("piece").alias("n_stain_particles"))
    if flat:
        order = ellipse(pieces, [*OBJECT, "piece"]).groupBy(*OBJECT).agg(axial_order(F.col("orientation")).alias("particle_alignment"))
        own = ellipse(nuclei, OBJECT).select(*OBJECT, "cy", "cx", F.sin("orientation").alias("s"), F.cos("orientation").alias("c"))
        dy, dx = F.col("y") - F.col("cy"), F.col("x") - F.col("cx")
        major, minor = dx * F.col("c") - dy * F.col("s"), dy * F.col("c") + dx * F.col("s")
    else:
        d = directors(pieces, [*OBJECT, "piece"]).select(*OBJECT, *[F.col("long")[i].alias(n) for i, n in enumerate(("nz", "ny", "nx"))])
        order = nematic_order(d, OBJECT).withColumnRenamed("order", "particle_alignment")
        own = directors(nuclei, OBJECT)
        along = lambda v: sum(((F.col(c) - F.col(f"c{c}")) * F.col(v)[i] for i, c in enumerate("zyx")), F.lit(0.0))
        major, minor = along("long"), along("short")
    at = pieces.join(own, OBJECT)
    major, minor = F.round(major, 9), F.round(minor, 9)  # spans of whole pixels stay whole
    size = nuclei.groupBy(*OBJECT).agg(F.first(px if isinstance(px, Column) else F.lit(float(px))).alias("px"))
    out = size.join(number, OBJECT, "left").join(order, OBJECT, "left")
    for name, position in (("major", major), ("minor", minor)):
        found = axis_profile_peaks(at, OBJECT, position)
        out = out.join(found.select(*OBJECT, F.col("n_peaks").alias(f"peak_count_{name}"), F.col("frequency").alias(f"freq_{name}_axis")), OBJECT, "left")
        out = out.withColumn(f"freq_{name}_axis", F.col(f"freq_{name}_axis") / F.col("px"))
    return out.drop("px").fillna(0, ["n_stain_particles", "peak_count_major", "peak_count_minor"])
