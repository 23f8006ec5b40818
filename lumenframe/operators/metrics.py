"""Long sample metrics, summary rows, wide tables and folder rollups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from lumenframe.functions.geometry import sem
from lumenframe.operators.quantiles import matched, quantiles


def long_metrics(wide: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, metric, value) of wide columns; nulls stay."""
    return wide.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(keys, values, "metric", "value")


def wide_metrics(metrics: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """One row a key with a column a metric."""
    return metrics.groupBy(*keys).pivot("metric", names).agg(F.max("value"))


def cell_metrics(cells: DataFrame, keys: list[str], values: list[str], fractions: list[str] = ()) -> DataFrame:
    """Long metrics of cells: their number, mean and standard error of each value, share of each flag."""
    aggs: list[Column] = [F.count("*").cast("double").alias("cell_count")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), sem(F.col(v)).alias(f"{v}_sem")]
    aggs += [F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int")).alias(f"{f}_fraction") for f in fractions]
    wide = cells.groupBy(*keys).agg(*aggs)
    return long_metrics(wide, keys, [c for c in wide.columns if c not in keys])


def stain_metrics(cells: DataFrame, keys: list[str], stems: list[str], word: str = "area", unit: str = "um2") -> DataFrame:
    """(keys, metric, value) of cells' stains: share of cells that have each stain, among those where that is known, and mean and standard error of five measures."""
    rows = None
    for s in stems:
        p = f"stain_{s}"
        names = [f"{p}_{word}_cell_{unit}", f"{p}_particle_count_cell", f"{p}_particle_avg_{word}_nuc_{unit}", f"{p}_particle_avg_{word}_cell_{unit}", f"{p}_coverage_fraction_cell"]
        aggs = [F.avg(F.col(f"`{p}_cell_has_stain`").cast("int")).alias(f"{p}_positive_fraction_cell")]
        for n in names:
            aggs += [F.avg(F.col(f"`{n}`")).alias(f"{n}_mean"), sem(F.col(f"`{n}`")).alias(f"{n}_sem")]
        wide = cells.groupBy(*keys).agg(*aggs)
        long = long_metrics(wide, keys, [c for c in wide.columns if c not in keys])
        rows = long if rows is None else rows.unionByName(long)
    return rows


def spatial_metrics(spatial: DataFrame, keys: list[str], stem: str) -> DataFrame:
    """(keys, metric, value) of ``spatial.stain_spatial`` rows: mean and standard error of particle alignment and of both frequencies; measures without a value have no row."""
    names = {"particle_alignment": "alignment", "freq_major_axis": "periodicity_major", "freq_minor_axis": "periodicity_minor"}
    long = spatial.select(*keys, *[F.col(c).alias(n) for c, n in names.items()]).unpivot(keys, list(names.values()), "measure", "v").where("v is not null")
    stats = long.groupBy(*keys, "measure").agg(F.avg("v").alias("mean"), sem(F.col("v")).alias("sem")).unpivot([*keys, "measure"], ["mean", "sem"], "stat", "value")
    return stats.select(*keys, F.concat_ws("_", F.lit(f"stain_{stem}"), "measure", "stat").alias("metric"), "value")


def nucleation(mapping: DataFrame) -> DataFrame:
    """Per sample: cells of one nucleus, of several, and the latter's share; cells are cytoplasms, not nuclei."""
    n = mapping.where("cyto_id is not null").groupBy("sample_id", "cyto_id").agg(F.count("*").alias("n"))
    poly = F.sum((F.col("n") > 1).cast("long"))
    return n.groupBy("sample_id").agg(F.sum((F.col("n") == 1).cast("long")).alias("mono"), poly.alias("poly"), (poly / F.count("*")).alias("poly_fraction"))


def with_summary_rows(table: DataFrame, id_column: str, include_sem: bool = False) -> DataFrame:
    """``table`` and a MEAN row, and a SEM row if asked, of its numeric columns; flags and texts are null there."""
    numeric = [f.name for f in table.schema.fields if isinstance(f.dataType, NumericType) and not isinstance(f.dataType, BooleanType) and f.name != id_column]
    body = table.select(*[F.col(f.name).cast("string" if f.name == id_column else "double" if f.name in numeric else f.dataType).alias(f.name) for f in table.schema.fields])
    rows = [("MEAN", F.avg)] + [("SEM", lambda c: sem(F.col(c)))] * include_sem
    for name, f in rows:
        one = table.agg(*[f(c).alias(c) for c in numeric]) if numeric else table.agg(F.lit(None).alias("_"))
        full = [F.lit(name).alias(id_column) if c.name == id_column else F.col(c.name) if c.name in numeric else F.lit(None).cast(c.dataType).alias(c.name) for c in table.schema.fields]
        body = body.unionByName(one.select(*full))
    return body


def without_summary_rows(table: DataFrame, id_column: str) -> DataFrame:
    return table.where(~F.coalesce(F.col(id_column).isin("MEAN", "SEM"), F.lit(False)))


def ancestors(path: Column) -> Column:
    """All folders on a path, itself included: a/b gives a and a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def folder_rollup(metrics: DataFrame, path: str = "path") -> DataFrame:
    """(level, metric, n, mean, sem) of metrics(path, metric, value) for every folder on the way to a sample."""
    at = metrics.select(F.explode(ancestors(F.col(path))).alias("level"), "metric", "value")
    return at.groupBy("level", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), sem(F.col("value")).alias("sem"))


def pooled(rows: DataFrame, path: str, values: list[str]) -> DataFrame:
    """(level, column, n, mean) of columns over all rows at or below each folder: numbers and sums by sample, then by folder."""
    sums = [F.struct(F.lit(v).alias("column"), F.count(F.col(f"`{v}`")).alias("n"), F.sum(F.col(f"`{v}`").cast("double")).alias("s")) for v in values]
    by_path = rows.groupBy(F.col(path).alias("_path")).agg(F.array(*sums).alias("_sums")).select("_path", F.explode("_sums").alias("c")).select("_path", "c.*")
    up = by_path.select(F.explode(ancestors(F.col("_path"))).alias("level"), "column", "n", "s")
    return up.groupBy("level", "column").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select("level", "column", "n", (F.col("s") / F.nullif("n", F.lit(0))).alias("mean"))


def numbered(rows: DataFrame, within: list[str], order: list[str], group: str) -> DataFrame:
    """``rows`` with cell_id, counted through all groups of ``within`` in order, and label_id, counted in each group."""
    n = lambda w: F.row_number().over(w).cast("long")
    return rows.withColumns({"cell_id": n(Window.partitionBy(*within).orderBy(group, *order)), "label_id": n(Window.partitionBy(*within, group).orderBy(*order))})


def channel_qc(pixels: DataFrame, low: float, high: float, dtype_max: float | None) -> DataFrame:
    """Per sample and channel: mean, percentage at the type's maximum (null for floats) and percentage in the band."""
    share = lambda c: 100.0 * F.avg(c.cast("int"))
    full = share(F.col("v") >= dtype_max) if dtype_max is not None else F.lit(None).cast("double")
    return pixels.groupBy("sample_id", "channel").agg(F.avg("v").alias("mean"), full.alias("saturated_pct"), share(F.col("v").between(low, high)).alias("in_band_pct"))


def channel_qc_bands(pixels: DataFrame, bands: Mapping[str, tuple[float, float]], type_max: Mapping[str, float] | None = None) -> DataFrame:
    """Quality of each sample's channels, each by its own band: mean, percentage at the type's maximum, the band and the percentage in it.

    Channels without a type maximum (floats) have no percentage at it, those without a band none in it.
    """

    def of(values: Mapping[str, float]) -> Column:
        out = F.lit(None).cast("double")
        for stem, v in values.items():
            out = F.when(F.col("channel") == stem, F.lit(float(v))).otherwise(out)
        return out

    low, high, most = of({s: b[0] for s, b in bands.items()}), of({s: b[1] for s, b in bands.items()}), of(type_max or {})
    share = lambda c: 100.0 * F.avg(c.cast("int"))
    return pixels.groupBy("sample_id", "channel").agg(
        F.avg("v").alias("mean"), share(F.col("v") >= most).alias("saturated_pct"), F.max(low).alias("threshold_min_used"), F.max(high).alias("threshold_max_used"),
        share((F.col("v") >= low) & (F.col("v") <= high)).alias("in_band_pct"),
    )


def qc_rows(qc: DataFrame) -> DataFrame:
    """(sample_id, metric, value) of channel quality, ``qc_<channel>_<measure>``; bands that were not used have no row."""
    names = {"mean": "intensity_mean", "saturated_pct": "pct_saturated", "threshold_min_used": "threshold_min_used", "threshold_max_used": "threshold_max_used", "in_band_pct": "pct_in_threshold_band"}
    long = qc.select("sample_id", "channel", *[F.col(c).cast("double").alias(n) for c, n in names.items()]).unpivot(["sample_id", "channel"], list(names.values()), "metric", "value")
    used = F.col("value").isNotNull() | F.col("metric").isin("intensity_mean", "pct_saturated")
    return long.where(used).select("sample_id", F.concat(F.lit("qc_"), "channel", F.lit("_"), "metric").alias("metric"), "value")


def particle_measures(particles: DataFrame, images: DataFrame, size: str) -> DataFrame:
    """Per sample and stain of images(sample_id, stain, image_px): number, total, mean and standard error of the sizes of its particles, covered share of the image.

    particles(sample_id, stain, n_px, <size>); a stain without particles has 0, 0, null, null and 0.
    """
    n = particles.groupBy("sample_id", "stain").agg(F.count("*").alias("particle_count"), F.sum(size).alias("total"), F.avg(size).alias("mean"), sem(F.col(size)).alias("sem"), F.sum("n_px").alias("_px"))
    out = images.join(n.hint("merge"), ["sample_id", "stain"], "left").fillna(0, ["particle_count", "total", "_px"])
    return out.withColumn("coverage", F.col("_px") / F.col("image_px")).drop("_px", "image_px")


def histogram(values: DataFrame, value: str, by: list[str], high: float, bins: int = 128) -> DataFrame:
    """Counts by bin (from 0) over [0, high]; the last bin holds its upper end."""
    v = F.col(value)
    bin_ = F.least(F.floor(v / high * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return values.where(v.between(0, high)).groupBy(*by, bin_).agg(F.count("*").alias("n"))


def box(table: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles and whiskers within 1.5 interquartile ranges of non-null values."""
    q = quantiles(table, by, F.col(value), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = matched(table, q, by).where(F.col(value).between(F.col("q1") - reach, F.col("q3") + reach))
    return matched(q, inside.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high")), by)


def completeness(cells: DataFrame, by: list[str], whole: Column) -> DataFrame:
    """(by, n, complete): rows of each group and the share of them that ``whole`` holds for; a null counts as not."""
    return cells.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce(whole, F.lit(False)).cast("int")).alias("complete"))


def top_values(table: DataFrame, value: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values with their number, ties to the lesser value."""
    return table.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)
