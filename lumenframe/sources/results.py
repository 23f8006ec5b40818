"""Saved runs as a source: tables by folder level, read with the folders that a prefix leaves out left unread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.config import Config
from lumenframe.operators import metrics
from lumenframe.plans.batch import sidecar

LEVELS = 2  # of a sample's folder that tables are partitioned by
NONE = "-"  # where a path has fewer levels


def level(path, k: int):
    """The k-th folder of a path."""
    part = F.try_element_at(F.filter(F.split(path, "/"), lambda p: p != ""), F.lit(k))
    return F.coalesce(part, F.lit(NONE))


def write(run: dict[str, DataFrame], paths: DataFrame, folder: str, config: Config, at: str | None = None) -> None:
    """Every table of a run below ``folder``, with each sample's path and partitioned by its first LEVELS folders, and a sidecar of JSON lines. paths(sample_id, path)."""
    named = paths.select("sample_id", "path", *[level(F.col("path"), k).alias(f"level_{k}") for k in range(1, LEVELS + 1)])
    parts = [f"level_{k}" for k in range(1, LEVELS + 1)]
    for name, df in run.items():
        df.join(named, "sample_id").write.mode("overwrite").partitionBy(*parts).parquet(f"{folder}/{name}")
    side = sidecar(run, config, at).join(named.select("sample_id", "path"), "sample_id")
    side.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{folder}/sidecar")


def read(spark: SparkSession, folder: str, name: str, prefix: str = "") -> DataFrame:
    """A table of saved runs, of the samples at or below the folder ``prefix``; other partitions are not read."""
    out = spark.read.option("mergeSchema", "true").parquet(f"{folder}/{name}")
    parts = [p for p in prefix.split("/") if p]
    for k, p in enumerate(parts[:LEVELS], 1):
        out = out.where(F.col(f"level_{k}") == p)
    if parts:
        whole = "/".join(parts)
        path = F.array_join(F.filter(F.split("path", "/"), lambda p: p != ""), "/")
        out = out.where((path == whole) | path.startswith(whole + "/"))
    return out.drop(*[f"level_{k}" for k in range(1, LEVELS + 1)])


CALIBRATION = "sample_id string, path string, px double, pz double, px_source string, pz_source string, written_at string, config string, channels array<struct<channel:string,mean:double,saturated_pct:double,in_band_pct:double>>"


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the sidecars of saved runs; a damaged line gives a record of nulls, with its text in ``damaged``."""
    lines = spark.read.text(f"{folder}/sidecar")
    parsed = lines.select("value", F.from_json("value", CALIBRATION + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r._bad").isNull()
    names = [f.name for f in parsed.schema["r"].dataType.fields if f.name != "_bad"]
    return parsed.select(*[F.when(good, F.col(f"r.{n}")).alias(n) for n in names], F.when(~good, F.col("value")).alias("damaged"))


def folder_sheet(cells: DataFrame, paths: DataFrame, folder: str, id_column: str = "cell_id") -> DataFrame:
    """All rows of samples at or below a folder, with their sample's name in front, and their MEAN row."""
    path = F.col("path")
    own = paths.where((path == folder) | path.startswith(folder + "/")).select("sample_id", F.regexp_extract("path", "([^/]*)$", 1).alias("sample_name"))
    rows = cells.join(own, "sample_id").drop("sample_id")
    return metrics.with_summary_rows(rows.select("sample_name", *[F.col(f"`{c}`") for c in rows.columns if c != "sample_name"]), id_column)


def pooled_means(cells: DataFrame, paths: DataFrame, id_column: str = "cell_id") -> DataFrame:
    """(level, column, n, mean) of every numeric column over the pooled rows of each folder: rows are summed by sample, and only these sums go up the folders."""
    return metrics.pooled(cells.join(paths, "sample_id"), "path", [f.name for f in cells.schema.fields if f.dataType.typeName() in ("integer", "long", "float", "double") and f.name not in ("sample_id", id_column)])
