"""Saved runs as a source, folder sheets and report views."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.config import Config, StainConfig
from lumenframe.plans import batch, report
from lumenframe.sources import results

PIXEL = "sample_id string, channel string, z int, y int, x int, v double"


@pytest.fixture(scope="module")
def run(spark):
    rows = []
    for s, n in (("a", 2), ("b", 3)):
        nuclei, stain = np.zeros((14, 24)), np.zeros((14, 24))
        for i in range(n):
            nuclei[4:8, 2 + 7 * i : 6 + 7 * i] = 100 + i
            stain[5 : 6 + i, 3 + 7 * i] = 200
        rows += [(s, c, 0, *map(int, p), float(v)) for c, image in (("dapi", nuclei), ("gfp", stain)) for p, v in np.ndenumerate(image)]
    config = Config(pixel_size_um=None, min_object_size=2, edge_margin=1, channel_roles={"dapi": "nuclear", "gfp": "stain"}, stains={"gfp": StainConfig(min_object_size=1)})
    pixels = spark.createDataFrame(rows, PIXEL)
    sizes = spark.createDataFrame([("a", 0.5, None), ("b", 2.0, None)], "sample_id string, px double, pz double")
    return batch.analyse(pixels, config, calibration=sizes), config


def test_samples_have_their_own_calibration_and_the_format_s_columns(run):
    cells = run[0]["cells"]
    got = sorted((r["sample_id"], r["cell_id"], r["N_area_um2"], r["stain_gfp_area_nuc_um2"]) for r in cells.collect())
    assert got == [("a", 1, 4.0, 0.25), ("a", 2, 4.0, 0.5), ("b", 1, 64.0, 4.0), ("b", 2, 64.0, 8.0), ("b", 3, 64.0, 12.0)]
    assert cells.columns[:8] == ["sample_id", "cell_id", "N_area_um2", "N_circularity", "N_solidity", "N_eccentricity", "N_major_axis_length_um", "N_minor_axis_length_um"]
    assert not [c for c in cells.columns if "centroid" in c or "median" in c or "p10" in c or "integrated" in c or c == "N_dapi_mean"] and "N_gfp_mean" in cells.columns
    m = {(r["sample_id"], r["tier"], r["metric"]): r["value"] for r in run[0]["metrics"].collect()}
    assert m["a", "all", "cell_count"] == 2 and m["b", "all", "stain_gfp_positive_fraction_cell"] == pytest.approx(2 / 3) and m["a", "all", "stain_gfp_area_cell_um2_mean"] == 0.375
    assert ("a", "all", "stain_gfp_alignment_mean") not in m and ("a", "all", "nuclear_alignment") in m


def test_saved_runs_are_read_by_prefix(spark, run, tmp_path):
    tables, config = run
    folder = f"file://{tmp_path}/saved"
    paths = spark.createDataFrame([("a", "root/x/a"), ("b", "root/y/b")], "sample_id string, path string")
    results.write({k: tables[k] for k in ("cells", "cells_filtered", "metrics", "scales", "qc", "outliers")}, paths, folder, config, "2024-05-01 10:00:00")
    x = results.read(spark, folder, "cells", "root/x")
    assert x.count() == 2 and results.read(spark, folder, "cells").count() == 5 and results.read(spark, folder, "cells", "root/z").count() == 0
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "level_2" in plan.split("PartitionFilters", 1)[1].split("]")[0]
    with open(next((tmp_path / "saved" / "sidecar").glob("part-*")), "a") as f:
        f.write("{broken\n")
    for crc in (tmp_path / "saved" / "sidecar").glob(".*.crc"):
        crc.unlink()
    side = results.sidecars(spark, folder).collect()
    assert sorted((r["sample_id"] or "", r["px"], r["damaged"]) for r in side) == [("", None, "{broken"), ("a", 0.5, None), ("b", 2.0, None)]
    assert {r["written_at"] for r in side if r["sample_id"]} == {"2024-05-01T10:00:00"}
    sheet = results.folder_sheet(tables["cells"], paths, "root/y").collect()
    assert [r["cell_id"] for r in sheet].count("MEAN") == 1 and len(sheet) == 4 and next(r["N_area_um2"] for r in sheet if r["cell_id"] == "MEAN") == 64.0
    pooled = {(r["level"], r["column"]): (r["n"], r["mean"]) for r in results.pooled_means(tables["cells"], paths).collect()}
    assert pooled["root", "N_area_um2"] == (5, 40.0) and pooled["root/x", "N_area_um2"] == (2, 4.0)


def test_report_views(run):
    views = report.views(run[0])
    rows = {r["sample_id"]: r for r in views["samples"].collect()}
    assert (rows["a"]["n_cells"], rows["b"]["n_cells"], rows["a"]["px_source"]) == (2, 3, "file")
    assert {r["sample_id"] for r in views["removal"].collect()} == {"a", "b"} and views["acquisition"].count() == 4
    assert {(r["sample_id"], r["column"]) for r in views["boxes"].collect()} >= {("a", "N_area_um2"), ("b", "N_area_um2")}
    assert views["votes"].where(F.col("n") > 0).count() >= 0
