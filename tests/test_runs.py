"""Whole runs: particle mode, cytoplasm sources, samples from folders."""

import math

import numpy as np
import pytest

from lumenframe.config import Config, CytoplasmConfig, StainConfig
from lumenframe.operators import metrics, segmentation
from lumenframe.plans import batch
from lumenframe.sources import samples, tiff

PIXEL = "sample_id string, channel string, z int, y int, x int, v double"
LABEL = "sample_id string, z int, y int, x int, label long"


def rows(sample, channel, a):
    a = np.asarray(a, float)
    a = a if a.ndim == 3 else a[None]
    return [(sample, channel, *map(int, i), float(v)) for i, v in np.ndenumerate(a)]


def spots(seed, n):
    a = np.zeros((20, 20))
    rng = np.random.default_rng(seed)
    for i in range(n):
        y, x = divmod(i, 4)
        a[1 + 4 * y : 2 + 4 * y + int(rng.integers(1, 3)), 1 + 4 * x : 2 + 4 * x + int(rng.integers(1, 3))] = rng.integers(50, 200)
    return a


STAINS = Config(pixel_size_um=0.5, edge_margin=1, channel_roles={"g": "stain", "r": "stain"}, stains={s: StainConfig(min_object_size=2) for s in "gr"})


def tables(run):
    return {k: sorted(map(str, run[k].collect())) for k in ("particles", "metrics", "qc", "outliers")}


def test_particle_mode_of_two_samples_is_that_of_each(spark):
    one = {s: rows(s, "g", spots(i, 9)) + rows(s, "r", spots(i + 5, 5)) for i, s in enumerate("ab")}
    both = tables(batch.analyse(spark.createDataFrame(one["a"] + one["b"], PIXEL), STAINS, type_max={"g": 255}))
    each = [tables(batch.analyse(spark.createDataFrame(one[s], PIXEL), STAINS, type_max={"g": 255})) for s in "ab"]
    assert all(both[k] == sorted(each[0][k] + each[1][k]) and both[k] for k in both)


def test_particles_are_numbered_and_measured(spark):
    g, r = np.zeros((10, 12)), np.zeros((10, 12))
    g[2:4, 2:5] = 100
    g[6:8, 6:8] = 50
    g[0:3, 10:12] = 90  # at the border
    r[5:8, 2:4] = 70
    px = spark.createDataFrame(rows("s", "g", g) + rows("s", "r", r) + rows("e", "g", np.zeros((4, 4))), PIXEL)
    run = batch.analyse(px, STAINS)
    got = {(p["stain"], p["label_id"]): p for p in run["particles"].collect()}
    assert {k: (p["cell_id"], p["area_um2"], p["intensity_mean"]) for k, p in got.items()} == {("g", 1): (1, 1.5, 100.0), ("g", 2): (2, 1.0, 50.0), ("r", 1): (3, 1.5, 70.0)}
    assert got["g", 1]["r_mean"] == 0 and got["g", 1]["g_mean"] is None and got["r", 1]["solidity"] == 1.0
    m = {(x["sample_id"], x["metric"]): x["value"] for x in run["metrics"].where("tier = 'all'").collect()}
    assert m["s", "stain_g_particle_count"] == 2 and m["s", "stain_g_area_total_um2"] == 2.5 and math.isclose(m["s", "stain_g_coverage_fraction_image"], 10 / 120)
    assert math.isclose(m["s", "stain_g_area_mean_um2_sem"], 0.25) and m["e", "stain_g_particle_count"] == 0 and m["e", "stain_g_area_mean_um2"] is None
    assert ("e", "stain_r_particle_count") not in m and m["s", "qc_r_threshold_min_used"] == 18 and m["s", "qc_r_pct_saturated"] is None


def test_particle_mode_needs_a_stain(spark):
    with pytest.raises(ValueError):
        batch.analyse(spark.createDataFrame([], PIXEL), Config(channel_roles={"g": "none"}))


def test_particles_of_a_stack(spark):
    a = np.zeros((4, 6, 6))
    a[1:3, 2:4, 2:4] = 100
    config = Config(pixel_size_um=1.0, z_size_um=2.0, edge_margin=1, channel_roles={"g": "stain"}, stains={"g": StainConfig(min_object_size=1)})
    (p,) = batch.analyse(spark.createDataFrame(rows("s", "g", a), PIXEL), config, flat=False)["particles"].collect()
    assert p["volume_um3"] == 16.0 and math.isclose(p["elongation"], 0.5, abs_tol=1e-6) and p["sphericity"] > 0


@pytest.mark.parametrize("flat", [True, False])
def test_cytoplasm_goes_to_the_nearest_nucleus_or_stops_at_the_membrane(spark, flat):
    v = np.full((1, 1, 9), 100.0)
    v[0, 0, 6] = 200  # the membrane
    px = spark.createDataFrame(rows("s", "c", v), PIXEL)
    nuclei = spark.createDataFrame([("s", 0, 0, 0, 1), ("s", 0, 0, 8, 2)], LABEL)
    split = {}
    for source in ("channel", "membrane"):
        c = CytoplasmConfig(source=source)
        split[source] = {r["x"]: r["label"] for r in batch.cytoplasm_by_flood(nuclei, px, c, flat).collect()}
    assert [split["channel"][x] for x in (1, 2, 3, 5, 6, 7)] == [1, 1, 1, 2, 2, 2]
    assert [split["membrane"][x] for x in (1, 2, 3, 4, 5, 7)] == [1, 1, 1, 1, 1, 2]
    few = batch.cytoplasm_by_flood(nuclei, px, CytoplasmConfig(source="membrane", min_object_size=3), flat)
    assert {r["label"] for r in few.collect()} == {1}


def test_distance_in_a_stack(spark):
    rng = np.random.default_rng(5)
    a = (rng.random((3, 5, 6)) < 0.85).astype(float)
    px = spark.createDataFrame(rows("s", "c", a), PIXEL)
    got = {(r["z"], r["y"], r["x"]): r["d2"] for r in segmentation.distance(px.where("v > 0"), px, flat=False, aniso=1.5).collect()}
    off = np.argwhere(a == 0) * [1.5, 1, 1]
    assert got == {tuple(map(int, p)): float((((off - p * [1.5, 1, 1])) ** 2).sum(1).min()) for p in np.argwhere(a > 0)}


def test_samples_from_folders(spark, tmp_path):
    for name, px in (("one", 0.5), ("two", None)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "dapi.tif").write_bytes(tiff.encode(np.full((2, 3), 7, np.uint8)))
        (tmp_path / name / "gfp.tif").write_bytes(tiff.encode(np.arange(6, dtype=np.uint16).reshape(2, 3), px))
        (tmp_path / name / "gfp.tiff").write_bytes(b"not read")
    (tmp_path / "two" / "bad.tif").write_bytes(b"no image")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.tif").write_bytes(tiff.encode(np.zeros((1, 1), np.uint8)))
    found = samples.load(spark, str(tmp_path), Config(channel_roles={"dapi": "nuclear"}))
    counts = {(r["sample_id"].rsplit("/", 1)[1], r["channel"]): (r["count"], r["sum(v)"]) for r in found.pixels.groupBy("sample_id", "channel").agg({"*": "count", "v": "sum"}).withColumnRenamed("count(1)", "count").collect()}
    assert counts == {(s, c): (6, t) for s in ("one", "two") for c, t in (("dapi", 42.0), ("gfp", 15.0))}
    cal = {r["name"]: (r["px"], r["pz"], r["is_3d"]) for r in found.calibration.collect()}
    assert math.isclose(cal["one"][0], 0.5) and cal["two"] == (None, None, False)
    assert [r["channel"] for r in found.unreadable.collect()] == ["bad"]
    by_file = samples.load(spark, str(tmp_path / "other"), Config(input_mode="file_per_sample"))
    assert {(r["sample_id"].rsplit("/", 1)[1], r["channel"]) for r in by_file.pixels.collect()} == {("x", "c0")}


def test_quality_without_band_or_type(spark):
    px = spark.createDataFrame([("s", "c", 0, 0, 0, 3.0), ("s", "c", 0, 0, 1, None)], PIXEL)
    (q,) = metrics.channel_qc_bands(px, {}, None).collect()
    assert (q["mean"], q["saturated_pct"], q["in_band_pct"], q["threshold_min_used"]) == (3.0, None, None, None)
    assert {r["metric"] for r in metrics.qc_rows(metrics.channel_qc_bands(px, {}, None)).collect()} == {"qc_c_intensity_mean", "qc_c_pct_saturated"}
