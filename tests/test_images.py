"""Segmentation and features on small shapes whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import compartments, features, outliers, quantiles, segmentation, spatial

PIXEL = "sample_id string, channel string, z int, y int, x int, v double"


def frame(spark, images):
    out = []
    for name, a in images.items():
        a = np.asarray(a, float)
        a = a if a.ndim == 3 else a[None]
        out += [(name, "c0", *map(int, i), float(v)) for i, v in np.ndenumerate(a)]
    return spark.createDataFrame(out, PIXEL)


def grid(df, shape, value="label"):
    out = np.zeros(shape, int)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


RING = [[0] * 7, [0, 1, 1, 1, 0, 0, 0], [0, 1, 0, 1, 0, 0, 0], [0, 1, 1, 1, 0, 0, 0], [0, 0, 0, 0, 1, 0, 0], [0] * 7]


def test_components_by_connectivity(spark):
    mask = frame(spark, {"a": RING}).where("v > 0")
    for connectivity, n in ((1, 2), (2, 1)):
        assert segmentation.components(mask, connectivity).select("label").distinct().count() == n


def test_components_match_a_flood(spark):
    rng = np.random.default_rng(4)
    images = {f"s{i}": (rng.random((9, 11)) < 0.45).astype(int) for i in range(4)}
    labels = segmentation.components(frame(spark, images).where("v > 0"), 1).collect()
    for name, a in images.items():
        got = {(r["y"], r["x"]): r["label"] for r in labels if r["sample_id"] == name}
        seen = {}
        for start in zip(*np.nonzero(a), strict=True):
            todo = [start]
            while todo:
                y, x = todo.pop()
                if 0 <= y < 9 and 0 <= x < 11 and a[y, x] and (y, x) not in seen:
                    seen[y, x] = start
                    todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
        pairs = {(got[int(y), int(x)], s) for (y, x), s in seen.items()}
        assert len(pairs) == len({p for p, _ in pairs}) == len({s for _, s in pairs})


def test_stack_connectivity(spark):
    a = np.zeros((2, 3, 3))
    a[0, 0, 0] = a[1, 1, 1] = 1
    mask = frame(spark, {"a": a}).where("v > 0")
    assert [segmentation.components(mask, c, flat=False).select("label").distinct().count() for c in (1, 2, 3)] == [2, 2, 1]


def test_holes_and_relabelling(spark):
    px = frame(spark, {"a": RING})
    filled = segmentation.holes_filled(px.where("v > 0"), px)
    assert filled.count() == 10
    labels = segmentation.segment(px, 1, 1, 1, min_size=2)
    assert grid(labels, (6, 7)).max() == 1 and labels.count() == 9
    assert segmentation.segment(px, 1, 1, 1, min_size=2, margin=2).count() == 0


def test_empty_mask(spark):
    px = frame(spark, {"a": [[0, 0], [0, 0]]})
    assert segmentation.components(px.where("v > 5"), 2).count() == 0
    assert segmentation.segment(px, 5, 9, 2).count() == 0


def test_distance_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    a = (rng.random((8, 9)) < 0.8).astype(int)
    px = frame(spark, {"a": a})
    got = {(r["y"], r["x"]): r["d2"] for r in segmentation.distance(px.where("v > 0"), px).collect()}
    off = np.argwhere(a == 0)
    assert got == {(y, x): int(((off - (y, x)) ** 2).sum(1).min()) for y, x in np.argwhere(a)}
    full = frame(spark, {"f": np.ones((2, 2))})
    assert {r["d2"] for r in segmentation.distance(full, full).collect()} == {None}


def test_flood_splits_at_the_ridge(spark):
    px = frame(spark, {"a": [[1, 2, 3, 2, 1]]})
    markers = spark.createDataFrame([("a", 0, 0, 0, 7), ("a", 0, 0, 4, 9)], "sample_id string, z int, y int, x int, label long")
    assert grid(segmentation.flooded(markers, px, "v"), (1, 5)).tolist() == [[7, 7, 7, 9, 9]]


def test_dilation_is_a_disk(spark):
    one = spark.createDataFrame([("a", 0, 5, 5, 1)], "sample_id string, z int, y int, x int, label long")
    assert segmentation.dilated(one, 2).count() == 13 and segmentation.dilated(one, 2, flat=False).count() == 33


def test_adjacency_ties_and_shared_cytoplasm(spark):
    s = "sample_id string, z int, y int, x int, label long"
    nuclei = spark.createDataFrame([("a", 0, 5, 5, 1), ("a", 0, 5, 12, 2), ("a", 0, 40, 40, 3)], s)
    cyto = spark.createDataFrame([("a", 0, 5, 4, 9), ("a", 0, 5, 6, 8), ("a", 0, 5, 11, 8)], s)
    m = {r["nuc_id"]: r["cyto_id"] for r in compartments.adjacent_cytoplasm(nuclei, cyto).collect()}
    assert m == {1: 8, 2: 8}  # a tie goes to the lower label; nucleus 3 touches none
    t = compartments.territories(nuclei, cyto, compartments.adjacent_cytoplasm(nuclei, cyto))
    owner = {(r["y"], r["x"]): r["cell_id"] for r in t.collect()}
    assert owner[5, 6] == owner[5, 11] == 2 and owner[5, 5] == 1 and (5, 4) not in owner


def test_ellipse_of_a_bar(spark):
    px = frame(spark, {"a": np.ones((1, 12))})
    r = features.ellipse(px, ["sample_id"]).first()
    assert math.isclose(r["major"], 4 * math.sqrt((144 - 1) / 12)) and r["eccentricity"] > 0.99 and r["area"] == 12


def test_perimeter_of_a_square(spark):
    px = frame(spark, {"a": np.ones((4, 4))})
    assert math.isclose(features.perimeter(px, ["sample_id"]).first()["perimeter"], 12)


def test_ellipsoid_axes_match_numpy(spark):
    rng = np.random.default_rng(0)
    a = rng.random((5, 6, 7)) < 0.3
    r = features.ellipsoid(frame(spark, {"a": a}).where("v > 0"), ["sample_id"], 2.0).first()
    p = np.argwhere(a) * [2.0, 1, 1]
    want = 2 * np.sqrt(5 * np.linalg.eigvalsh(np.cov(p.T, bias=True)))[::-1]
    assert np.allclose([r["major"], r["mid"], r["minor"]], want, atol=1e-6)


def test_constant_texture_is_null(spark):
    r = features.texture(frame(spark, {"a": np.full((4, 4), 3)}), ["sample_id"]).first()
    assert r["contrast"] is None and r["correlation"] is None


def test_texture_of_stripes(spark):
    r = features.texture(frame(spark, {"a": [[0, 255, 0, 255]] * 4}), ["sample_id"]).first()
    assert math.isclose(r["contrast"], 255**2 * 3 / 4)  # all neighbours differ but those above


def test_robust_z_without_spread_flags_none(spark):
    d = spark.createDataFrame([("a", 10.0)] * 5 + [("a", 1e9), ("b", 0.0), ("b", -1.0), ("b", None)], "channel string, size double")
    assert outliers.screened(d, ["channel"]).where("flagged").count() == 0


def test_robust_z_flags_the_far_one(spark):
    d = spark.createDataFrame([(i, 100.0 + i) for i in range(9)] + [(9, 1e6)], "id int, size double").withColumn("channel", F.lit("a"))
    assert [r["id"] for r in outliers.screened(d, ["channel"]).where("flagged").collect()] == [9]


def test_axis_peaks(spark):
    line = [("a", float(p)) for p in (0, 0, 0, 0, 10, 10, 10, 10, 20, 20, 20, 20)]
    d = spark.createDataFrame(line + [("b", 1.0), ("b", 2.0)], "sample_id string, p double")
    got = {r["sample_id"]: (r["n_peaks"], r["frequency"]) for r in spatial.axis_profile_peaks(d, ["sample_id"], F.col("p")).collect()}
    assert got["b"] == (0, None) and got["a"] == (1, 1 / 20)  # a smoothed block is a plateau and counts once; the ends do not


@pytest.mark.parametrize("n,order", [([(0, 0, 1), (0, 0, -1)], 1.0), ([(1, 0, 0), (0, 1, 0), (0, 0, 1)], 0.0)])
def test_nematic_order(spark, n, order):
    d = spark.createDataFrame([("a", *map(float, v)) for v in n], "sample_id string, nx double, ny double, nz double")
    assert math.isclose(spatial.nematic_order(d, ["sample_id"]).first()["order"], order, abs_tol=1e-6)


def test_medians_of_groups_match_and_keep_null_groups(spark):
    import random
    import statistics

    rng, rows = random.Random(7), []
    for g in ("a", "b", None):
        rows += [(g, rng.choice([None, rng.gauss(0, 3), 1.5])) for _ in range(rng.randint(20, 40))]
    rows += [("c", 2.0), ("d", None), ("e", -1.25), ("e", 7.0)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["m"]) for r in quantiles.with_median(d, ["g"], F.col("v"), "m").select("g", "m").distinct().collect()}
    of = lambda g: [v for h, v in rows if h == g and v is not None]
    assert got == {(g, statistics.median(of(g)) if of(g) else None) for g in ("a", "b", "c", "d", "e", None)}
    assert quantiles.with_median(d.where("g = 'e'"), [], F.col("v"), "m").first()["m"] == 2.875


def test_spaced_points_match_a_greedy_choice(spark):
    import random

    rng = random.Random(3)
    rows = list({("a" if i % 2 else "b", rng.randrange(30), rng.randrange(30)): rng.randrange(6) for i in range(160)}.items())
    d = spark.createDataFrame([(*k, v) for k, v in rows], "g string, y int, x int, v long")
    want = set()
    for g in "ab":
        kept = []
        for v, y, x in sorted((-v, y, x) for (h, y, x), v in rows if h == g):
            if all(max(abs(y - q), abs(x - r)) >= 4 for _, q, r in kept):
                kept.append((v, y, x))
        want |= {(g, y, x, -v) for v, y, x in kept}
    assert {tuple(r) for r in segmentation.spaced(d, ["g"], 4, "v").select("g", "y", "x", "v").collect()} == want
    assert segmentation.spaced(d.limit(0), ["g"], 4, "v").count() == 0


def test_touching_disks_are_split_and_a_single_one_is_not(spark):
    y, x = np.mgrid[:26, :56]
    disk = lambda cy, cx: (y - cy) ** 2 + (x - cx) ** 2 <= 25
    label = np.where(disk(12, 12) | disk(12, 21), 1, np.where(disk(12, 40), 2, 0))
    pixels = frame(spark, {"a": label})
    labels = pixels.where("v > 0").select("sample_id", "z", "y", "x", F.col("v").cast("long").alias("label"))
    out = segmentation.split_doublets(labels, pixels, 5)
    rows = out.collect()
    assert len(rows) == (label > 0).sum()
    one = {(r["y"], r["x"]): r["part"] for r in rows if r["label"] == 1}
    assert {r["part"] for r in rows if r["label"] == 2} == {1} and set(one.values()) == {1, 2}
    assert all(p == one[12, 12] for (_, c), p in one.items() if c < 16) and all(p == one[12, 21] for (_, c), p in one.items() if c > 17)
    assert segmentation.split_doublets(labels.limit(0), pixels, 5).count() == 0
