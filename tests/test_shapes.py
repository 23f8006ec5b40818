"""Hulls, surfaces, directors, profiles, quantiles and tiled floods against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import doublets, hull, quantiles, segmentation, spatial, surface

PLACE = "sample_id string, z int, y int, x int, label long"


def labelled(spark, images):
    rows = [(k, *((0,) if a.ndim == 2 else ()), *map(int, p), 1) for k, a in images.items() for p in zip(*np.nonzero(a), strict=True)]
    return spark.createDataFrame(rows, PLACE)


def pieces(mask, eight):
    mask, out = mask.astype(int), []
    for start in zip(*np.nonzero(mask), strict=True):
        if mask[start]:
            todo, own = [start], []
            mask[start] = 0
            while todo:
                y, x = todo.pop()
                own.append((y, x))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p = (y + dy, x + dx)
                        if (dy or dx) and (eight or not (dy and dx)) and 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]:
                            mask[p] = 0
                            todo.append(p)
            out.append(own)
    return out


def hull_image(a):
    points = sorted({(2 * int(y) + dy, 2 * int(x) + dx) for y, x in zip(*np.nonzero(a), strict=True) for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))})
    cross = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    def half(ps):
        h = []
        for p in ps:
            while len(h) > 1 and cross(h[-2], h[-1], p) <= 0:
                h.pop()
            h.append(p)
        return h

    h = half(points)[:-1] + half(points[::-1])[:-1]
    return np.array([[all(cross(h[i], h[(i + 1) % len(h)], (2 * y, 2 * x)) >= 0 for i in range(len(h))) for x in range(a.shape[1])] for y in range(a.shape[0])])


def test_convexity_of_random_objects(spark):
    rng = np.random.default_rng(3)
    images = {f"s{i}": (rng.random((11, 12)) < (0.1, 0.4, 0.8)[i % 3]).astype(int) for i in range(9)} | {"line": np.eye(7, dtype=int), "pixel": np.ones((1, 1), int), "ring": np.pad(np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]]), 1)}
    got = {r["sample_id"]: r for r in hull.convexity(labelled(spark, images)).collect()}
    for k, a in images.items():
        whole, filled = hull_image(a), a.copy()
        ys, xs = np.nonzero(a)
        box = (slice(ys.min(), ys.max() + 1), slice(xs.min(), xs.max() + 1))
        for c in pieces(1 - a[box], False):
            if not any(y in (0, a[box].shape[0] - 1) or x in (0, a[box].shape[1] - 1) for y, x in c):
                for y, x in c:
                    filled[box][y, x] = 1
        r = got[k]
        assert (r["area_convex"], r["convexity_defects"]) == (whole.sum(), len(pieces(whole & (filled == 0), True))), k
        assert math.isclose(r["solidity"], a.sum() / whole.sum())
    assert hull.convexity(labelled(spark, images).limit(0)).count() == 0


def test_surface_of_a_block_and_a_ball(spark):
    g = np.mgrid[-8:9, -8:9, -8:9]
    images = {"block": np.ones((3, 4, 5), int), "ball": ((g**2).sum(0) <= 49).astype(int)}
    labels = labelled(spark, images)
    scale = spark.createDataFrame([("block", 1.0, 1.0), ("ball", 2.0, None)], "sample_id string, px double, pz double")
    got = {r["sample_id"]: r["surface_area"] for r in surface.surface_area(labels, scale).collect()}
    assert math.isclose(got["block"], 2 * (2 * 3 + 2 * 4 + 3 * 4) + 4 * (2 + 3 + 4) * math.sqrt(0.5) + math.sqrt(3))  # sides, edges, corners
    assert 1.0 < got["ball"] / (4 * math.pi * 14**2) < 1.12
    flat = surface.surface_area(labels.where("sample_id = 'block'"), scale.withColumn("pz", F.lit(3.0))).first()["surface_area"]
    assert flat > got["block"]


def test_directors_match_numpy(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for i in range(8):
        p = np.unique(np.round(rng.normal(size=(70, 3)) @ np.diag(rng.permutation([4, 2, 1])) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]).astype(int), axis=0)
        rows += [(f"s{i}", *map(int, q), 1) for q in p]
        c = (p - p.mean(0)) * [1.5, 1, 1]
        want[f"s{i}"] = np.linalg.eigh(c.T @ c / len(c))[1]
    rows += [("one", 0, 0, 0, 1), ("line", 0, 0, 0, 1), ("line", 0, 1, 0, 1)]
    for r in spatial.directors(spark.createDataFrame(rows, PLACE), ["sample_id", "label"], 1.5).collect():
        if r["sample_id"] in want:
            for name, axis in (("long", 2), ("short", 0)):
                assert math.isclose(abs(np.dot(r[name], want[r["sample_id"]][:, axis])), 1, abs_tol=1e-6)
        else:
            assert math.isclose(np.linalg.norm(r["long"]), 1) and (r["sample_id"] == "one" or np.allclose(r["long"], [0, 1, 0]))


def peaks_by_hand(p):
    p = np.array(p, float)
    span = p.max() - p.min()
    if len(p) < 3 or span < 2:
        return 0
    h, _ = np.histogram(p, np.arange(p.min() - 0.5, p.max() + 1.5, 1.0))
    size = max(3, int(len(h) * 0.05))
    before = size // 2
    wide = np.concatenate([h[:before][::-1], h, h[len(h) - (size - before - 1) :][::-1]])
    s = [wide[i : i + size].sum() / size for i in range(len(h))]
    tops = [s[0], *[b for a, b in zip(s[:-1], s[1:], strict=True) if b != a]]  # plateaus as one
    return sum(a < b > c and b >= 0.5 for a, b, c in zip(tops[:-2], tops[1:-1], tops[2:], strict=True))


def test_profile_peaks(spark):
    rng = np.random.default_rng(6)
    groups = {"spike": [0] + [5] * 4 + [10], "two": [0] + [5] * 3 + [11] * 3 + [16], "few": [1, 2], "short": [1, 1.5, 2.2, 2.9], "fraction": [0, 5.2, 5.2, 5.2, 9.7]}
    groups |= {f"g{i}": np.round(rng.normal(0, (2, 10, 60)[i % 3], 20 + 20 * i), 3).tolist() for i in range(12)}
    d = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r["n_peaks"] for r in spatial.axis_profile_peaks(d, ["g"], F.col("v")).collect()}
    assert got == {k: peaks_by_hand(v) for k, v in groups.items()} and got["spike"] == 1 and got["two"] == 2


def test_stain_in_stacks(spark):
    a = np.zeros((9, 5, 5), int)
    a[1:8, 1:4, 1:4] = 1
    stain = np.zeros_like(a)
    stain[[1, 4, 7], 2, 2] = 1
    got = spatial.stain_spatial(labelled(spark, {"s": stain}), labelled(spark, {"s": a, "t": a}), 0.5, False).collect()
    of = {r["sample_id"]: r for r in got}
    assert (of["s"]["n_stain_particles"], of["s"]["peak_count_major"], of["s"]["freq_minor_axis"]) == (3, 0, None) and of["s"]["freq_major_axis"] == 0
    assert (of["t"]["n_stain_particles"], of["t"]["particle_alignment"], of["t"]["peak_count_minor"]) == (0, None, 0)


@pytest.mark.parametrize("few", [3, 10_000])
def test_quantiles_of_skewed_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "SORTED", few)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = np.random.default_rng(8)
    groups = {"wide": np.exp(rng.normal(0, 12, 600)), "equal": np.full(50, 2.5), None: rng.integers(0, 9, 200).astype(float), "one": np.array([4.0]), "far": np.array([*range(90), 1e300])}
    d = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None)], "g string, v double")
    shares = {"low": 0.1, "mid": 0.5, "high": 0.9}
    got = {r["g"]: [r[n] for n in shares] for r in quantiles.quantiles(d, ["g"], F.col("v"), shares).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert np.allclose(got[k], np.percentile(v, [10, 50, 90]), rtol=1e-12)


@pytest.mark.parametrize("flat", [True, False])
def test_floods_over_tiles_are_those_of_one_tile(spark, monkeypatch, flat):
    rng = np.random.default_rng(9)
    shape = (1, 17, 19) if flat else (5, 7, 8)
    rows = [("s", *map(int, p), float(v)) for p, v in np.ndenumerate(rng.integers(0, 6, shape)) if rng.random() < 0.9]
    mask = spark.createDataFrame(rows, "sample_id string, z int, y int, x int, e double")
    seeds = [rows[i][:4] for i in (0, len(rows) // 2, len(rows) - 1)]
    markers = spark.createDataFrame([(*p, i) for i, p in enumerate(seeds, 1)], PLACE)
    found = []
    for side in (64, 4):
        monkeypatch.setattr(segmentation, "TILE", side)
        monkeypatch.setattr(segmentation, "TILE_DEEP", side)
        found.append({tuple(r) for r in segmentation.flooded(markers, mask, "e", flat).collect()})
    assert found[0] == found[1] and {r[-1] for r in found[0]} == {1, 2, 3}


def test_segmentation_splits_touching_disks_and_numbers_them_last(spark):
    y, x = np.mgrid[:30, :70]
    disk = lambda cy, cx: (y - cy) ** 2 + (x - cx) ** 2 <= 30
    image = np.where(disk(14, 12) | disk(14, 22) | disk(14, 40) | disk(14, 58), 100, 0)
    pixels = spark.createDataFrame([("s", 0, *map(int, p), float(v)) for p, v in np.ndenumerate(image)], "sample_id string, z int, y int, x int, v double")
    got = {(r["y"], r["x"]): r["label"] for r in doublets.segment(pixels, 50, 255, 2, 20, 1, threshold=0.3, min_distance=5).collect()}
    assert len(got) == (image > 0).sum()
    assert (got[14, 40], got[14, 58]) == (1, 2) and {got[14, 12], got[14, 22]} == {3, 4}
    whole = doublets.segment(pixels, 50, 255, 2, 20, 1, threshold=0.9).select("label").distinct().count()
    assert whole == 3
