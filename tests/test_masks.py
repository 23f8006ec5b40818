"""Masks written as TIFF: round trips, samples without objects, and nothing left by a failed job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.sources import masks, tiff

PLACE = "sample_id string, z int, y int, x int"


def test_masks_round_trip(spark, tmp_path):
    rng = np.random.default_rng(4)
    images = {"a": rng.integers(0, 4, (2, 7, 9)), "p/b": rng.integers(0, 2, (1, 5, 6)) * 70_000, "none": np.zeros((1, 3, 3), int)}
    every = [(s, *map(int, i), int(v)) for s, a in images.items() for i, v in np.ndenumerate(a)]
    pixels = spark.createDataFrame(every, PLACE + ", label long")
    scale = spark.createDataFrame([("a", 0.5, 2.0)], "sample_id string, px double, pz double")
    masks.write_masks(pixels.where("label > 0").repartition(3), pixels, f"file://{tmp_path}/out", "nuclear", scale)
    for s, a in images.items():
        for kind, want in (("labeled", a), ("binary", (a > 0) * 255)):
            got, px, pz = tiff.decode((tmp_path / "out" / s / f"nuclear_{kind}.tif").read_bytes())
            assert np.array_equal(got, np.squeeze(want, 0) if len(want) == 1 else want)
            assert got.dtype == (np.uint8 if kind == "binary" else np.uint32 if a.max() > 65535 else np.uint16)
            assert (s == "a") == (px is not None) and (s != "a" or (abs(px - 0.5) < 1e-5 and pz == 2.0))
    assert not list((tmp_path / "out").glob(".stage*"))


def test_a_failed_job_shows_no_file(spark, tmp_path):
    pixels = spark.range(40).select(F.lit("s").alias("sample_id"), F.lit(0).alias("z"), (F.col("id") / 8).cast("int").alias("y"), (F.col("id") % 8).cast("int").alias("x"))
    bad = pixels.withColumn("label", F.when(F.col("y") == 4, F.raise_error(F.lit("broken"))).otherwise(F.lit(1)).cast("long"))
    with pytest.raises(Exception, match="broken"):
        masks.write_masks(bad, pixels, f"file://{tmp_path}/out", "nuclear")
    assert not list(tmp_path.rglob("*.tif"))
