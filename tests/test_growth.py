"""Plans of steps whose cost must follow the input: what is broadcast, and what meets in one task."""

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import hull, runs, segmentation
from lumenframe.operators.quantiles import with_median
from lumenframe.sources import pixels


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_few_groups_are_not_brought_together_for_their_median(spark):
    d = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("double").alias("v"))
    out = with_median(d, ["g"], F.col("v"), "med")
    assert "SortMergeJoin" not in plan(out) and "BroadcastHashJoin" in plan(out)
    assert "hashpartitioning(g" not in plan(out)
    assert {(r["g"], r["med"]) for r in out.select("g", "med").distinct().collect()} == {("0", 1498.5), ("1", 1499.5), ("2", 1500.5)}


@pytest.fixture(scope="module")
def band(spark):
    rows = spark.range(40).select(F.col("id"), F.expr("transform(sequence(0, 63), i -> pmod(xxhash64(id, i), 4))").alias("a"))
    return pixels.from_arrays(rows, "id", "a", 8).where("v > 0")


def test_tables_of_runs_and_objects_are_not_broadcast(spark, band):
    spark.sparkContext.setJobGroup("growth", "growth")
    labels = segmentation.components(band, 2)
    assert "Broadcast" not in plan(labels)
    assert "Broadcast" not in plan(hull.convexity(labels))
    edges = runs.touching(runs.runs_of(band).withColumn("id", F.monotonically_increasing_id()), 2)
    assert "Broadcast" not in plan(edges)


def test_objects_within_a_tile_are_flooded_once(spark, monkeypatch):
    names, keep = [], segmentation.written
    monkeypatch.setattr(segmentation, "written", lambda df, name: (names.append(name), keep(df, name))[1])
    mask = spark.createDataFrame([(1, 0, 0, x, 0.0) for x in range(200)], "sample_id long, z int, y int, x int, e double")
    markers = spark.createDataFrame([(1, 0, 0, 0, 7)], "sample_id long, z int, y int, x int, label long")
    assert segmentation.flooded(markers, mask.where("x < 127"), "e").where("label = 7").count() == 127
    assert "changed-tiles" not in names  # nothing to exchange
    assert segmentation.flooded(markers, mask, "e").where("label = 7").count() == 200
    assert "changed-tiles" in names
