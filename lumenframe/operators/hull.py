"""Convex hulls of flat objects: hull area, solidity and convexity defects, without a pixel of theirs in one place.

The hull is that of the middles of the pixels' four sides, in doubled whole coordinates, so every
comparison is exact. Each row gives three points a side; the left and the right chain are folds
over an object's rows (the right one mirrored), and every row between two points of a chain gets its
end by the line between them. The hull's image holds the pixels whose centres lie in it or on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.geometry import ratio
from lumenframe.operators import runs as R
from lumenframe.runtime import written

OBJECT = ["sample_id", "label"]
POINT = "array<struct<y:int,x:int>>"


def up(a: Column, b: Column) -> Column:
    """Least whole number not under a / b, for whole a and b > 0."""
    c = a + b - 1
    return F.call_function("div", c - F.pmod(c, b), b)


def chain(points: Column) -> Column:
    """Corners of the lower hull of points sorted by y: a new point drops those at the end that the line to it leaves on or above it."""

    def add(kept: Column, p: Column) -> Column:
        def below(q: Column, i: Column) -> Column:
            a = F.get(kept, i - 1)
            return (i == 0) | ((q["x"] - a["x"]) * (p["y"] - a["y"]) < (p["x"] - a["x"]) * (q["y"] - a["y"]))

        return F.concat(F.filter(kept, below), F.array(p))

    return F.aggregate(points, F.array().cast(POINT), add)


def hull_rows(runs: DataFrame) -> DataFrame:
    """(sample_id, z, y, a, b): first and last column of each row of the hull's image of each image's ``runs``."""
    ends = runs.groupBy(*R.ROW).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), (2 * F.col("x0")).alias("e")), F.struct(F.lit(1).alias("side"), (-2 * F.col("x1")).alias("e")))).alias("s")
    row = ends.select(*R.ROW, side).select("sample_id", "z", "y", "s.*")
    three = F.explode(F.array(*[F.struct((2 * F.col("y") + d).cast("int").alias("y"), (F.col("e") - int(d == 0)).cast("int").alias("x")) for d in (-1, 0, 1)])).alias("p")
    points = row.select("sample_id", "z", "side", three).groupBy("sample_id", "z", "side", F.col("p.y").alias("y")).agg(F.min("p.x").alias("x"))
    corners = points.groupBy("sample_id", "z", "side").agg(chain(F.array_sort(F.collect_list(F.struct("y", "x")))).alias("c"))  # two rows of points for each row of the object
    lines = corners.select("sample_id", "z", "side", F.explode(F.arrays_zip(F.slice("c", 1, F.size("c") - 1).alias("p"), F.slice("c", 2, F.size("c") - 1).alias("q"))).alias("l"))
    p, q = F.col("l.p"), F.col("l.q")
    at = lines.select("sample_id", "z", "side", p.alias("p"), q.alias("q"), F.explode(F.sequence(F.ceil(p["y"] / 2), F.floor(q["y"] / 2))).alias("y"))
    p, q = F.col("p"), F.col("q")
    long = lambda c: c.cast("long")
    end = up(long(p["x"]) * (q["y"] - p["y"]) + long(q["x"] - p["x"]) * (2 * F.col("y") - p["y"]), 2 * long(q["y"] - p["y"]))
    rows = at.select("sample_id", "z", F.col("y").cast("int").alias("y"), "side", end.cast("int").alias("end"))
    return rows.groupBy(*R.ROW).agg(F.min(F.when(F.col("side") == 0, F.col("end"))).alias("a"), (-F.min(F.when(F.col("side") == 1, F.col("end")))).alias("b"))


def as_images(labels: DataFrame) -> DataFrame:
    """Each object as an image of its own: sample_id is (sample_id, label)."""
    return labels.select(F.struct(*OBJECT).alias("sample_id"), "z", "y", "x")


def filled(labels: DataFrame, flat: bool = True) -> DataFrame:
    """``labels``, each object with its own holes filled; an object may then hold pixels of another."""
    own = written(R.runs_of(as_images(labels)), "object-runs")
    both = own.unionByName(R.holes(own, flat))
    return R.pixels_of(both).select("sample_id.sample_id", "z", "y", "x", "sample_id.label")


def convexity(labels: DataFrame) -> DataFrame:
    """(sample_id, label, area_convex, solidity, convexity_defects) of flat objects.

    Solidity is the object's area over its hull's; defects are the pieces, by corners too, of the
    hull's image that the object with its holes filled leaves open. A pixel, and any straight row of
    pixels, is its own hull.
    """
    own = written(R.runs_of(as_images(labels)), "object-runs")
    rows = written(hull_rows(own), "hull-rows")
    open_ = R.gaps(own, rows).drop("inner").join(R.holes(own).select(*R.ROW, "x0").hint("merge"), [*R.ROW, "x0"], "left_anti")
    pieces = R.labelled(open_, 2).groupBy("sample_id").agg(F.countDistinct("z", "label").alias("convexity_defects"))
    area = own.groupBy("sample_id").agg(F.sum(R.length()).alias("area"))
    hull = rows.groupBy("sample_id").agg(F.sum(F.col("b") - F.col("a") + 1).alias("area_convex"))
    out = hull.join(area.hint("merge"), "sample_id").join(pieces.hint("merge"), "sample_id", "left").fillna(0, ["convexity_defects"])
    return out.select("sample_id.sample_id", "sample_id.label", "area_convex", ratio(F.col("area").cast("double"), F.col("area_convex")).alias("solidity"), "convexity_defects")
