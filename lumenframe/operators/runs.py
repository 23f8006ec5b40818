"""Masks as horizontal runs: (sample_id, z, y, x0, x1), ends included. Far fewer rows than pixels, and the unit in which components are found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.runtime import forget, written

ROW = ["sample_id", "z", "y"]
TILE = 64  # columns of a tile; runs of neighbouring rows meet by tile, so that a row of many runs is no product


def runs_of(mask: DataFrame) -> DataFrame:
    """The runs of a mask's pixels(sample_id, z, y, x); repeated pixels count once."""
    place = F.dense_rank().over(Window.partitionBy(*ROW).orderBy("x"))
    return mask.select(*ROW, "x", (F.col("x") - place).alias("_gap")).groupBy(*ROW, "_gap").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_gap")


def pixels_of(runs: DataFrame, *keep: str) -> DataFrame:
    """The pixels of runs, with the columns ``keep``."""
    return runs.select(*ROW, F.explode(F.sequence("x0", "x1")).alias("x"), *keep)


def touching(runs: DataFrame, connectivity: int, flat: bool = True) -> DataFrame:
    """(sample_id, u, v): ids of runs(sample_id, z, y, x0, x1, id) that touch when at most ``connectivity`` coordinates change."""
    moves = [(dz, dy) for dz in ((0,) if flat else (-1, 0, 1)) for dy in (-1, 0, 1) if (dz, dy) > (0, 0) and abs(dz) + abs(dy) <= connectivity]
    move = F.explode(F.array(*[F.struct(F.lit(dz).alias("z"), F.lit(dy).alias("y"), F.lit(int(abs(dz) + abs(dy) < connectivity)).alias("t")) for dz, dy in moves])).alias("d")
    tile = lambda a, b: F.explode(F.sequence(F.floor(a / TILE), F.floor(b / TILE))).alias("tile")
    left = runs.select("*", move).select(
        "sample_id", (F.col("z") + F.col("d.z")).alias("z"), (F.col("y") + F.col("d.y")).alias("y"), (F.col("x0") - F.col("d.t")).alias("a0"), (F.col("x1") + F.col("d.t")).alias("a1"), F.col("id").alias("u")
    )
    left = left.select("*", tile(F.col("a0"), F.col("a1")))
    right = runs.select(*ROW, "x0", "x1", F.col("id").alias("v"), tile(F.col("x0"), F.col("x1")))
    return left.join(right.hint("merge"), [*ROW, "tile"]).where("a0 <= x1 and a1 >= x0").select("sample_id", "u", "v").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(sample_id, id, root): the least id of the component of each id that edges(sample_id, u, v) name.

    Alternates two moves until nothing changes: each id's greater neighbours go to its least one, then
    its lesser neighbours do. Edges never grow in number, and rounds are of the order of the
    logarithm of the longest path; a state is removed once the next is written.
    """
    key = ["sample_id", "u"]
    near = Window.partitionBy(*key)
    link = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    state = written(edges.where("u != v").select("sample_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = state.select("sample_id", F.explode(F.array(link("u", "v"), link("v", "u"))).alias("e")).select("sample_id", "e.u", "e.v")
        least = F.least(F.col("u"), F.min("v").over(near)).alias("least")
        wide = both.select(*key, "v", least).where("v > u").select("sample_id", F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        low = wide.select(*key, "v", F.min("v").over(near).alias("least"))
        moved = low.select("sample_id", F.explode(F.array(link("u", "least"), link("v", "least"))).alias("e")).select("sample_id", "e.u", "e.v")
        after = written(moved.where("u != v").distinct(), "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("sample_id", "u", "v").cast("decimal(38,0)"))).first()
        forget(state)
        state = after
        if mark == before:
            return state.select("sample_id", F.col("u").alias("id"), F.col("v").alias("root"))
        before = mark


def labelled(runs: DataFrame, connectivity: int, flat: bool = True) -> DataFrame:
    """``runs`` with ``label``, the least raster place of the component of each."""
    runs = written(runs.select(*ROW, "x0", "x1"), "runs")
    size = runs.agg(F.max("y"), F.max("x1")).first()
    if size[0] is None:
        return runs.withColumn("label", F.lit(0).cast("long"))
    width, height = int(size[1]) + 1, int(size[0]) + 1
    named = runs.withColumn("id", (F.col("z") * F.lit(width * height).cast("long") + F.col("y") * F.lit(width).cast("long") + F.col("x0")).cast("long"))
    found = roots(touching(named, connectivity, flat))
    return named.join(found.hint("merge"), ["sample_id", "id"], "left").select(*ROW, "x0", "x1", F.coalesce("root", "id").alias("label"))


def gaps(runs: DataFrame, spans: DataFrame) -> DataFrame:
    """What ``runs`` leave open of spans(sample_id, z, y, a, b) that hold them: runs with ``inner``, whether a run lies on either side."""
    w = Window.partitionBy(*ROW).orderBy("x0")
    at = spans.join(runs.hint("merge"), ROW, "left").withColumns({"before": F.lag("x1").over(w), "after": F.lead("x0").over(w)})
    gap = lambda a, b, inner: F.struct(a.cast("int").alias("x0"), b.cast("int").alias("x1"), inner.alias("inner"))
    none = F.col("x0").isNull()
    first = gap(F.coalesce(F.col("before") + 1, F.col("a")), F.when(none, F.col("b")).otherwise(F.col("x0") - 1), F.col("before").isNotNull())
    last = gap(F.when(F.col("after").isNull(), F.col("x1") + 1), F.col("b"), F.lit(False))
    return at.select(*ROW, F.explode(F.array(first, last)).alias("g")).select(*ROW, "g.*").where("x0 <= x1")


def holes(runs: DataFrame, flat: bool = True) -> DataFrame:
    """Runs of the background that no side-connected path leads out of the box of each image's ``runs``; planes of flat images are apart."""
    image = ["sample_id", "z"] if flat else ["sample_id"]
    ends = [] if flat else [F.min("z").alias("z0"), F.max("z").alias("z1")]
    box = runs.groupBy(*image).agg(*ends, F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x0").alias("a"), F.max("x1").alias("b"))
    rows = box if flat else box.select("*", F.explode(F.sequence("z0", "z1")).alias("z"))
    rows = rows.select("sample_id", "z", "a", "b", F.explode(F.sequence("y0", "y1")).alias("y"))
    open_ = written(gaps(runs, rows), "gaps")
    some = open_.where("inner").select(*image).distinct()
    label = labelled(open_.join(some.hint("merge"), image, "left_semi"), 1, flat)
    edge = F.expr("y = y0 or y = y1 or x0 = a or x1 = b" + ("" if flat else " or z = z0 or z = z1"))
    outside = label.join(box.hint("merge"), image).where(edge).select(*image, "label").distinct()
    return label.join(outside.hint("merge"), [*image, "label"], "left_anti").select(*ROW, "x0", "x1")


def length() -> Column:
    return F.col("x1") - F.col("x0") + 1
