"""Masks and labels as relations; every step works on images of any size.

A mask is pixels(sample_id, z, y, x); labels add ``label``. A label is the raster place of an
object's first pixel until ``relabelled`` makes labels dense.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import runs as R
from lumenframe.operators.kernels import LINE, envelopes, flood
from lumenframe.runtime import forget, written

PLACE = ["sample_id", "z", "y", "x"]
OBJECT = ["sample_id", "label"]


def neighbours(connectivity: int, flat: bool, half: bool = True) -> list[tuple[int, int, int]]:
    """Offsets (dz, dy, dx) that change at most ``connectivity`` coordinates; one of each opposite pair if ``half``."""
    out = [d for d in product((0,) if flat else (-1, 0, 1), (-1, 0, 1), (-1, 0, 1)) if 0 < sum(map(abs, d)) <= connectivity]
    return [d for d in out if d > (0, 0, 0)] if half else out


def shifted(pixels: DataFrame, offsets: list[tuple[int, int, int]], keep: list[str]) -> DataFrame:
    """A copy of each pixel moved by each offset, with the columns ``keep``."""
    moves = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(y).alias("y"), F.lit(x).alias("x")) for z, y, x in offsets])).alias("d")
    moved = pixels.select("sample_id", "z", "y", "x", *keep, moves)
    return moved.select("sample_id", *[(F.col(c) + F.col(f"d.{c}")).cast("int").alias(c) for c in ("z", "y", "x")], *keep)


def components(mask: DataFrame, connectivity: int, flat: bool = True) -> DataFrame:
    """Connected components: the pixels of ``mask`` with ``label``, the least raster place of the component. An empty mask gives an empty result."""
    return R.pixels_of(R.labelled(R.runs_of(mask), connectivity, flat), "label").select(*PLACE, "label")


def holes_filled(mask: DataFrame, frame: DataFrame, flat: bool = True) -> DataFrame:
    """``mask`` with the background that no side-connected path leads to the frame's edge; frame holds all pixels."""
    back = frame.select(*PLACE).join(mask.select(*PLACE).hint("merge"), PLACE, "left_anti")
    label = written(R.labelled(R.runs_of(back), 1, flat), "background")
    ends = frame.groupBy("sample_id").agg(*[f(c).alias(f"{c}{n}") for c in ("z", "y", "x") for n, f in (("a", F.min), ("b", F.max))])
    edge = F.expr("y = ya or y = yb or x0 = xa or x1 = xb" + ("" if flat else " or z = za or z = zb"))
    outside = label.join(ends, "sample_id").where(edge).select(*OBJECT).distinct()
    return mask.select(*PLACE).unionByName(R.pixels_of(label.join(outside.hint("merge"), OBJECT, "left_anti")).select(*PLACE))


def kept_objects(labels: DataFrame, frame: DataFrame, min_size: int = 0, margin: int = 0) -> DataFrame:
    """(sample_id, label, size) of objects of ``min_size`` pixels whose rows and columns keep ``margin`` from the frame's edge."""
    objects = labels.groupBy(*OBJECT).agg(F.count("*").alias("size"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1")).where(F.col("size") >= min_size)
    if margin > 0:
        extent = frame.groupBy("sample_id").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"))
        inside = (F.col("y0") >= margin) & (F.col("x0") >= margin) & (F.col("y1") < F.col("h") - margin) & (F.col("x1") < F.col("w") - margin)
        objects = objects.join(extent, "sample_id").where(inside)
    return objects.select(*OBJECT, "size")


def relabelled(labels: DataFrame, kept: DataFrame) -> DataFrame:
    """Labels of kept objects only, dense from 1 in order of the old ones."""
    dense = kept.select(*OBJECT, F.row_number().over(Window.partitionBy("sample_id").orderBy("label")).cast("long").alias("new"))
    return labels.join(dense.hint("merge"), OBJECT).select(*PLACE, F.col("new").alias("label"))


def candidates(pixels: DataFrame, low: float, high: float, connectivity: int, min_size: int = 0, margin: int = 0, flat: bool = True) -> DataFrame:
    """Objects of a band: threshold, fill, label, filter by size and border; labels stay raster places."""
    labels = written(components(holes_filled(pixels.where(F.col("v").between(low, high)), pixels, flat), connectivity, flat), "labels")
    return labels.join(kept_objects(labels, pixels, min_size, margin).hint("merge"), OBJECT, "left_semi")


def segment(pixels: DataFrame, low: float, high: float, connectivity: int, min_size: int = 0, margin: int = 0, flat: bool = True) -> DataFrame:
    """``candidates`` with dense labels."""
    labels = candidates(pixels, low, high, connectivity, min_size, margin, flat)
    return relabelled(labels, labels.select(*OBJECT).distinct())


def stain(pixels: DataFrame, low: float, high: float, min_size: int = 0, margin: int = 0, flat: bool = True) -> DataFrame:
    """Objects of a stain, labelled by corners too; labels stay raster places."""
    return candidates(pixels, low, high, 2, min_size, margin, flat)


def ball(radius: int, flat: bool = True) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(z, y, x) for z, y, x in product((0,) if flat else r, r, r) if z * z + y * y + x * x <= radius * radius]


def dilated(labels: DataFrame, radius: int, flat: bool = True) -> DataFrame:
    """Each object grown by a disk or ball; objects may overlap."""
    return shifted(labels, ball(radius, flat), ["label"]).distinct()


def nearest_along(values: DataFrame, by: list[str], at: str, weight: Column | float = 1.0) -> DataFrame:
    """(by, at, g): the least of g' + weight (at - at')² over the places at' of each line of values(by, at, g), null where a line has no g. A line is as long as its image's side, and one array."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    lines = values.groupBy(*by).agg(F.first(w).alias("w"), F.collect_list(F.struct(F.col(at).cast("int").alias("at"), F.col("g").cast("double").alias("g"))).alias("line"))
    schema = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in [*by, "w"]) + f", line {LINE}"
    found = lines.mapInArrow(envelopes, schema)
    return found.select(*by, F.explode("line").alias("l")).select(*by, F.col("l.at").alias(at), F.col("l.g").alias("g"))


def distance(mask: DataFrame, frame: DataFrame, flat: bool = True, aniso: float | Column = 1.0) -> DataFrame:
    """Squared Euclidean distance of mask pixels to the nearest background, in separable passes of linear work.

    The first pass has the distance down each column by windows; the second takes the lower envelope
    of the columns' parabolas along each row, of stacks a third along the planes, ``aniso`` pixels
    apart (a number or a column of ``frame``). In flat images each plane is one of its own. Images without background have null.
    """
    deep = aniso if isinstance(aniso, Column) else F.lit(float(aniso))
    cells = frame.select(*PLACE, deep.alias("aniso")).join(mask.select(*PLACE, F.lit(True).alias("on")).hint("merge"), PLACE, "left")
    own = F.when(F.col("on").isNull(), F.col("y"))
    w = Window.partitionBy("sample_id", "z", "x").orderBy("y")
    above = F.last(own, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    column = F.least(F.col("y") - above, below - F.col("y")).cast("long")
    row = nearest_along(cells.select("sample_id", "z", "y", "x", (column * column).alias("g")), ["sample_id", "z", "y"], "x")
    if flat:
        return row.join(mask.select(*PLACE).hint("merge"), PLACE, "left_semi").select(*PLACE, F.col("g").cast("long").alias("d2"))
    planes = row.join(cells.select(*PLACE, "aniso").hint("merge"), PLACE)
    line = nearest_along(planes, ["sample_id", "y", "x"], "z", F.col("aniso") * F.col("aniso"))
    return line.join(mask.select(*PLACE).hint("merge"), PLACE, "left_semi").select(*PLACE, F.col("g").alias("d2"))


def peaks(values: DataFrame, min_distance: int, value: str) -> DataFrame:
    """Pixels that no pixel within ``min_distance`` in rows and columns exceeds, off the frame's edge by as much; plateaus count at each place.

    Pixels that are greatest along their own rows put a probe into each row around; a running maximum
    along rows tells each probe the greatest of its stretch.
    """
    ends = values.groupBy("sample_id").agg(F.max("y").alias("h"), F.max("x").alias("w"))
    along = Window.partitionBy("sample_id", "z", "y").orderBy("x").rangeBetween(-min_distance, min_distance)
    inside = (F.col("y") >= min_distance) & (F.col("x") >= min_distance) & (F.col("y") <= F.col("h") - min_distance) & (F.col("x") <= F.col("w") - min_distance)
    row_tops = values.select(*PLACE, value, F.max(value).over(along).alias("most")).where(F.col(value) == F.col("most"))
    tops = written(row_tops.join(ends, "sample_id").where(inside).select(*PLACE, value), "row-tops")
    around = F.explode(F.sequence(F.col("y") - min_distance, F.col("y") + min_distance))
    probes = tops.select("sample_id", "z", "x", F.col("y").alias("own"), around.alias("y"))
    both = values.select(*PLACE, F.lit(None).cast("int").alias("own"), value).unionByName(probes.withColumn(value, F.lit(None).cast(values.schema[value].dataType)))
    seen = both.withColumn("most", F.max(value).over(along)).where("own is not null")
    most = seen.groupBy("sample_id", "z", F.col("own").alias("y"), "x").agg(F.max("most").alias("most"))
    return tops.join(most.hint("merge"), PLACE).where(F.col(value) == F.col("most")).select(*PLACE, value)


TILE, TILE_DEEP = 128, 32  # a tile's side; of stacks, a cube's


def flooded(markers: DataFrame, mask: DataFrame, elevation: str, flat: bool = True) -> DataFrame:
    """Mask pixels labelled by the marker whose path reaches each first: by the lowest pass, then the fewest steps, then the least label.

    Each tile of an image floods itself in one pass; what leads over its border is offered to the
    neighbours, and tiles to which other offers come flood again, until none changes. Rounds are
    of the order of the tiles that a path crosses, and only borders are written. Pixels that no path reaches are left out.
    """
    spark, moves = mask.sparkSession, neighbours(1, flat, half=False)
    side = {"z": 1 if flat else TILE_DEEP, "y": TILE if flat else TILE_DEEP, "x": TILE if flat else TILE_DEEP}
    key = ["sample_id", "tz", "ty", "tx"]
    tiled = lambda df: df.withColumns({f"t{c}": F.floor(F.col(c) / side[c]).cast("int") for c in side})
    cost = mask.select(*PLACE, F.col(elevation).cast("double").alias("e"))
    cells = written(tiled(cost.join(markers.select(*PLACE, F.col("label").cast("long").alias("label")).hint("merge"), PLACE, "left")), "tiles")
    name = f"sample_id {cells.schema['sample_id'].dataType.simpleString()}"
    offer = f"{name}, z int, y int, x int, pass double, steps int, label long, fz int, fy int, fx int"  # and the tile it comes from
    path = ["pass", "steps", "label"]

    def give(of: pa.Table, came: pa.Table) -> pa.Table:
        best, out = flood(of, came, moves)
        at = [i for i, *_ in out]
        columns = {"sample_id": of.column("sample_id").take(pa.array(at, pa.int64()))}
        columns |= {c: pa.array([o[k] for o in out], pa.int32()) for k, c in enumerate("zyx", 1)}
        columns |= {c: pa.array([best[i][k] for i in at], t) for k, (c, t) in enumerate(zip(path, (pa.float64(), pa.int32(), pa.int64()), strict=True))}
        return pa.table(columns | {f"f{c}": of.column(f"t{c}").take(pa.array(at, pa.int64())) for c in "zyx"})

    def settle(of: pa.Table, came: pa.Table) -> pa.Table:
        best, _ = flood(of, came, moves)
        label = pa.array([b and b[2] for b in best], pa.int64())
        return pa.table({c: of.column(c) for c in PLACE} | {"label": label}).filter(label.is_valid())

    def flooding(active: DataFrame, offers: DataFrame, run, schema: str) -> DataFrame:
        came = tiled(offers).select(*key, "z", "y", "x", *path)
        return active.groupBy(*key).cogroup(came.groupBy(*key)).applyInArrow(run, schema)

    offers = written(spark.createDataFrame([], offer), "offers")
    active = cells
    # what leads from tile to tile passes a last row, column or plane of one
    last = [F.pmod(F.col(c), F.lit(n)) == n - 1 for c, n in side.items() if n > 1]
    joined = not cells.where(reduce(or_, last)).isEmpty()
    while joined:
        new = flooding(active, offers, give, offer)
        new = written(new.join(cells.select(*PLACE).hint("merge"), PLACE, "left_semi"), "offers")  # to pixels of the mask
        old = offers.join(active.select("sample_id", *[F.col(f"t{c}").alias(f"f{c}") for c in "zyx"]).distinct().hint("merge"), ["sample_id", "fz", "fy", "fx"], "left_anti")
        every = written(old.select(new.columns).unionByName(new), "offers")
        mark = lambda df, n: tiled(df).groupBy(*key).agg(F.sum(F.xxhash64(*PLACE, *path).cast("decimal(38,0)")).alias(n))
        changed = mark(offers, "a").join(mark(every, "b").hint("merge"), key, "full").where("not (a <=> b)").select(*key)
        changed = written(changed, "changed-tiles")
        for done in (offers, new):
            forget(done)
        offers = every
        if changed.isEmpty():
            break
        active = cells.join(changed.hint("merge"), key, "left_semi")
    return flooding(cells, offers, settle, f"{name}, z int, y int, x int, label long")


def spaced(points: DataFrame, by: list[str], least: int, value: str) -> DataFrame:
    """Of points(by, y, x, value) those that a choice by falling value, then by place, keeps ``least`` rows or columns apart.

    Cells of that side hold one chosen point at most, so in a round each cell puts its best one
    up, which wins if no better point lies near; what is near a winner goes. Each round is linear in the points and written.
    """
    cell = lambda c: F.floor(F.col(c) / least).alias(f"c{c}")
    alive = written(points.select(*by, F.struct((-F.col(value)).alias("o"), "y", "x").alias("rank"), cell("y"), cell("x")), "points")
    moves = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y in (-1, 0, 1) for x in (-1, 0, 1)])).alias("d")
    chosen = None
    while True:
        best = alive.groupBy(*by, "cy", "cx").agg(F.min("rank").alias("best"))
        around = best.select("*", moves).select(*by, (F.col("cy") + F.col("d.y")).alias("cy"), (F.col("cx") + F.col("d.x")).alias("cx"), "best")
        near = F.greatest(F.abs(F.col("rank.y") - F.col("best.y")), F.abs(F.col("rank.x") - F.col("best.x"))) < least
        met = alive.join(around.hint("merge"), [*by, "cy", "cx"]).where(near).select(*by, "rank", "best")
        beaten = met.where("rank < best").select(*by, "best").distinct()
        won = written(best.select(*by, "best").join(beaten.hint("merge"), [*by, "best"], "left_anti"), "won")
        chosen = won if chosen is None else chosen.unionByName(won)
        gone = met.join(won.hint("merge"), [*by, "best"], "left_semi").select(*by, "rank").distinct()
        alive = written(alive.join(gone.hint("merge"), [*by, "rank"], "left_anti"), "points")
        if alive.isEmpty():
            return chosen.select(*by, "best.y", "best.x", (-F.col("best.o")).alias(value))


def split_doublets(labels: DataFrame, frame: DataFrame, min_distance: int = 80) -> DataFrame:
    """Flat objects cut where they touch: ``labels`` with ``part``, from 1.

    The peaks of the distance to what is not the object, ``min_distance`` apart and off the frame's
    edge by as much, grow by a disk of 2 and flood the object over the falling distance. An
    object with fewer than two peaks is one part; an empty table stays empty.
    """
    labels = written(labels.select(*PLACE, "label"), "objects")
    own = labels.select(F.struct(*OBJECT).alias("sample_id"), "z", "y", "x")
    ends = frame.groupBy("sample_id").agg(*[f(c).alias(f"{c}{n}") for c in "yx" for n, f in (("a", F.min), ("b", F.max))])
    box = labels.groupBy(*OBJECT).agg(*[f(c).alias(f"{c}{n}") for c in "yx" for n, f in ((0, F.min), (1, F.max))], F.min("z").alias("z")).join(ends, "sample_id")
    side = lambda c: F.explode(F.sequence(F.greatest(F.col(f"{c}0") - 1, f"{c}a"), F.least(F.col(f"{c}1") + 1, f"{c}b"))).alias(c)
    grid = box.select(F.struct(*OBJECT).alias("sample_id"), "z", "x0", "x1", "xa", "xb", side("y")).select("sample_id", "z", "y", side("x"))
    depth = written(distance(own, grid).where("d2 is not null"), "depth")
    off = F.lit(True)
    for c in "yx":
        off = off & (F.col(c) - F.col(f"{c}a") >= min_distance) & (F.col(f"{c}b") - F.col(c) >= min_distance)
    inner = depth.join(ends.withColumnRenamed("sample_id", "image"), F.col("sample_id.sample_id") == F.col("image")).where(off).select(*PLACE, "d2")
    around = shifted(inner.withColumns({"cy": F.col("y"), "cx": F.col("x")}), [(0, y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)], ["cy", "cx"])
    most = around.join(depth.hint("merge"), PLACE).groupBy("sample_id", "z", F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.max("d2").alias("most"))
    tops = inner.join(most.hint("merge"), PLACE).where("d2 = most")
    seeds = spaced(tops, ["sample_id", "z"], min_distance, "d2")
    w = Window.partitionBy("sample_id")
    seeds = seeds.withColumns({"part": F.row_number().over(w.orderBy(F.desc("d2"), "y", "x")), "n": F.count("*").over(w)}).where("n > 1")
    markers = written(shifted(seeds, ball(2), ["part"]).groupBy(*PLACE).agg(F.max("part").alias("label")), "markers")
    several = markers.select("sample_id").distinct()
    parts = flooded(markers, depth.join(several, "sample_id", "left_semi").withColumn("fall", -F.sqrt("d2")), "fall")
    out = own.join(parts.withColumnRenamed("label", "part").hint("merge"), PLACE, "left")
    return out.select("sample_id.sample_id", "z", "y", "x", "sample_id.label", F.coalesce("part", F.lit(1)).alias("part"))
