"""Surface area of stacks' objects by marching cubes, as a histogram of cell patterns an object."""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.geometry import ratio

OBJECT = ["sample_id", "label"]
CORNERS = list(product((0, 1), repeat=3))  # z, y, x; a corner's bit is its place here
Point = tuple[float, ...]


def crossed(a: tuple[int, ...], b: tuple[int, ...]) -> Point:
    """Where the surface crosses the edge between two corners."""
    return tuple((p + q) / 2 for p, q in zip(a, b, strict=True))


def outlines(code: int) -> list[list[Point]]:
    """Closed lines of the surface in a cell: on each side of the cell the crossed edges are linked; where a side has its object's corners across, these stay apart."""
    inside = {c: bool(code >> i & 1) for i, c in enumerate(CORNERS)}
    links: dict[Point, list[Point]] = {}
    for axis, at in product(range(3), (0, 1)):
        ring = [c[:axis] + (at,) + c[axis:] for c in ((0, 0), (0, 1), (1, 1), (1, 0))]
        points = [crossed(ring[i], ring[(i + 1) % 4]) for i in range(4)]
        cut = [i for i in range(4) if inside[ring[i]] != inside[ring[(i + 1) % 4]]]
        pairs = [(cut[0], cut[1])] if len(cut) == 2 else [((i - 1) % 4, i) for i in range(4) if inside[ring[i]]] if cut else []
        for i, j in pairs:
            links.setdefault(points[i], []).append(points[j])
            links.setdefault(points[j], []).append(points[i])
    out, seen = [], set()
    for start in sorted(links):
        if start not in seen:
            line, at = [], start
            while at is not None:
                seen.add(at)
                line.append(at)
                at = next((p for p in links[at] if p not in seen), None)
            out.append(line)
    return out


def normal(a: Point, b: Point, c: Point) -> Point:
    """Cross product of two sides, of twice the triangle's area in length."""
    u, v = ([q - p for p, q in zip(a, x, strict=True)] for x in (b, c))
    return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])


@cache
def least_cover(line: tuple[Point, ...]) -> tuple[float, tuple[Point, ...]]:
    """Area and normals of the triangles of least area that a closed line bounds."""
    if len(line) < 3:
        return 0.0, ()
    best = None
    for i in range(1, len(line) - 1):
        n = normal(line[0], line[i], line[-1])
        (a, left), (b, right) = least_cover(line[: i + 1]), least_cover(line[i:])
        total = a + b + math.hypot(*n) / 2
        if best is None or total < best[0] - 1e-12:
            best = (total, (n, *left, *right))
    return best


@cache
def patterns() -> list[tuple[int, float, float, int]]:
    """(code, u, w, n) of all cells that a surface crosses: n triangles of area sqrt(u + w a²) / 2 where planes are ``a`` pixels apart."""
    rows: dict[tuple[int, float, float], int] = {}
    for code in range(1, 255):
        for line in outlines(code):
            for nz, ny, nx in least_cover(tuple(line))[1]:
                key = (code, nz * nz, ny * ny + nx * nx)
                rows[key] = rows.get(key, 0) + 1
    return [(*k, n) for k, n in sorted(rows.items())]


def surface_area(labels: DataFrame, scale: DataFrame) -> DataFrame:
    """(sample_id, label, surface_area) of labels(sample_id, z, y, x, label), closed at the frame; scale(sample_id, px, pz) are the sample's pixel size and plane distance (null: the pixel size)."""
    corner = F.explode(F.array(*[F.struct(*[F.lit(-d).alias(c) for c, d in zip("zyx", at, strict=True)], F.lit(1 << i).alias("bit")) for i, at in enumerate(CORNERS)])).alias("c")
    cells = labels.select(*OBJECT, "z", "y", "x", corner).groupBy(*OBJECT, *[(F.col(a) + F.col(f"c.{a}")).alias(a) for a in "zyx"]).agg(F.sum("c.bit").cast("int").alias("code"))
    codes = cells.groupBy(*OBJECT, "code").agg(F.count("*").alias("cells"))
    table = labels.sparkSession.createDataFrame(patterns(), "code int, u double, w double, n int")  # some hundreds of rows, whatever the input
    sized = codes.join(F.broadcast(table), "code", "left").join(scale.select("sample_id", "px", (F.coalesce("pz", "px") / F.col("px")).alias("aniso")), "sample_id")
    area = F.col("cells") * F.col("n") * F.sqrt(F.col("u") + F.col("w") * F.col("aniso") * F.col("aniso")) / 2 * F.col("px") * F.col("px")
    return sized.groupBy(*OBJECT).agg(F.coalesce(F.sum(area), F.lit(0.0)).alias("surface_area"))


def sphericity(volume: Column, surface: Column) -> Column:
    """Surface of the ball of that volume over the surface; null without a surface."""
    return ratio(math.pi ** (1 / 3) * F.pow(6 * volume, F.lit(2 / 3)), surface)
