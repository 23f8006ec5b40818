"""Closed forms over second moments, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float = 0.0, high: float | None = None) -> Column:
    x = F.greatest(x, F.lit(low))
    return x if high is None else F.least(x, F.lit(high))


def eigen2(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Eigenvalues, larger first, of [[a, b], [b, c]], not below zero."""
    mid, half = (a + c) / 2, F.sqrt(clamp(((a - c) / 2) * ((a - c) / 2) + b * b))
    return clamp(mid + half), clamp(mid - half)


def eigen3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> tuple[Column, Column, Column]:
    """Eigenvalues, largest first, of a symmetric 3x3 matrix by the trigonometric form."""
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(clamp(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6))
    flat = p < 1e-12
    s = F.when(flat, F.lit(1.0)).otherwise(p)
    a, b, c, d, e, f = (xx - q) / s, (yy - q) / s, (zz - q) / s, xy / s, xz / s, yz / s
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    angle = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
    first = q + 2 * p * F.cos(angle)
    last = q + 2 * p * F.cos(angle + 2 * math.pi / 3)
    return F.when(flat, q).otherwise(first), F.when(flat, q).otherwise(3 * q - first - last), F.when(flat, q).otherwise(last)


def axis3(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column, value: Column, axis: int) -> Column:
    """Unit eigenvector, an array of three, of a symmetric 3x3 matrix for one of its eigenvalues.

    It stands upright on two rows of the matrix less the eigenvalue: the largest of the rows' cross
    products. Of a repeated eigenvalue, any vector upright on the largest row will do; of a multiple
    of the identity, the unit vector of ``axis``. The sign is such that the largest component is positive.
    """
    rows = [(xx - value, xy, xz), (xy, yy - value, yz), (xz, yz, zz - value)]
    cross = lambda a, b: (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    square = lambda v: v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    sized = lambda v: F.struct(square(v).alias("n"), F.array(*v).alias("v"))
    best = F.array_max(F.array(*[sized(cross(rows[i], rows[j])) for i, j in ((0, 1), (0, 2), (1, 2))]))
    row = F.array_max(F.array(*[sized(r) for r in rows]))
    scale = F.greatest(F.abs(xx), F.abs(yy), F.abs(zz), F.abs(xy), F.abs(xz), F.abs(yz))
    unit = F.array(*[F.lit(1.0 if i == axis else 0.0) for i in range(3)])
    r = row["v"]
    turned = F.when(F.abs(r[0]) > F.abs(r[2]), F.array(-r[1], r[0], F.lit(0.0))).otherwise(F.array(F.lit(0.0), -r[2], r[1]))
    v = F.when(row["n"] <= 1e-16 * scale * scale, unit).when(best["n"] <= 1e-14 * row["n"] * scale * scale, turned).otherwise(best["v"])
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    most = F.array_max(F.transform(v, lambda x: F.struct(F.abs(x).alias("size"), x.alias("x"))))["x"]
    return F.transform(v, lambda x: x / length * F.signum(most))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0.0))


def sem(value: Column) -> Column:
    """Standard error of the mean over non-null values; null below two of them."""
    return F.stddev_samp(value) / F.sqrt(F.count(value))


def axial_order(theta: Column) -> Column:
    """Length of the mean doubled direction; null below two angles."""
    length = F.sqrt(F.pow(F.avg(F.cos(2 * theta)), 2) + F.pow(F.avg(F.sin(2 * theta)), 2))
    return F.when(F.count(theta) > 1, length)
