"""Images as relations: pixels(sample_id, channel, z, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["sample_id", "channel"]
PLANE = ["y", "x"]


def from_arrays(images: DataFrame, sample: str, data: str, width: int, height: int | None = None, channel: str = "c0", scale: Column | None = None) -> DataFrame:
    """Pixels of images stored as arrays in raster order.

    With ``height`` the array is a stack of planes, else one plane (z is 0). ``scale`` maps the
    element, named ``e``, to an intensity. Null arrays and null elements give no pixel.
    """
    value = F.col("e") if scale is None else scale
    flat = images.select(F.col(sample).alias("sample_id"), F.posexplode(data).alias("pos", "e")).where("e is not null")
    pos = F.col("pos")
    plane = width * height if height else None
    z = F.floor(pos / plane).cast("int") if plane else F.lit(0)
    inside = pos % plane if plane else pos
    return flat.select(
        "sample_id", F.lit(channel).alias("channel"), z.alias("z"), F.floor(inside / width).cast("int").alias("y"), (inside % width).cast("int").alias("x"), value.alias("v")
    )


def from_text(texts: DataFrame, sample: str, data: str, width: int) -> DataFrame:
    """A raster of character codes, ``width`` to a line; null and empty texts give no pixel."""
    each = lambda c, n: F.posexplode(F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)))
    lines = texts.select(F.col(sample).alias("sample_id"), each(F.col(data), width).alias("y", "line"))
    cells = lines.select("sample_id", "y", each(F.col("line"), 1).alias("x", "c"))
    return cells.select("sample_id", F.lit("c0").alias("channel"), F.lit(0).alias("z"), "y", "x", F.ascii("c").cast("long").alias("v"))


def split_axes(axes: str, shape: tuple[int, ...]) -> list[tuple[str, dict[str, int]]]:
    """Channels that a file's other axes bundle: (suffix, index by axis). Z stays within an image; axes of size 1 add no suffix."""
    out: list[tuple[str, dict[str, int]]] = [("", {})]
    for axis, size in zip(axes, shape, strict=True):
        if axis not in "YXZ":
            mark = f"_{axis.lower()}"
            out = [(s + (f"{mark}{i}" if size > 1 else ""), at | {axis: i}) for s, at in out for i in range(size)]
    return out


def repaired_axes(axes: str, rank: int) -> str:
    """Axis letters that fit the rank: a usual order when their number is wrong, and a Z when a stack names none."""
    usual = {1: "X", 2: "YX", 3: "ZYX", 4: "CZYX", 5: "TCZYX"}
    if len(axes) != rank:
        axes = usual.get(rank, "Q" * (rank - 2) + "YX")
    if rank >= 3 and "Z" not in axes:
        odd = next((i for i, a in enumerate(axes) if a not in "YXCTS"), None)
        if odd is not None:
            axes = axes[:odd] + "Z" + axes[odd + 1 :]
    return axes
