"""Pixel sizes: the configuration wins, then the file, then 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Micrometres in a unit; fixed values.
MICROMETRES = {
    "um": 1.0, "µm": 1.0, "μm": 1.0, "micron": 1.0, "microns": 1.0, "micrometer": 1.0, "micrometre": 1.0,
    "nm": 1e-3, "nanometer": 1e-3, "nanometre": 1e-3, "mm": 1e3, "millimeter": 1e3, "millimetre": 1e3,
    "cm": 1e4, "centimeter": 1e4, "centimetre": 1e4, "m": 1e6, "meter": 1e6, "metre": 1e6, "in": 25400.0, "inch": 25400.0,
}


def unit_to_um(unit: Column) -> Column:
    """Micrometres in a unit's name, in any case; null for other names."""
    pairs = [F.lit(x) for kv in MICROMETRES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.trim(unit)))


def falsy(x: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(x.cast("double"), F.lit(0.0))


def pixel_size(configured: Column, of_file: Column) -> Column:
    return F.coalesce(falsy(configured), falsy(of_file), F.lit(1.0))


def plane_distance(configured: Column, of_file: Column, pixel: Column, is_3d: Column) -> Column:
    """Null for flat images; a stack without any takes the pixel size."""
    return F.when(is_3d, F.coalesce(falsy(configured), falsy(of_file), pixel))


def anisotropy(plane: Column, pixel: Column) -> Column:
    return F.coalesce(plane / pixel, F.lit(1.0))


def source(configured: Column, of_file: Column) -> Column:
    return F.when(falsy(configured).isNotNull(), "config").when(falsy(of_file).isNotNull(), "file").otherwise("fallback")
