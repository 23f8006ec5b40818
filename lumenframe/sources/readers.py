"""Readers of image files by extension. A reader turns files(path) into headers and headers into pixels, both as in ``tiff``."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.sources import tiff


class Reader(NamedTuple):
    headers: Callable[[DataFrame], DataFrame]
    pixels: Callable[[DataFrame], DataFrame]


_readers: dict[str, Reader] = {}


def register(extension: str, reader: Reader) -> None:
    """A reader for files of an extension, in any case and without its dot."""
    _readers[extension.lower().lstrip(".")] = reader


def extensions() -> tuple[str, ...]:
    """Extensions that a reader is known for; of files of one stem, those named first win."""
    return tuple(_readers)


def extension(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def headers(files: DataFrame) -> DataFrame:
    """Headers of files(path) by their readers; a file that no reader knows has its error."""
    out = None
    for name in _readers:
        own = files.where(extension() == name).select("path")
        found = _readers[name].headers(own)
        out = found if out is None else out.unionByName(found)
    other = files.where(~extension().isin(*_readers)).select("path")
    unread = other.select("path", *[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields if f.name not in ("path", "error")], F.lit("no reader for its extension").alias("error"))
    return out.unionByName(unread)


def pixels(found: DataFrame) -> DataFrame:
    """(path, suffix, z, y, x, v) of headers, by the readers of their files."""
    out = None
    for name in _readers:
        rows = _readers[name].pixels(found.where(extension() == name))
        out = rows if out is None else out.unionByName(rows)
    return out


register("tif", Reader(tiff.headers, tiff.pixel_rows))
register("tiff", Reader(tiff.headers, tiff.pixel_rows))
