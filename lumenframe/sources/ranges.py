"""Ranged reads of files and whole writes, by pyarrow's file systems."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow.fs as fs

Read = Callable[[int, int], bytes]


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """A file system and the path in it."""
    uri = re.sub(r"^file:/(?!/)", "file:///", uri)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri.replace(" ", "%20"))
    return fs.LocalFileSystem(), uri


def in_memory(data: bytes) -> Read:
    return lambda at, n: data[at : at + n]


@lru_cache(maxsize=16)
def _file(uri: str):
    system, path = located(uri)
    return system.open_input_file(path)


def opened(uri: str) -> Read:
    """Reads of a range of a file; a worker keeps few files open."""
    file = _file(uri)
    return lambda at, n: file.read_at(n, at)
