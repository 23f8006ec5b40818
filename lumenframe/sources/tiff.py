"""TIFF images as Spark jobs: headers by ranged reads, then blocks of pixels, so that a listing reads no pixels and one large file is many tasks.

Read are classic and BigTIFF files of 8 to 64-bit integers and floats in strips or tiles, plain,
LZW, Deflate or PackBits, with horizontal differences or without, several samples a pixel
included. The axes that a file's metadata names beside Z, Y and X become channels of their own.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lumenframe.functions.calibration import MICROMETRES
from lumenframe.sources.pixels import repaired_axes, split_axes
from lumenframe.sources.ranges import Read, in_memory, opened

# Fixed values of the format: field types' sizes and letters, and tag numbers.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION, OFFSETS, SAMPLES, ROWS, COUNTS, XRES, PLANAR, UNIT, PREDICTOR, FORMAT = 256, 257, 258, 259, 270, 273, 277, 278, 279, 282, 284, 296, 317, 339
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
BLOCK_BYTES = 4 << 20  # plain strips are read in parts of about so many bytes

BLOCK = "struct<suffixes:array<string>,z:int,y:int,x:int,rows:int,columns:int,width:int,offset:bigint,bytes:bigint,samples:int>"
HEADER = f"path string, axes string, shape array<int>, dtype string, compression int, predictor int, px double, pz double, unit string, is_3d boolean, channels array<string>, blocks array<{BLOCK}>, error string"


def pages(read: Read) -> Iterator[dict[int, tuple]]:
    """Tags of each page; pixels are not read."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else 0
    if kind not in (42, 43):
        raise ValueError("not a TIFF file")
    big = kind == 43
    number, entry, word = ("Q", 20, 8) if big else ("H", 12, 4)
    at = struct.unpack_from(order + "IQ"[big], head, 8 if big else 4)[0]
    seen = set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack(order + number, read(at, struct.calcsize(number)))
        start = at + struct.calcsize(number)
        table = read(start, n * entry + word)
        tags: dict[int, tuple] = {-1: (order,)}
        for i in range(n):
            tag, form, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, entry * i)
            if form in TYPES:
                size, letter = TYPES[form]
                inline = table[entry * i + entry - word : entry * i + entry]
                raw = inline[: size * count] if size * count <= word else read(struct.unpack(order + "IQ"[big], inline)[0], size * count)
                tags[tag] = (raw,) if letter == "c" else struct.unpack(order + letter * count, raw)
        yield tags
        (at,) = struct.unpack_from(order + "IQ"[big], table, n * entry)


def named_axes(description: str, n: int) -> tuple[str, tuple[int, ...]]:
    """Letters and sizes, slowest first, of the axes that ``n`` planes run through, by their metadata."""
    found = lambda p: (m[1] if (m := re.search(p, description)) else None)
    if "<OME" in description and (by := found(r'DimensionOrder="XY([CZT]{3})"')):
        sizes = {c: int(found(rf'Size{c}="(\d+)"') or 1) for c in "CZT"}
        order = [(c, sizes[c]) for c in reversed(by)]
    else:
        order = [(c, int(found(rf"(?m)^{word}=(\d+)") or 1)) for c, word in (("T", "frames"), ("Z", "slices"), ("C", "channels"))]
    order = [(c, s) for c, s in order if s > 1]
    if order and math.prod(s for _, s in order) == n:
        return "".join(c for c, _ in order), tuple(s for _, s in order)
    return ("Q", (n,)) if n > 1 else ("", ())


def sizes(tags: dict[int, tuple], description: str) -> tuple[float | None, float | None, str | None]:
    """(pixel size, plane distance, unit) in micrometres; sizes only from known units."""
    found = lambda p: (m[1] if (m := re.search(p, description)) else None)
    number = lambda t: float(t) if t else None
    unit = (found(r"(?m)^unit=(.*)$") or "").strip()
    scale = MICROMETRES.get(unit.lower())
    of_ome = lambda c: number(found(rf'PhysicalSize{c}="([0-9.eE+-]+)"')) and number(found(rf'PhysicalSize{c}="([0-9.eE+-]+)"')) * MICROMETRES.get((found(rf'PhysicalSize{c}Unit="([^"]*)"') or "um").lower(), 1.0)
    px, pz = of_ome("X"), of_ome("Z")
    rate = tags.get(XRES)
    if px is None and scale and rate and rate[0]:
        px = rate[1] / rate[0] * scale
    if pz is None and scale and (spacing := found(r"(?m)^spacing=([0-9.eE+-]+)")):
        pz = float(spacing) * scale
    return px, pz, unit or ("um" if px else None)


def header(path: str, read: Read) -> dict:
    """What a file says of itself, and its blocks: where the bytes of each part of each plane are."""
    every = list(pages(read))
    first = every[0]
    (order,) = first[-1]
    width, height = first[WIDTH][0], first[HEIGHT][0]
    samples, planar = first.get(SAMPLES, (1,))[0], first.get(PLANAR, (1,))[0] == 2
    bits, compression = first.get(BITS, (8,))[0], first.get(COMPRESSION, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(first.get(FORMAT, (1,))[0], "")
    if bits not in (8, 16, 32, 64) or not kind or compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError(f"{bits} bits of format {kind or 'unknown'}, compression {compression}: not supported")
    alike = [t for t in every if (t[WIDTH][0], t[HEIGHT][0], t.get(SAMPLES, (1,))[0], t.get(BITS, (8,))[0]) == (width, height, samples, bits)]  # thumbnails are left out
    description = first.get(DESCRIPTION, (b"",))[0].split(b"\0")[0].decode("utf-8", "replace")
    item = bits // 8
    planes = [(t, 0) for t in alike]
    images = re.search(r"(?m)^images=(\d+)", description)
    if len(every) == 1 and images and int(images[1]) > 1 and compression == NONE and OFFSETS in first:  # one page stands for all planes, which follow each other
        planes = [(first, i * width * height * samples * item) for i in range(int(images[1]))]
    letters, counts = named_axes(description, len(planes))
    axes, shape = letters + "YX", (*counts, height, width)
    if samples > 1:
        axes, shape = (letters + "SYX", (*counts, samples, height, width)) if planar else (axes + "S", (*shape, samples))
    axes = repaired_axes(axes, len(shape))
    if "Z" in axes and shape[axes.index("Z")] == 1:
        axes = axes.replace("Z", "Q")
    is_3d = "Z" in axes
    channels = split_axes(axes, shape)
    by_place = {tuple(sorted(at.items())): suffix for suffix, at in channels}
    outer = [i for i, a in enumerate(axes) if a not in "YXS"]
    blocks = []
    for (tags, shift), at in zip(planes, product(*[range(shape[i]) for i in outer]), strict=True):
        place = {axes[i]: k for i, k in zip(outer, at, strict=True)}
        z = place.pop("Z", 0)
        of = lambda s: by_place[tuple(sorted((place | ({"S": s} if "S" in axes else {})).items()))]  # noqa: B023, E731
        if TILE_OFFSETS in tags:
            tw, th = tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]
            across, down = -(-width // tw), -(-height // th)
            parts = [(k % (across * down) // across * th, k % across * tw, th, tw, o, n, k // (across * down)) for k, (o, n) in enumerate(zip(tags[TILE_OFFSETS], tags[TILE_COUNTS], strict=True))]
        else:
            rows = min(tags.get(ROWS, (height,))[0], height)
            down = -(-height // rows)
            parts = [(k % down * rows, 0, min(rows, height - k % down * rows), width, o + shift, n, k // down) for k, (o, n) in enumerate(zip(tags[OFFSETS], tags.get(COUNTS, (rows * width * samples * item,)), strict=True))]
        inner = 1 if planar else samples
        for y, x, rows, columns, offset, size, sample in parts:
            suffixes = [of(sample)] if planar or samples == 1 else [of(s) for s in range(samples)]
            line = columns * inner * item
            step = max(1, BLOCK_BYTES // max(line, 1)) if compression == NONE and TILE_OFFSETS not in tags else rows
            for r in range(0, rows, step):
                n = min(step, rows - r)
                span = (offset + r * line, n * line) if compression == NONE else (offset, size)
                blocks.append({"suffixes": suffixes, "z": z, "y": y + r, "x": x, "rows": min(n, height - y - r), "columns": min(columns, width - x), "width": columns, "offset": span[0], "bytes": span[1], "samples": inner})
    px, pz, unit = sizes(first, description)
    return {"path": path, "axes": axes, "shape": list(shape), "dtype": f"{order}{kind}{item}", "compression": compression, "predictor": first.get(PREDICTOR, (1,))[0], "px": px, "pz": pz, "unit": unit, "is_3d": is_3d, "channels": [s for s, _ in channels], "blocks": blocks, "error": None}


def unpacked_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


CLEAR, END = 256, 257


def unpacked_lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, that grow one code early."""
    out, words, width, held, bits, before = [], [], 9, 0, 0, b""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            words, width, before = list(single), 9, b""
            continue
        if not words:
            words = list(single)
        word = words[code] if code < len(words) else before + before[:1]
        out.append(word)
        if before:
            words.append(before + word[:1])
        before = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return b"".join(out)


UNPACK: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: unpacked_lzw, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: unpacked_bits}


def block_pixels(data: bytes, b: dict, dtype: str, compression: int, predictor: int) -> np.ndarray:
    """(rows, columns, samples) of a block."""
    raw = UNPACK[compression](data)
    item = np.dtype(dtype).itemsize
    line = b["width"] * b["samples"]
    rows = min(len(raw) // (line * item), max(b["rows"], 1)) if line else 0
    if rows < b["rows"]:
        raise ValueError("a block is shorter than its header says")
    a = np.frombuffer(raw, dtype, rows * line).reshape(rows, b["width"], b["samples"])
    if predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype.newbyteorder("="))
    elif predictor != 1:
        raise ValueError(f"predictor {predictor} is not supported")
    return a[: b["rows"], : b["columns"]]


def decode(data: bytes) -> tuple[np.ndarray, float | None, float | None]:
    """(pixels by channel, plane, row and column without axes of size 1, pixel size, plane distance) of a whole file."""
    read = in_memory(data)
    h = header("", read)
    size = dict(zip(h["axes"], h["shape"], strict=True))
    out = np.zeros((len(h["channels"]), size.get("Z", 1), size["Y"], size["X"]), np.dtype(h["dtype"]).newbyteorder("="))
    place = {s: i for i, s in enumerate(h["channels"])}
    for b in h["blocks"]:
        a = block_pixels(read(b["offset"], b["bytes"]), b, h["dtype"], h["compression"], h["predictor"])
        for k, s in enumerate(b["suffixes"]):
            out[place[s], b["z"], b["y"] : b["y"] + a.shape[0], b["x"] : b["x"] + a.shape[1]] = a[:, :, k]
    keep = tuple(i for i in (0, 1) if out.shape[i] == 1)
    return np.squeeze(out, keep), h["px"], h["pz"]


def headers(files: DataFrame) -> DataFrame:
    """Headers of the images of files(path), read in ranges; a file that cannot be read has its error. No pixels are read."""

    schema = to_arrow_schema(StructType.fromDDL(HEADER))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                try:
                    rows.append(header(path, opened(path)))
                except (ValueError, KeyError, IndexError, OSError, struct.error, AttributeError) as e:
                    rows.append({"path": path, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in schema} for r in rows], schema=schema)

    return files.select("path").mapInArrow(run, HEADER)


PIXELS = "path string, suffix string, z int, y int, x int, v double"
ONE_BLOCK = f"path string, dtype string, compression int, predictor int, block {BLOCK}"


def pixel_rows(found: DataFrame, tasks: int | None = None) -> DataFrame:
    """(path, suffix, z, y, x, v) of ``headers``: blocks are dealt out over tasks, and each is read by itself. A filter on suffix or z goes before this, on ``blocks_of``."""
    return block_rows(blocks_of(found), tasks)


def blocks_of(found: DataFrame) -> DataFrame:
    """One row a block of ``headers``."""
    return found.where("error is null").select("path", "dtype", "compression", "predictor", F.explode("blocks").alias("block"))


def block_rows(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    n = tasks or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, read = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != last:
                    last, read = row["path"], opened(row["path"])
                b = row["block"]
                a = block_pixels(read(b["offset"], b["bytes"]), b, row["dtype"], row["compression"], row["predictor"])
                y, x = np.indices(a.shape[:2], np.int32)
                for k, suffix in enumerate(b["suffixes"]):
                    m = a.shape[0] * a.shape[1]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "path": pa.array([last] * m, pa.string()), "suffix": pa.array([suffix] * m, pa.string()), "z": pa.array(np.full(m, b["z"], np.int32)),
                            "y": pa.array(y.ravel() + np.int32(b["y"])), "x": pa.array(x.ravel() + np.int32(b["x"])), "v": pa.array(a[:, :, k].ravel().astype(float)),
                        }
                    )

    return blocks.repartition(n, F.xxhash64("path", "block.offset", "block.y")).mapInArrow(run, PIXELS)


def read_tiff(spark: SparkSession, root: str) -> DataFrame:
    """``headers`` of all TIFF files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return headers(files.where(F.lower("path").rlike(r"\.tiff?$")))


def layout(shape: tuple[int, int, int], dtype: np.dtype, px: float | None, pz: float | None, unit: str = "um") -> tuple[bytes, bytes]:
    """(what comes before the pixels, what comes after) of a file of plain planes in order, one strip each; BigTIFF where offsets need it."""
    depth, height, width = shape
    plane = height * width * dtype.itemsize
    big = depth * plane > 0xF0000000
    text = ("ImageJ=1.0\n" + (f"images={depth}\nslices={depth}\n" if depth > 1 else "") + f"unit={unit}\n" + (f"spacing={pz}\n" if pz else "")).encode() + b"\0"
    text += b"\0" * (len(text) % 2)
    start = 16 if big else 8
    end = start + depth * plane
    pad = b"\0" * (end % 2)
    shared = end + len(pad)
    tail = bytearray(pad + text + struct.pack("<II", round(1e6 / px) if px else 1, 1_000_000 if px else 1))
    rate_at, at = shared + len(text), shared + len(text) + 8
    kind, word, entry, number = {"u": 1, "i": 2, "f": 3}[dtype.kind], "IQ"[big], "<HHQQ" if big else "<HHII", "<Q" if big else "<H"
    wide = 16 if big else 4
    before = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at) if big else struct.pack("<2sHI", b"II", 42, at)
    for z in range(depth):
        tags = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, dtype.itemsize * 8), (COMPRESSION, 3, 1, NONE), (DESCRIPTION, 2, len(text), shared), (OFFSETS, wide, 1, start + z * plane), (SAMPLES, 3, 1, 1), (ROWS, 4, 1, height), (COUNTS, wide, 1, plane)]
        tags += [(XRES, 5, 1, rate_at)] * bool(px) + [(FORMAT, 3, 1, kind)]
        size = struct.calcsize(number) + len(tags) * struct.calcsize(entry) + struct.calcsize("<" + word)
        tail += struct.pack(number, len(tags)) + b"".join(struct.pack(entry, *t) for t in tags) + struct.pack("<" + word, at + size if z + 1 < depth else 0)
        at += size
    return before, bytes(tail)


def encode(image: np.ndarray, px: float | None = None, pz: float | None = None) -> bytes:
    """An uncompressed TIFF of a plane or stack, with its calibration in micrometres."""
    planes = image[None] if image.ndim == 2 else image
    before, after = layout(planes.shape, planes.dtype, px, pz)
    return before + planes.astype(planes.dtype.newbyteorder("<")).tobytes() + after
