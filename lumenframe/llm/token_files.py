"""Token-id shards with a minimal perfect hash index from document keys to offsets (op 5).

A shard is one file: magic, raw ids (little-endian, 2 bytes where the vocabulary fits, else 4),
document keys, id offsets, index, and a JSON trailer that places them. Shards hold documents in
ascending key order, so a manifest of key ranges leads a key to its shard and the index to its
ids; stored fingerprints refuse keys that the shard lacks.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text, partitions, shared_path, written
from lumenframe.llm.perfect_hash import PerfectHash, fingerprints
from lumenframe.llm.tokens import encoded
from lumenframe.llm.wordhash import column

MAGIC = b"LFTOKEN1"
READ_BYTES = 8 << 20


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


MANIFEST = "shard int, path string, n_docs long, n_tokens long, low long, high long"


def shard_writer(folder: str, tokenizer: str, end_id: int, width: int):
    """Writes one shard for a task; a retried task writes another file, and only the rows of the attempt that counts name theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root)
        name = f"shard-{shard:07d}-{uuid.uuid4().hex[:8]}.tok"
        keys, lengths = [], []
        out = None
        for batch, ids, bounds in encoded(batches, tokenizer, end_id):
            if out is None:
                out = fs.open_output_stream(f"{root}/{name}")
                out.write(MAGIC)
            out.write(ids.astype(f"<u{width}").tobytes())
            lengths.append(np.diff(bounds))
            keys.append(column(batch, "doc_id"))
        if out is None:
            return
        ids = pa.chunked_array(keys)
        nulls = ids.null_count  # they come first
        doc = ids.fill_null(0).to_numpy().astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype("<i8")
        own = doc[nulls:]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        keyed = own[first].view(np.uint64)
        index = PerfectHash.build(keyed)
        slots = index.slots(keyed)
        prints, rows = np.zeros(len(keyed), "<u4"), np.zeros(len(keyed), "<u4")
        prints[slots], rows[slots] = fingerprints(keyed), first + nulls
        at, places = len(MAGIC) + width * int(offsets[-1]), {}
        for part, data in (("keys", doc.tobytes()), ("offsets", offsets.tobytes()), ("index", index.to_bytes()), ("prints", prints.tobytes()), ("rows", rows.tobytes())):
            places[part] = [at, len(data)]
            out.write(data)
            at += len(data)
        meta = json.dumps({"width": width, "docs": len(doc), "nulls": nulls, "places": places}).encode()
        out.write(meta + len(meta).to_bytes(8, "little") + MAGIC)
        out.close()
        yield pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "path": [f"{folder}/{name}"],
                "n_docs": pa.array([len(doc)], pa.int64()),
                "n_tokens": pa.array([int(offsets[-1])], pa.int64()),
                "low": pa.array([int(own[0]) if len(own) else None], pa.int64()),
                "high": pa.array([int(own[-1]) if len(own) else None], pa.int64()),
            }
        )

    return run


class Shard:
    """A shard opened for keyed or sequential reading."""

    def __init__(self, path: str):
        fs, name = open_fs(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a complete shard")
        n = int.from_bytes(tail[:8], "little")
        meta = json.loads(self.file.read_at(n, size - 16 - n))
        self.width, self.nulls = meta["width"], meta["nulls"]
        part = lambda k, kind: np.frombuffer(self.file.read_at(meta["places"][k][1], meta["places"][k][0]), kind)
        self.keys, self.offsets = part("keys", "<i8"), part("offsets", "<i8")
        self.prints, self.rows = part("prints", "<u4"), part("rows", "<u4")
        self.index = PerfectHash.from_bytes(part("index", np.uint8).tobytes())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First row of each key, -1 if the shard lacks it."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        slot = self.index.slots(keys)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(keys[ok])
        return np.where(ok, self.rows[np.where(ok, slot, 0)].astype(np.int64) if len(self.rows) else -1, -1)

    def ids(self, row: int, to: int | None = None) -> np.ndarray:
        a, b = int(self.offsets[row]), int(self.offsets[row + 1 if to is None else to])
        return np.frombuffer(self.file.read_at(self.width * (b - a), len(MAGIC) + self.width * a), f"<u{self.width}").astype("<u4")

    def documents(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) in file order, a bounded run of the payload at a time."""
        row, n = 0, len(self.keys)
        while row < n:
            to = max(row + 1, int(np.searchsorted(self.offsets, self.offsets[row] + READ_BYTES // self.width, side="right")) - 1)
            run, base = self.ids(row, to), int(self.offsets[row])
            for r in range(row, to):
                yield r, run[self.offsets[r] - base : self.offsets[r + 1] - base]
            row = to


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, vocabulary: int = 50257) -> DataFrame:
    """Encode ``docs(doc_id, text, ...)`` and write shards; returns the manifest with each shard's first id position.

    Null text counts as empty (only the end id). Rows are ordered by doc_id (nulls first, and not
    in the index), rows of one id by text; other columns are ignored; an empty table writes no
    shard. Ranges split on the text too, so rows of one id may span shards.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    width = 2 if max(vocabulary, end_id + 1) <= 1 << 16 else 4
    ordered = id_and_text(docs).repartitionByRange(partitions(spark), "doc_id", F.crc32("text")).sortWithinPartitions("doc_id", F.crc32("text"), "text")
    manifest = written(ordered.mapInArrow(shard_writer(folder, tokenizer, end_id, width), MANIFEST), "manifest")
    # one row a shard
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist(), strict=True):
            shard = Shard(path)
            own = shard.keys[shard.nulls :]
            if (shard.find(own) != np.searchsorted(own, own) + shard.nulls).any():
                raise ValueError(f"{path}: its index does not lead to its documents")
            crc = [zlib.crc32(ids) for _, ids in shard.documents()]
            n = np.diff(shard.offsets)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(shard.keys, mask=np.arange(len(shard.keys)) < shard.nulls),
                    "start": pa.array(shard.offsets[:-1] + start),
                    "n_tokens": pa.array(n),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
            )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, read from the shards: doc_id, start, n_tokens, ids_crc32."""
    spread = manifest.select("path", "start").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Index:
    """Keyed access over all shards: a bisection of the manifest's key ranges, then the shard's index."""

    def __init__(self, manifest: DataFrame):
        self.rows = [r for r in manifest.orderBy("shard").collect() if r["low"] is not None]  # one row a shard
        self.high = np.array([r["high"] for r in self.rows], np.int64)
        self.opened: dict[str, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        """Ids of every row with this key; an empty list if there is none."""
        out, at = [], int(np.searchsorted(self.high, key))
        while at < len(self.rows) and self.rows[at]["low"] <= key:
            path = self.rows[at]["path"]
            if path not in self.opened:
                self.opened[path] = Shard(path)
            shard = self.opened[path]
            row = int(shard.find(np.array([key]))[0])
            while 0 <= row < len(shard.keys) and shard.keys[row] == key:
                out.append(shard.ids(row))
                row += 1
            at += 1
        return out

