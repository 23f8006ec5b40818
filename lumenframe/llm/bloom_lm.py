"""Language-model scores from a log-frequency Bloom filter (op 3).

Tokens are words and one end a text. Unigram counts of the training rows are exact. Counts of
longer n-grams are quantised on a log scale, and an n-gram of level q is stored in the filter
once for each level up to q, so repeated membership probes give its level back. The filter holds
all training n-grams, also those seen once. Its size follows the corpus; it is made of shards by
n-gram hash, which are broadcast together while they fit ``BROADCAST_BYTES``, and in several passes
beyond that.

Probabilities interpolate the n-gram estimates with the add-one unigram; the weights depend on
the context only and are fitted by expectation maximisation, leaving one occurrence out, on all
training texts: their tokens are counted by context and by the ratios of the estimates, in
``CELLS`` steps an octave. N-gram identity has 32 bits and a shard's number, words 64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import crc_mod, partitions, written
from lumenframe.llm.wordhash import U, Words, blocks, column, mix, raw, seeded, words

ORDERS = (2, 3)
LEVEL_BASE = 2.0  # a level is a doubling of the count
PROBES = 6
BITS_AN_ENTRY = 10
BROADCAST_BYTES = 256 << 20
CELLS = 8
FIT_STEPS = 25
CHUNK_BYTES = 10_000_000  # of text
PROBED = 1 << 15  # n-grams probed at once
HELD_CELLS = 1_000_000  # cells of a task that wait to be counted together
END = U(0x5851F42D4C957F2D)


@dataclass
class Tokens:
    """Token hashes of a block; ``bounds[d]:bounds[d+1]`` are row d's, its end last."""

    hash: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, w: Words) -> "Tokens":
        n = len(w.bounds) - 1
        bounds = w.bounds + np.arange(n + 1)
        hashed = np.empty(bounds[-1], U)
        last = np.zeros(len(hashed), bool)
        last[bounds[1:] - 1] = True
        hashed[~last], hashed[last] = w.hash, END
        return cls(hashed, bounds)

    def place(self) -> np.ndarray:
        """Place of each token in its row."""
        return np.arange(len(self.hash)) - np.repeat(self.bounds[:-1], np.diff(self.bounds))


def grams(t: Tokens, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of last tokens, hashes) of the n-grams of an order."""
    at = np.flatnonzero(t.place() >= order - 1)
    h = np.zeros(len(at), U)
    for j in range(order):
        h += t.hash[at - j] * U((2 * j + 3) * 0x9E3779B97F4A7C15 + 2 * order & (1 << 64) - 1 | 1)
    return at, mix(h + U(order))


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> U(40)) * U(n) >> U(24)


def gram_key(h: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(h, n) << U(32) | h & U(0xFFFFFFFF)


def cuts(bucket: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(n + 1, dtype=U))


COUNTED = "bucket int, chunk long, tokens binary, counts binary, grams binary, many binary"


def packed(tokens: np.ndarray, train: np.ndarray, n: int) -> list[tuple[bytes, bytes]]:
    """For each bucket a chunk's distinct tokens and their training counts."""
    h, where = np.unique(tokens, return_inverse=True) if len(tokens) else (tokens, np.zeros(0, np.int64))
    count = np.bincount(where, train, len(h)).astype("<u4") if len(h) else np.zeros(0, "<u4")
    at = cuts(bucket_of(h, n), n)
    return [(h[a:b].tobytes(), count[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]


def count_chunks(n: int):
    """Chunks of a task's rows, counted; a chunk is a fixed run of rows, so that the later pass meets the same ones."""

    def emit(chunk: int, parts: list[tuple[Tokens, np.ndarray]]) -> pa.RecordBatch:
        tokens = np.concatenate([t.hash for t, _ in parts])
        train = np.concatenate([np.repeat(y, np.diff(t.bounds)) for t, y in parts])
        rows = packed(tokens, train, n)
        keys = []
        for t, y in parts:
            per_token = np.repeat(y, np.diff(t.bounds))
            for order in ORDERS:
                at, h = grams(t, order)
                keys.append(gram_key(h[per_token[at]], n))
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        at = cuts(key >> U(32), n)
        fingerprint = (key & U(0xFFFFFFFF)).astype("<u4")
        grams_of, many_of = [], []
        for a, b in zip(at[:-1], at[1:], strict=True):
            more = np.flatnonzero(count[a:b] > 1)
            grams_of.append(fingerprint[a:b].tobytes())
            many_of.append(np.stack([more, count[a:b][more]]).astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, chunk, np.int64)), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array(grams_of, pa.binary()), pa.array(many_of, pa.binary())],
            names=["bucket", "chunk", "tokens", "counts", "grams", "many"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, part in chunks(batches):
            yield emit(chunk, [(Tokens.of(words(column(b, "text"))), trained(b)) for b in part])

    return run


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Runs of rows of about CHUNK_BYTES bytes of text, numbered by task and place; cuts depend on the texts before them only, not on batches or other columns."""
    from pyspark import TaskContext

    task, held, at, seen = TaskContext.get().partitionId() << 32, [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(column(batch, "text"))
        number = (seen + offsets[:-1]) // CHUNK_BYTES
        seen += int(offsets[-1])
        cut = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if number[a] != at and held:
                yield task + at, held
                held = []
            at = int(number[a])
            held += blocks(iter([batch.slice(a, b - a)]))
    if held:
        yield task + at, held


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk, part in chunks(batches):
        for b in part:
            yield b.append_column("chunk", pa.array(np.full(b.num_rows, chunk, np.int64)))


MERGED = "bucket int, chunk long, total long, known long, check long, data binary"


def checksum(h: np.ndarray) -> int:
    return int(seeded(h, 17).sum(dtype=U).astype(np.int64)) if len(h) else 0


def levels(count: np.ndarray) -> np.ndarray:
    """Quantised count, 1 for a count of one."""
    return 1 + np.floor(np.log(count) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)


def level_count(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range on the log scale; 0 and 1 for levels 0 and 1, which are exact."""
    return np.where(level > 1, LEVEL_BASE ** (level - 0.75), level * 1.0)


def hash_pair(fingerprint: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes that give all probes of an item."""
    f = fingerprint.astype(U)
    return seeded(f, 31 + level), seeded(f, 77 + level) | U(1)


def bit_places(pair: tuple[np.ndarray, np.ndarray], probe: int, bits: np.ndarray | int) -> np.ndarray:
    a, b = pair
    return (a + U(probe) * b) % (bits if isinstance(bits, np.ndarray) else U(bits))


def merge(table: pa.Table) -> pa.Table:
    """Of one bucket: the total count of each chunk's tokens, and the filter's shard."""
    bucket = int(table.column("bucket")[0].as_py())
    chunk = table.column("chunk").to_pylist()
    get = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind) for x in table.column(c)]
    tokens, counts, fingerprints, many = get("tokens", "<u8"), get("counts", "<u4"), get("grams", "<u4"), get("many", "<u4")
    h, where = np.unique(np.concatenate(tokens), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(h)).astype(np.int64)
    rows = {"chunk": [], "check": [], "data": []}
    at = 0
    for c, t in zip(chunk, tokens, strict=True):
        rows["chunk"].append(c)
        rows["check"].append(checksum(t))
        rows["data"].append(total[where[at : at + len(t)]].astype("<i8").tobytes())
        at += len(t)
    number = []
    for f, m in zip(fingerprints, many, strict=True):
        x = np.ones(len(f), np.int64)
        place, count = m.reshape(2, -1)
        x[place] = count
        number.append(x)
    f, where = np.unique(np.concatenate(fingerprints), return_inverse=True)
    count = np.bincount(where, np.concatenate(number), len(f)).astype(np.int64)
    level = levels(count)
    bits = max(64, -(-int(level.sum()) * BITS_AN_ENTRY // 64) * 64)
    shard = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        pair = hash_pair(f[level >= j], j)
        for probe in range(PROBES):
            shard[bit_places(pair, probe, bits).astype(np.int64)] = True
    n = len(chunk)
    return pa.table(
        {
            "bucket": pa.array(np.full(n + 1, bucket, np.int32)),
            "chunk": pa.array([*rows["chunk"], None], pa.int64()),
            "total": pa.array([None] * n + [int(total.sum())], pa.int64()),
            "known": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
            "check": pa.array([*rows["check"], 0], pa.int64()),
            "data": pa.array([*rows["data"], np.packbits(shard, bitorder="little").tobytes()], pa.binary()),
        }
    )


class Filter:
    """Shards ``first`` to ``last`` of the filter."""

    def __init__(self, sizes: list[int], first: int, n: int):
        self.first, self.n = first, n
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.bytes = np.zeros(int(self.start[-1]), np.uint8)

    def put(self, bucket: int, shard: bytes) -> None:
        at = self.start[bucket - self.first]
        self.bytes[at : at + len(shard)] = np.frombuffer(shard, np.uint8)

    def hits(self, level: int, at: np.ndarray, f: np.ndarray, bits: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Those of the places ``at`` whose n-gram is in the filter at a level."""
        a, b = hash_pair(f[at], level)
        bits, base = bits[at], base[at]
        for probe in range(PROBES):
            place = bit_places((a, b), probe, bits).astype(np.int64)
            on = np.flatnonzero(self.bytes[base + (place >> 3)] >> (place & 7).astype(np.uint8) & 1)
            if len(on) < len(at):
                at, a, b, bits, base = at[on], a[on], b[on], bits[on], base[on]
        return at

    def level(self, h: np.ndarray, stored: np.ndarray) -> np.ndarray:
        """Levels of n-gram hashes; 0 for those of other shards.

        Those that are ``stored`` for certain, as n-grams of training rows, have level 1 without a probe:
        a filter has no false negatives. Many at once go shard by shard, as a shard fits a cache and the filter does not.
        """
        out = np.zeros(len(h), np.uint8)
        bucket = bucket_of(h, self.n).astype(np.int32) - self.first
        every = np.flatnonzero((bucket >= 0) & (bucket < len(self.start) - 1)).astype(np.int32)
        every = every[np.argsort(bucket[every].astype(np.uint16 if self.n < 1 << 16 else np.int32), kind="stable")]
        size = np.diff(self.start).astype(U) * U(8)
        for k in range(0, len(every), PROBED):
            own = every[k : k + PROBED]
            shard, f, sure = bucket[own], h[own] & U(0xFFFFFFFF), stored[own]
            bits, base = size[shard], self.start[shard]
            at = np.concatenate([np.flatnonzero(sure), self.hits(1, np.flatnonzero(~sure), f, bits, base)])
            level = 1
            while len(at):
                out[own[at]] = level
                level += 1
                at = self.hits(level, at, f, bits, base)
        return out


def probed(blocks_of: list[Tokens], train: list[np.ndarray], f: Filter) -> list[np.ndarray]:
    """For each block, with its rows' ``train``, the level of the n-gram of each order that ends at each token: orders x tokens."""
    out = [np.zeros((len(ORDERS), len(t.hash)), np.uint8) for t in blocks_of]
    for i, order in enumerate(ORDERS):
        found = [grams(t, order) for t in blocks_of]
        stored = [np.repeat(y, np.diff(t.bounds))[at] for t, y, (at, _) in zip(blocks_of, train, found, strict=True)]
        level = f.level(np.concatenate([h for _, h in found]), np.concatenate(stored))
        ends = np.cumsum([len(at) for at, _ in found])[:-1]
        for x, (at, _), own in zip(out, found, np.split(level, ends), strict=True):
            x[i, at] = own
    return out


CONTEXTS = 32


def estimates(t: Tokens | Rows, count: np.ndarray, level: np.ndarray, total: int, known: int, left_out: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(context class of each token, estimates by order 1, 2, 3). ``left_out`` is 1 if the text itself was counted."""
    place = t.place()
    p1 = (np.maximum(count - left_out, 0) + 1) / (total - left_out + 1.0 * (known + 1))
    number = level_count(level)
    number = np.where(number > 0, number - left_out, 0)
    before = np.maximum(np.concatenate([[0], count[:-1]]) - left_out, 0) * (place >= 1)
    f2 = np.where(place >= 1, np.minimum(1, number[0] / np.maximum(before, 1)), 0)
    pair = np.concatenate([[0], number[0][:-1]]) * (place >= 2)
    f3 = np.where(pair > 0, np.minimum(1, number[1] / np.maximum(np.maximum(pair, number[1]), 1)), 0)
    # what is known of the context without what is left out: levels of the two words before, and of the word before
    by_word = np.minimum(np.log2(before + 1).astype(np.int64) // 3, 7)
    by_pair = np.where(pair > 0, np.minimum(levels(np.maximum(pair, 1)), 3), 0)
    return by_pair * 8 + by_word, np.stack([p1, f2, f3])


def cells_of(context: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Context and both ratios to the unigram on a log scale, in one number; 0 stands for a ratio of zero."""
    ratio = p[1:] / p[0]
    step = np.where(ratio > 0, np.round(CELLS * np.log2(np.where(ratio > 0, ratio, 1))) + (1 << 15), 0).astype(np.int64)
    return context << 32 | step[0] << 16 | step[1]


def weights(cell: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Interpolation weights by context class, of counted cells; classes that training lacks keep to the unigram."""
    context, step = cell >> 32, np.stack([cell >> 16, cell]) & 0xFFFF
    p = np.concatenate([np.ones((1, len(cell))), np.where(step > 0, 2.0 ** ((step - (1 << 15)) / CELLS), 0.0)])
    w = np.tile(np.array([0.9, 0.06, 0.04]), (CONTEXTS, 1))
    for _ in range(FIT_STEPS):
        share = w[context].T * p
        share *= number / share.sum(axis=0)
        for i in range(3):
            w[:, i] = np.bincount(context, share[i], CONTEXTS) + (2.0 if i == 0 else 0.02)
        w /= w.sum(axis=1, keepdims=True)
    return w


def chunk_counts(t_hash: np.ndarray, rows: pa.Table, n: int) -> np.ndarray:
    """Training count of each token of a chunk, from the chunk's rows of all buckets."""
    h, where = np.unique(t_hash, return_inverse=True)
    order = np.argsort(rows.column("bucket").to_numpy())
    at = cuts(bucket_of(h, n), n)
    data, check, bucket = rows.column("data"), rows.column("check").to_pylist(), rows.column("bucket").to_pylist()
    counts = []
    for i in order:
        part = h[at[bucket[i]] : at[bucket[i] + 1]]
        if check[i] != checksum(part):
            raise ValueError("rows came in another order than in the counting pass; write the input as a table first")
        counts.append(np.frombuffer(data[int(i)].as_buffer(), "<i8"))
    return np.concatenate(counts)[where] if counts else np.zeros(len(where), np.int64)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs(doc_id, text, ...)``, learnt from rows whose crc32(doc_id) mod 7 is not 2.

    Null text counts as empty: one end token. Repeated rows count and are scored each; a null id
    hashes as empty text; other columns are ignored; an empty table gives an empty result. The
    input is read twice and must give its rows in one order, as a stored table does.
    """
    spark = docs.sparkSession
    n = 4 * partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (crc_mod(F.col("doc_id"), 7) != 2).alias("train"))
    counted = docs.select("text", "train").mapInArrow(count_chunks(n), COUNTED)
    merged = written(counted.groupBy("bucket").applyInArrow(merge, MERGED), "counts", "zstd")
    total, known, size = merged.where("chunk is null").agg(F.sum("total"), F.sum("known"), F.sum(F.length("data"))).first()
    total, known = int(total or 0), int(known or 0)
    passes = max(1, -(-int(size or 0) // BROADCAST_BYTES))
    parts = [(i * n // passes, (i + 1) * n // passes) for i in range(passes)]

    def shards(first: int, last: int) -> Filter:
        own = merged.where(f"chunk is null and bucket >= {first} and bucket < {last}")
        size = {r["bucket"]: r["size"] for r in own.select("bucket", F.length("data").alias("size")).collect()}
        out = Filter([size.get(i, 8) for i in range(first, last)], first, n)
        for r in own.select("bucket", "data").toLocalIterator():  # shard by shard into one array: never twice on the driver
            out.put(r["bucket"], r["data"])
        return out

    per_chunk = merged.where("chunk is not null").select("chunk", "bucket", "check", "data")
    source = docs.mapInArrow(keyed, "doc_id long, text string, train boolean, chunk long")
    if passes == 1:
        filters = spark.sparkContext.broadcast(shards(0, n))
    else:  # each pass adds the levels that its shards know, and is written before the next
        filters = None
        source = source.withColumn("levels", F.lit(None).cast("binary"))
        for first, last in parts:
            shared = spark.sparkContext.broadcast(shards(first, last))
            source = written(source.mapInArrow(add_levels(shared), "doc_id long, text string, train boolean, chunk long, levels binary"), "levels")
            shared.unpersist()
    both = source.groupBy("chunk").cogroup(per_chunk.groupBy("chunk"))
    # probed and counted once; what the weights and the scores need of each token is read from here
    judged = written(both.applyInArrow(judge_chunk(filters, n), JUDGED), "judged", "zstd")
    if filters is not None:
        filters.unpersist()
    cells = judged.where("train").mapInArrow(count_cells(total, known), "cell long, number long").groupBy("cell").agg(F.sum("number").alias("number")).orderBy("cell").toArrow()
    weight = weights(cells.column("cell").to_numpy(), cells.column("number").to_numpy())
    return judged.mapInArrow(score_rows(weight, total, known), SCORES)


def trained(batch: pa.RecordBatch) -> np.ndarray:
    return column(batch, "train").to_numpy(zero_copy_only=False)


def add_levels(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in chunks(batches):
            tokens = [Tokens.of(words(column(b, "text"))) for b in parts]
            for b, t, level in zip(parts, tokens, probed(tokens, [trained(b) for b in parts], shared.value), strict=True):
                old = column(b, "levels")
                out = []
                for d, (a, e) in enumerate(zip(t.bounds[:-1], t.bounds[1:], strict=True)):
                    own = level[:, a:e]
                    if old[d].is_valid:
                        own = np.maximum(own, np.frombuffer(old[d].as_buffer(), np.uint8).reshape(len(ORDERS), -1))
                    out.append(own.tobytes())
                yield b.set_column(b.schema.get_field_index("levels"), "levels", pa.array(out, pa.binary()))

    return run


JUDGED = "doc_id long, train boolean, counts binary, levels binary"


def judge_chunk(shared, n: int):
    """Of each row of a chunk: the training count of each token (4 bytes, or 8 where one needs them) and the levels of the n-grams that end at it."""

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        parts = [b for b in blocks(iter(docs.combine_chunks().to_batches()))]
        tokens = [Tokens.of(words(column(b, "text"))) for b in parts]
        every = chunk_counts(np.concatenate([t.hash for t in tokens]) if tokens else np.zeros(0, U), counts, n)
        found = probed(tokens, [trained(b) for b in parts], shared.value) if shared is not None and tokens else [None] * len(tokens)
        at, out = 0, []
        for b, t, level in zip(parts, tokens, found, strict=True):
            count = every[at : at + len(t.hash)]
            at += len(t.hash)
            rows = list(zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True))
            if level is not None:
                levels = [level[:, a:e].tobytes() for a, e in rows]
            else:
                levels = column(b, "levels").to_pylist()
            width = "<u4" if count.max(initial=0) < 1 << 32 else "<i8"
            own = [count[a:e].astype(width).tobytes() for a, e in rows]
            out.append(pa.table({"doc_id": column(b, "doc_id"), "train": column(b, "train"), "counts": pa.array(own, pa.binary()), "levels": pa.array(levels, pa.binary())}))
        return pa.concat_tables(out)

    return run


@dataclass
class Rows:
    """Tokens of a batch of judged rows, without their hashes."""

    bounds: np.ndarray
    count: np.ndarray
    level: np.ndarray

    @staticmethod
    def of(batch: pa.RecordBatch) -> "Rows":
        counts, levels = ([x.as_buffer() for x in column(batch, c)] for c in ("counts", "levels"))
        size = np.array([len(x) // len(ORDERS) for x in levels], np.int64)
        count = [np.frombuffer(c, "<u4" if len(c) == 4 * k else "<i8").astype(np.int64) for c, k in zip(counts, size.tolist(), strict=True)]
        level = [np.frombuffer(x, np.uint8).reshape(len(ORDERS), -1) for x in levels]
        return Rows(np.concatenate([[0], np.cumsum(size)]), np.concatenate([*count, np.zeros(0, np.int64)]), np.concatenate([*level, np.zeros((len(ORDERS), 0), np.uint8)], axis=1))

    def place(self) -> np.ndarray:
        return np.arange(self.bounds[-1]) - np.repeat(self.bounds[:-1], np.diff(self.bounds))


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return blocks(batches, text="levels")


def count_cells(total: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, held = [np.zeros(0, np.int64)], 0
        number = [np.zeros(0, np.int64)]

        def flushed() -> pa.RecordBatch:
            cell, where = np.unique(np.concatenate(cells), return_inverse=True)
            return pa.RecordBatch.from_pydict({"cell": pa.array(cell), "number": pa.array(np.bincount(where, np.concatenate(number), len(cell)).astype(np.int64))})

        for batch in row_blocks(batches):
            r = Rows.of(batch)
            context, p = estimates(r, r.count, r.level, total, known, 1)
            cell, many = np.unique(cells_of(context, p), return_counts=True)
            cells.append(cell)
            number.append(many)
            held += len(cell)
            if held > HELD_CELLS:
                yield flushed()
                cells, number, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        yield flushed()

    return run


def score_rows(weight: np.ndarray, total: int, known: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_blocks(batches):
            r = Rows.of(batch)
            context, p = estimates(r, r.count, r.level, total, known)
            log_p = np.log10((weight[context].T * p).sum(axis=0))
            add = lambda x: np.add.reduceat(x, r.bounds[:-1])  # noqa: B023, E731  every row has a token
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": column(batch, "doc_id"),
                    "held_out": pa.array(~column(batch, "train").to_numpy(zero_copy_only=False)),
                    "n_tokens": pa.array(np.diff(r.bounds)),
                    "n_known": pa.array(add((r.count > 0).astype(np.int64))),
                    "train_tokens": pa.array(np.full(batch.num_rows, total, np.int64)),
                    "base_score": pa.array(add(np.log10((r.count + 1) / (total + 1.0 * (known + 1))))),
                    "score": pa.array(add(log_p)),
                }
            )

    return run
