"""Exact Jaccard self-join of shingle sets by universe partition (op 9).

Sets are grouped into size bands. In a band two similar sets differ in at most ``tau``
elements, so when the universe of hashes is cut into segments whose weights sum to more than
``tau``, one segment differs in fewer elements than its weight: a segment of weight 1 is then
equal in both sets and is indexed by the hash of its elements, one of weight 2 also by its
one-deletion neighbourhood. ``Band.allocate`` picks the weights by cost; those of 0 go to segments
whose elements are frequent, as counted over all sets. Equal sets are one
node, and posting groups are linked as a star, never as all their pairs.
Whatever such a group leaves apart is joined once more at the finest partition (one element
a segment, the rarest segments allotted), which again loses no pair.
Candidates whose parity sketches differ too much are no links; all others are verified on
whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text, partitions, written
from lumenframe.llm.components import components
from lumenframe.llm.wordhash import U, blocks, column, mix, seeded, shingles, words

SHINGLE = 5
NUM, DEN = 80, 100  # linked when DEN * |intersection| >= NUM * |union|
STAR_GROUP = 2  # in larger posting groups the star leaves pairs out; their members are kept for the second join
LOCAL_GROUP = 16  # a task forwards the head of a larger group only
BROADCAST_ROWS = 1_000_000  # 8 bytes a row; beyond this the join shuffles
FLUSH = 1_000_000
COMMON, COMMON_ELEMENTS = 2, 8_000_000  # an element that more sets hold is frequent; so many of them are told apart
TOP = 31  # leading bits by which frequent elements are known on the driver
SHARE = 8
SPARE = 2  # segments a set beyond those that may be empty, so that the most frequent ones can be passed over
KEY_BYTES = 5


class Band(NamedTuple):
    index: int
    low: int
    high: int  # exclusive
    tau: int
    ones: int
    twos: int
    slack: int

    @property
    def segments(self) -> int:
        return self.ones + self.twos

    @staticmethod
    def allocate(index: int, low: int, high: int) -> "Band":
        """The cheapest weights: signatures written, plus the false postings of empty segments."""
        tau = (DEN - NUM) * 2 * (high - 1) // (DEN + NUM)
        size = max(1, low * NUM / DEN)
        best = None
        for twos in range(min(tau // 2 + 1, 4) + 1):
            ones, slack = max(0, tau + 1 - 2 * twos), 0
            if not twos:  # all of weight 1: spare segments allow for empty ones, which then needn't be indexed
                for _ in range(20):
                    m = tau + 1 + slack
                    p = (1 - 1 / m) ** size
                    slack = math.ceil(m * p + 3 * math.sqrt(m * p * (1 - p))) + SPARE
                ones = tau + 1 + slack
            n = ones + twos
            empty = n * (1 - 1 / n) ** size
            cost = ones + twos * (1 + size / n) + (40 * empty if twos else 0)
            if best is None or cost < best[0]:
                best = (cost, Band(index, low, high, tau, ones, twos, slack))
        return best[1]


@lru_cache(maxsize=None)
def band(index: int) -> Band:
    low = 4
    for _ in range(index):
        low = math.ceil(low * 1.6)
    return Band.allocate(index, low, math.ceil(low * 1.6))


def bands_of(size: int) -> list[Band]:
    """Own band, and the next one if it has similar larger sets. Sets under 4 elements are similar to equal ones only."""
    if size < 4:
        return []
    k = 0
    while band(k).high <= size:
        k += 1
    out = [band(k)]
    if DEN * size >= NUM * band(k + 1).low:
        out.append(band(k + 1))
    return out


class Popular:
    """How many sets hold an element, on a log scale and by the leading bits of its hash; 0 for an element that few hold.

    Elements that share these bits get the highest of their levels. Levels order elements, the same way
    in all sets: they settle what is indexed, hence the cost, and never what is found.
    """

    def __init__(self, elements: np.ndarray, counts: np.ndarray | None = None):
        bits = min(max(16, (4 * len(elements)).bit_length()), TOP - 6)
        self.shift, self.table = U(64 - bits), np.zeros(1 << bits, np.uint8)
        level = np.ones(len(elements), np.uint8) if counts is None else (1 + np.floor(4 * np.log2(counts))).astype(np.uint8)
        order = np.argsort(level, kind="stable")
        self.table[(elements[order] >> self.shift).astype(np.int64)] = level[order]

    def levels(self, elements: np.ndarray) -> np.ndarray:
        return self.table[(elements >> self.shift).astype(np.int64)]

    def mask(self, elements: np.ndarray) -> np.ndarray:
        return self.levels(elements) > 0

    def rarest(self, elements: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` elements by level, then by hash: one order for all sets."""
        return elements[np.lexsort((elements, self.levels(elements)))[:n]]


def signatures(elements: np.ndarray, level: np.ndarray, b: Band) -> np.ndarray:
    """Index keys of one set in a band. Without weights of 2 the ``tau + 1`` segments of the rarest contents are kept.

    A segment is as rare as its rarest element by ``level``, an empty one comes last, and ties go by the
    key: one order of contents for all sets. Similar sets differ in at most ``tau`` segments, so the first
    content in that order that both have is within the first ``tau + 1`` of either.
    """
    m = b.segments
    segment = (elements % U(m)).astype(np.int64)
    sums, rarest = np.zeros(m, U), np.full(m, 1 << 8, np.int64)
    strong = seeded(elements, 7)
    np.add.at(sums, segment, strong)
    place = np.arange(m, dtype=U) + U(b.index << 40)
    keys = mix(mix(sums) + place)
    if not b.twos:
        np.minimum.at(rarest, segment, level)
        return np.unique(keys[np.lexsort((keys, rarest))[: b.tau + 1]])
    near = segment < b.twos
    s = segment[near]
    return np.unique(np.concatenate([keys, mix(mix(sums[s] - strong[near]) + place[s])]))


def sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    s, bounds = shingles(words(column(batch, "text")), SHINGLE)
    return [np.unique(s[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def node_of(elements: np.ndarray) -> int:
    """The identity of a set: a 64-bit hash of its elements."""
    x = seeded(elements, 3)
    total = mix(np.array([x.sum(dtype=U) + U(len(x)), np.bitwise_xor.reduce(x)], U))
    return int((total[0] + total[1] * U(0x9E3779B97F4A7C15)).astype(np.int64))


def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        sets = sets_of(batch)
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([node_of(x) if len(x) else None for x in sets], pa.int64())],
            names=["doc_id", "n_shingles", "node"],
        )


def with_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        names = [node_of(x) if len(x) else None for x in sets_of(batch)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), column(batch, "text")], names=["node", "text"])


def groups(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, node) in order, and the start of each key's run."""
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
    key, node = key[new], node[new]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key, node, start


def star(start: np.ndarray, n: int, node: np.ndarray) -> np.ndarray:
    """Each run's head with the others of the run."""
    head = np.repeat(start, np.diff(np.append(start, n)))
    rest = np.flatnonzero(np.arange(n) > head)
    both = np.sort(np.stack([node[head[rest]], node[rest]]), axis=0)
    return np.unique(both, axis=1) if both.shape[1] else both


KEYS = "bucket int, edges binary, members binary, data binary"
FOUND = "edge boolean, a long, b long"


def _split(pairs: np.ndarray, n_buckets: int) -> list[bytes]:
    """Columns of ``pairs`` dealt evenly to the buckets, as bytes of both rows."""
    return [pairs[:, i::n_buckets].astype("<i8").tobytes() for i in range(n_buckets)]


def posting(key: np.ndarray, bucket: np.ndarray | int) -> np.ndarray:
    """The identity of a posting group, by what tells keys apart after packing: the low KEY_BYTES and the bucket."""
    return seeded(mix((key & U((1 << 8 * KEY_BYTES) - 1)) + (U(bucket) if isinstance(bucket, int) else bucket) * U(0x9E3779B97F4A7C15)), 5).view(np.int64)


def index(n_buckets: int, popular):
    """Signature entries of a task, packed by bucket; edges and members of groups that are large within the task."""

    def flush(parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, node, start = groups(np.concatenate([k for k, _ in parts]), np.concatenate([np.full(len(k), n, np.int64) for k, n in parts]))
        length = np.diff(np.append(start, len(key)))
        large = length > LOCAL_GROUP
        flag = np.zeros(len(key), np.uint8)
        edges = members = np.zeros((2, 0), np.int64)
        if large.any():
            inside = np.repeat(large, length)
            own = node[inside]
            own_start = np.concatenate([[0], np.cumsum(length[large])[:-1]])
            edges = star(own_start, len(own), own)
            members = np.stack([posting(key[inside], (key[inside] >> U(40)) % U(n_buckets)), own])
            flag[start[large]] = 1
            keep = ~inside
            keep[start[large]] = True
            key, node, flag = key[keep], node[keep], flag[keep]
        bucket = (key >> U(40)) % U(n_buckets)
        order = np.argsort(bucket, kind="stable")
        key, node, flag = key[order], node[order], flag[order]
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1, dtype=U))
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            low = key[a:b].view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]  # with the bucket's own bits, enough to tell keys apart
            blobs.append(np.uint64(b - a).tobytes() + low.tobytes() + node[a:b].tobytes() + np.packbits(flag[a:b]).tobytes())
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array(np.arange(n_buckets, dtype=np.int32)), "edges": pa.array(_split(edges, n_buckets), pa.binary()), "members": pa.array(_split(members, n_buckets), pa.binary()), "data": pa.array(blobs, pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, set()
        for batch in blocks(batches):
            for elements in sets_of(batch):
                if len(elements) < 4 or (node := node_of(elements)) in seen:
                    continue
                seen.add(node)
                level = popular.value.levels(elements)
                for b in bands_of(len(elements)):
                    keys = signatures(elements, level, b)
                    parts.append((keys, node))
                    held += len(keys)
            if held > FLUSH:
                yield from flush(parts)
                parts, held = [], 0
                seen.clear()
        if parts:
            yield from flush(parts)

    return run


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    parts = [np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1) for x in column]
    return np.concatenate(parts, axis=1)


def match(table: pa.Table) -> pa.Table:
    """Edges of one bucket, and members of its large groups; those that tasks found by themselves pass through."""
    bucket = int(table.column("bucket")[0].as_py())
    keys, ids, flags = [], [], []
    for blob in table.column("data"):
        data = np.frombuffer(blob.as_buffer(), np.uint8)
        n = int(data[:8].view(np.uint64)[0])
        nodes_at, flags_at = 8 + KEY_BYTES * n, 8 + (KEY_BYTES + 8) * n
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :KEY_BYTES] = data[8:nodes_at].reshape(n, KEY_BYTES)
        keys.append(wide.view(U).ravel())
        ids.append(np.frombuffer(data[nodes_at:flags_at].tobytes(), np.int64))
        flags.append(np.unpackbits(data[flags_at:], count=n).astype(bool))
    raw_key, flag = np.concatenate(keys), np.concatenate(flags)
    key, node, start = groups(raw_key, np.concatenate(ids))
    length = np.diff(np.append(start, len(key)))
    hot = (length > STAR_GROUP) | np.isin(key[start], raw_key[flag])
    inside = np.repeat(hot & (length > 1), length)
    pairs = np.concatenate([star(start, len(key), node), _joined(table.column("edges"))], axis=1)
    own = np.stack([posting(key[inside], bucket), node[inside]])
    members = np.concatenate([own, _joined(table.column("members"))], axis=1)
    both = np.concatenate([pairs, members], axis=1)
    return pa.table({"edge": pa.array(np.arange(both.shape[1]) < pairs.shape[1]), "a": pa.array(both[0]), "b": pa.array(both[1])})


SETS = "node long, size int, sketch binary, elements binary"


def sketch(elements: np.ndarray) -> bytes:
    """Parities of hashed elements, four bits or more an element; two sketches differ in no more bits than the sets in elements."""
    bits = 1 << max(6, (4 * len(elements) - 1).bit_length())
    odd = np.bincount((seeded(elements, 23) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """Least size of the symmetric difference, from sketches; the longer one is folded."""
    a, b = np.frombuffer(x, U), np.frombuffer(y, U)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def packed_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the rows that a node is wanted of; rows of its id with other texts fall out."""
    for batch in blocks(batches):
        sets, wanted = sets_of(batch), column(batch, "node").to_pylist()
        keep = [(n, x) for n, x in zip(wanted, sets, strict=True) if len(x) and node_of(x) == n]
        yield pa.RecordBatch.from_pydict(
            {
                "node": pa.array([n for n, _ in keep], pa.int64()),
                "size": pa.array([len(x) for _, x in keep], pa.int32()),
                "sketch": pa.array([sketch(x) for _, x in keep], pa.binary()),
                "elements": pa.array([x.tobytes() for _, x in keep], pa.binary()),
            }
        )


def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches do not rule a link out."""
    for batch in batches:
        keep = []
        for x, y, m, n in zip(*(column(batch, c).to_pylist() for c in ("x", "y", "m", "n")), strict=True):
            both = (m + n - differing(x, y)) // 2
            keep.append(DEN * both >= NUM * (m + n - both))
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(column(batch, "x"), column(batch, "y"), strict=True):
            r, s = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = len(np.intersect1d(r, s, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(r) + len(s) - both))
        yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) that are linked: first by sketches, what they leave by whole sets."""
    side = lambda of, node, kept: of.select(F.col("node").alias(node), *(F.col(c).alias(n) for c, n in kept.items()))
    near = pairs.join(side(sets, "b", {"sketch": "y", "size": "n"}), "b").join(side(sets, "a", {"sketch": "x", "size": "m"}), "a")
    near = written(near.select("a", "b", "x", "y", "m", "n").mapInArrow(possible, "a long, b long"), "near")
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    # sets of no pair that is left are not shuffled
    held = sets.join(F.broadcast(ends) if near.count() <= BROADCAST_ROWS else ends, "node", "left_semi")
    whole = near.join(side(held, "b", {"elements": "y"}), "b").join(side(held, "a", {"elements": "x"}), "a")
    return whole.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


COUNTED = "bucket int, elements binary, many binary"


def count_elements(n_buckets: int):
    """A task's elements by bucket, in KEY_BYTES leading bytes each, and (place, count) of those that several of its sets hold."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        key = np.concatenate(parts)
        key >>= U(64 - 8 * KEY_BYTES)
        key.sort()
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(start, len(key)))
        key = key[start]
        bucket = key * U(n_buckets) >> U(8 * KEY_BYTES)
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=U))
        low = key.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
        elements, many = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            elements.append(low[a:b].tobytes())
            more = np.flatnonzero(count[a:b] > 1)
            many.append(np.stack([more, count[a:b][more]]).astype("<u4").tobytes())
        return pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(n_buckets, dtype=np.int32)), "elements": pa.array(elements, pa.binary()), "many": pa.array(many, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen = [], 0, set()
        for batch in blocks(batches):
            for elements in sets_of(batch):
                if len(elements) < 4 or (node := node_of(elements)) in seen:
                    continue
                seen.add(node)
                parts.append(elements)
                held += len(elements)
            if held > FLUSH // 2:
                yield flush(parts)
                parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def frequent_elements(table: pa.Table) -> pa.Table:
    """Of one bucket: the TOP leading bits of each element that more than COMMON sets hold, with their number."""
    keys, counts = [], []
    for packed, many in zip(table.column("elements"), table.column("many"), strict=True):
        data = np.frombuffer(packed.as_buffer(), np.uint8).reshape(-1, KEY_BYTES)
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, :KEY_BYTES] = data
        keys.append(wide.view(U).ravel())
        count = np.ones(len(data), np.uint32)
        place, number = np.frombuffer(many.as_buffer(), "<u4").reshape(2, -1)
        count[place] = number
        counts.append(count)
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order], start, dtype=np.int64) if len(key) else count
    often = total > COMMON
    top = (key[start][often] >> U(8 * KEY_BYTES - TOP)).astype(np.int32)
    return pa.table({"top": pa.array(top), "n": pa.array(np.minimum(total[often], (1 << 31) - 1).astype(np.int32))})


def frequent(docs: DataFrame, n_buckets: int) -> Popular:
    """Elements that more than COMMON sets hold, counted over all sets: all of them, or the COMMON_ELEMENTS or fewer most frequent ones.

    Copies of a set count once a task.
    """
    counted = docs.select("text").mapInArrow(count_elements(n_buckets), COUNTED)
    counts = written(counted.groupBy("bucket").applyInArrow(frequent_elements, "top int, n int"), "frequent")
    least, total = COMMON, 0
    for octave, n in sorted(counts.groupBy(F.floor(F.log2("n")).alias("octave")).count().collect(), reverse=True):  # at most 32 rows
        total += n
        if total > COMMON_ELEMENTS:
            least = (2 << octave) - 1
            break
    found = counts.where(F.col("n") > least).toArrow()
    return Popular(found.column("top").to_numpy().astype(U) << U(64 - TOP), found.column("n").to_numpy())


def prefix(popular):
    """So many of a set's rarest elements that a similar set shares one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for e in column(batch, "elements"):
                x = np.frombuffer(e.as_buffer(), U)
                out.append(popular.value.rarest(x, len(x) + NUM * len(x) // -DEN + 1))
            n, size = [len(x) for x in out], column(batch, "size").to_numpy()
            place = np.concatenate([*map(np.arange, n), np.zeros(0, int)])
            yield pa.RecordBatch.from_pydict(
                {
                    "node": pa.array(np.repeat(column(batch, "node").to_numpy(), n)),
                    "root": pa.array(np.repeat(column(batch, "root").to_numpy(), n)),
                    "left": pa.array((np.repeat(size, n) - place).astype(np.int32)),
                    "size": pa.array(np.repeat(size, n)),
                    "element": pa.array(np.concatenate([*out, np.zeros(0, U)]).view(np.int64)),
                }
            )

    return run


def split_elements(e: DataFrame) -> DataFrame:
    """Rows of elements whose nodes are in more than one component."""
    parted = e.groupBy("element").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("element")
    return e.join(parted, "element", "left_semi")


def apart(e: DataFrame) -> DataFrame:
    """(a, b) of nodes in different components that share an element and have enough elements left for a link.

    At the first element in order that two sets share, what is left of either bounds their
    intersection; a similar pair passes there, whatever it does at later ones.
    """
    x = e.select("element", F.col("node").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), F.col("left").alias("la"))
    y = e.select("element", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), F.col("left").alias("lb"))
    near = F.least("la", "lb") * (DEN + NUM) >= (F.col("sa") + F.col("sb")) * NUM
    return x.join(y, "element").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & near)


def finest(open_nodes: DataFrame, sets: DataFrame, links: DataFrame, popular) -> DataFrame:
    """Roots by ``links`` and those between open nodes of different components: one element a segment, weight 1 for the tau + 1 rarest, 0 for others.

    One in SHARE of the pairs, by hash, is verified first: a node that has many links to a family of near
    copies joins it by one of them, and needn't be held against all others. The rest of the pairs
    that are still apart follows.
    """
    few = open_nodes.count() <= BROADCAST_ROWS
    open_sets = sets.join(F.broadcast(open_nodes) if few else open_nodes, "node")
    e = open_sets.select("node", "root", "size", "elements").mapInArrow(prefix(popular), "node long, root long, left int, size int, element long")
    e = written(split_elements(written(e, "rarest")), "split")
    early = F.pmod(F.xxhash64("a", "b"), F.lit(SHARE)) == 0
    for turn in (early, ~early):
        pairs = apart(e).where(turn).select("a", "b").distinct()
        links = links.unionByName(written(verified(pairs, sets), "more-links"))
        roots = written(components(links), "roots")
        e = split_elements(e.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    return roots


def jaccard_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: doc_id, n_shingles, component_id.

    Null and empty texts, or texts of white space, have no shingles and are linked with nothing:
    their component is their own id. A null doc_id stays null, linked as any other; without a
    linked row that has an id its component is null.
    Repeated rows, also of one id, give a row each; equal sets are linked. Other columns are
    ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = id_and_text(docs)
    own = written(docs.mapInArrow(nodes, "doc_id long, n_shingles long, node long"), "nodes")
    # ids that are null come last, so that a set has a real id if any
    rep = own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    buckets = 4 * partitions(spark)
    popular = spark.sparkContext.broadcast(frequent(docs, 4 * buckets))
    keyed = docs.select("text").mapInArrow(index(buckets, popular), KEYS)
    found = written(keyed.groupBy("bucket").applyInArrow(match, FOUND), "postings")
    pairs = written(found.where("edge").select("a", "b").where("a != b").distinct(), "pairs")
    members = found.where("not edge").select(F.col("a").alias("key"), F.col("b").alias("node"))
    met = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(met.join(rep, "node").select(F.col("rep").alias("doc_id"), "node"), "wanted")
    number = wanted.count()
    source = docs.join(F.broadcast(wanted) if number <= BROADCAST_ROWS else wanted.hint("shuffle_hash"), "doc_id")
    source = source.select("node", "text")
    unnamed = written(met.join(rep.where("rep is null"), "node").select("node"), "unnamed")
    extra = unnamed.count()
    if extra:  # sets that only rows without an id have
        keys = F.broadcast(unnamed) if extra <= BROADCAST_ROWS else unnamed
        rows = docs.where("doc_id is null").select("text").mapInArrow(with_nodes, "node long, text string")
        source = source.unionByName(rows.join(keys, "node", "left_semi"))
    sets = written(source.mapInArrow(packed_sets, SETS), "sets")
    if sets.count() > number + extra:  # rows that repeat id and text
        sets = written(sets.dropDuplicates(["node"]), "sets")
    links = written(verified(pairs, sets), "checked")
    roots = written(components(links), "roots")
    # groups that the star left in more than one component
    member = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parted = member.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key")
    rest = written(member.join(parted, "key", "left_semi").select("node", "root").distinct(), "open")
    if not rest.isEmpty():
        roots = finest(rest, sets, links, popular)
    named = own.join(rep, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rep.join(roots, "node").groupBy("root").agg(F.min("rep").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "rep", "doc_id").alias("component_id")
    )
