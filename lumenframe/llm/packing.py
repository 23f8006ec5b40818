"""Packing of documents into sequences by linear grouping (op 6).

The plan is made on the histogram of piece lengths, which has at most ``capacity`` rows however
many documents there are. Large lengths, longest first, form groups of equal cardinality and are
rounded up to their group's largest; a configuration program over these few sizes, solved by
column generation, says how many sequences of each configuration to fill; the actual documents
are put in place of the rounded ones; what is left and all small documents go best-fit into the
gaps. The plan maps (length, rank among equal lengths) to a place, so documents are never gathered.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text, written
from lumenframe.llm.tokens import encoded
from lumenframe.llm.wordhash import column

LARGE = (2, 4, 8)  # lengths over capacity / one of these are large; the plan with the fewest sequences counts
GROUPS = 96
GAP = 0.002


def best_configuration(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within capacity of the largest total worth (unbounded knapsack, one more document at each level)."""
    value, choices = np.zeros(capacity + 1), []
    shift = np.arange(capacity + 1)[None, :] + capacity - sizes[:, None]
    for _ in range(capacity // int(sizes.min())):
        padded = np.concatenate([np.full(capacity, -np.inf), value])
        gains = padded[shift] + worth[:, None]
        choice = gains.argmax(axis=0)
        gain = gains[choice, np.arange(capacity + 1)]
        choice[gain <= value + 1e-12] = -1
        if (choice < 0).all():
            break
        choices.append(choice)
        value = np.maximum(gain, value)
    count, c = np.zeros(len(sizes)), capacity
    for choice in reversed(choices):
        if choice[c] >= 0:
            count[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(value[capacity]), count


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Configurations and fractional numbers of them that cover the demand with the least sequences (revised simplex)."""
    k = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(40 * k):
        dual = np.ones(k) @ inverse
        worth, new = best_configuration(sizes, np.maximum(dual, 0), capacity)
        if worth <= 1 + GAP:  # no cover uses fewer than 1 / worth of these
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
        x = np.maximum(x - ratio[leave] * step, 0)
        x[leave] = ratio[leave]
        columns[:, leave] = new
    return [(columns[:, j], float(x[j])) for j in range(k)]


class Plan:
    """Rows (length, rank, count, sequence, offset, stack): ``stack`` documents of a length one after another in each sequence from ``sequence`` on."""

    @classmethod
    def best(cls, histogram: dict[int, int], capacity: int) -> "Plan":
        """The best plan over the thresholds of LARGE; the first within a thousandth of the least possible ends the search."""
        least, found = -(-sum(n * c for n, c in histogram.items()) // capacity), None
        for share in LARGE:
            plan = cls(histogram, capacity, share)
            if found is None or plan.next < found.next:
                found = plan
            if found.next <= 1.001 * least:
                break
        return found

    def __init__(self, histogram: dict[int, int], capacity: int, share: int):
        self.capacity, self.rows = capacity, []
        self.next = 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room: runs (first sequence, number) filled up to it
        self.used = dict.fromkeys(histogram, 0)
        self.counts = dict(histogram)
        large = sorted((n for n in histogram if capacity // share < n < capacity), reverse=True)
        if capacity in histogram:
            self.place(capacity, histogram[capacity], self.open(histogram[capacity]), 0, 1)
        self.group(large)
        for n in sorted(histogram, reverse=True):
            if n < capacity:
                self.best_fit(n)

    def open(self, number: int) -> int:
        self.next += number
        return self.next - number

    def place(self, length: int, count: int, sequence: int, offset: int, stack: int) -> None:
        if count:
            self.rows.append((length, self.used[length], count, sequence, offset, stack))
            self.used[length] += count

    def group(self, large: list[int]) -> None:
        total = sum(self.counts[n] for n in large)
        if not total:
            return
        k = min(GROUPS, total)
        queues, at, left = [], 0, self.counts[large[0]]
        for g in range(k):  # equal cardinality, longest first
            need, queue = total * (g + 1) // k - total * g // k, []
            while need:
                if not left:
                    at += 1
                    left = self.counts[large[at]]
                take = min(need, left)
                queue.append([large[at], take])
                need, left = need - take, left - take
            queues.append(queue)
        sizes = np.array([q[0][0] for q in queues])
        demand = np.array([sum(n for _, n in q) for q in queues], float)
        merged = np.unique(sizes)[::-1]  # groups of one size are one row of the program
        found = configurations(merged, np.array([demand[sizes == s].sum() for s in merged]), self.capacity)
        pools = {int(s): [x for q, z in zip(queues, sizes, strict=True) if z == s for x in q] for s in merged}
        for shape, number in found:
            number = int(number + 1e-6)
            if number:
                self.fill([int(s) for s, c in zip(merged, shape, strict=True) for _ in range(int(round(c)))], number, pools)

    def fill(self, slots: list[int], number: int, pools: dict[int, list[list[int]]]) -> None:
        """``number`` sequences of one configuration, with the next actual documents of each slot's group."""
        sequence, taken = self.open(number), []
        for s in slots:
            runs, need = [], number
            while need and pools[s]:
                length, have = pools[s][0]
                take = min(need, have)
                runs.append((length, take))
                need -= take
                pools[s][0][1] -= take
                if not pools[s][0][1]:
                    pools[s].pop(0)
            taken.append(runs + [(0, need)] * bool(need))
        cuts = sorted({0, number, *(int(c) for runs in taken for c in np.cumsum([n for _, n in runs]))})
        where = [(np.cumsum([n for _, n in runs]), [m for m, _ in runs]) for runs in taken]
        fill = dict.fromkeys(cuts[:-1], 0)
        for ends, lengths in where:
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                n = lengths[int(np.searchsorted(ends, a, side="right"))]
                if n:
                    self.place(n, b - a, sequence + a, fill[a], 1)
                    fill[a] += n
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            self.gaps[self.capacity - fill[a]].append((sequence + a, b - a))

    def best_fit(self, length: int) -> None:
        room = length
        while (left := self.counts[length] - self.used[length]) > 0:
            while room <= self.capacity and not self.gaps[room]:
                room += 1
            if room > self.capacity:
                stack = self.capacity // length
                self.gaps[self.capacity].append((self.open(-(-left // stack)), -(-left // stack)))
                room = self.capacity
            first, number = self.gaps[room].pop()
            offset, stack = self.capacity - room, min(room // length, left)
            n = min(number, left // stack)
            self.place(length, n * stack, first, offset, stack)
            if room > stack * length:
                self.gaps[room - stack * length].append((first, n))
            if number > n:
                self.gaps[room].append((first + n, number - n))

    def arrays(self) -> tuple[np.ndarray, ...]:
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 6)
        return tuple(rows.T)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"


def cut(tokenizer: str, end_id: int, capacity: int, keep_ids: bool):
    """Pieces of each document, and each piece's rank among those of its length in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch, ids, bounds in encoded(batches, tokenizer, end_id, by_word=True):
            out: list[list] = [[] for _ in range(7)]
            for doc, a, b in zip(column(batch, "doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for i, at in enumerate(range(0, b - a, capacity)):
                    piece = ids[a + at : min(b, a + at + capacity)].tobytes()
                    n = len(piece) // 4
                    for values, v in zip(out, (doc, i, at, n, zlib.crc32(piece), seen[n], piece), strict=True):
                        values.append(v)
                    seen[n] += 1
            doc, piece, start, length, crc, local, ids = out
            arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(local, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def located(plan: tuple[np.ndarray, ...]):
    length, rank, _, sequence, offset, stack = plan
    key = (length << 40) + rank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (n << 40) + r, side="right") - 1
            r = r - rank[at]
            batch = batch.append_column("sequence_id", pa.array(sequence[at] + r // stack[at]))
            yield batch.append_column("offset", pa.array(offset[at] + r % stack[at] * n))

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text, ...)`` with their places in sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian
    uint32) if asked. Null text counts as empty: one piece that holds only the end id. Repeated
    rows and null ids are packed like others, other columns are ignored, an empty table gives no
    row. Only documents over ``capacity`` are cut.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    pieces = written(id_and_text(docs).mapInArrow(cut(tokenizer, end_id, capacity, keep_ids), schema), "pieces")
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # at most ``capacity`` rows
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan.best(histogram, capacity).arrays()
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"] + ["ids"] * keep_ids
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long" + ", ids binary" * keep_ids + ", sequence_id long, offset long"
    return ranked.select(columns).mapInArrow(located(plan), out).drop("rank")
