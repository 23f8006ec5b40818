"""Benchmark decontamination (op 2): CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

An item leaks into a document when some window of the document's words is within an edit distance
of a fifth of the item's words. Such a window shares with the item a run of words whose least length
follows from the pigeonhole principle, so windows are laid only where the document has such a
run, which loses none. Each window and item is embedded by random walks (the walk goes on in its
string where a random bit of the symbol says so), which turns edits into few differing places;
windows that agree with the item at one of the sampled places of one of the walks are candidates,
and an exact approximate-matching pass decides. Everything runs in one pass over the documents
without a shuffle; the items are read in blocks of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text, without_ids, written
from lumenframe.llm.wordhash import LETTERS, SPACES, U, blocks, column, mix, seeded, words

DISTANCE = 5  # one edit for each so many words of an item
WALKS, SAMPLES = 4, 8
STRETCH = 3  # steps of a walk a word of the item
ITEM_BYTES = 16 << 20  # items handled in one pass over the documents
SEED = 9
FILTER_BITS = 20

_spaces = SPACES.copy()
_spaces[:128] = [not chr(c).isalnum() for c in range(128)]
_letters = LETTERS.copy()
_letters[0x80:0x9F] = LETTERS[0xA0:0xBF]


def run_length(n: int) -> int:
    """The least longest run of unedited words in an item of n words within its distance."""
    d = n // DISTANCE
    return -(-(n - d) // (d + 1))


def gram(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of n words that start at each place."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, U)
    for j in range(n):
        out += h[j : j + size] * U((2 * j + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
    return mix(out + U(n))


@dataclass
class Items:
    ids: list
    words: np.ndarray  # all items, one after another
    bounds: np.ndarray

    def __post_init__(self):
        self.length = np.diff(self.bounds)
        self.tables = {}
        for n in sorted({run_length(int(x)) for x in self.length if x}):
            h, item, place = [], [], []
            for i in np.flatnonzero(self.length):
                if run_length(int(self.length[i])) == n:
                    g = gram(self.words[self.bounds[i] : self.bounds[i + 1]], n)
                    h.append(g)
                    item.append(np.full(len(g), i))
                    place.append(np.arange(len(g)))
            h, item, place = np.concatenate(h), np.concatenate(item), np.concatenate(place)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << FILTER_BITS, bool)
            seen[(h >> U(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables[n] = (h[order], item[order], place[order], seen)
        rng = np.random.default_rng(SEED)
        self.longest = int(self.length.max(initial=1))
        self.samples = [np.sort(rng.random(SAMPLES)) for _ in range(WALKS)]

    def windows(self, h: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (row, item, first word) where a window shares a run with an item."""
        rows, items, starts = [], [], []
        for n, (table, item, place, seen) in self.tables.items():
            g = gram(h, n)
            at = np.flatnonzero(seen[(g >> U(64 - FILTER_BITS)).astype(np.int64)])
            at = at[doc[at] == doc[at + n - 1]]
            low, high = np.searchsorted(table, g[at]), np.searchsorted(table, g[at], side="right")
            count = high - low
            pick = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(at, count)
            rows.append(doc[at])
            items.append(item[pick])
            starts.append(np.maximum(at - place[pick], bounds[doc[at]]))
        if not rows:
            return (np.zeros(0, np.int64),) * 3
        found = np.unique(np.stack([np.concatenate(rows), np.concatenate(items), np.concatenate(starts)]), axis=1)
        return found[0], found[1], found[2]

    def walk(self, text: np.ndarray, start: np.ndarray, end: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
        """Symbols at the sampled steps of a walk over text[start:end]; 0 past the end."""
        steps = (self.samples[seed][None, :] * (STRETCH * length)[:, None] * 0.6).astype(np.int64)
        out = np.zeros((len(start), SAMPLES), U)
        at = start.copy()
        padded = np.append(text, U(0))
        for j in range(int(steps.max(initial=-1)) + 1):
            symbol = padded[np.where(at < end, at, len(text))]
            hit = steps == j
            if hit.any():
                out = np.where(hit, symbol[:, None], out)
            at = at + (seeded(symbol, 1000 * seed + j) >> U(63)).astype(np.int64)
        return out

    def candidates(self, h: np.ndarray, item: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Which windows agree with their item at a sampled place."""
        keep = np.zeros(len(item), bool)
        length = self.length[item]
        end = np.minimum(start + length, stop)
        for seed in range(WALKS):
            own, where = np.unique(item, return_inverse=True)
            of_item = self.walk(self.words, self.bounds[own], self.bounds[own + 1], self.length[own], seed)[where]
            of_text = self.walk(h, start, end, length, seed)
            keep |= ((of_item == of_text) & (of_item != 0)).any(axis=1)
        return keep

    def pattern(self, i: int) -> list[int]:
        return self.words[self.bounds[i] : self.bounds[i + 1]].tolist()


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to a part of the text, end of the first such part); bit-parallel."""
    n = len(pattern)
    masks: dict[int, int] = {}
    for i, symbol in enumerate(pattern):
        masks[symbol] = masks.get(symbol, 0) | 1 << i
    every, top = (1 << n) - 1, 1 << n - 1
    plus, minus, score = every, 0, n
    best, end = n, 0
    for j, symbol in enumerate(text, 1):
        eq = masks.get(symbol, 0)
        zero = ((eq & plus) + plus ^ plus) | eq | minus
        up, down = minus | ~(zero | plus) & every, plus & zero
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1, down << 1
        plus, minus = (down | ~(zero | up)) & every, up & zero & every
        if score < best:
            best, end = score, j
    return best, end


FOUND = "doc_id long, item_id long, distance int, n_words int, start long, end long"


def _leaks(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = words(column(batch, "text"), _letters, _spaces)
            rows, item, start = items.windows(w.hash, w.doc(), w.bounds)
            keep = items.candidates(w.hash, item, start, w.bounds[rows + 1])
            rows, item, start = rows[keep], item[keep], start[keep]
            best: dict[tuple[int, int], tuple[int, int, int]] = {}
            for r, i, s in zip(rows.tolist(), item.tolist(), start.tolist(), strict=True):
                n = int(items.length[i])
                most = n // DISTANCE
                if best.get((r, i), (most + 1,))[0] == 0:
                    continue
                a, b = max(int(w.bounds[r]), s - most), min(int(w.bounds[r + 1]), s + n + most)
                distance, end = best_match(items.pattern(i), w.hash[a:b].tolist())
                if distance <= most and distance < best.get((r, i), (most + 1,))[0]:
                    back = best_match(items.pattern(i)[::-1], w.hash[a : a + end][::-1].tolist())[1]
                    best[r, i] = (distance, a + end - back, a + end)
            out = []
            for (r, i), (distance, a, b) in sorted(best.items()):
                offset = int(w.offsets[r])
                before = lambda to: len(w.data[offset:to].tobytes().decode())  # noqa: B023, E731
                out.append((column(batch, "doc_id")[r].as_py(), items.ids[i], distance, int(items.length[i]), before(int(w.first[a])), before(int(w.last[b - 1]))))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            names = ["doc_id", "item_id", "distance", "n_words", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)

    return run


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Items in blocks of at most ITEM_BYTES of text, streamed to the driver one block at a time."""
    ids, texts, size = [], [], 0

    def made() -> Items:
        w = words(pa.array(texts, pa.string()), _letters, _spaces)
        return Items(list(ids), w.hash, w.bounds)

    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += len(r["text"])
        if size > ITEM_BYTES:
            yield made()
            ids, texts, size = [], [], 0
    if ids:
        yield made()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, n_words, start, end) of every item that leaks into a document, by its nearest window.

    ``start`` and ``end`` are code points of the window. Null and empty texts, items without words
    and null item ids have no leaks; a null doc_id is kept; repeated rows are reported each; other
    columns are ignored; an empty table on either side gives an empty result.
    """
    docs = id_and_text(docs)
    parts = [docs.mapInArrow(_leaks(items), FOUND) for items in item_blocks(benchmark)]
    if len(parts) == 1:
        return parts[0]
    out = docs.sparkSession.createDataFrame([], FOUND)
    for p in parts:
        out = out.unionByName(written(p, "leaks"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id has a leak; rows with a null id stay."""
    return without_ids(docs, leaks(docs, benchmark).where("doc_id is not null").select("doc_id").distinct())
