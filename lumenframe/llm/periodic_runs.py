"""Runs of words that repeat with a period (op 11), found by probing a harmonic grid.

A run of period p and at least 2 * p words holds two neighbouring points j * p and (j + 1) * p of
the grid of p, so words are compared there only: n / p probes for each p, n log n for a text.
Pairs that are equal grow to both sides by comparing chunks of twice the size each round; those of
one period that meet become one. Periods go by bands [P, 2P): a pair that lies within a run of a
divisor of its period, found in an earlier band, is passed over, and so is any longer period of the
same run. Words count as equal when their 64-bit hashes are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import id_and_text
from lumenframe.llm.wordhash import CASED, blocks, column, words

LEAST = 12
FIRST_CHUNK = 8
CELLS = 1 << 20  # words compared at once
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_DDL = "struct<start:bigint,length:bigint,period:bigint>"


def ranges(each: np.ndarray) -> np.ndarray:
    """0, 1, ... below each count, one after the other."""
    end = np.cumsum(each)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - each, each)


def inside(found: np.ndarray, low: np.ndarray, band: int, span: int) -> np.ndarray:
    """Keys period * span + place of the grid pairs that lie within found runs (start, end, period, text) of a divisor of their period."""
    start, end, q, text = found
    first = -(-band // q)
    each = np.maximum(np.minimum((2 * band - 1) // q, (end - start - 1) // q) - first + 1, 0)
    run = np.repeat(np.arange(len(q)), each)
    p = (first[run] + ranges(each)) * q[run]
    base = low[text[run]]
    at = base - (base - start[run]) // p * p
    pairs = np.maximum(-(-(end[run] - p - at) // p), 0)
    return np.repeat(p * span + at, pairs) + ranges(pairs) * np.repeat(p, pairs)


def matched(codes: np.ndarray, at: np.ndarray, p: np.ndarray, room: np.ndarray, chunk: int, step: int) -> np.ndarray:
    """How many of the next ``chunk`` words, from ``at`` by ``step``, equal those ``p`` further on."""
    out = np.empty(len(at), np.int64)
    rows = max(1, CELLS // chunk)
    for i in range(0, len(at), rows):
        part = slice(i, i + rows)
        off = np.arange(chunk)
        ok = off < room[part, None]
        where = np.where(ok, at[part, None] + step * off, 0)
        same = ok & (codes[where] == codes[np.where(ok, where + p[part, None], 0)])
        out[part] = np.where(same.all(1), chunk, same.argmin(1))
    return out


def stretches(codes: np.ndarray, at: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> np.ndarray:
    """Maximal stretches (first, end, period, low) of places that equal those a period further on, for pairs in order of period and place; those too short for a run are left out early."""
    span = len(codes) + 1
    x, y = at.copy(), at + 1
    left, right = np.ones(len(at), bool), np.ones(len(at), bool)
    done, chunk = [], FIRST_CHUNK
    while len(x):
        go = np.flatnonzero(right)
        k = matched(codes, y[go], p[go], high[go] - p[go] - y[go], chunk, 1)
        y[go] += k
        right[go] = k == chunk
        go = np.flatnonzero(left)
        k = matched(codes, x[go] - 1, p[go], x[go] - low[go], chunk, -1)
        x[go] -= k
        left[go] = k == chunk
        ends = ~left & ~right
        keep = ~ends | (y - x >= np.maximum(p, least - p))
        x, y, p, low, high, left, right = (v[keep] for v in (x, y, p, low, high, left, right))
        if not len(x):
            break
        order = np.argsort(p * span + x, kind="stable")  # growing to the left may change the order
        x, y, p, low, high, left, right = (v[order] for v in (x, y, p, low, high, left, right))
        reach = np.maximum.accumulate(p * span + y)
        heads = np.flatnonzero(np.concatenate([[True], p[1:] * span + x[1:] > reach[:-1]]))
        y = np.maximum.reduceat(y, heads)
        left, right = np.logical_and.reduceat(left, heads), np.logical_and.reduceat(right, heads)
        x, p, low, high = x[heads], p[heads], low[heads], high[heads]
        ends = ~left & ~right
        done.append(np.stack([x[ends], y[ends], p[ends], low[ends]]))
        x, y, p, low, high, left, right = (v[~ends] for v in (x, y, p, low, high, left, right))
        chunk *= 2
    return np.concatenate([np.zeros((4, 0), np.int64), *done], axis=1)


def find_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """All runs of a block of texts: rows start, end (places in ``codes``), period and text, in order of start and period.

    ``codes[bounds[d]:bounds[d + 1]]`` are the words of text ``d``. A run is a stretch of smallest
    period p, of at least ``least`` and 2 * p words, that no neighbouring word extends.
    """
    n = np.diff(bounds)
    span = len(codes) + 1
    found, band = np.zeros((4, 0), np.int64), 1
    while len(texts := np.flatnonzero(n >= max(2 * band, least))):
        each = np.minimum(2 * band - 1, n[texts] // 2) - band + 1
        text = np.repeat(texts, each)
        p = band + ranges(each)
        pairs = (n[text] - 1) // p
        place = np.repeat(bounds[text], pairs) + ranges(pairs) * (period := np.repeat(p, pairs))
        hit = np.flatnonzero(codes[place] == codes[place + period])
        if found.shape[1]:
            hit = hit[~np.isin(period[hit] * span + place[hit], inside(found, bounds, band, span))]
        place, period, text = place[hit], period[hit], np.repeat(text, pairs)[hit]
        order = np.argsort(period * span + place, kind="stable")
        place, period, text = place[order], period[order], text[order]
        x, y, p, low = stretches(codes, place, period, bounds[text], bounds[text + 1], least)
        keep = (y - x >= p) & (y - x + p >= least)
        x, y, p = x[keep], y[keep], p[keep]
        found = np.concatenate([found, np.stack([x, y + p, p, np.searchsorted(bounds, x, "right") - 1])], axis=1)
        band *= 2
    return found[:, np.lexsort((found[2], found[0]))]


def text_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches):
        texts = column(batch, "text")
        w = words(texts, CASED)
        start, end, p, text = find_runs(w.hash, w.bounds, least)
        own = pa.StructArray.from_arrays([pa.array(start - w.bounds[text]), pa.array(end - start), pa.array(p)], fields=list(RUN))
        cuts = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        change = np.zeros(len(w.hash) + 1, np.int64)
        np.add.at(change, start + p, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change)[:-1] == 0
        collapsed = []
        for d, value in enumerate(texts):
            parts = value.as_buffer().to_pybytes().split()
            mine = kept[w.bounds[d] : w.bounds[d + 1]]
            collapsed.append(b" ".join(parts if mine.all() else [parts[i] for i in np.flatnonzero(mine).tolist()]))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "doc_id"), pa.ListArray.from_arrays(cuts, own), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"]
        )


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: doc_id, its ``runs`` and the text ``collapsed``.

    Words are runs of other characters than space and 0x09-0x0D, and numbered from 0; letters count
    with their case. ``runs`` lists start, length and period of every run, by start and period;
    ``collapsed`` joins by one space the words that no run holds after its first period. Null text
    counts as empty and has no run; rows are independent, so repeated rows and ids give a row each
    and a null id stays null; other columns are ignored; an empty table gives no rows.
    """
    return id_and_text(docs).mapInArrow(lambda it: text_runs(it, least), f"doc_id long, runs array<{RUN_DDL}>, collapsed string")


def with_planted_tails(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` where every tenth text by the hash h of its id repeats a stretch of its words to its end.

    With h = crc32 of the id in decimals (a null id counts as empty text) and g = h // 10, texts of
    n > 0 words with h % 10 = 0 get word a + (i - a) % p for each word i >= a, where a = g % n and
    p = 1 + (n - a) // (3 + g % 8); their words are then joined by one space. Others stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = column(batch, "text")
            hashed = [zlib.crc32(b"" if i is None else str(i).encode()) for i in column(batch, "doc_id").to_pylist()]
            new = {}
            for d in (d for d, h in enumerate(hashed) if h % 10 == 0):
                parts, g = texts[d].as_buffer().to_pybytes().split(), hashed[d] // 10
                if n := len(parts):
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    cycle = parts[a : a + p]
                    new[d] = b" ".join(parts[:a] + cycle * ((n - a) // p) + cycle[: (n - a) % p]).decode()
            if new:
                texts = pa.array([new.get(d, t) for d, t in enumerate(texts.to_pylist())], texts.type)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), texts], ["doc_id", "text"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, text string")


def digest(found: DataFrame) -> DataFrame:
    """Per row of ``periodic_runs``: number of runs, the longest one (ties: smallest start, then period), hashes of the runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    length, period = best["length"], -best["short"]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-best["back"]).alias("start"), length.alias("length"), period.alias("period"),
        F.call_function("div", F.lit(1000) * length, period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
