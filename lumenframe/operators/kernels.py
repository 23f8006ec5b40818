"""Small array helpers that run on one line or tile of an image at a time, in Arrow batches that Spark deals out."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LINE = "array<struct<at:int,g:double>>"


def envelope(at: np.ndarray, g: np.ndarray, w: float) -> np.ndarray:
    """Least of g + w (at - at')² over the places at' whose g is a number, at each place: the lower envelope of parabolas, each put on a stack and taken off once."""
    sites = np.flatnonzero(~np.isnan(g))
    if not len(sites):
        return np.full(len(at), np.nan)
    p, h = at[sites].astype(float), g[sites]
    key = (h + w * p * p).tolist()
    place, stack, start = p.tolist(), [0], [-np.inf]
    for q in range(1, len(place)):
        while True:
            top = stack[-1]
            meet = (key[q] - key[top]) / (2 * w * (place[q] - place[top]))
            if meet > start[-1] or len(stack) == 1:
                break
            stack.pop()
            start.pop()
        if meet <= start[-1]:
            stack[-1], start[-1] = q, -np.inf
        else:
            stack.append(q)
            start.append(meet)
    own = np.array(stack)[np.searchsorted(start, at, side="left") - 1]
    return h[own] + w * (at - p[own]) ** 2


def envelopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``envelope`` of each row's ``line`` with its weight ``w``: (at, g) becomes (at, least)."""
    for batch in batches:
        line, weight = batch.column(batch.schema.get_field_index("line")), batch.column(batch.schema.get_field_index("w")).to_pylist()
        flat = line.flatten()
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in line])]).astype(np.int32)
        at, g = flat.field("at").to_numpy(), flat.field("g").to_numpy(zero_copy_only=False)
        out = np.full(len(at), np.nan)
        for a, b, w in zip(cuts[:-1].tolist(), cuts[1:].tolist(), weight, strict=True):
            order = a + np.argsort(at[a:b], kind="stable")
            out[order] = envelope(at[order], g[order], w)
        value = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(out, mask=np.isnan(out))], ["at", "g"])
        yield batch.set_column(batch.schema.get_field_index("line"), "line", pa.ListArray.from_arrays(cuts, value))


def flood(cells: pa.Table, offers: pa.Table, moves: list[tuple[int, int, int]]) -> tuple[list, list[tuple[int, int, int, int]]]:
    """Best path (pass, steps, label) to each cell of a tile, and the (cell, neighbour) pairs that lead out of it.

    A cell's path is the least of its neighbours' paths taken one step on, over the higher of their pass
    and its own elevation; markers are where paths begin. Cells leave the queue in the order of
    their paths, so each is settled once. ``offers`` are paths that come in from other tiles.
    """
    z, y, x, e, marker = (cells.column(c).to_pylist() for c in ("z", "y", "x", "e", "label"))
    index = {p: i for i, p in enumerate(zip(z, y, x, strict=True))}
    best: list = [None] * len(e)
    queue = [(e[i], 0, m, i) for i, m in enumerate(marker) if m is not None]
    for oz, oy, ox, top, steps, label in zip(*(offers.column(c).to_pylist() for c in ("z", "y", "x", "pass", "steps", "label")), strict=True):
        i = index.get((oz, oy, ox))
        if i is not None and marker[i] is None:
            queue.append((max(top, e[i]), steps + 1, label, i))
    heapq.heapify(queue)
    out = []
    while queue:
        top, steps, label, i = heapq.heappop(queue)
        if best[i] is not None:
            continue
        best[i] = (top, steps, label)
        for dz, dy, dx in moves:
            to = (z[i] + dz, y[i] + dy, x[i] + dx)
            j = index.get(to)
            if j is None:
                out.append((i, *to))
            elif best[j] is None and marker[j] is None:
                heapq.heappush(queue, (max(top, e[j]), steps + 1, label, j))
    return best, out
