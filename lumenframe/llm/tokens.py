"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once a worker.

A text is cut at places where the pre-tokenizers in use cut anyway, so the ids of the text are
those of its pieces in order: before a letter-ended word's punctuation for both kinds; for
byte-level vocabularies also before a space between two other characters (it starts the next
piece) and around such a newline; for word vocabularies at every space or newline, which are
dropped. Cuts, piece hashes, look-ups and the gathering of ids are NumPy passes over a block;
only pieces not met before go to the library. The table of known pieces keeps 64-bit hashes and
ids, no strings, so that a worker holds it from task to task in a few tens of megabytes; it
starts anew when it is full. Pieces over LONG bytes are encoded each time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lumenframe.llm.wordhash import LETTERS, U, blocks, column, mix, prefix_sums, raw, release

TABLE_BITS = 21
KNOWN_PIECES = 1_200_000
LONG = 64
JOINED = 50  # pieces in one text for the library
_encoders: dict[tuple[str, bool], "Encoder"] = {}
SPACE = re.compile(r"\s")
_cased = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123)]] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in ',.;:!?)"']] = True


class Table:
    """Open addressing from piece hashes to runs of ids."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits, self.n, self.used = bits, 0, 0
        self.keys = np.zeros(1 << bits, U)
        self.start, self.count = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint32)
        self.ids = np.zeros(1 << 18, "<u4")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of hashes, -1 for unknown ones."""
        slot = (h >> U(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, slot, -1)
        open_ = np.flatnonzero((key != h) & (key != 0))
        slot, h = slot[open_], h[open_]
        while len(open_):
            slot = slot + 1 & (1 << self.bits) - 1
            key = self.keys[slot]
            hit = key == h
            out[open_[hit]] = slot[hit]
            go = ~hit & (key != 0)
            open_, slot, h = open_[go], slot[go], h[go]
        return out

    def add(self, h: np.ndarray, runs: list[np.ndarray]) -> None:
        """New distinct hashes with their ids."""
        count = np.array([len(r) for r in runs], np.int64)
        need = self.used + int(count.sum())
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(need, 2 * self.used) - self.used, "<u4")])
        self.ids[self.used : need] = np.concatenate([*runs, np.zeros(0, "<u4")])
        start, slot = self.used + np.cumsum(count) - count, (h >> U(64 - self.bits)).astype(np.int64)
        self.used, self.n = need, self.n + len(h)
        open_ = np.arange(len(h))
        while len(open_):
            at = slot[open_]
            _, first = np.unique(at, return_index=True)
            won = first[self.keys[at[first]] == 0]
            self.keys[at[won]] = h[open_[won]]
            self.start[at[won]], self.count[at[won]] = start[open_[won]], count[open_[won]]
            open_ = np.delete(open_, won)
            slot[open_] = slot[open_] + 1 & (1 << self.bits) - 1


def white(data: np.ndarray) -> np.ndarray:
    """Bytes of white space and control characters, also those of more than one byte."""
    out = data <= 0x20
    n = len(data)
    for lead, width, second, third in (
        (0xC2, 2, (0x85, 0xA0), None),
        (0xE1, 3, (0x9A,), (0x80,)),
        (0xE2, 3, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)),
        (0xE2, 3, (0x81,), (0x9F,)),
        (0xE3, 3, (0x80,), (0x80,)),
    ):
        at = np.flatnonzero(data == lead)
        at = at[at + width <= n]
        at = at[np.isin(data[at + 1], second)]
        if third is not None:
            at = at[np.isin(data[at + 2], third)]
        for i in range(width):
            out[at + i] = True
    return out


class Encoder:
    def __init__(self, path: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.tokenizer = Tokenizer.from_file(path)
        release()  # what reading the file took
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.by_word = by_word
        self.table = Table()
        self.letters = LETTERS if by_word else _cased
        self.mark = "|" if by_word else "\n"
        (self.mark_id,) = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # each piece reaches the library once
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.shown = {c: "".join(shown[b] for b in (chr(c).lower() if by_word else chr(c)).encode()) for c in range(256)}

    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end, bounds by row) of the pieces of a block of texts."""
        n = len(data)
        starts = np.zeros(n + 1, bool)
        starts[offsets] = True
        inner = ~starts[1:n]  # byte i + 1 is of the same text as byte i
        after = np.zeros(n, bool)  # punctuation just after a letter
        after[1:] = _mark[data[1:]] & _letter[data[:-1]] & inner
        if self.by_word:
            solid = (data != 32) & (data != 10)
            begin, end = solid.copy(), solid.copy()
            begin[1:] &= ~(solid[:-1] & inner) | after[1:]
            end[:-1] &= ~(solid[1:] & inner) | after[1:]
            first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
        else:
            space, alone = white(data), np.zeros(n, bool)
            alone[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~space[:-2] & ~space[2:] & inner[:-1] & inner[1:]
            begin = alone | after | starts[:n]
            begin[1:] |= alone[:-1] & (data[:-1] == 10)
            first = np.flatnonzero(begin)
            last = np.append(first[1:], n) if len(first) else first
        return first, last, np.searchsorted(first, offsets)

    def library(self, new: list[str]) -> list[np.ndarray]:
        """Ids of pieces: single words of letters up to U+00FF, which every pattern keeps whole, by the model; others as texts, many in one."""
        out: list = [None] * len(new)
        joined, alone, shown, tokenize = [], [], self.shown, self.model.tokenize
        for i, p in enumerate(new):
            word = p[1:] if p[:1] == " " else p
            if word.isalpha() and max(word) <= "\xff":
                out[i] = np.array([t.id for t in tokenize(p.translate(shown))], "<u4")
            elif not word or self.mark in p or SPACE.search(word):
                alone.append(i)
            else:
                joined.append(i)
        mark = " | " if self.by_word else "\n"
        runs = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        found = self.tokenizer.encode_batch_fast([mark.join(new[i] for i in r) for r in runs] + [new[i] for i in alone], add_special_tokens=False)
        for r, e in zip(runs, found):
            ids = np.array(e.ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark_id)
            assert len(cuts) == len(r) - 1
            for i, a, b in zip(r, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True):
                out[i] = ids[a:b]
        for i, e in zip(alone, found[len(runs) :], strict=True):
            out[i] = np.array(e.ids, "<u4")
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin and end."""
        data, offsets = raw(texts)
        first, last, bounds = self.pieces(data, offsets)
        if not len(first):
            return np.zeros(0, "<u4"), np.zeros(len(bounds), np.int64)
        sums, inverse = prefix_sums(data, self.letters)
        h = np.maximum(mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(U)), U(1))
        text = lambda i: data[first[i] : last[i]].tobytes().decode()
        long = np.flatnonzero(last - first > LONG)
        h[long] = 0
        slot = self.table.find(h)
        slot[long] = -1
        h[long] = U(1) << U(63)
        missing = np.setdiff1d(np.flatnonzero(slot < 0), long)
        if len(missing):
            new, at = np.unique(h[missing], return_index=True)
            if self.table.n + len(new) > KNOWN_PIECES and self.table.n:
                missing = np.setdiff1d(np.arange(len(h)), long)
                new, at = np.unique(h[missing], return_index=True)
                self.table = Table(max(TABLE_BITS, len(new).bit_length() + 1))
            elif 2 * len(new) > len(self.table.keys):
                self.table = Table(len(new).bit_length() + 1)
            self.table.add(new, self.library([text(i) for i in missing[at].tolist()]))
            slot[missing] = self.table.find(h[missing])
        start, count = self.table.start[slot].astype(np.int64), self.table.count[slot].astype(np.int64)
        known = self.table.ids
        if len(long):
            runs = self.library([text(i) for i in long.tolist()])
            count[long] = [len(r) for r in runs]
            start[long] = self.table.used + np.cumsum(count[long]) - count[long]
            known = np.concatenate([known[: self.table.used], *runs])
        end = np.cumsum(count)
        ids = known[np.repeat(start - end + count, count) + np.arange(end[-1])]
        return ids, np.concatenate([[0], end])[bounds]


def encoder(path: str, by_word: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file: a path, or the bare name of a file of the public tokenizers as this worker has them."""
    key = (path, by_word)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, by_word: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with the ids of their texts, each followed by ``end_id``, and where each row's ids begin and end."""
    for batch in blocks(batches):
        ids, bounds = encoder(path, by_word).encode(column(batch, "text"))
        yield batch, np.insert(ids, bounds[1:], end_id).astype("<u4"), bounds + np.arange(len(bounds))
