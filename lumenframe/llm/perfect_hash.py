"""Minimal perfect hash by levels of collision-free bits, with fingerprints that refuse foreign keys."""

from __future__ import annotations

import numpy as np

from lumenframe.llm.wordhash import U, seeded

GAMMA = 2  # bits a remaining key at each level


class PerfectHash:
    """Maps ``n`` distinct uint64 keys to 0..n-1 in expected constant time."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = [np.concatenate([[0], np.cumsum(x, dtype=np.int64)]) for x in levels]
        self.base = np.concatenate([[0], np.cumsum([b[-1] for b in self.before])]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        levels, rest = [], keys
        while len(rest):
            size = max(64, -(-GAMMA * len(rest) // 64) * 64)
            at = (seeded(rest, len(levels)) % U(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            levels.append(bits)
            rest = rest[~bits[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 if no level holds it. A foreign key may get a slot: compare its fingerprint."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            at = (seeded(keys[open_], level) % U(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.base[level] + self.before[level][at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u8")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n = int(np.frombuffer(data, "<u8", 1)[0])
        sizes, at, levels = np.frombuffer(data, "<u8", n, 8), 8 + 8 * n, []
        for size in map(int, sizes):
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size // 8, at)).astype(bool))
            at += size // 8
        return cls(levels)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (seeded(keys, 1000) >> U(32)).astype("<u4")
