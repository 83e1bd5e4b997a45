"""Minimal perfect hash over 64-bit keys, built and probed in numpy.

Level by level, each key left sets a bit of a bit array; keys alone on their
bit stay there, the others go on to the next level. The number of set bits
before a key's bit, over all levels, is its place: n keys get the places
0 to n - 1 at about four bits a key.
"""

from __future__ import annotations

import numpy as np

LOAD = 1.7
LEVELS = 48


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) with a seed."""
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray]):
        """levels: of each, the bits packed into bytes; all have whole words of 64 bits."""
        self.levels = levels
        self.before: list[np.ndarray] = []
        base = 0
        for bits in levels:
            ones = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64)
            ends = np.cumsum(ones)
            self.before.append(base + ends - ones)
            base += int(ends[-1]) if len(ends) else 0
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct uint64."""
        levels: list[np.ndarray] = []
        left = keys
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, -(-int(len(left) * LOAD) // 64) * 64)
            place = (mix(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[place]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Of each key its place; of a key that wasn't built in, any place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = (mix(keys[left], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            word = bits.view(np.uint64)[place >> 6]
            bit = (place & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[here]] = (self.before[level][place >> 6] + np.bitwise_count(lower))[here]
            left = left[~here]
        return out

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes(), *(x.tobytes() for x in self.levels)])

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        sizes = np.frombuffer(data, np.int64, n, 8)
        at, levels = 8 * (n + 1), []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, int(size), at))
            at += int(size)
        return cls(levels)
