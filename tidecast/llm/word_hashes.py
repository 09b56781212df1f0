"""64-bit hashes of all words of a batch of texts at once, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

MIX1, MIX2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX1
    h = h ^ (h >> np.uint64(29))
    h = h * MIX2
    return h ^ (h >> np.uint64(32))


def text_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts in turn, where each text starts, and the end); a null text has none."""
    text = text.cast(pa.large_string())
    bounds = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    raw = text.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, bounds - bounds[0]


def word_bounds(solid: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs where ``solid``; a run ends where its text ends."""
    n = len(solid)
    padded = np.zeros(n + 2, dtype=bool)
    padded[1:-1] = solid
    edge = np.zeros(n + 1, dtype=bool)
    edge[bounds] = True
    starts = np.flatnonzero(solid & (edge[:-1] | ~padded[:-2]))
    ends = np.flatnonzero(solid & (edge[1:] | ~padded[2:])) + 1
    return starts, ends


class ByteHasher:
    """Polynomial hash over random values of bytes: a word's hash is the difference
    of two running sums, taken back to the word's start, and mixed with its length."""

    def __init__(self, seed: int = 20_011):
        self.values = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.unpower = np.ones(1, dtype=np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(data):
            def powers(base):
                steps = np.full(len(data) + len(data) // 8 + 1, base, dtype=np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)
            self.power, self.unpower = powers(self.base), powers(self.inverse)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.power[:len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.unpower[starts] + (ends - starts).astype(np.uint64))
