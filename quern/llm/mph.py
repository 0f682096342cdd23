"""A minimal perfect hash over 64-bit keys, in levels of bit arrays, made and asked in whole arrays."""

from __future__ import annotations

import numpy as np

#: Bits per key and level; levels before the few keys left are listed.
SPREAD, LEVELS = 2.0, 24
_SEEDS = [np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & 0xFFFFFFFFFFFFFFFF) for i in range(LEVELS + 1)]


def mix(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64) ^ seed
    for multiplier, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(multiplier)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct keys one to one onto 0 to n - 1. Other keys get some slot or -1: compare a stored fingerprint."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.ranks = np.cumsum(bits, dtype=np.int64) - bits

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """Each level takes the keys that have a bit of it to themselves; the next level takes the others."""
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two keys are equal: no function maps them one to one")
        sizes, levels, left = [], [], keys.astype(np.uint64)
        while len(left) and len(levels) < LEVELS:
            size = int(SPREAD * len(left)) + 1
            spot = (mix(left, _SEEDS[len(levels)]) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(spot, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            sizes.append(size)
            left = left[~alone[spot]]
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        return cls(np.array(sizes, np.int64), bits, np.sort(left))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            spot = (mix(keys[left], _SEEDS[level]) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[spot] == 1
            out[left[hit]] = self.ranks[spot[hit]]
            left = left[~hit]
            if not len(left):
                break
        if len(left) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
            same = self.rest[at] == keys[left]
            out[left[same]] = int(self.bits.sum()) + at[same]
        return out

    def to_bytes(self) -> bytes:
        """Level sizes, packed bits and the listed keys."""
        head = np.array([len(self.sizes), len(self.bits), len(self.rest)], "<i8")
        parts = (head, self.sizes.astype("<i8"), np.packbits(self.bits), self.rest.astype("<u8"))
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        levels, n_bits, n_rest = np.frombuffer(raw, "<i8", 3).tolist()
        sizes = np.frombuffer(raw, "<i8", levels, 24)
        packed = (n_bits + 7) // 8
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, packed, 24 + 8 * levels), count=n_bits)
        return cls(sizes, bits, np.frombuffer(raw, "<u8", n_rest, 24 + 8 * levels + packed))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits that tell a stored key from others in its slot."""
    return (mix(keys, _SEEDS[LEVELS]) >> np.uint64(32)).astype(np.uint32)
