"""A minimal perfect hash over distinct 128-bit keys, built and probed with numpy.

Level by level, keys are hashed to bits; a key alone on its bit is placed there, the others go on to the next level. A
key's index is the number of set bits before its own. About three bits a key.
"""

from __future__ import annotations

import numpy as np

from callscope.llm.textops import mix

#: Bits per key still to be placed.
ROOM = 2.0


def _slots(hi: np.ndarray, lo: np.ndarray, level: int, bits: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    return (mix(hi ^ mix(lo + salt)) % np.uint64(bits)).astype(np.int64)


def build(hi: np.ndarray, lo: np.ndarray) -> tuple[list[int], bytes]:
    """(bits of each level, all levels' bits packed) for distinct keys."""
    sizes, parts, level = [], [], 0
    while len(hi):
        bits = max(64, int(ROOM * len(hi)))
        slot = _slots(hi, lo, level, bits)
        alone = np.bincount(slot, minlength=bits) == 1
        parts.append(alone)
        sizes.append(bits)
        rest = ~alone[slot]
        hi, lo, level = hi[rest], lo[rest], level + 1
    return sizes, np.packbits(np.concatenate(parts)).tobytes() if parts else b""


class PerfectHash:
    def __init__(self, sizes: list[int], packed: bytes):
        self.sizes = sizes
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.bits) - self.bits

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The index of each key; a key outside the set gets -1 or another key's index."""
        out = np.full(len(hi), -1, np.int64)
        todo, base = np.arange(len(hi)), 0
        for level, bits in enumerate(self.sizes):
            slot = _slots(hi[todo], lo[todo], level, bits) + base
            hit = self.bits[slot]
            out[todo[hit]] = self.rank[slot[hit]]
            todo, base = todo[~hit], base + bits
            if not len(todo):
                break
        return out
