"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of ASCII letters and digits and of all bytes above 127 of the UTF-8 text; ASCII letters are
lower-cased. A text of fewer words than a shingle has one shingle of all its words, a text without words none.
Hashes depend on nothing but the words, so recomputed tasks agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled together up to about this many bytes, which bounds the arrays of a task.
CHUNK_BYTES = 256_000

_BYTE = np.arange(256)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_IS_WORD = ((_BYTE >= 48) & (_BYTE <= 57)) | ((_LOWER >= 97) & (_LOWER <= 122)) | (_BYTE >= 128)
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
_OF_BYTE = (_RANDOM.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_OF_PLACE = (_RANDOM.integers(1, 2**63, 4096, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_VALUE = np.where(_IS_WORD, _OF_BYTE[_LOWER], np.uint64(0))


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of SplitMix64: every bit of the input moves every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, offsets) of consecutive texts; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, number of the first word of each text, with the total at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = _IS_WORD[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    place = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(starts, append=len(data)))
    values = _VALUE[data[starts[0] :]] * _OF_PLACE[place & 4095]
    # a word longer than the table of places: its later rounds are told apart by their number
    if (late := place > 4095).any():
        values[late] *= mix((place[late] >> 12).astype(np.uint64)) | np.uint64(1)
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    return hashes, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of n words, number of the first run of each text, with the total at the end)."""
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    start = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(start[-1]) + np.repeat(first[:-1] - start[:-1], size)
    length = np.repeat(np.minimum(count, n), size)
    out = length.astype(np.uint64)
    for k in range(n):
        word = hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] if len(hashes) else hashes[at]
        out = np.where(k < length, mix(out ^ word) + np.uint64(k), out)
    return out, start
