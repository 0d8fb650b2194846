"""Words of whole texts, ``[^\\x20\\x09-\\x0D]+``, as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the one behind its last."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~WHITE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def coded(data: bytes | np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each run of ``size`` bytes of ``data``, end to end: equal runs, compared byte by byte, have equal numbers.

    Numbers follow first occurrence; the distinct runs stand in their order beside.
    """
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    runs = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data) if isinstance(data, np.ndarray) else data)])
    found = runs.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """``coded`` for the words of ``word_bounds``."""
    return coded(data[~WHITE[data]], end - start)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash (XXH3) of each word; the distinct words of ``data`` are hashed once each."""
    if not len(start):
        return np.zeros(0, np.uint64)
    code, distinct = word_codes(data, start, end)
    return hashed(distinct.to_pylist())[code]


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_marks(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits that equal words share, eight bytes of all words at a time: good to deal words out, not to tell them apart."""
    lanes = np.ndarray((len(data),), "<u8", np.append(data, np.zeros(8, np.uint8)).tobytes(), strides=(1,))
    size = end - start
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    out, left = size.astype(np.uint64), np.arange(len(start))
    at = 0
    while len(left):
        lane = lanes[start[left] + at] & masks[np.minimum(size[left] - at, 8)]
        h = (out[left] ^ lane) * STEP
        out[left] = h ^ (h >> np.uint64(29))
        at += 8
        left = left[size[left] > at]
    return (out ^ (out >> np.uint64(32))) * MIX


def run_hashes(units: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` hashes; every step multiplies and mixes, so no sum of powers cancels."""
    if len(units) < size:
        return np.zeros(0, np.uint64)
    n = len(units) - size + 1
    out = units[:n]
    for i in range(1, size):
        out = (out ^ (out >> np.uint64(32))) * STEP + units[i : i + n]
    out = (out ^ (out >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(29))


def joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts with a line feed behind each, and where each one ends."""
    return b"\n".join(texts) + b"\n", np.cumsum([len(t) + 1 for t in texts])
