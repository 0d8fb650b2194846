"""Byte-level substring dedup: shard Burrows-Wheeler transforms, merged by refining their interleave.

What carries a shared minimiser (see ``repeats``) comes together as strings. They are cut into shards, and of each
only its transform and its suffix order go on. The merge starts with the shards' rows one behind another in one
interval. A row's front extension follows from the transform alone: the count of its symbol above it, behind the rows
of lesser symbols. Every step brings each row's symbols (two bytes at once) before the interval it lies in, so that
after h bytes the intervals are those of equal first h bytes over all shards together; no suffix is compared or sorted
again. Where a boundary first parts a row from all others is the length of its longest common prefix with any other
row. Rows alone in their interval leave; what is left after a window's length are the repeated intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .repeats import Chunk, Method, beside_columns, rolling, shared_windows, sliding_min

WINDOW, GRAM = 50, 24
SHARD_BYTES = 1 << 19
#: Never part of UTF-8, so it ends a string.
END = 0xFF


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text in the order of the (cyclic) ``depth`` bytes from there; eight bytes at a time, ties alone again."""
    n = len(text)
    around = np.concatenate([text, np.resize(text, 8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | around[i : i + n]
    order = np.argsort(key)
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    for at in range(8, depth, 8):
        group = np.cumsum(head)
        alone = head & np.append(head[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        following, own = key[(order[tied] + at) % n], group[tied]
        turn = np.lexsort((following, own))
        order[tied] = order[tied][turn]
        following = following[turn]
        new = np.ones(len(tied), bool)
        new[1:] = (following[1:] != following[:-1]) | (own[1:] != own[:-1])
        head[tied] = new
    return order


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and Burrows-Wheeler transform."""
    order = suffix_order(text, depth).astype(np.int32)
    return order, text[order - 1]


def front_extensions(symbols: np.ndarray) -> np.ndarray:
    """The row that each row of a transform has as its extension by its symbol: counted, from the symbols alone."""
    turn = np.argsort(symbols, kind="stable")
    out = np.empty(len(symbols), np.int32)
    out[turn] = np.arange(len(symbols), dtype=np.int32)
    return out


def merged(transforms: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (of the transforms end to end) in intervals of equal next ``window`` bytes, where each begins, and common prefixes.

    The last holds for every row how many bytes at its front another row shares, up to ``window``; it is counted in
    steps of two bytes, so it may be one too low where it is under ``window``.
    """
    base = np.cumsum([0, *(len(t) for t in transforms)], dtype=np.int32)
    before = np.concatenate(transforms)
    extension = np.concatenate([front_extensions(t) + b for t, b in zip(transforms, base, strict=False)])
    # two bytes a step: what stands before the byte before, and the extension's extension
    ended = before == END
    twice = (before[extension].astype(np.uint16) << 8) | before
    either, farther = ended | ended[extension], extension[extension]
    common = np.zeros(len(before), np.uint8)
    rows, interval, length = np.arange(len(before), dtype=np.int32), np.zeros(len(before), np.int32), 0
    for step in [2] * (window // 2) + [1] * (window % 2):
        symbol, over, to = (twice, either, farther) if step == 2 else (before, ended, extension)
        rows_in = ~over[rows]
        rows, interval = rows[rows_in], interval[rows_in]
        key = symbol[rows]
        turn = np.argsort(key, kind="stable")
        key, interval, rows = key[turn], interval[turn], to[rows[turn]]
        head = np.ones(len(rows), bool)
        head[1:] = (key[1:] != key[:-1]) | (interval[1:] != interval[:-1])
        stay = ~(head & np.append(head[1:], True))
        interval = np.cumsum(head, dtype=np.int32)[stay]
        rows = rows[stay]
        length += step
        common[rows] = length
        if not len(rows):
            break
    return rows, np.flatnonzero(np.diff(interval, prepend=-1)), common


def repeated_intervals(shards: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in the shards end to end) whose next ``window`` bytes stand elsewhere too, interval by interval, where each begins, and each place's common prefix."""
    made = [transform(s, window + 6) for s in shards]
    base = np.cumsum([0, *(len(s) for s in shards)])
    place = np.concatenate([o + b for (o, _), b in zip(made, base, strict=False)])
    rows, heads, common = merged([t for _, t in made], window)
    at_place = np.empty_like(common)
    at_place[place] = common
    return place[rows], heads, at_place


def minimiser_of(strings: list[bytes], window: int) -> np.ndarray:
    """The minimiser that a string's windows share, from its first window."""
    out, first, held = [np.zeros(0, np.uint64)], 0, 0
    for i, s in enumerate(strings):
        held += len(s)
        if held >= SHARD_BYTES or i + 1 == len(strings):
            part = strings[first : i + 1]
            size = np.array([len(x) for x in part])
            least = sliding_min(rolling(np.frombuffer(b"".join(part), np.uint8).astype(np.uint64) + np.uint64(1), GRAM), window - GRAM + 1)
            out.append(least[np.cumsum(size) - size])
            first, held = i + 1, 0
    return np.concatenate(out)


def least_owners(strings: list[bytes], own: np.ndarray, window: int) -> list[np.ndarray]:
    """For each string, the smallest document of each of its windows, through the merged transforms.

    Equal windows have equal minimisers, so a string that is the only one with its minimiser has no window in
    common with any other; it stays out of the merge.
    """
    if not strings:
        return []
    _, kind, times = np.unique(minimiser_of(strings, window), return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[kind] > 1)
    out = [np.full(len(s) - window + 1, o) for s, o in zip(strings, own.tolist(), strict=True)]
    for i, low in zip(several.tolist(), _merged_owners([strings[i] for i in several.tolist()], own[several], window), strict=True):
        out[i] = low
    return out


def _merged_owners(strings: list[bytes], own: np.ndarray, window: int) -> list[np.ndarray]:
    if not strings:
        return []
    size = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(size)
    data = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
    cuts = np.unique(np.append(ends[np.searchsorted(ends, np.arange(SHARD_BYTES, len(data), SHARD_BYTES))], len(data)))
    shards = np.split(data, cuts[:-1])
    low = np.repeat(own, size)
    places, heads, _ = repeated_intervals(shards, window)
    if len(places):
        least = np.minimum.reduceat(low[places], heads)
        low[places] = np.repeat(least, np.diff(np.append(heads, len(places))))
    return [low[e - n : e - window] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]


def _chunk(rows: np.ndarray, texts: list[bytes]) -> Chunk:
    data = b"".join(texts)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    return Chunk(rows, np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1), doc, data, (np.cumsum([0, *(len(t) for t in texts)]),))


def _packed(chunk: Chunk, window: int, windows: int) -> bytes:
    return chunk.data[window : window + windows + WINDOW - 1]


def _kept(chunk: Chunk, covered: np.ndarray):
    raw, (bounds,) = np.frombuffer(chunk.data, np.uint8), chunk.more
    for row, a, b in zip(chunk.rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        gone = covered[a:b]
        n = int(gone.sum())
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()) if n else 0
        yield row, b - a, n, spans, (raw[a:b][~gone].tobytes() if n else chunk.data[a:b])


def _finish_digest(chunk: Chunk, keep: list[str], covered: np.ndarray) -> dict[int, tuple]:
    return {row: (size, n, spans, hashlib.sha256(kept).hexdigest()) for row, size, n, spans, kept in _kept(chunk, covered)}


def _finish_bytes(chunk: Chunk, keep: list[str], covered: np.ndarray) -> dict[int, tuple]:
    return {row: (kept, n) for row, _, n, _, kept in _kept(chunk, covered)}


_DIGEST = (("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))
DIGEST = Method(GRAM, WINDOW, _chunk, _packed, least_owners, _finish_digest, _DIGEST)
BYTES = Method(GRAM, WINDOW, _chunk, _packed, least_owners, _finish_bytes, (("kept", pa.binary()), ("n_removed_bytes", pa.int64())))


def remove_shared_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (the bytes that stay, as binary: a cut may fall inside a character) and ``n_removed_bytes``.

    A byte goes if it lies in 50 bytes that also start in a smaller ``doc_id``; strings are judged on the input, and
    don't cross documents. Null texts are empty; texts under 50 bytes are left alone; rows with equal ids take
    nothing from each other; null ids come after all others; an empty table gives an empty one. Columns of ``docs``
    named like the two are replaced.
    """
    return beside_columns(docs, BYTES, ["kept", "n_removed_bytes"])


def shared_byte_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of the same removal."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return shared_windows(docs, DIGEST, ["doc_id"])
