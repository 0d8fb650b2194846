"""Word-level substring dedup by super-k-mers: consecutive windows that share a minimiser travel as one packed string."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .repeats import Chunk, Method, beside_columns, shared_windows
from .words import WHITE, joined, word_bounds, word_codes, word_marks

WINDOW, GRAM = 50, 8


def _chunk(rows: np.ndarray, texts: list[bytes]) -> Chunk:
    data, ends = joined(texts)
    raw = np.frombuffer(data, np.uint8)
    start, end = word_bounds(raw)
    # the words with one space between them, of which packed strings are slices
    white = WHITE[raw]
    keep = ~white
    keep[1:] |= ~white[:-1]
    place = np.cumsum(keep) - 1
    plain = np.where(white, np.uint8(0x20), raw)[keep].tobytes()
    first = place[start]
    return Chunk(rows, word_marks(raw, start, end), np.searchsorted(ends, start, "right"), plain, (data, ends, start, first, first + (end - start)))


def _packed(chunk: Chunk, window: int, windows: int) -> bytes:
    _, _, _, first, last = chunk.more
    return chunk.data[first[window] : last[window + windows + WINDOW - 2]]


def _least(strings: list[bytes], own: np.ndarray, window: int) -> list[np.ndarray]:
    """For each packed string, the smallest document of each of its windows: equal windows meet by sorting.

    Words are numbered by comparing their bytes, pairs of them by sorting pairs of numbers, then runs of 4, 8, 16 and
    so on words by sorting pairs of half as long ones: two windows have one number if, and only if, they are equal.
    """
    if not strings:
        return []
    data, ends = joined(strings)
    raw = np.frombuffer(data, np.uint8)
    start, end = word_bounds(raw)
    doc = np.searchsorted(ends, start, "right")
    inside = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :])
    number = window_numbers(word_codes(raw, start, end)[0], window)[inside]
    least = np.full(int(number.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, own[doc[inside]])
    return np.split(least[number], np.searchsorted(doc[inside], np.arange(1, len(strings))))


def window_numbers(code: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of ``window`` codes, equal for equal runs alone."""

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]

    width, out = 1, code
    while 2 * width <= window:
        out, width = paired(out[: len(out) - width], out[width:]), 2 * width
    return paired(out[: len(code) - window + 1], out[window - width :][: len(code) - window + 1]) if width < window else out


def _finish_digest(chunk: Chunk, keep: list[str], covered: np.ndarray) -> dict[int, tuple]:
    _, _, _, first, last = chunk.more
    out = {}
    bounds = np.searchsorted(chunk.doc, np.arange(len(chunk.rows) + 1)).tolist()
    for row, a, b in zip(chunk.rows.tolist(), bounds, bounds[1:], strict=False):
        gone = int(covered[a:b].sum())
        kept = b" ".join(chunk.data[first[x] : last[y - 1]] for x, y in _stretches(~covered[a:b], a))
        out[row] = (b - a, gone, hashlib.sha256(kept).hexdigest())
    return out


def _finish_text(chunk: Chunk, keep: list[str], covered: np.ndarray) -> dict[int, tuple]:
    data, ends, start, _, _ = chunk.more
    out = {}
    bounds = np.searchsorted(chunk.doc, np.arange(len(chunk.rows) + 1)).tolist()
    for i, (row, a, b) in enumerate(zip(chunk.rows.tolist(), bounds, bounds[1:], strict=False)):
        low, high = (int(ends[i - 1]) if i else 0), int(ends[i]) - 1
        if covered[a:b].any():
            cuts = [(int(start[x]) if x > a else low, int(start[y]) if y < b else high) for x, y in _stretches(~covered[a:b], a)]
            text = b"".join(data[x:y] for x, y in cuts)
        else:
            text = data[low:high]
        out[row] = (text.decode(), int(covered[a:b].sum()))
    return out


def _stretches(mask: np.ndarray, offset: int) -> list[tuple[int, int]]:
    """Maximal stretches of true values."""
    if mask.all():
        return [(offset, offset + len(mask))] if len(mask) else []
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip((np.flatnonzero(edge == 1) + offset).tolist(), (np.flatnonzero(edge == -1) + offset).tolist(), strict=True))


DIGEST = Method(GRAM, WINDOW, _chunk, _packed, _least, _finish_digest, (("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())))
TEXT = Method(GRAM, WINDOW, _chunk, _packed, _least, _finish_text, (("text", pa.string()), ("n_removed_words", pa.int64())))


def remove_shared_windows(docs: DataFrame) -> DataFrame:
    """``docs`` with every word taken out of ``text`` that lies in 50 words which also stand in a smaller ``doc_id``.

    What stays keeps its layout; ``n_removed_words`` is added. Windows are judged on the input. Null texts count as
    empty (and come out empty), texts of fewer than 50 words are left alone, rows with equal ids take nothing from
    each other, null ids come after all others; an empty table gives an empty one.
    """
    return beside_columns(docs, TEXT, ["n_removed_words"])


def shared_window_digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of the same removal; kept words are joined by one space."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return shared_windows(docs, DIGEST, ["doc_id"])
