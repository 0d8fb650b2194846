"""What the corpus operators share: column hygiene, written intermediate tables, block sizes."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.tables import table, written  # noqa: F401

# Python workers live on from task to task: large arrays are to go back to the system as they are freed, small ones
# to be used again without new pages. Fixed values of the C library: the two settings' numbers.
M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3
pa.set_memory_pool(pa.system_memory_pool())
for _setting, _bytes in ((M_MMAP_THRESHOLD, 4 << 20), (M_TRIM_THRESHOLD, 16 << 20)):
    getattr(ctypes.CDLL(None), "mallopt", lambda *_: 0)(_setting, _bytes)

#: Text bytes that one block of documents should hold; the number of blocks follows the input.
BLOCK_BYTES = 8 << 20
#: The id that stands for a null one wherever ids are compared: it comes after all others.
NULL_ID = (1 << 63) - 1


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that ``docs`` doesn't have, in any case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only ``doc_id`` (long) and ``text`` (string), whatever else the table holds."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def block_count(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about ``block_bytes`` of text that the table fills."""
    total = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0]
    return max(1, -(-(total or 0) // block_bytes))


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")


def dealt(docs: DataFrame, blocks: int, most_bytes: int = 2 * BLOCK_BYTES) -> DataFrame:
    """``block, payload``: the documents (``doc_id``, ``text``) dealt into blocks by a hash of the id, compressed to travel.

    A task packs what it has read for each block, every ``most_bytes`` of text; ``unpacked`` gives them back.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            made = [zstandard.compress(pickle.dumps(x, 5), 3) for x in held.values()]
            return pa.RecordBatch.from_pydict({"block": pa.array(list(held), pa.int32()), "payload": pa.array(made, pa.binary())})

        for batch in batches:
            for i, t, b in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("block").to_pylist(), strict=True):
                ids, texts = held.setdefault(b, ([], []))
                ids.append(i)
                texts.append(raw := (t or "").encode())
                size += len(raw) + 16
                if size >= most_bytes:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    return docs.withColumn("block", block_of(blocks)).mapInArrow(pack, "block int, payload binary")


def text_chunks(column: pa.Array, size: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of about ``size`` bytes each; null ones are empty, a longer text stays whole."""
    raw = column.cast(pa.large_string()).cast(pa.large_binary())
    ends = np.cumsum(np.diff(np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1])) if len(raw) else np.zeros(0, np.int64)
    first = 0
    while first < len(raw):
        upto = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
        yield first, [x or b"" for x in raw.slice(first, upto - first).to_pylist()]
        first = upto


def unpacked(payloads: pa.ChunkedArray) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and UTF-8 texts of each payload of ``dealt``; null texts have become empty."""
    for x in payloads:
        yield pickle.loads(zstandard.decompress(x.as_py()))


def planes(values: np.ndarray) -> bytes:
    """The bytes of numbers, all first ones, then all second ones, and so on: alike ones lie together."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplaned(data: bytes, kind: np.dtype | type | str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps([(a.dtype.str, planes(a)) for a in arrays], 5), 1)


def unpack_arrays(data: bytes) -> list[np.ndarray]:
    return [unplaned(raw, kind) for kind, raw in pickle.loads(zstandard.decompress(data))]
