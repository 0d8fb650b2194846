"""Token counts: pieces are counted once per distinct pre-token, and joined to per-document pre-token frequencies."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import block_count, id_and_text, written
from .pretokens import chunks, encoder, split

#: Bytes of text in one block; a block's distinct pre-tokens travel once.
BLOCK_BYTES = 32 << 20
#: Parts for each block of input into which the pre-tokens are dealt by their hash.
PARTS_A_BLOCK = 4
BLOCKS = "block long, doc_id array<bigint>, n_bytes array<bigint>, tails array<int>, frequencies binary, parts array<struct<part int, pieces binary>>"


def token_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` (long) for each row of ``docs``, as the ``tokenizers`` file gives them.

    One pass writes blocks of documents: each with its distinct pre-tokens, and per document the frequency of
    each. The distinct pre-tokens are brought together by hash, their pieces counted once, and the counts
    joined back to the blocks' frequencies and summed; ids are never put down. A special string inside a text
    is one token and cuts the text, as in the library.

    A null text counts as empty; a null id stays null; repeated rows each give a row; an empty table gives none.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng()
        for batch in batches:
            for start, texts in chunks(batch.column("text"), BLOCK_BYTES):
                yield _block(int(rng.integers(1 << 62)), batch.column("doc_id").slice(start, len(texts)), texts, encoder(tokenizer_path).specials, parts)

    def count(key: tuple, group: pa.Table) -> pa.Table:
        lists = [_unpack(x) for x in group.column("pieces").to_pylist()]
        distinct = list(dict.fromkeys(p for x in lists for p in x))
        sizes = dict(zip(distinct, encoder(tokenizer_path).sizes(distinct).tolist(), strict=True))
        out = [zstandard.compress(np.array([sizes[p] for p in x], np.uint32).tobytes(), 1) for x in lists]
        return pa.table({"block": group.column("block"), "part": group.column("part"), "sizes": pa.array(out, pa.binary())})

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                sizes = np.concatenate([np.frombuffer(zstandard.decompress(x["sizes"]), np.uint32) for x in sorted(r["counted"] or [], key=lambda x: x["part"])] + [np.zeros(0, np.uint32)])
                docs, codes, times = np.frombuffer(zstandard.decompress(r["frequencies"]), np.uint32).reshape(3, -1)
                n = np.bincount(np.cumsum(docs), sizes[codes].astype(np.int64) * times, len(r["doc_id"])).astype(np.int64) + np.array(r["tails"], np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(r["doc_id"], pa.int64()), "n_bytes": pa.array(r["n_bytes"], pa.int64()), "n_tokens": pa.array(n)})

    docs = id_and_text(docs)
    parts = PARTS_A_BLOCK * block_count(docs, BLOCK_BYTES)
    table = written(docs.mapInArrow(blocks, BLOCKS), "pre-tokens")
    counted = table.select("block", F.inline("parts")).groupBy("part").applyInArrow(count, "block long, part int, sizes binary")
    counted = counted.groupBy("block").agg(F.collect_list(F.struct("part", "sizes")).alias("counted"))
    return table.select("block", "doc_id", "n_bytes", "tails", "frequencies").join(counted, "block", "left").mapInArrow(sums, "doc_id long, n_bytes long, n_tokens long")


def _pack(pieces: list[str]) -> bytes:
    raw = [p.encode() for p in pieces]
    return zstandard.compress(np.array([len(raw), *map(len, raw)], np.uint32).tobytes() + b"".join(raw), 1)


def _unpack(data: bytes) -> list[str]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4)).tolist()
    body = raw[4 + 4 * n :]
    return [body[a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]


def _block(number: int, ids: pa.Array, texts: pa.Array, specials: list[str], parts: int) -> pa.RecordBatch:
    n_docs, tails = len(texts), np.zeros(len(texts), np.int32)
    n_bytes = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n_docs + 1])
    owner = np.arange(n_docs)
    if specials and any(s in (t or "") for s in specials for t in (texts.to_pylist() if _holds(texts, specials) else [])):
        import re

        cut = re.compile("|".join(map(re.escape, specials)))
        each = [cut.split(t) for t in texts.to_pylist()]
        tails = np.array([len(x) - 1 for x in each], np.int32)  # the special tokens themselves
        owner = np.repeat(np.arange(n_docs), tails + 1)
        texts = pa.array([p for x in each for p in x], pa.large_string())
    pieces, keys = [], []
    names: dict[str, int] = {}
    for start, part in chunks(texts):
        found, rows = split(part)
        coded = found.dictionary_encode()
        local = np.fromiter((names.setdefault(p, len(names)) for p in coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        pieces.append(local[coded.indices.to_numpy(zero_copy_only=False)])
        keys.append(owner[start + rows])
    both, times = np.unique((np.concatenate(keys) << 32) | np.concatenate(pieces), return_counts=True) if pieces else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    known = list(names)
    part_of = np.fromiter((zlib.crc32(p.encode()) % parts for p in known), np.int64, len(known))
    order = np.argsort(part_of, kind="stable")
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    doc = both >> 32
    body = np.stack([np.diff(doc, prepend=0), place[both & 0xFFFFFFFF] if len(known) else both, times]).astype(np.uint32)
    bounds = np.searchsorted(part_of[order], np.arange(parts + 1)).tolist()
    dealt = [{"part": i, "pieces": _pack([known[j] for j in order[a:b]])} for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)) if b > a]
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([number], pa.int64()),
            "doc_id": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
            "n_bytes": pa.array([n_bytes.tolist()], pa.list_(pa.int64())),
            "tails": pa.array([tails.tolist()], pa.list_(pa.int32())),
            "frequencies": pa.array([zstandard.compress(body.tobytes(), 1)], pa.binary()),
            "parts": pa.array([dealt], pa.list_(pa.struct([("part", pa.int32()), ("pieces", pa.binary())]))),
        }
    )


def _holds(texts: pa.Array, specials: list[str]) -> bool:
    import pyarrow.compute as pc

    return any(pc.any(pc.match_substring(texts, s)).as_py() for s in specials)
