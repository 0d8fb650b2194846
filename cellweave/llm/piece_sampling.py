"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

A text is cut where no piece can span (before a run of blanks, around characters that only byte pieces can write),
and the lattice of each distinct stretch of a batch is built and filtered once: the weight of all ways from its
beginning to each place. Every occurrence is then sampled from its end backwards, each step with a number that
follows from the row's key, the place and the seed alone. So a text's pieces don't depend on partitions or on the
rows around it, and equal keys and texts give equal pieces.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .repeats import mixed
from .words import coded

#: The escaped blank of the piece files.
BLANK = 0x2581
#: Stands for a character that no piece holds, and for a literal U+2581, which must not come back as a blank.
ODD = 0x110000
CHUNK_BYTES = 2 << 20
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass(frozen=True)
class Sampling:
    """Weights: a piece of rank r counts as (r + offset) ** -alpha, after Zipf; a large alpha nears one best way."""

    alpha: float = 1.0
    offset: float = 10.0
    seed: int = 0


class Pieces:
    """A trie of the pieces, their ranks, and the bytes that each id stands for.

    Each node is told by the node before it and its character, as one number.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.first_byte = next(i for i in range(model.get_piece_size()) if model.is_byte(i))
        self.ranks = np.zeros(model.get_piece_size())
        surface: list[bytes] = []
        nodes: dict[int, int] = {}  # the node before and a character: number of the node
        piece_at: dict[int, int] = {}
        singles = set()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                surface.append(bytes([i - self.first_byte]))
                continue
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                surface.append(b"")
                continue
            surface.append(piece.replace(chr(BLANK), " ").encode())
            self.ranks[i] = -model.get_score(i)
            node = 0
            for c in piece:
                node = nodes.setdefault(node << 21 | ord(c), len(nodes) + 1)
            if piece:
                piece_at[node] = i
            if len(piece) == 1:
                singles.add(ord(piece))
        self.longest = max(len(model.id_to_piece(i)) for i in range(model.get_piece_size()) if self.ranks[i] or not model.is_byte(i))
        raw = np.fromiter(nodes, np.uint64, len(nodes))
        order = np.argsort(mixed(raw))
        self.keys = mixed(raw)[order]
        self.nodes = np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.ids = np.array([piece_at.get(n, -1) for n in self.nodes.tolist()], np.int64)
        self.shift = np.uint64(64 - 20)
        # where the search for a key begins: at the first key with its upper 20 bits
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int64)
        self.deepest = int(np.diff(self.begin).max())
        self.known = np.zeros(ODD + 1, bool)
        self.known[list(singles)] = True
        self.sizes = np.array([len(s) for s in surface])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(surface), np.uint8)

    def find(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The place in ``ids`` and ``nodes`` of each node's child by a character, -1 for none."""
        wanted = mixed((nodes << 21 | chars).astype(np.uint64))
        at, out = self.begin[(wanted >> self.shift).astype(np.int64)], np.full(len(wanted), -1)
        for _ in range(self.deepest):
            now = np.minimum(at, len(self.keys) - 1)
            out = np.where(self.keys[now] == wanted, now, out)
            at = at + 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - (ends - size), size)].tobytes()


@functools.cache
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def sample(texts: list[str], keys: np.ndarray, pieces: Pieces, how: Sampling) -> list[np.ndarray]:
    """Ids of each text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    if not len(points):
        return [np.zeros(0, np.int64) for _ in texts]
    doc = np.repeat(np.arange(len(texts)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    odd = (points == BLANK) | ~pieces.known[np.where(points == 0x20, BLANK, points)]
    code = np.where(odd, ODD, np.where(points == 0x20, BLANK, points)).astype(np.int64)
    # stretches that no piece leaves
    begin = np.ones(len(code), bool)
    begin[1:] = (doc[1:] != doc[:-1]) | ((code[1:] == BLANK) & (code[:-1] != BLANK)) | odd[1:] | odd[:-1]
    start = np.flatnonzero(begin)
    size = np.diff(np.append(start, len(code)))
    kind, kind_of = _distinct(code, size)
    # the distinct ones, end to end, with a node before each character and one behind the last
    k_size = size[kind]
    node0 = np.cumsum(k_size + 1) - (k_size + 1)
    flat = np.repeat(start[kind] - (np.cumsum(k_size) - k_size), k_size) + np.arange(k_size.sum())
    chars = code[flat]
    at_node = np.repeat(node0 - (np.cumsum(k_size) - k_size), k_size) + np.arange(len(chars))
    left = np.repeat(np.cumsum(k_size), k_size) - np.arange(len(chars))  # characters to the end of the stretch
    e_from, e_to, e_id = [], [], []
    active, inner = np.arange(len(chars)), np.zeros(len(chars), np.int64)
    for n in range(1, pieces.longest + 1):
        node = pieces.find(inner, chars[active + n - 1])
        ids = np.where(node >= 0, pieces.ids[node], -1)
        if n == 1:
            ids = np.where(chars == ODD, -2, ids)  # written by byte pieces
        hit = ids != -1
        e_from.append(at_node[active[hit]])
        e_to.append(at_node[active[hit]] + n)
        e_id.append(ids[hit])
        on = (node >= 0) & (left[active] > n)
        active, inner = active[on], pieces.nodes[node[on]]
        if not len(active):
            break
    e_from, e_to, e_id = np.concatenate(e_from), np.concatenate(e_to), np.concatenate(e_id)
    order = np.argsort(e_to, kind="stable")
    e_from, e_to, e_id = e_from[order], e_to[order], e_id[order]
    weight = np.where(e_id >= 0, -how.alpha * np.log(pieces.ranks[np.maximum(e_id, 0)] + how.offset), 0.0)
    # forward filtering: nodes of equal depth together
    n_nodes = int((k_size + 1).sum())
    depth = np.arange(n_nodes) - np.repeat(node0, k_size + 1)
    head = np.flatnonzero(np.diff(e_to, prepend=-1))
    node_of, first_edge = e_to[head], head
    n_edges = np.diff(np.append(head, len(e_to)))
    by_depth = np.argsort(depth[node_of], kind="stable")
    alpha = np.zeros(n_nodes)
    bounds = np.append(np.flatnonzero(np.diff(depth[node_of][by_depth], prepend=0)), len(by_depth))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = by_depth[a:b]
        count = n_edges[own]
        ends = np.cumsum(count)
        edges = np.arange(ends[-1]) + np.repeat(first_edge[own] - (ends - count), count)
        alpha[node_of[own]] = np.logaddexp.reduceat(alpha[e_from[edges]] + weight[edges], ends - count)
    # backward sampling: each node's own edges, as shares of its weight summed up, in whole numbers of 2^-53
    share = np.exp(alpha[e_from] + weight - alpha[e_to])
    upto, so_far, open_ = np.empty(len(e_to), np.int64), np.zeros(len(head)), np.arange(len(head))
    for k in range(int(n_edges.max())):
        open_ = open_[n_edges[open_] > k]
        so_far[open_] += share[head[open_] + k]
        upto[head[open_] + k] = np.minimum(so_far[open_], 1.0) * 2.0**53
    upto[np.append(head[1:], len(e_to)) - 1] = 1 << 53
    edge_of = np.full(n_nodes, -1)
    edge_of[node_of] = head
    seed = mixed(keys.astype(np.uint64) * SPREAD + np.uint64(how.seed & 0xFFFFFFFFFFFFFFFF))
    turn = np.argsort(kind_of, kind="stable")  # alike stretches together: their edges are read once
    node, origin = (node0[kind_of] + size)[turn], node0[kind_of][turn]
    base, owner = start[turn], doc[start][turn]
    out_at, out_id = [], []
    while len(node):
        at = base + (node - origin)  # behind the piece to come, in the batch
        u = (mixed(seed[owner] + (place[at - 1] + 1).astype(np.uint64) * STEP) >> np.uint64(11)).astype(np.int64)
        edge = edge_of[node]
        over = np.flatnonzero(u >= upto[edge])
        while len(over):
            edge[over] += 1
            over = over[u[over] >= upto[edge[over]]]
        node = e_from[edge]
        out_at.append(base + (node - origin))
        out_id.append(e_id[edge])
        on = node > origin
        node, origin, base, owner = node[on], origin[on], base[on], owner[on]
    at, ids = np.concatenate(out_at), np.concatenate(out_id)
    order = np.argsort(at)
    at, ids = at[order], ids[order]
    if (ids == -2).any():
        at, ids = _with_bytes(at, ids, points, pieces.first_byte)
    cuts = np.searchsorted(at, np.cumsum(lengths))
    return np.split(ids, cuts[:-1])


def _distinct(code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stretch for each distinct one, and for each stretch which; they are compared character by character."""
    kind_of, distinct = coded(code.astype(np.uint32).view(np.uint8), 4 * size)
    kind = np.empty(len(distinct), np.int64)
    kind[kind_of[::-1]] = np.arange(len(size))[::-1]
    return kind, kind_of


def _with_bytes(at: np.ndarray, ids: np.ndarray, points: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    odd = np.flatnonzero(ids == -2)
    written = [chr(c).encode() for c in points[at[odd]].tolist()]
    times = np.ones(len(ids), np.int64)
    times[odd] = [len(b) for b in written]
    out = np.repeat(ids, times)
    out[np.repeat(ids == -2, times)] = np.frombuffer(b"".join(written), np.uint8).astype(np.int64) + first_byte
    return np.repeat(at, times), out


def _batches(batch: pa.RecordBatch, model_path: str, how: Sampling) -> Iterator[tuple[int, list[str], list[np.ndarray]]]:
    pieces = pieces_of(model_path)
    texts = [t or "" for t in batch.column("text").to_pylist()]
    keys = batch.column("doc_id").fill_null(-1).to_numpy().astype(np.int64)
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield first, texts[first : i + 1], sample(texts[first : i + 1], keys[first : i + 1], pieces, how)
            first, size = i + 1, 0


def encoded(docs: DataFrame, model_path: str, how: Sampling = Sampling()) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row of ``docs``: one sampled segmentation of its whole text.

    Null and empty texts have no pieces. Rows with a null id share a key; rows that repeat id and text have equal
    pieces. An empty table gives no rows. No dummy blank is put before a text. A very long text takes one step of
    numpy for each character of its longest stretch without a blank, and memory in proportion to its length.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts, found in _batches(batch, model_path, how):
                ends = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(texts)), "ids": ids})

    return _keyed(docs).mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text`` for rows of ``encoded``: the texts that were encoded, byte for byte (null ones have become empty)."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            out = [pieces.decode(np.array(x or [], np.int64)).decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(out, pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def digests(docs: DataFrame, model_path: str, how: Sampling = Sampling()) -> DataFrame:
    """``doc_id, n_bytes, n_pieces, ids_crc32`` (of little-endian unsigned 32-bit ids) and whether decoding gives the text back; rows as in ``encoded``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in batches:
            for first, texts, found in _batches(batch, model_path, how):
                raw = [t.encode() for t in texts]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(first, len(texts)),
                        "n_bytes": pa.array([len(r) for r in raw], pa.int64()),
                        "n_pieces": pa.array([len(x) for x in found], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                        "lossless": pa.array([pieces.decode(x) == r for x, r in zip(found, raw, strict=True)], pa.bool_()),
                    }
                )

    return _keyed(docs).mapInArrow(rows, "doc_id long, n_bytes long, n_pieces long, ids_crc32 long, lossless boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
