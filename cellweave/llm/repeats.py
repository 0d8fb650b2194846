"""Windows that a document shares with a smaller document, found through minimisers; what word and byte dedup share.

Documents are dealt into blocks by a hash of their id, and messages go between blocks and *parts*, each holding a
range of hashes: a row is (block, part, payload) with packed arrays as payload. There are as many parts as blocks,
both follow the input, and every message holds a thing at most once for each block, so that a passage in a third
of all documents meets in a part as often as there are blocks, not documents.

1. each block sends the minimisers of its windows, with the number of its documents that have each;
2. parts answer with those of two or more documents, and mark the hot ones;
3. blocks send what carries a wanted minimiser: runs of windows as one packed string; where the minimiser is hot,
   each window is a packed string of its own and goes by its own hash, so that no bucket outgrows a task;
4. parts find each window's smallest document (the named method of either operator) and answer;
5. blocks take out what windows of smaller documents cover.

Steps 1 and 2 lose nothing: a window of two documents has the same minimiser in both.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import NULL_ID, block_count, block_of, pack_arrays, unpack_arrays

MESSAGE = "block int, part int, payload binary"
#: Documents with one minimiser from which its windows travel one by one: a bucket holds a string of each at most.
HOT = 1 << 15
CHUNK_BYTES = 1 << 18
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def rolling(units: np.ndarray, size: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` units, by doubling."""
    out, width, have, power = None, 0, units, multiplier
    step, n = 1, len(units)
    if n < size:
        return np.zeros(0, np.uint64)
    while step <= size:
        if size & step:
            out = have[: n - size + 1] if out is None else out[: n - size + 1] + have[width : width + n - size + 1] * _power(multiplier, width)
            width += step
        step *= 2
        if step <= size:
            half = step // 2
            have = have[:-half] + have[half:] * power
            power = _power(power, 2)
    return mixed(out)


def _power(base: np.uint64, times: int) -> np.uint64:
    return np.uint64(pow(int(base), times, 1 << 64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


@dataclass
class Runs:
    """Runs of consecutive windows that share a minimiser: first window, number of windows, minimiser, document."""

    start: np.ndarray
    windows: np.ndarray
    value: np.ndarray
    doc: np.ndarray


def runs(units: np.ndarray, doc: np.ndarray, gram: int, window: int) -> Runs:
    if len(units) < window:
        return Runs(*(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.int64)))
    least = sliding_min(rolling(units, gram), window - gram + 1)
    inside = doc[: len(least)] == doc[window - 1 :]
    head = np.ones(len(least), bool)
    head[1:] = (least[1:] != least[:-1]) | ~inside[:-1] | (doc[1 : len(least)] != doc[: len(least) - 1])
    start = np.flatnonzero(head & inside)
    stop = np.append(np.flatnonzero(head | ~inside), len(least))
    windows = stop[np.searchsorted(stop, start, "right")] - start
    # 48 bits will do: where two minimisers fall together, windows travel that needn't
    return Runs(start, windows, least[start] >> np.uint64(16), doc[start].astype(np.int64))


@dataclass
class Chunk:
    """Some documents of a block: their rows, the units of all, each unit's document, and what the operator needs beside."""

    rows: np.ndarray
    units: np.ndarray
    doc: np.ndarray
    data: bytes
    more: tuple


@dataclass(frozen=True)
class Method:
    """What the two operators differ in; all functions are plain and run inside tasks."""

    gram: int
    window: int
    chunk: Callable[[np.ndarray, list[bytes]], Chunk]
    packed: Callable[[Chunk, int, int], bytes]
    least: Callable[[list[bytes], np.ndarray, int], list[np.ndarray]]
    finish: Callable[[Chunk, list, np.ndarray], dict[int, tuple]]
    columns: tuple[tuple[str, pa.DataType], ...]


def _pack(*arrays: object) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, 5), 1)


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.decompress(data))


def _messages(block: int, part_of: np.ndarray, parts: int, payload: Callable[[np.ndarray], bytes]) -> list[tuple[int, int, bytes]]:
    order = np.argsort(part_of, kind="stable")
    cuts = np.flatnonzero(np.diff(part_of[order], prepend=-1, append=parts))
    return [(block, int(part_of[order[a]]), payload(order[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _table(messages: list[tuple[int, int, bytes]]) -> pa.Table:
    block, part, payload = zip(*messages, strict=True) if messages else ((), (), ())
    return pa.table({"block": pa.array(block, pa.int32()), "part": pa.array(part, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _chunks(group: pa.Table, method: Method) -> list[Chunk]:
    """The group's documents in chunks; null texts are empty, null ids come last."""
    texts = [(t or "").encode() for t in group.column("text").to_pylist()]
    out, first, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            out.append(method.chunk(np.arange(first, i + 1), texts[first : i + 1]))
            first, size = i + 1, 0
    return out


def _ids(group: pa.Table) -> np.ndarray:
    return group.column("doc_id").fill_null(NULL_ID).to_numpy().astype(np.int64)


def shared_windows(docs: DataFrame, method: Method, keep: list[str], hot: int = HOT) -> DataFrame:
    """``keep`` columns of ``docs`` (``doc_id`` long and ``text`` among its columns) and the method's own columns."""
    blocks = block_count(docs)
    parts = blocks
    rows = docs.withColumn("block", block_of(blocks))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)
    schema += "".join(f", {name} {kind}" for name, kind in ((n, {"int64": "long", "string": "string", "binary": "binary"}[str(t)]) for n, t in method.columns if n not in keep))

    def minimisers(key: tuple, group: pa.Table) -> pa.Table:
        ids, found, owner = _ids(group), [], []
        for chunk in _chunks(group, method):
            r = runs(chunk.units, chunk.doc, method.gram, method.window)
            found.append(r.value)
            owner.append(ids[chunk.rows[r.doc]])
        value, owner = np.concatenate([np.zeros(0, np.uint64), *found]), np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        other = new.copy()
        other[1:] |= owner[1:] != owner[:-1]
        heads = np.flatnonzero(new)
        count = np.add.reduceat(other.astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
        value = value[heads]
        return _table(_messages(key[0].as_py(), (value % np.uint64(parts)).astype(np.int64), parts, lambda at: pack_arrays(np.diff(value[at], prepend=np.uint64(0)), count[at].astype(np.uint32))))

    def wanted(key: tuple, group: pa.Table) -> pa.Table:
        got = [(np.cumsum(v, dtype=np.uint64), n) for v, n in (unpack_arrays(x) for x in group.column("payload").to_pylist())]
        value = np.concatenate([g[0] for g in got])
        distinct, place = np.unique(value, return_inverse=True)
        documents = np.bincount(place, np.concatenate([g[1] for g in got]))
        ends = np.cumsum([len(g[0]) for g in got])
        out = []
        for block, (own, _), end in zip(group.column("block").to_pylist(), got, ends, strict=True):
            n = documents[place[end - len(own) : end]]
            if (n > 1).any():
                out.append((block, key[0].as_py(), _pack("values", pack_arrays(np.diff(own[n > 1], prepend=np.uint64(0)), n[n > 1] >= hot))))
        return _table(out)

    def wanted_runs(chunk: Chunk, values: np.ndarray, is_hot: np.ndarray) -> tuple[Runs, list[bytes], np.ndarray]:
        """The runs that carry a wanted minimiser (of a hot one each window alone), as packed strings, and the part of each."""
        r = runs(chunk.units, chunk.doc, method.gram, method.window)
        at = np.minimum(np.searchsorted(values, r.value), max(len(values) - 1, 0))
        good = values[at] == r.value if len(values) else np.zeros(len(r.value), bool)
        r, hot_run = Runs(r.start[good], r.windows[good], r.value[good], r.doc[good]), is_hot[at[good]]
        if hot_run.any():
            single, cold = _ranges(r.start[hot_run], r.windows[hot_run]), ~hot_run
            own = rolling(chunk.units, method.window)[single] >> np.uint64(16)
            r = Runs(*(np.concatenate(x) for x in ((r.start[cold], single), (r.windows[cold], np.ones(len(single), np.int64)), (r.value[cold], own), (r.doc[cold], np.repeat(r.doc[hot_run], r.windows[hot_run])))))
        return r, [method.packed(chunk, a, n) for a, n in zip(r.start.tolist(), r.windows.tolist(), strict=True)], (r.value % np.uint64(parts)).astype(np.int64)

    def values_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        got = [unpack_arrays(_unpack(x)[1]) for x in group.column("payload").to_pylist()]
        values = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(v, dtype=np.uint64) for v, _ in got)])
        order = np.argsort(values)
        return values[order], np.concatenate([np.zeros(0, bool), *(h for _, h in got)])[order]

    def packed_runs(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows or not answers.num_rows:
            return _table([])
        values, is_hot = values_of(answers)
        ids = _ids(group)
        strings: dict[bytes, list] = {}  # packed string: [part, smallest document]
        for chunk in _chunks(group, method):
            r, packed, part_of = wanted_runs(chunk, values, is_hot)
            for s, v, o in zip(packed, part_of.tolist(), ids[chunk.rows[r.doc]].tolist(), strict=True):
                if (e := strings.get(s)) is None:
                    strings[s] = [v, o]
                elif o < e[1]:
                    e[1] = o
        keys = sorted(strings)  # the answer comes in this order, without the strings
        part = np.array([strings[s][0] for s in keys], np.int64)
        own = np.array([strings[s][1] for s in keys], np.int64)
        return _table(_messages(key[0].as_py(), part, parts, lambda at: _pack([keys[i] for i in at.tolist()], pack_arrays(own[at]))))

    def smallest(key: tuple, group: pa.Table) -> pa.Table:
        out, place, own, sent = [], {}, [], []
        for x in group.column("payload").to_pylist():  # each distinct string once, with its smallest document
            strings, owners = _unpack(x)
            mine = np.empty(len(strings), np.int64)
            for k, (s, o) in enumerate(zip(strings, unpack_arrays(owners)[0].tolist(), strict=True)):
                if (i := place.setdefault(s, len(own))) == len(own):
                    own.append(o)
                elif o < own[i]:
                    own[i] = o
                mine[k] = i
            sent.append(mine)
        found = method.least(list(place), np.array(own, np.int64), method.window)
        for block, mine in zip(group.column("block").to_pylist(), sent, strict=True):
            out.append((block, key[0].as_py(), _pack("strings", pack_arrays(np.concatenate([found[i] for i in mine.tolist()])))))
        return _table(out)

    def removed(key: tuple, group: pa.Table, answers: pa.Table) -> pa.Table:
        ids, names = _ids(group), [n for n, _ in method.columns]
        values, is_hot = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        told: dict[int, np.ndarray] = {}  # of each part's strings, in their order, end to end
        for part, x in zip(answers.column("part").to_pylist(), answers.column("payload").to_pylist(), strict=True) if answers.num_rows else []:
            kind, *got = _unpack(x)
            if kind == "strings":
                told[part] = unpack_arrays(got[0])[0]
            else:
                v, h = unpack_arrays(got[0])
                values.append(np.cumsum(v, dtype=np.uint64))
                is_hot.append(h)
        values, is_hot = np.concatenate(values), np.concatenate(is_hot)
        order = np.argsort(values)
        values, is_hot = values[order], is_hot[order]
        chunks, size, part_of = [], {}, {}
        for chunk in _chunks(group, method):
            r, strings, parts_ = wanted_runs(chunk, values, is_hot)
            size.update(zip(strings, r.windows.tolist(), strict=True))
            part_of.update(zip(strings, parts_.tolist(), strict=True))
            n_units, chunk.units = len(chunk.units), np.zeros(0, np.uint64)
            chunks.append((chunk, n_units, r, strings))
        least: dict[bytes, np.ndarray] = {}
        at_part = dict.fromkeys(told, 0)
        for s in sorted(size):
            at = at_part[part_of[s]]
            least[s] = told[part_of[s]][at : at + size[s]]
            at_part[part_of[s]] = at + size[s]
        out: dict[int, tuple] = {}
        while chunks:
            chunk, n_units, r, strings = chunks.pop()
            owner = ids[chunk.rows[r.doc]]
            hit = np.zeros(0, np.int64)
            if strings:
                told_low = np.concatenate([least[s] for s in strings])
                hit = _ranges(r.start, r.windows)[told_low < np.repeat(owner, r.windows)]
            delta = np.bincount(hit, minlength=n_units + 1)[: n_units + 1]
            cover = np.cumsum(delta)
            cover[method.window :] -= cover[: -method.window].copy()
            out |= method.finish(chunk, keep, cover[:-1] > 0)
        made = [out[i] for i in range(group.num_rows)]
        table = group.select(keep)
        for j, (name, kind) in enumerate(method.columns):
            column = pa.array([m[j] for m in made], kind)
            table = table.set_column(keep.index(name), name, column) if name in keep else table.append_column(name, column)
        return table.select([*keep, *(n for n in names if n not in keep)])

    sent = rows.groupBy("block").applyInArrow(minimisers, MESSAGE)
    answered = sent.groupBy("part").applyInArrow(wanted, MESSAGE)
    strings = rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(packed_runs, MESSAGE)
    found = strings.groupBy("part").applyInArrow(smallest, MESSAGE)
    # the last step needs both answers; they are told apart by their form
    return rows.groupBy("block").cogroup(answered.unionByName(found).groupBy("block")).applyInArrow(removed, schema)


def beside_columns(docs: DataFrame, method: Method, added: list[str]) -> DataFrame:
    """``docs`` with the method's ``text`` (if it makes one) in place and the columns ``added`` at the end.

    The other columns travel under names of their own, so that they clash with none; those named like ``added`` are replaced.
    """
    rest = {c: f"_c{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", *added)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c).alias(n) for c, n in rest.items()])
    rows = shared_windows(rows, method, rows.columns)
    return rows.select(*[F.col(rest.get(c, c)).alias(c) for c in docs.columns if c not in added], *added)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) + np.repeat(start - (ends - n), n)
