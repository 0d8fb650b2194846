"""N-gram Jaccard join by vertical partitioning, and the components of its links.

Documents with equal shingle sets are one class, joined through its smallest id. Shingles have one global order,
rarer ones first; two sets as alike as the threshold asks share one of the first few shingles of either, so only
classes that meet in such a prefix are compared. First each class is compared with one other: the one that most of a
sample of its shingles names, of whose own shingles the fewest come before. That links the bulk of a large group to
few texts. Then, at every prefix shingle whose classes are in several components, all pairs of classes of different
components are compared that can still be alike by size and place. Classes at very mixed shingles come again with 16
bits of each of their shingles, which bound an overlap almost exactly: of those with which it shares some of its
rarest shingles there, a class is compared with the likeliest ones of other components, then with more of them from
round to round, until no such pair is left. Mixed shingles of the same classes are one bundle, in which a class stands
once; its classes are dealt to sides of bounded size, and any two sides meet in a group of their own.

A comparison is vertical: the global order is cut into fragments, partial overlaps are counted for each fragment
on its own, and summed for each pair. Overlaps are counted on 64-bit hashes of the shingles; prefixes, which only
name candidates, hold 48 bits of them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellweave.functions.groups import spread

from .common import block_count, block_of, dealt, id_and_text, pack_arrays, text_chunks, unpack_arrays, unpacked, written
from .components import components
from .words import joined, run_hashes, word_bounds, word_hashes

#: Buckets of the sketch that tells frequent shingles from rare ones; a fixed size, whatever the corpus.
SKETCH_BITS, SKETCH_SLICES = 22, 16
FRAGMENTS = 3
#: Partners that a document meets at once.
PARTNERS = 64
#: Equal ranges of hashes in which a set's shingles are counted, for a bound of overlaps.
BINS = 128
#: Text bytes for each part into which prefix shingles are dealt.
PART_BYTES = 64 << 20
#: Tables of ids and components (16 bytes a row) of no more rows than these are broadcast; larger ones are joined by a shuffle.
FEW = 200_000
#: The first round reads every so many-th shingle.
SAMPLE = 4
#: A shingle is mixed if it has more pairs than these of a class outside its largest component and any other class.
MIXED = 16_384
#: Shingles of the classes that one side of a bundle of mixed shingles should hold; how many sides there are follows the classes.
SIDE_SHINGLES = 1 << 19
#: So many of their rarest shingles two classes at a mixed shingle have to share before they are looked at.
COMMON = 3
CHUNK_BYTES = 1 << 19
#: Bytes of prefixes that a task deals out at once.
DEAL_BYTES = 4 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles (A-Z lower-cased) and the text of each; shorter texts have one of all words."""
    data, ends = joined([t.translate(LOWER) for t in texts])
    raw = np.frombuffer(data, np.uint8)
    start, end = word_bounds(raw)
    units, doc = word_hashes(raw, start, end), np.searchsorted(ends, start, "right")
    values, owner = run_hashes(units, size), doc[: max(len(doc) - size + 1, 0)]
    inside = owner == doc[size - 1 :] if len(owner) else np.zeros(0, bool)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < size))
    own = [run_hashes(units[first[i] : first[i] + n[i]], int(n[i])) for i in short]
    values, owner = np.concatenate([values[inside], *own]), np.concatenate([owner[inside], short])
    order = np.argsort(owner, kind="stable")
    return values[order], owner[order]


def _chunked(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


def _sets(texts: list[bytes], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes)"""
    values, owner = shingle_hashes(texts, size)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        yield i, np.unique(values[a:b])


def rarity_levels(docs: DataFrame, size: int) -> bytes:
    """One byte for each bucket of hashes: how many binary digits the number of its shingles has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for _, part in text_chunks(batch.column("text"), CHUNK_BYTES):
                np.add.at(total, (shingle_hashes(part, size)[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SKETCH_SLICES), pa.int32()), "counts": pa.array([pack_arrays(x) for x in np.split(total, SKETCH_SLICES)], pa.binary())})

    def levels(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_SLICES, np.int64)
        for batch in group:
            for x in batch.column("counts").to_pylist():
                total += unpack_arrays(x)[0]
        digits = np.ceil(np.log2(total + 1)).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"slice": pa.array([key[0].as_py()], pa.int32()), "levels": pa.array([zlib.compress(digits.tobytes(), 1)], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(levels, "slice int, levels binary").collect()
    return b"".join(zlib.decompress(r["levels"]) for r in sorted(rows, key=lambda r: r["slice"])) or bytes(1 << SKETCH_BITS)


def shingle_sets(docs: DataFrame, size: int, percent: int, levels: bytes) -> DataFrame:
    """``doc_id, n, digest, bins, prefix``: size and digest of each document's set, how many shingles lie in each of BINS
    ranges, and in their order the shingles of which a likeness shares one."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for first, part in text_chunks(batch.column("text"), CHUNK_BYTES):
                n, digest, bins, prefix = [], [], [], []
                for _, s in _sets(part, size):
                    n.append(len(s))
                    digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    counts = np.bincount((s >> np.uint64(57)).astype(np.int64), minlength=BINS) if len(s) <= 0xFFFF else np.full(BINS, 0xFFFF)  # no bound for a set that large
                    bins.append(counts.astype(np.uint16).tobytes())
                    take = len(s) - -(-percent * len(s) // 100) + 1 if len(s) else 0
                    rank = (level[s >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                    chosen = np.argpartition(rank, take - 1)[:take] if 0 < take < len(s) else np.arange(len(s))
                    prefix.append(_narrow(s[chosen[np.lexsort((s[chosen], rank[chosen]))]]))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(first, len(part)), "n": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "bins": pa.array(bins, pa.binary()), "prefix": pa.array(prefix, pa.binary())})

    return docs.mapInArrow(sets, "doc_id long, n long, digest binary, bins binary, prefix binary")


def _narrow(hashes: np.ndarray) -> bytes:
    """The upper 48 bits of each, six bytes apiece."""
    return (hashes >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


class Members:
    """The classes at one prefix shingle: id, set size, place of the shingle in the class's order, component.

    Where ``side`` is given, only classes of different sides make a pair.
    """

    def __init__(self, ids: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, percent: int, side: np.ndarray | None = None):
        self.ids, self.n, self.root, self.percent, self.side = ids, n, root, percent, side
        self.most = n - at  # what the class shares at most with another whose first common shingle this is

    def possible(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether two classes whose first common shingle is this one can be as alike as asked."""
        most = np.minimum(self.most[u], self.most[v])
        apart = self.root[u] != self.root[v]
        if self.side is not None:
            apart &= self.side[u] != self.side[v]
        return apart & (100 * most >= self.percent * (self.n[u] + self.n[v] - most))

    def alive(self) -> tuple[np.ndarray, np.ndarray]:
        """Members that can be alike with any other, and those of them outside the largest component."""
        alive = np.flatnonzero((100 + self.percent) * self.most >= self.percent * (self.n + self.n.min()))
        if not len(alive):
            return alive, alive
        _, code, count = np.unique(self.root[alive], return_inverse=True, return_counts=True)
        return alive, alive[code != count.argmax()]

    def pairs(self, mixed: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """Pairs of different components that can be alike, and whether these are all: a shingle of more than ``mixed`` gives none."""
        alive, minor = self.alive()
        if len(minor) * len(alive) > mixed:
            return alive[:0], alive[:0], False
        left, right = np.repeat(minor, len(alive)), np.tile(alive, len(minor))
        outside = np.zeros(len(self.n), bool)
        outside[minor] = True
        some = self.possible(left, right) & (~outside[right] | (left < right))
        return left[some], right[some], True

    def postings(self, alive: np.ndarray, thin: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``owner, value, start, least``: the first few of each class's distinct 16-bit shingles, those that fewest of these classes have first.

        As many are taken as the class can lack of an alike one, and COMMON more; so two alike classes have COMMON of them
        in common, or ``least`` of the class, where it has few. ``owner`` is sorted by value, and ``start`` tells where
        each value's owners begin.
        """
        flat = np.unique(np.concatenate([thin[i].astype(np.int64) + (k << 16) for k, i in enumerate(alive.tolist())]))
        owner, value = flat >> 16, flat & 0xFFFF
        rare = np.bincount(value, minlength=1 << 16)[value]
        order = np.lexsort((value, rare, owner))
        owner, value = owner[order], value[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        lack = self.n[alive] - -(-self.percent * self.n[alive] // 100)
        least = np.zeros(len(self.n), np.int64)
        least[alive] = np.clip(np.bincount(owner, minlength=len(alive)) - lack, 1, COMMON)
        some = place < (lack + COMMON)[owner]
        owner, value = owner[some], value[some]
        order = np.argsort(value, kind="stable")
        return alive[owner[order]], value[order], np.searchsorted(value[order], np.arange((1 << 16) + 1)), least

    def likeliest(self, thin: list[np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray, bool]:
        """For each class outside the largest component, the ``top`` classes of other components that can be alike and
        share the most of ``thin`` (16 bits of each shingle), and whether these are all there are.

        Only classes that share some of their rarest shingles here are looked at, so that many unlike ones that meet at
        a common shingle cost little more than their number.
        """
        alive, minor = self.alive()
        seen, table, all_ = np.zeros(len(self.n), bool), np.zeros(1 << 16, bool), True
        left, right = [alive[:0]], [alive[:0]]
        if not len(minor):
            return left[0], right[0], all_
        owner, value, start, least = self.postings(alive, thin)
        by_class = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[by_class], np.arange(len(self.n) + 1))
        for u in minor.tolist():
            seen[u] = True  # what has been paired with u
            own = value[by_class[ends[u] : ends[u + 1]]].tolist()
            v, times = np.unique(np.concatenate([owner[start[x] : start[x + 1]] for x in own]), return_counts=True)
            v = v[(times >= least[u]) & ~seen[v]]
            v = v[self.possible(np.full(len(v), u), v)]
            if not len(v):
                continue
            table[thin[u]] = True
            size = np.array([len(thin[i]) for i in v.tolist()])
            most = np.add.reduceat(table[np.concatenate([thin[i] for i in v.tolist()])].astype(np.int64), np.cumsum(size) - size)
            table[thin[u]] = False
            good = 100 * most >= self.percent * (self.n[u] + self.n[v] - most)
            v, most = v[good], most[good]
            all_ &= len(v) <= top
            v = v[np.lexsort((self.ids[v], -most))[:top]]
            left.append(np.full(len(v), u))
            right.append(v)
        return np.concatenate(left), np.concatenate(right), all_


CANDIDATES = "a long, b long, na long, nb long, votes long"


def _distinct(left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once."""
    low, high = np.minimum(ids[left], ids[right]), np.maximum(ids[left], ids[right])
    order = np.lexsort((high, low))
    new = np.ones(len(order), bool)
    new[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
    return left[order[new]], right[order[new]]


def _told(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> pa.Table:
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else order
    return pa.table({"a": a[head], "b": b[head], "na": na[head], "nb": nb[head], "votes": np.diff(np.append(head, len(a)))})


def _found(left: np.ndarray, right: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray, token: np.ndarray, open_: np.ndarray) -> pa.Table:
    """CANDIDATES of the pairs, and of the rows ``open_``, at whose shingle pairs are left."""
    first = ids[left] < ids[right]
    left, right = np.where(first, left, right), np.where(first, right, left)
    rest = pa.table({"a": ids[open_], "b": pa.nulls(len(open_), pa.int64()), "na": n[open_], "nb": at[open_], "votes": token[open_].astype(np.int64)})
    return pa.concat_tables([_told(ids[left], ids[right], n[left], n[right]), rest])


def _candidates(classes: DataFrame, parts: int, percent: int, round_: int) -> DataFrame:
    """``a, b, na, nb, votes``: pairs of ``classes`` (``id, n, prefix, root``) to compare, each once from each part of the shingles.

    In round 0 ``a`` is a class and ``b`` the pivot of ``votes`` of its shingles; later ``a < b``, and ``b`` is null for
    the classes at a mixed shingle: there ``a`` and ``na`` are a class and its size, ``nb`` is the place of the shingle in
    it, and ``votes`` the shingle.
    """
    mixed = MIXED

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("prefix").nbytes
            if size >= DEAL_BYTES:
                yield dealt_out(held)
                held, size = [], 0
        if held:
            yield dealt_out(held)

    def dealt_out(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        tokens = [_wide(x) for batch in batches for x in batch.column("prefix").to_pylist()]
        ids, n, root = (np.concatenate([batch.column(c).to_numpy() for batch in batches]) for c in ("id", "n", "root"))
        size = np.array([len(t) for t in tokens], np.int64)
        flat, row = np.concatenate([np.zeros(0, np.uint64), *tokens]), np.repeat(np.arange(len(ids)), size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        if not round_:
            some = (flat >> np.uint64(8)) % np.uint64(SAMPLE) == 0
            flat, row, at = flat[some], row[some], at[some]
        order = np.lexsort((flat, flat % np.uint64(parts)))
        flat, row, at = flat[order], row[order], at[order].astype(np.uint32)
        part = (flat % np.uint64(parts)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, place = np.unique(row[a:b], return_inverse=True)
            out.append((int(part[a]), pack_arrays(np.diff(flat[a:b], prepend=np.uint64(0)), place.astype(np.uint32), at[a:b], ids[own], n[own].astype(np.uint32), root[own] - ids[own])))
        return pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in out], pa.int32()), "payload": pa.array([x for _, x in out], pa.binary())})

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        got = [unpack_arrays(x) for x in group.column("payload").to_pylist()]
        token = np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(g[0], dtype=np.uint64) for g in got)])
        order = np.argsort(token, kind="stable")
        same = np.diff(token[order]) == 0
        shared = order[np.append(same, False) | np.insert(same, 0, False)] if len(order) else order
        base = np.cumsum([0, *(len(g[3]) for g in got)])
        place = np.concatenate([np.zeros(0, np.int64), *(g[1].astype(np.int64) + b for g, b in zip(got, base, strict=False))])[shared]
        at = np.concatenate([np.zeros(0, np.int64), *(g[2].astype(np.int64) for g in got)])[shared]
        ids, n, moved = (np.concatenate([np.zeros(0, np.int64), *(g[k].astype(np.int64) for g in got)])[place] for k in (3, 4, 5))
        token, root = token[shared], ids + moved
        return remaining(token, ids, n, at, root) if round_ else nominated(token, ids, n, at)

    def nominated(token: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.Table:
        order = np.lexsort((ids, at, token))
        token, ids, n, at = token[order], ids[order], n[order], at[order]
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else order
        pivot = np.repeat(head, np.diff(np.append(head, len(token))))
        members = Members(ids, n, at, ids, percent)
        some = np.flatnonzero(members.possible(np.arange(len(ids)), pivot))
        return _told(ids[some], ids[pivot[some]], n[some], n[pivot[some]])

    def remaining(token: np.ndarray, ids: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray) -> pa.Table:
        head = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        ends = np.append(head[1:], len(token))
        several = np.minimum.reduceat(root, head) != np.maximum.reduceat(root, head) if len(head) else head
        left, right, open_, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for a, b in zip(head[several].tolist(), ends[several].tolist(), strict=True) if len(head) else []:
            members = Members(ids[a:b], n[a:b], at[a:b], root[a:b], percent)
            u, v, all_ = members.pairs(mixed)
            left.append(u + a)
            right.append(v + a)
            size += len(u)
            if size > 1 << 20:
                u, v = _distinct(np.concatenate(left), np.concatenate(right), ids)
                left, right, size = [u], [v], 0
            if not all_:
                open_.append(members.alive()[0] + a)
        left, right = _distinct(np.concatenate(left), np.concatenate(right), ids)
        return _found(left, right, ids, n, at, token, np.concatenate(open_))

    return classes.mapInArrow(deal, "part int, payload binary").groupBy("part").applyInArrow(meet, CANDIDATES)


def _sides(open_: DataFrame, roots: DataFrame, thin: DataFrame) -> DataFrame:
    """``bundle, low, high, side, id, n, at, root, thin``: the classes that meet at mixed shingles of several components, any two sides of them together and each side alone.

    ``open_`` (``token, id, n, at``) has the classes at each shingle. Shingles with the same smallest class are one bundle,
    so that a class travels once for many shingles that it shares with the same others; ``at`` is the first of its places
    there. A bundle has as many sides as SIDE_SHINGLES asks for, so no group holds more than two, however many classes meet.
    """
    rows = _with_root(open_, roots, "id", "root")
    several = rows.groupBy("token").agg(F.min("id").alias("bundle"), F.min("root").alias("_low"), F.max("root").alias("_high")).filter("_low < _high")
    rows = rows.join(_small(written(several.select("token", "bundle"), "bundles")), "token")
    rows = written(rows.groupBy("bundle", "id").agg(F.first("n").alias("n"), F.min("at").alias("at"), F.first("root").alias("root")), "bundled")
    count = written(rows.groupBy("bundle").agg(F.ceil(F.sum("n") / F.lit(SIDE_SHINGLES)).cast("int").alias("sides")), "sides")
    rows = rows.join(_small(count), "bundle").join(thin, "id").withColumn("side", F.pmod(F.xxhash64("id"), F.col("sides")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return rows.select("bundle", F.least("side", "_other").alias("low"), F.greatest("side", "_other").alias("high"), "side", "id", "n", "at", "root", "thin")


def _likeliest(sides: DataFrame, percent: int, top: int) -> DataFrame:
    """CANDIDATES of ``_sides``: for each class outside the largest component of a group the ``top`` likeliest others; a bundle that has more is open as one shingle."""

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        bundle, low, high = (x.as_py() for x in key)
        side, ids, n, at, root = (group.column(c).to_numpy() for c in ("side", "id", "n", "at", "root"))
        members = Members(ids, n, at, root, percent, side if low < high else None)
        left, right, all_ = members.likeliest([np.frombuffer(x, np.uint16) for x in group.column("thin").to_pylist()], top)
        return _found(left, right, ids, n, at, np.full(len(ids), bundle), members.alive()[0][: 0 if all_ else None])

    return spread(sides, "bundle", "low", "high").groupBy("bundle", "low", "high").applyInArrow(meet, CANDIDATES)


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` to broadcast, if they are few."""
    return F.broadcast(rows) if rows.limit(FEW + 1).count() <= FEW else rows


def _ordered(pairs: DataFrame) -> DataFrame:
    first = F.col("a") < F.col("b")
    return pairs.select(*(F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("a", "b", "a"), ("b", "a", "b"), ("na", "nb", "na"), ("nb", "na", "nb")))).distinct()


def _close(pairs: DataFrame, bins: DataFrame, percent: int) -> DataFrame:
    """``a, b, na, nb`` of those ``pairs`` whose counts by range still allow the likeness: no range shares more than its smaller side."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BINS) for c in ("left", "right"))
            most = np.minimum(left, right).sum(axis=1, dtype=np.int64)
            both = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            chosen = pa.array(100 * most >= percent * (both - most))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(chosen) for c in ("a", "b", "na", "nb")})

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "compared")
    own = written(bins.select("id", "bins").join(_small(ids), "id", "left_semi").dropDuplicates(["id"]), "bins")  # repeated rows are one
    left, right = (own.select(F.col("id").alias(x), F.col("bins").alias(y)) for x, y in (("a", "left"), ("b", "right")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "left", "right").mapInArrow(possible, "a long, b long, na long, nb long")


def _meetings(pairs: DataFrame) -> DataFrame:
    """``hub, slot, other`` of each of ``pairs``: the side with more partners is the hub, whose partners are dealt to slots of about PARTNERS."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    degrees = written(sides, "degrees")
    for x in "ab":
        pairs = pairs.join(degrees.select(F.col("id").alias(x), F.col("n").alias(f"d{x}")), x)
    first = F.col("da") >= F.col("db")
    slots = F.ceil(F.greatest("da", "db") / F.lit(PARTNERS))
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), slots.alias("_s")).select("hub", F.pmod(F.xxhash64("other"), F.col("_s")).cast("long").alias("slot"), "other")


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (``a, b, na, nb``) whose sets are as alike as asked.

    A document that has many partners meets them in slots: it sends the fragments of its set once for each slot of
    partners, and a partner sends its own once for each such document. The overlap of each fragment is counted where
    they meet, and the counts are summed for each pair.
    """
    blocks = block_count(docs)

    def cut(key: tuple, group: pa.Table, wanted: pa.Table) -> pa.Table:
        meetings: dict[int, list[tuple[int, int]]] = {}
        for i, hub, slot in zip(*(wanted.column(c).to_pylist() for c in ("doc_id", "hub", "slot")), strict=True) if wanted.num_rows else []:
            meetings.setdefault(i, []).append((hub, slot))
        rows = []
        for own, texts in unpacked(group.column("payload")) if meetings and group.num_rows else []:
            chosen = [(d, meetings.pop(d), t) for d, t in zip(own, texts, strict=True) if d in meetings]  # repeated rows count once
            for first, part in _chunked([t for _, _, t in chosen]):
                for row, s in _sets(part, size):
                    bounds = np.searchsorted(s, np.arange(1, FRAGMENTS).astype(np.uint64) * np.uint64((1 << 64) // FRAGMENTS))
                    i, places, _ = chosen[first + row]
                    rows += [(hub, slot, f, i, x.tobytes()) for f, x in enumerate(np.split(s, bounds)) if len(x) for hub, slot in places]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = {"hub": pa.int64(), "slot": pa.int64(), "fragment": pa.int32(), "id": pa.int64(), "hashes": pa.binary()}
        return pa.table({c: pa.array(x, k) for x, (c, k) in zip(columns, kinds.items(), strict=True)})

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = [], [], []
            for hub, sides in zip(batch.column("hub").to_pylist(), batch.column("sides"), strict=True):
                sides = {side["id"].as_py(): np.frombuffer(side["hashes"].as_buffer(), np.uint64) for side in sides.values}
                if (own := sides.pop(hub, None)) is not None:
                    for other, x in sides.items():
                        a.append(min(hub, other))
                        b.append(max(hub, other))
                        n.append(len(np.intersect1d(own, x, assume_unique=True)))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "overlap": pa.array(n, pa.int64())})

    meet = written(_meetings(pairs), "meetings")
    senders = meet.select(F.col("other").alias("doc_id"), "hub", "slot").unionByName(meet.select(F.col("hub").alias("doc_id"), "hub", "slot").distinct())
    wanted = written(senders.withColumn("block", block_of(blocks)), "wanted")
    docs = docs.join(_small(wanted.select("doc_id").distinct()), "doc_id", "left_semi")  # no others are dealt
    cuts = dealt(docs, blocks).groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(cut, "hub long, slot long, fragment int, id long, hashes binary")
    met = cuts.groupBy("hub", "slot", "fragment").agg(F.collect_list(F.struct("id", "hashes")).alias("sides")).filter(F.size("sides") > 1)
    total = met.select("hub", "sides").mapInArrow(overlaps, "a long, b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("o"))
    return total.join(pairs, ["a", "b"]).filter(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _thin(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """``id, thin``: the lower 16 bits of each shingle of the documents in ``ids``, each document once."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_chunks(batch.column("text"), CHUNK_BYTES):
                out = [(s & np.uint64(0xFFFF)).astype(np.uint16).tobytes() for _, s in _sets(part, size)]
                yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id").slice(first, len(part)), "thin": pa.array(out, pa.binary())})

    rows = docs.join(_small(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(made, "id long, thin binary")
    return rows.groupBy("id").agg(F.first("thin").alias("thin"))


def _with_root(rows: DataFrame, roots: DataFrame | None, key: str, name: str) -> DataFrame:
    if roots is None:
        return rows.withColumn(name, F.col(key))
    moved = roots.select(F.col("id").alias(key), F.col("root").alias("_root"))
    return rows.join(_small(moved), key, "left").withColumn(name, F.coalesce("_root", key)).drop("_root")


def _compared(classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``id, root`` of the ``classes`` (``id, n, bins, prefix``) that have links; the root names the component."""
    parts = block_count(docs, PART_BYTES)
    roots, tested, open_, thin, round_ = None, None, None, None, 0
    while True:
        if round_ < 2:
            found = _candidates(_with_root(classes.select("id", "n", "prefix"), roots, "id", "root"), parts, percent, round_)
        else:
            found = _likeliest(_sides(open_, roots, thin), percent, 4 ** (round_ - 2))
        if round_ == 0:
            votes = found.groupBy("a", "b", "na", "nb").agg(F.sum("votes").alias("votes"))
            best = votes.groupBy("a").agg(F.max(F.struct("votes", (-F.col("b")).alias("_b"), "b", "na", "nb")).alias("best"))
            pairs = written(_ordered(best.select("a", "best.b", "best.na", "best.nb")), "pairs")
            left = None
        else:
            found = written(found, "candidates")
            pairs = found.filter("b is not null").select("a", "b", "na", "nb").distinct()
            pairs = written(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            left = found.filter("b is null").select(F.col("votes").alias("token"), F.col("a").alias("id"), F.col("na").alias("n"), F.col("nb").alias("at")).distinct()
        tested = pairs if tested is None else tested.unionByName(pairs)
        close = written(_close(pairs, classes, percent), "close")
        links = written(_links(close, docs, size, percent), "links")
        edges = _with_root(_with_root(links, roots, "a", "ra"), roots, "b", "rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        moved = written(components(edges), "moved")  # vertex, root
        if roots is None:
            roots = moved.select(F.col("vertex").alias("id"), "root")
        else:
            new = moved.select(F.col("vertex").alias("id")).join(roots, "id", "left_anti").withColumn("root", F.col("id"))
            rows = roots.unionByName(new).join(moved.select(F.col("vertex").alias("root"), F.col("root").alias("_next")), "root", "left")
            roots = written(rows.select("id", F.coalesce("_next", "root").alias("root")), "roots")
        if left is not None:
            if left.isEmpty():
                return roots
            open_ = written(left, "open")
            if thin is None:
                thin = written(_thin(docs, open_.select("id").distinct(), size), "thin")
        round_ += 1


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` (long) for each row: the smallest id that links lead to.

    A document's set holds its distinct ``size``-word shingles, A-Z lower-cased; with fewer words, all of them as one;
    null, empty and blank texts have no shingle and no link. Two documents link when 100 times their overlap is
    ``percent`` times their union or more. The answer is components: a pair inside a component that other links have
    already made is not compared, so links are not listed or counted. Repeated rows are one document and each give a
    row; ids are otherwise taken as unique; a null id keeps its row, has a null component and links with nothing. An
    empty table gives an empty one.
    """
    docs = id_and_text(docs)
    known = docs.filter("doc_id is not null")
    table = written(shingle_sets(docs, size, percent, rarity_levels(docs, size)), "sets")
    same = table.filter("doc_id is not null and digest is not null")
    classes = written(same.groupBy("digest").agg(F.min("doc_id").alias("id")), "classes")
    copies = same.select("digest", "doc_id").join(classes, "digest").filter("doc_id <> id").select("digest", "doc_id").distinct()  # fewer than classes, so that prefixes seldom travel
    first = same.join(_small(written(copies, "copies")), ["digest", "doc_id"], "left_anti").select(F.col("doc_id").alias("id"), "n", "bins", "prefix")
    roots = _compared(written(first, "representatives"), known, size, percent)
    rows = table.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes.select("digest", "id"), "digest", "left")
    low = written(roots.join(roots.groupBy("root").agg(F.min("id").alias("low")), "root").select("id", "low"), "low")
    return rows.join(low, "id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "id", "doc_id")).alias("component_id"))
