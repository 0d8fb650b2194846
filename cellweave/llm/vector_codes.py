"""Vectors as codes of part codebooks: rounds of exact assignment, each part's nearest entry found in a vantage-point tree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import written
from .vectors import long_or_null, matrix, whole_vectors

#: An entry c counts as floor(SCALE * c).
SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Entries that a tree keeps in one leaf.
LEAF = 4
#: Numbers of this size and more are squared as Python's whole numbers.
_WIDE = 1 << 28


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``(n, w)`` points to one entry, in the points' own kind of whole numbers."""
    d = points - entry
    return (d * d).sum(axis=1) if d.dtype == object else np.einsum("ij,ij->i", d, d)


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays as they are if longs hold all squared distances between them, else as Python's whole numbers."""
    most = max((float(np.abs(a.astype(float)).max()) for a in arrays if a.size), default=0.0)
    return list(arrays) if most < _WIDE and arrays[0].shape[1] <= 32 else [a.astype(object) for a in arrays]


def _below(d2: np.ndarray | float) -> np.ndarray:
    """A root that is no larger than the true one."""
    return np.maximum(np.sqrt(np.asarray(d2, float)) * (1 - 1e-12) - 1e-12, 0.0)


def _above(d2: np.ndarray | float) -> np.ndarray:
    """A root that is no smaller than the true one."""
    return np.sqrt(np.asarray(d2, float)) * (1 + 1e-12) + 1e-12


@dataclass(frozen=True)
class Ball:
    """Entries around a vantage entry: ``low`` and ``high`` bound their distances to it, rounded away from them."""

    entries: np.ndarray
    vantage: int = -1
    children: tuple[tuple[float, float, "Ball"], ...] = ()


def tree(codebook: np.ndarray, entries: np.ndarray | None = None, leaf: int = LEAF) -> Ball:
    """A vantage-point tree over ``(k, w)`` entries: the one farthest from the first is the vantage, the rest are halved by distance to it."""
    entries = np.arange(len(codebook)) if entries is None else entries
    if len(entries) <= leaf:
        return Ball(entries)
    vantage = int(entries[int(np.argmax(squared(codebook[entries], codebook[entries[0]])))])
    rest = entries[entries != vantage]
    d2 = squared(codebook[rest], codebook[vantage])
    order = np.argsort(d2, kind="stable")
    halves = [order[: len(order) // 2], order[len(order) // 2 :]]
    children = [(float(_below(min(d2[h]))), float(_above(max(d2[h]))), tree(codebook, rest[np.sort(h)], leaf)) for h in halves if len(h)]
    return Ball(entries, vantage, tuple(children))


class Search:
    """Nearest entries of many points at once: branch and bound down one tree, exact by whole numbers."""

    def __init__(self, codebook: np.ndarray, leaf: int = LEAF):
        self.given, self.root = codebook, tree(exact(codebook)[0], leaf=leaf)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (of equally near ones the lowest) and its squared distance, for each of ``(n, w)``."""
        self.points, self.codebook = exact(points, self.given)
        self.index = np.full(len(points), len(self.given))
        self.best = np.full(len(points), np.iinfo(np.int64).max) if self.points.dtype != object else np.full(len(points), float("inf"), object)
        self._visit(self.root, np.arange(len(points)))
        return self.index, self.best

    def _try(self, entry: int, rows: np.ndarray) -> np.ndarray:
        d2 = squared(self.points[rows], self.codebook[entry])
        closer = ((d2 < self.best[rows]) | ((d2 == self.best[rows]) & (entry < self.index[rows]))).astype(bool)
        self.best[rows[closer]], self.index[rows[closer]] = d2[closer], entry
        return d2

    def _visit(self, ball: Ball, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if ball.vantage < 0:
            for entry in ball.entries.tolist():
                self._try(entry, rows)
            return
        d2 = self._try(ball.vantage, rows)
        low, high = _below(d2), _above(d2)
        gaps = [np.maximum(np.maximum(low - far, near - high), 0.0) for near, far, _ in ball.children]
        nearer = gaps[0] <= gaps[-1]
        for first in (True, False):  # rows that are nearer to the inner half take it first, the others the outer one
            own = np.flatnonzero(nearer == first)
            for k in (range(len(gaps)) if first else reversed(range(len(gaps)))):
                open_ = gaps[k][own] <= _above(self.best[rows[own]])  # an equally near entry may have a lower index
                self._visit(ball.children[k][2], rows[own[open_]])


def parts_of(x: np.ndarray, parts: int) -> list[np.ndarray]:
    """``(n, d)`` cut into equal consecutive parts; a width that they don't divide is filled up with zeros."""
    short = -x.shape[1] % parts
    x = np.pad(x, ((0, 0), (0, short))) if short else x
    return np.split(x, parts, axis=1)


def _assigned(x: np.ndarray, searches: list[Search]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [s.nearest(np.ascontiguousarray(p)) for s, p in zip(searches, parts_of(x, len(searches)), strict=True)]


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Each part of the ``entries`` rows with the smallest ids (nulls last, of equal ids the smaller vector first)."""
    x = np.array([r["x"] for r in rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()], np.int64)
    return parts_of(x, parts) if len(x) else []


def improved(rows: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: the componentwise floor of the mean of the parts that an entry is nearest to; unused ones stay.

    A task sends one row of sums for each entry that it has used; sums are exact.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(c) for c in codebooks]
        totals: dict[tuple[int, int], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            for part, (index, own) in enumerate(zip((a[0] for a in _assigned(x, searches)), parts_of(x, len(codebooks)), strict=True)):
                own = own if int(np.abs(own.astype(float)).max()) * len(own) < 1 << 62 else own.astype(object)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                for entry, sums, n in zip(used.tolist(), np.add.reduceat(own[order], starts, axis=0), np.diff([*starts, len(order)]).tolist(), strict=True):
                    there = totals.setdefault((part, entry), [0, np.zeros(own.shape[1], object)])
                    there[0] += n
                    there[1] = there[1] + sums.astype(object)
        if totals:
            keys = [(part, entry, k) for part, entry in totals for k in range(len(totals[part, entry][1]))]
            cols = [pa.array([key[c] for key in keys], pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([totals[p, e][0] for p, e, _ in keys], pa.int64()), pa.array([str(int(totals[p, e][1][k])) for p, e, k in keys])], names=["part", "entry", "k", "n", "s"])

    sums = rows.select("x").mapInArrow(summed, "part int, entry int, k int, n long, s string")
    out = [c.copy() for c in codebooks]
    for r in sums.groupBy("part", "entry", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        out[r["part"]][r["entry"], r["k"]] = int(r["s"]) // r["n"]
    return out


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of each kept row of ``embeddings`` (``vec_id, embedding, label``).

    Which rows are kept says ``whole_vectors``. ``code`` has two hex digits for each part, so up to 256 entries;
    ``error`` is the exact squared distance of the whole vector to its entries, ``label_error`` its sum over equal
    labels, nulls together. Fewer rows than ``entries`` give as many entries. Equally near entries go to the lowest
    index, equal entries too. Sums that no long holds are null. Repeated rows count and are returned each, null ids
    stay null and come after all others; an empty table gives none. Codebooks travel to every task: parts * entries
    rows of them, however many vectors there are. A label may hold most of the rows: errors are summed in the tasks
    first, and the join with the sums can be split.
    """
    if not 1 <= entries <= 256:
        raise ValueError(f"a code holds 1 to 256 entries, not {entries}")
    rows = written(whole_vectors(embeddings, SCALE, 0, "label"), "vectors")
    codebooks = first_codebooks(rows, parts, entries)
    for _ in range(rounds if codebooks else 0):
        codebooks = improved(rows, codebooks)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(c) for c in codebooks]
        for batch in batches:
            if batch.num_rows:
                found = _assigned(matrix(batch.column("x")), searches)
                index = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
                error = sum((e.astype(object) if any(x.dtype == object for _, x in found) else e for _, e in found[1:]), found[0][1])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in index]), long_or_null(error)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    made = written(rows.mapInArrow(coded, f"vec_id long, label {label}, code string, error long"), "codes")
    sums = made.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return made.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
