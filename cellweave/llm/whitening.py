"""Whitened embeddings: a covariance summed over tiles of dimension pairs, its eigenvectors, and every row projected on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import pack_arrays, unpack_arrays, written
from .vectors import lists, long_or_null, matrix, whole_vectors

#: Dimensions of a column block; a tile is a pair of column blocks.
TILE = 16
#: Entries of a row-block.
BLOCK_ENTRIES = 1 << 18
#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
_SUMS = "i int, j int, value double"


@dataclass(frozen=True)
class Centre:
    """Exact totals of whole-number vectors: ``n`` rows and their sums by dimension."""

    n: int
    sums: tuple[int, ...]

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where they fit, else Python's whole numbers."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        near = x.astype(object) - base if len(x) and int(np.abs(x.astype(float)).max()) > 1 << 61 else x - base
        if len(x) and self.n * (int(np.abs(near).max()) + 1) >= 1 << 62:
            return near.astype(object) * self.n - rest
        return near * self.n - rest.astype(np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in double precision, divided once."""
        return (self.scaled(x) / self.n).astype(float)

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """The sum of (n * x - S)^2 over the dimensions, exact."""
        a = self.scaled(x)
        if a.dtype != object and len(a) and int(np.abs(a).max()) ** 2 * a.shape[1] >= 1 << 63:
            a = a.astype(object)
        return (a * a).sum(axis=1)


def centre_of(rows: DataFrame) -> Centre:
    """The totals of ``x`` over all rows: one row of sums for each task and dimension travels."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                part = x.sum(axis=0) if int(np.abs(x.astype(float)).max()) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
                n, total = n + len(x), part.astype(object) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()), "s": pa.array([str(int(v)) for v in total])})

    found = rows.select("x").mapInArrow(summed, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found.sort(key=lambda r: r["i"])
    return Centre(found[0]["n"] if found else 0, tuple(int(r["s"]) for r in found))


def column_blocks(rows: DataFrame, tile: int = TILE, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``row_block, col_block, payload``: rows of a task of up to ``block_entries`` entries make a row-block, cut into blocks of ``tile`` dimensions."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row_block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            x = np.concatenate(held)
            parts = [pack_arrays(np.ascontiguousarray(x[:, a : a + tile]).ravel()) for a in range(0, x.shape[1], tile)]
            return pa.RecordBatch.from_pydict({"row_block": pa.array([row_block] * len(parts), pa.int64()), "col_block": pa.array(range(len(parts)), pa.int32()), "payload": pa.array(parts, pa.binary())})

        for batch in batches:
            x = matrix(batch.column("x"))
            step = max(1, block_entries // max(1, x.shape[1]))
            for at in range(0, len(x), step):
                held.append(x[at : at + step])
                size += len(held[-1])
                if size >= step:
                    yield out()
                    row_block, held, size = row_block + 1, [], 0
        if held:
            yield out()

    return rows.select("x").mapInArrow(cut, "row_block long, col_block int, payload binary")


def tiled_covariance(rows: DataFrame, centre: Centre, tile: int = TILE, block_entries: int = BLOCK_ENTRIES) -> np.ndarray:
    """The covariance of ``x`` (divisor n, centred before multiplying), as ``(d, d)`` on the driver.

    Column blocks travel once, by row-block. A task multiplies the pairs of column blocks of each of its row-blocks
    and adds the products up by tile, so that it holds one row-block and d * d / 2 sums and sends each sum once; the
    tasks' sums of a tile are then added by dimension pair. Only the d * (d + 1) / 2 totals come to the driver.
    """
    d = len(centre.sums)
    starts = list(range(0, d, tile))

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        at, blocks = None, {}

        def add() -> None:
            centred = {}
            for k, flat in blocks.items():
                own = Centre(centre.n, centre.sums[starts[k] : starts[k] + tile])
                centred[k] = own.centred(flat.reshape(-1, len(own.sums)))
            for a in centred:
                for b in centred:
                    if a <= b:
                        totals[a, b] = centred[a].T @ centred[b] + totals.get((a, b), 0.0)

        for batch in batches:
            for row_block, col_block, payload in zip(*(batch.column(c) for c in ("row_block", "col_block", "payload")), strict=True):
                if row_block.as_py() != at:
                    add()
                    at, blocks = row_block.as_py(), {}
                blocks[col_block.as_py()] = unpack_arrays(payload.as_py())[0]
        add()
        for (a, b), sums in totals.items():
            i, j = (x.ravel() for x in np.meshgrid(np.arange(sums.shape[0]) + starts[a], np.arange(sums.shape[1]) + starts[b], indexing="ij"))
            once = i <= j
            yield pa.RecordBatch.from_arrays([pa.array(i[once], pa.int32()), pa.array(j[once], pa.int32()), pa.array(sums.ravel()[once])], names=["i", "j", "value"])

    dealt = column_blocks(rows, tile, block_entries).repartition("row_block").sortWithinPartitions("row_block", "col_block")
    return _assembled(dealt.mapInArrow(multiplied, _SUMS), d) / max(1, centre.n)


def _assembled(sums: DataFrame, d: int) -> np.ndarray:
    """The symmetric matrix of ``i, j, value`` (i <= j), values of equal places added."""
    out = np.zeros((d, d))
    for i, j, value in sums.groupBy("i", "j").agg(F.sum("value")).collect():
        out[i, j] = out[j, i] = value
    return out


@dataclass(frozen=True)
class Model:
    """What whitening needs: totals, up to ``count`` unit eigenvectors (columns, by falling eigenvalue), and the whole variance."""

    centre: Centre
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of their variance; no number for components without any."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.some, self.centre.centred(x) @ self.vectors / np.sqrt(self.values), np.nan)

    @property
    def some(self) -> np.ndarray:
        """Which components have a variance above what rounding leaves of none."""
        return self.values > len(self.centre.sums) * np.finfo(float).eps * self.trace


def fitted(rows: DataFrame, count: int = 32, tile: int = TILE, block_entries: int = BLOCK_ENTRIES) -> Model:
    """The model of all ``rows`` (``x``)."""
    centre = centre_of(rows)
    values, vectors = np.linalg.eigh(covariance := tiled_covariance(rows, centre, tile, block_entries))
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    return Model(centre, np.ascontiguousarray(vectors), np.maximum(values, 0.0), float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Model) -> float | None:
    """The largest absolute entry of the covariance of all whitened rows minus the identity; components without variance don't count."""
    some = model.some
    d = int(some.sum())

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                w = model.whitened(matrix(batch.column("x")))[:, some]
                total += w.T @ w
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "value"])

    if not d:
        return None
    return float(np.abs(_assembled(rows.select("x").mapInArrow(multiplied, _SUMS), d) / model.centre.n - np.eye(d)).max())


def whitened(embeddings: DataFrame, count: int = 32, tile: int = TILE, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: each kept row on each of ``count`` components.

    ``embeddings`` has ``vec_id`` and ``embedding``; which rows are kept says ``whole_vectors``. Fit and result take
    all of them, and the result's covariance is measured over all of them too. Eigenvectors of equal eigenvalues are
    any of their space. A component without variance (constant dimensions, fewer rows than dimensions) has a null
    ``whitened`` and is left out of ``identity_error``, which is null if there is no other. A deviation that no long
    holds is null. Repeated rows count and are returned each; null ids stay null; an empty table gives none.
    The driver and each task hold d * d sums for vectors of d entries, whatever the number of rows.
    """
    rows = written(whole_vectors(embeddings, SCALE, SHIFT), "vectors")
    model = fitted(rows, count, tile, block_entries)
    error = identity_error(rows, model) if model.centre.n else None
    explained = [float(v / model.trace) if model.trace > 0 else 0.0 for v in model.values]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("x"))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), long_or_null(model.centre.deviation(x)), lists(model.whitened(x), pa.float64())], names=["vec_id", "deviation", "w"])

    made = rows.mapInArrow(projected, "vec_id long, deviation long, w array<double>").select("vec_id", "deviation", F.posexplode("w").alias("_k", "_w"))
    share = F.get(F.array(*[F.lit(e) for e in explained]).cast("array<double>"), F.col("_k"))
    value = F.when(~F.isnan("_w"), F.col("_w"))
    return made.select("vec_id", (F.col("_k") + 1).alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation", value.alias("whitened"), share.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
