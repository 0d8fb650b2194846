"""What the operators on vectors share: which rows count, whole numbers of their entries, matrices of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LONG = (1 << 63) - 1


def finite(vector: Column) -> Column:
    """Whether a vector is there, has an entry, and none that is null, infinite or no number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & good


def whole_vectors(rows: DataFrame, scale: int, shift: int, *others: str) -> DataFrame:
    """``vec_id`` (long), ``others`` and ``x``, floor(scale * entry) + shift of each entry (long), of the rows that count.

    Left out are null vectors, those with a null or non-finite entry, empty ones, and vectors of another length than
    the commonest (of equally common ones the longest), which no matrix has a place for. Entries beyond what a long
    holds are taken as the largest or smallest one that leaves room for ``shift``. Other columns are not looked at.
    """
    vector = rows["embedding"].cast("array<double>")
    kept = rows.select(rows["vec_id"].cast("long").alias("vec_id"), *[rows[c].alias(c) for c in others], vector.alias("_e")).filter(finite(F.col("_e")))
    sizes = kept.groupBy(F.size("_e").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    width = sizes[0]["d"] if sizes else 0
    most = float(1 << 62)
    whole = F.transform("_e", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-most)), F.lit(most))) + F.lit(shift))
    return kept.filter(F.size("_e") == width).select("vec_id", *others, whole.alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as ``(rows, width)``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """``(rows, width)`` as lists."""
    n, d = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * d, d) if d else np.zeros(n + 1, int), pa.int32()), pa.array(values.reshape(-1), kind))


def long_or_null(values: np.ndarray) -> pa.Array:
    """Whole numbers of any size as longs, null where they don't fit."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -LONG - 1 <= v <= LONG else None for v in values], pa.int64())
