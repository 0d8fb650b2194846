"""Many small groups at once: tasks take their sorted rows as a stream and hand whole groups on, a batch at a time.

A frame for each group costs milliseconds; here a batch of thousands of rows is one call. The number of tasks follows
from the cores, as groups are few bytes but much work. What a task holds is a batch and the largest group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt by ``by`` to three tasks a core, which small rows don't make fewer."""
    return df.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, *by)


def _changes(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """The places whose row starts another group than the row before."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in by:
        v = batch.column(name).to_numpy(zero_copy_only=False)
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1


def grouped(df: DataFrame, by: list[str], f: Callable[[pa.Table, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``f`` gives for tables of whole groups and the places of their first rows; rows of a group stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            return f(table, np.append(0, _changes(table.to_batches(max_chunksize=None)[0], by)))

        for batch in batches:
            if not batch.num_rows:
                continue
            inner = _changes(batch, by)
            fresh = bool(held) and any(held[-1].column(x)[-1] != batch.column(x)[0] for x in by)
            if not len(inner) and not fresh:
                held.append(batch)
                continue
            last = int(inner[-1]) if len(inner) else 0
            if last:
                held.append(batch.slice(0, last))
            yield told()
            held = [batch.slice(last)]
        if held:
            yield told()

    return spread(df, *by).sortWithinPartitions(*by).mapInArrow(run, schema)
