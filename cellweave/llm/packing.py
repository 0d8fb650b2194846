"""Vector best-fit packing of tokenised documents into sequences under three capacities.

The vector of a piece is fixed by its length: its tokens, one document, and the attention cost length^2. So the
choice of bins depends on the lengths' histogram alone, which has at most ``max_tokens`` rows at any input size:
it is packed by length, longest first, whole groups of alike bins at a time, and the documents are dealt to the
plan's places by their rank within their length.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import block_count, block_of, id_and_text, written
from .pretokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most, and what each of the three counts for when bins are compared."""

    tokens: int = 2048
    documents: int = 2048
    attention_cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "residual_norm"  # or "dot_product"

    def vector(self, length: int) -> tuple[int, int, int]:
        return length, 1, length * length

    def full(self) -> tuple[int, int, int]:
        return self.tokens, self.documents, self.attention_cost


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``max_tokens`` from its end: the first may be shorter.

    Columns ``doc_id, piece, start, length, ids_crc32, block``. A null text counts as empty and gives one piece.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            doc_ids, blocks = batch.column("doc_id").to_pylist(), batch.column("block").to_pylist()
            for first, ids, bounds in encoder(tokenizer_path).encode(batch.column("text")):
                out = []
                for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.concatenate([ids[a:b].astype("<u4"), end])
                    head = len(own) % max_tokens or max_tokens
                    cuts = [0, *range(head, len(own) + 1, max_tokens)]
                    out += [(doc_ids[first + i], k, x, y - x, zlib.crc32(own[x:y].tobytes()), blocks[first + i]) for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]
                if out:
                    columns = list(zip(*out, strict=True))
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "block"])

    docs = id_and_text(docs)
    return docs.withColumn("block", block_of(block_count(docs))).mapInArrow(pieces, PIECES)


def plan(histogram: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first bin, places a bin, offset) for runs of alike pieces.

    Best fit, longest first: each piece goes to the open bin whose residual, less the piece, has the least
    weighted norm (or to that with the largest weighted dot product), if every capacity still holds it.
    """
    scale = [w / c for w, c in zip(capacity.weights, capacity.full(), strict=True)]
    groups: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residual: intervals of bins
    out, bins = [], 0

    def worth(residual: tuple[int, ...], item: tuple[int, ...]) -> float:
        if capacity.rule == "dot_product":
            return -sum(r * x * s * s for r, x, s in zip(residual, item, scale, strict=True))
        return sum(((r - x) * s) ** 2 for r, x, s in zip(residual, item, scale, strict=True))

    for length in sorted(histogram, reverse=True):
        item, left, rank = capacity.vector(length), histogram[length], 0
        if any(x > c for x, c in zip(item, capacity.full(), strict=True)):
            raise ValueError(f"a piece of {length} tokens is over the capacity")
        fitting = [(worth(r, item), r) for r in groups if all(a >= b for a, b in zip(r, item, strict=True))]
        heapq.heapify(fitting)
        while left:
            if fitting:
                _, residual = heapq.heappop(fitting)
                intervals = groups.pop(residual)
            else:
                most = min(c // x for c, x in zip(capacity.full(), item, strict=True) if x)
                residual, intervals = capacity.full(), [(bins, bins + -(-left // most))]
                bins = intervals[0][1]
            most = min(r // x for r, x in zip(residual, item, strict=True) if x)
            offset = capacity.tokens - residual[0]
            while intervals and left:
                low, high = intervals.pop()
                whole = min(high - low, left // most)
                for first, count, each in ((low, whole, most), (low + whole, int(whole < high - low and left > whole * most), left - whole * most)):
                    if count:
                        out.append((length, rank, rank + count * each, first, each, offset))
                        rank, left = rank + count * each, left - count * each
                        rest = tuple(r - each * x for r, x in zip(residual, item, strict=True))
                        groups.setdefault(rest, []).append((first, first + count))
                        low = first + count
                if low < high:
                    intervals.append((low, high))
            if intervals:
                groups.setdefault(residual, []).extend(intervals)
    return out


def vector_best_fit(pieces: DataFrame, capacity: Capacity | None = None) -> DataFrame:
    """Adds ``sequence_id, offset`` (long) to ``pieces`` (``doc_id, piece, length, block`` and others).

    ``pieces`` is read twice and should be a written table. The histogram of lengths (at most ``capacity.tokens``
    rows) is all that the driver sees; ranks within a length are counted by block and then carried over the
    blocks. Ties of length go by block, id and piece. An empty table gives an empty result.
    """
    spark: SparkSession = pieces.sparkSession
    capacity = capacity or Capacity()
    counts = written(pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.createDataFrame(plan(histogram, capacity), "length long, low long, high long, first_bin long, places long, run_offset long")
    before = counts.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("block", "length").orderBy("doc_id", "piece", "start")) - 1)
    ranked = ranked.join(before, ["length", "block"]).withColumn("_rank", F.col("_rank") + F.col("before"))
    # one array of runs for each length: an equi-join on at most capacity.tokens rows instead of a range join
    lists = runs.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("low", "first_bin", "places", "run_offset"))).alias("runs"))
    placed = ranked.join(F.broadcast(lists), "length").withColumn("_run", F.element_at(F.expr("filter(runs, r -> r.low <= _rank)"), -1))
    return placed.select(
        *[c for c in pieces.columns if c != "block"],
        (F.col("_run.first_bin") + F.expr("(_rank - _run.low) div _run.places")).alias("sequence_id"),
        (F.col("_run.run_offset") + (F.col("_rank") - F.col("_run.low")) % F.col("_run.places") * F.col("length")).alias("offset"),
    )


def packed(docs: DataFrame, tokenizer_path: str, capacity: Capacity | None = None) -> DataFrame:
    """All documents as pieces with their places in sequences; see ``token_pieces`` and ``vector_best_fit``."""
    capacity = capacity or Capacity()
    return vector_best_fit(written(token_pieces(docs, tokenizer_path, capacity.tokens), "pieces"), capacity)
