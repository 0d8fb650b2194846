"""Pixels of cells, their compartments, and intensity statistics per compartment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

CELL, NUCLEUS, CYTOPLASM, MEMBRANE = "CELL", "NUCLEUS", "CYTOPLASM", "MEMBRANE"
STATISTICS = {"Mean": "mean", "Median": "median", "Min": "min", "Max": "max", "Std.Dev.": "std"}


def with_membrane(pixels: DataFrame) -> DataFrame:
    """Adds ``is_membrane``: a pixel of whose four neighbours not all belong to the same cell. Outside is background."""
    row, column = Window.partitionBy("cell_id", "r").orderBy("c"), Window.partitionBy("cell_id", "c").orderBy("r")
    inner = F.lit(True)
    for axis, w in (("c", row), ("r", column)):
        inner = inner & F.coalesce(F.lag(axis).over(w) == F.col(axis) - 1, F.lit(False)) & F.coalesce(F.lead(axis).over(w) == F.col(axis) + 1, F.lit(False))
    return pixels.withColumn("is_membrane", ~inner)


def _bodies(cells: DataFrame, nuclei: DataFrame, whole: DataFrame, grown: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``cell_id, r, c, nucleus_label`` of the cells that have pixels of their own, and ``cell_id, r, c`` of those with a nucleus alone."""
    known = cells.select("cell_id", "nucleus_label", "whole_cell_label", F.col("match_source") if "match_source" in cells.columns else F.lit("").alias("match_source"))
    body = whole.filter("label > 0").join(known.filter("whole_cell_label is not null"), F.col("label") == F.col("whole_cell_label")).select("cell_id", "r", "c", "nucleus_label")
    if grown is not None:
        more = grown.join(known.filter("match_source = 'watershed_synth'"), F.col("label") == F.col("nucleus_label"))
        body = body.unionByName(more.select("cell_id", "r", "c", "nucleus_label"))
    bare = known.join(body.select("cell_id").distinct(), "cell_id", "left_anti")
    alone = nuclei.filter("label > 0").join(bare, F.col("label") == F.col("nucleus_label")).select("cell_id", "r", "c")
    return body, alone


def cell_places(cells: DataFrame, nuclei: DataFrame, whole: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """``cell_id, r, c`` of ``cell_pixels``, for what asks neither for nuclei nor for membranes."""
    body, alone = _bodies(cells, nuclei, whole, grown)
    return body.select("cell_id", "r", "c").unionByName(alone)


def cell_pixels(cells: DataFrame, nuclei: DataFrame, whole: DataFrame, grown: DataFrame | None = None) -> DataFrame:
    """``cell_id, r, c, is_nuc, is_membrane``: a cell's own pixels, and which of them its nucleus covers.

    A cell with a whole-cell label has that label's pixels, a synthesised one those that ``grown`` (``r, c, label``)
    gives its nucleus; the nucleus' own ones among them count as nucleus. One with a nucleus alone, or whose other
    pixels are gone, has the nucleus' pixels.
    """
    body, alone = _bodies(cells, nuclei, whole, grown)
    nuc = nuclei.filter("label > 0").select("r", "c", F.col("label").alias("nucleus_label"), F.lit(True).alias("_n"))
    body = body.join(nuc, ["r", "c", "nucleus_label"], "left").select("cell_id", "r", "c", F.coalesce("_n", F.lit(False)).alias("is_nuc"))
    return with_membrane(body.unionByName(alone.withColumn("is_nuc", F.lit(True))))


def bounded(cells: DataFrame) -> DataFrame:
    """``cell_id, _b``: whether a cell has a boundary of its own."""
    synthesised = F.col("match_source") == "watershed_synth" if "match_source" in cells.columns else F.lit(False)
    return cells.select("cell_id", (F.col("whole_cell_label").isNotNull() | synthesised).alias("_b"))


def compartments(pixels: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell_id, compartment, r, c``. Cytoplasm needs boundary and nucleus pixels, membrane a boundary; empty ones have no rows."""
    of = lambda name, when: F.when(when, F.lit(name))
    rows = pixels.withColumn("_n", F.max("is_nuc").over(Window.partitionBy("cell_id"))).join(bounded(cells), "cell_id")
    names = F.array(F.lit(CELL), of(NUCLEUS, F.col("is_nuc")), of(CYTOPLASM, F.col("_b") & F.col("_n") & ~F.col("is_nuc")), of(MEMBRANE, F.col("_b") & F.col("is_membrane")))
    return rows.select("cell_id", F.explode(F.array_compact(names)).alias("compartment"), "r", "c")


#: Sides of the squares of the image in which places meet it.
SQUARE = 64
#: Rows of a task that are packed at once.
_HELD = 1 << 18


def pack(table: pa.Table, by: list[str], more: list[str]) -> pa.RecordBatch:
    """``packed`` for the rows of one table."""
    r, c = (table[x].to_numpy().astype(np.int64) for x in ("r", "c"))
    table = table.select([*by, *more])
    for name, x, kind in (("by_", r // SQUARE, pa.int32()), ("bx_", c // SQUARE, pa.int32()), ("at", r % SQUARE * SQUARE + c % SQUARE, pa.int16())):
        table = table.append_column(name, pa.array(x, kind))
    keys, values = [*by, "by_", "bx_"], ["at", *more]
    made = table.group_by(keys, use_threads=False).aggregate([(x, "list") for x in values])
    return pa.RecordBatch.from_arrays([made[x].combine_chunks() for x in [*keys, *[f"{x}_list" for x in values]]], names=[*keys, *values])


def packed_schema(rows: DataFrame, by: list[str], more: list[str]) -> str:
    kinds = [f"{x} {rows.schema[x].dataType.simpleString()}" for x in by] + ["by_ int", "bx_ int", "at array<smallint>"]
    return ", ".join(kinds + [f"{x} array<{rows.schema[x].dataType.simpleString()}>" for x in more])


def packed(rows: DataFrame, by: list[str], more: list[str]) -> DataFrame:
    """``by, by_, bx_, at`` and ``more``: what a task holds of one group in one square of the image at a time is one row of lists; ``at`` is the place there.

    A group's rows that stand near each other travel together; others travel in more rows, but none is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= _HELD:
                yield pack(pa.Table.from_batches(held), by, more)
                held, n = [], 0
        if held:
            yield pack(pa.Table.from_batches(held), by, more)

    rows = rows.filter("r is not null and c is not null").select(*by, "r", "c", *more)
    return rows.mapInArrow(run, packed_schema(rows, by, more))


def _flat(lists: pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(lists).to_numpy()


def sampled(places: DataFrame, image: DataFrame, by: list[str]) -> DataFrame:
    """``by, ch, vals``: the values under each group of ``places``, a row for each square of the image that it meets.

    Places and image are dealt to squares, packed, and each square meets in one task. What lies outside the image has no values.
    What is ``packed`` already (places by ``by`` or finer, the image by ``ch``) is taken as it is.
    """
    squares = image if "at" in image.columns else packed(image.filter("v is not null"), ["ch"], ["v"])
    kind = squares.schema["v"].dataType.simpleString()
    known = ", ".join(f"{x} {places.schema[x].dataType.simpleString()}" for x in by)
    channel = squares.schema["ch"].dataType.simpleString()

    def values(at: pa.Table, square: pa.Table) -> pa.Table:
        groups = at.select(by).append_column("_k", pa.array(np.arange(at.num_rows))).group_by(by, use_threads=False).aggregate([("_k", "list")])
        rows = pc.list_flatten(groups["_k_list"])
        group = np.repeat(np.arange(groups.num_rows), pc.list_value_length(groups["_k_list"]).to_numpy())
        lists = at["at"].take(rows)
        group = np.repeat(group, pc.list_value_length(lists).to_numpy())
        wanted = _flat(lists)
        parts = []
        for ch in pc.unique(square["ch"]):
            own = square.filter(pc.equal(square["ch"], ch))
            v = pc.list_flatten(own["v"]).combine_chunks()
            row = np.full(SQUARE * SQUARE, -1)
            row[_flat(own["at"])] = np.arange(len(v))
            hit = row[wanted]
            n = np.bincount(group[hit >= 0], minlength=groups.num_rows)
            some = np.flatnonzero(n)
            found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[some])), pa.int32()), v.take(pa.array(hit[hit >= 0])))
            part = groups.select(by).take(pa.array(some)).append_column("ch", pa.array([ch.as_py()] * len(some), square.schema.field("ch").type))
            parts.append(part.append_column("vals", found))
        return pa.concat_tables(parts)

    def met(at: pa.Table, square: pa.Table) -> pa.Table:
        if at.num_rows and square.num_rows:
            return values(at, square)
        fields = [at.schema.field(x) for x in by] + [square.schema.field("ch"), pa.field("vals", square.schema.field("v").type)]
        return pa.schema(fields).empty_table()

    own = (places if "at" in places.columns else packed(places, by, [])).groupBy("by_", "bx_")
    return own.cogroup(squares.groupBy("by_", "bx_")).applyInArrow(met, f"{known}, ch {channel}, vals {kind}")


def gathered(samples: DataFrame, by: list[str]) -> DataFrame:
    """``by, vals``: all values of each group."""
    return samples.groupBy(*by).agg(F.flatten(F.collect_list("vals")).alias("vals"))


def _deviation(v: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Population deviation: exact sums for whole numbers, which no size of group overflows; else about the mean."""
    if v.dtype.kind == "f":
        off = v - np.repeat(v[starts], n)  # so that equal values have none
        off -= np.repeat(np.add.reduceat(off, starts) / n, n)
        return np.sqrt(np.add.reduceat(off * off, starts) / n)
    largest = max(abs(int(v.min())), abs(int(v.max())))
    if largest * largest * int(n.max()) ** 2 < 1 << 62:
        total, squares = np.add.reduceat(v, starts), np.add.reduceat(v * v, starts)
        return np.sqrt((n * squares - total * total).astype(float)) / n
    whole = v.astype(object)
    total, squares = np.add.reduceat(whole, starts), np.add.reduceat(whole * whole, starts)
    return np.array([math.sqrt(float(k * q - s * s)) / k for k, q, s in zip(n.tolist(), squares, total, strict=True)])


def statistics(groups: DataFrame, at: list[float]) -> DataFrame:
    """The columns of ``gathered`` but ``vals``, and ``n, mean, min, max, std`` and ``q``, the percentiles ``at`` (0 to 1) with linear interpolation."""
    kind = groups.schema["vals"].dataType.elementType.simpleString()
    keys = [x for x in groups.columns if x != "vals"]
    known = ", ".join(f"{x} {groups.schema[x].dataType.simpleString()}" for x in keys)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("vals")), 0))
            if not batch.num_rows:
                continue
            lists = batch.column("vals")
            n = pc.list_value_length(lists).to_numpy().astype(np.int64)
            v = lists.flatten().to_numpy(zero_copy_only=False)
            v = v.astype(np.float64 if v.dtype.kind == "f" else np.int64)
            starts = np.cumsum(n) - n
            v = v[np.lexsort((v, np.repeat(np.arange(len(n)), n)))]
            columns = [n, np.add.reduceat(v, starts) / n, v[starts], v[starts + n - 1], _deviation(v, starts, n)]
            q = np.empty((len(n), len(at)))
            for k, p in enumerate(at):
                place = (n - 1) * p
                low, high = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
                a, b = v[starts + low].astype(float), v[starts + high].astype(float)
                q[:, k] = np.where(a == b, a, (high - place) * a + (place - low) * b)
            arrays = [pa.array(x) for x in columns]
            arrays[2:4] = [x.cast(lists.type.value_type) for x in arrays[2:4]]
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(at), pa.int32()), pa.array(q.ravel())))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), *arrays], names=[*keys, "n", "mean", "min", "max", "std", "q"])

    return groups.mapInArrow(made, f"{known}, n long, mean double, min {kind}, max {kind}, std double, q array<double>")


def _shown(found: DataFrame, by: list[str], mode: str) -> DataFrame:
    median = [F.get("q", F.lit(0)).alias("median")] if mode == "exact" else []
    return found.select(*by, "n", "mean", "min", "max", "std", *median)


def intensity(places: DataFrame, image: DataFrame, by: list[str], mode: str = "exact") -> DataFrame:
    """``n, mean, min, max, std`` and, but for the fast modes, ``median`` of the image under each group of ``places``."""
    return _shown(statistics(gathered(sampled(places, image, by), [*by, "ch"]), [0.5]), [*by, "ch"], mode)


def _of_compartments(pixels: DataFrame, cells: DataFrame, image: DataFrame, at: list[float]) -> DataFrame:
    """``cell_id, ch, compartment`` and the ``statistics`` of each: every pixel meets the image once."""
    rows = pixels.join(bounded(cells), "cell_id").select("cell_id", "r", "c", "is_nuc", "is_membrane", "_b")
    rows = sampled(rows, image, ["cell_id", "is_nuc", "is_membrane", "_b"]).repartition("cell_id")
    rows = rows.withColumn("_n", F.max("is_nuc").over(Window.partitionBy("cell_id", "ch")))
    of = lambda name, when: F.when(when, F.lit(name))
    names = F.array(F.lit(CELL), of(NUCLEUS, F.col("is_nuc")), of(CYTOPLASM, F.col("_b") & F.col("_n") & ~F.col("is_nuc")), of(MEMBRANE, F.col("_b") & F.col("is_membrane")))
    rows = rows.select("cell_id", "ch", F.explode(F.array_compact(names)).alias("compartment"), "vals")
    return statistics(gathered(rows, ["cell_id", "ch", "compartment"]), at)


def compartment_intensity(pixels: DataFrame, cells: DataFrame, image: DataFrame, mode: str = "exact") -> DataFrame:
    """``cell_id, ch, compartment`` and the statistics of ``intensity``, from ``cell_pixels``."""
    return _shown(_of_compartments(pixels, cells, image, [0.5]), ["cell_id", "ch", "compartment"], mode)


def compartment_percentiles(pixels: DataFrame, cells: DataFrame, image: DataFrame, at: list[float], min_pixels: int = 0) -> DataFrame:
    """``cell_id, ch, compartment, p, value`` with linear interpolation; cells of fewer than ``min_pixels`` pixels have none."""
    if min_pixels:
        pixels = pixels.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("cell_id"))).filter(F.col("_size") >= min_pixels).drop("_size")
    rows = _of_compartments(pixels, cells, image, [p / 100.0 for p in at])
    pairs = F.arrays_zip(F.array(*[F.lit(float(p)) for p in at]).alias("p"), F.col("q").alias("value"))
    return rows.select("cell_id", "ch", "compartment", F.inline(pairs)).toDF("cell_id", "ch", "compartment", "p", "value")


def keyed(summary: DataFrame, channels: DataFrame) -> DataFrame:
    """``cell_id, key, value``: one row for each statistic, named like ``CD3: Nucleus: Mean``.

    Of channels that share a name the last counts.
    """
    present = [c for c in STATISTICS.values() if c in summary.columns]
    pairs = F.array(*[F.struct(F.lit(k).alias("s"), F.col(c).cast("double").alias("value")) for k, c in STATISTICS.items() if c in present])
    rows = summary.join(channels, "ch").select("cell_id", "ch", "name", "compartment", F.explode(pairs).alias("p"))
    key = F.concat_ws(": ", "name", F.initcap("compartment"), F.col("p.s"))
    return rows.groupBy("cell_id", key.alias("key")).agg(F.max_by("p.value", "ch").alias("value"))


def as_map(long: DataFrame) -> DataFrame:
    """``cell_id, measurements``: a map from the keys of ``cell_id, key, value`` to their values."""
    return long.groupBy("cell_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("measurements"))
