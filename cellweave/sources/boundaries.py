"""Boundary tables: polygons as well-known binary in Parquet, burned to masks or made to outlines."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.functions.tables import numbered
from cellweave.operators import outlines as ol, raster as ra

RINGS = f"label bigint, part int, hole boolean, ring {ol.RING}"
#: Fixed values of well-known binary.
POLYGON, MULTIPOLYGON = 3, 6


def polygons(data: bytes) -> list[list[np.ndarray]]:
    """The polygons of a geometry, each its outer ring and holes as ``(n, 2)`` of x, y; rings of under four positions are dropped."""
    place = 0

    def number(kind: str) -> int:
        nonlocal place
        value = struct.unpack_from(kind, data, place)[0]
        place += struct.calcsize(kind)
        return value

    def geometry() -> list[list[np.ndarray]]:
        nonlocal place
        order = "<" if number("B") else ">"
        code = number(order + "I")
        extra = bool(code & 0x80000000) + bool(code & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}.get(code % 0x20000000 // 1000, 0)
        if code & 0x20000000:
            number(order + "I")  # a reference system
        kind = code % 0x20000000 % 1000
        if kind == MULTIPOLYGON:
            return [p for _ in range(number(order + "I")) for p in geometry()]
        if kind != POLYGON:
            raise ValueError(f"geometry {kind} is no polygon")
        rings = []
        for _ in range(number(order + "I")):
            n = number(order + "I")
            rings.append(np.frombuffer(data, order + "f8", n * (2 + extra), place).reshape(n, 2 + extra)[:, :2].astype(float))
            place += n * (2 + extra) * 8
        good = [r for r in rings if len(r) >= 4]
        return [good] if rings and len(rings[0]) >= 4 else []

    return geometry()


def well_known(rings: list[list[tuple[float, float]]]) -> bytes:
    """A polygon of closed rings."""
    return struct.pack("<BII", 1, POLYGON, len(rings)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rings)


def multi(polygons_: list[list[list[tuple[float, float]]]]) -> bytes:
    """A multipolygon."""
    return struct.pack("<BII", 1, MULTIPOLYGON, len(polygons_)) + b"".join(map(well_known, polygons_))


def read_boundaries(spark: SparkSession, path: str, column: str = "geometry") -> DataFrame:
    """``label, geometry`` of a Parquet table; labels count its rows from 1 in the order of the files."""
    rows = spark.read.parquet(path).select(F.col(column).alias("geometry"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"))
    return numbered(rows, [F.col("_f"), F.col("_i")], "label").select("label", "geometry")


def rings(boundaries: DataFrame) -> DataFrame:
    """``label, part, hole, ring`` of ``label, geometry``; null and empty geometries have none."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, data in zip(batch.column("label").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                for part, found in enumerate(polygons(data) if data else []):
                    out += [(label, part, k > 0, [{"x": x, "y": y} for x, y in ring.tolist()]) for k, ring in enumerate(found)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["label", "part", "hole", "ring"])

    return boundaries.select(F.col("label").cast("long").alias("label"), F.col("geometry").cast("binary").alias("geometry")).mapInArrow(parsed, RINGS)


def edges(rings_: DataFrame) -> DataFrame:
    """``id, y0, x0, y1, x1``: the sides of all rings of a label, holes too, for ``raster.filled``."""
    at = lambda i: F.get("ring", i)
    sides = F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(at(i)["y"].alias("y0"), at(i)["x"].alias("x0"), at(i + 1)["y"].alias("y1"), at(i + 1)["x"].alias("x1")))
    return rings_.filter(F.size("ring") >= 4).select(F.col("label").alias("id"), F.inline(sides))


def burned(rings_: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``r, c, label``: places whose centre lies in a label's polygons and not in their holes; the later label wins."""
    h, w = size
    places = ra.filled(edges(rings_), 0.5).filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))
    return places.groupBy("r", "c").agg(F.max("id").alias("label"))


def painted(rings_: DataFrame, size: tuple[int, int]) -> DataFrame:
    """``r, c, label`` of final polygons, by pixel centres at whole numbers: the smaller covers the larger, a hole is open for others."""
    h, w = size
    places = ra.filled(edges(rings_), 0.0).filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1))
    return ra.painted(places.select(F.col("id").alias("ord"), F.col("id").alias("label"), "r", "c"))


def outlines(rings_: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``label, ring, area``: the outer ring of each label's largest polygon, simplified; labels without one are left out."""

    def simple(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.array([(p["x"], p["y"]) for p in ring]) for ring in batch.column("ring").to_pylist()]
            made = [ol.simplified(r[:-1] if (r[0] == r[-1]).all() else r, tolerance) for r in made]
            closed = [[{"x": x, "y": y} for x, y in np.vstack([r, r[:1]]).tolist()] for r in made]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(closed, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), pa.array([ol.area(r) for r in made], pa.float64())], names=["label", "ring", "area"])

    turned = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 2), F.lit(0.0), lambda s, i: s + F.get("ring", i)["x"] * F.get("ring", i + 1)["y"] - F.get("ring", i + 1)["x"] * F.get("ring", i)["y"])
    outer = rings_.filter(~F.col("hole")).withColumn("_a", F.abs(turned) / 2).filter("_a > 0")
    largest = outer.groupBy("label").agg(F.max_by("ring", F.struct("_a", -F.col("part"))).alias("ring"))
    return largest.mapInArrow(simple, f"label bigint, ring {ol.RING}, area double")
