"""GeoJSON features and measurement rows, as text that Spark writes in order."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .parts import Parts


def _polygon(rings: Column) -> Column:
    return F.struct(F.lit("Polygon").alias("type"), F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def _rings(table: DataFrame) -> Column:
    """The rings of each polygon; a table of outlines has one ``ring`` without holes."""
    return F.col("rings") if "rings" in table.columns else F.array("ring")


def features(cells: DataFrame, cell_rings: DataFrame, nucleus_rings: DataFrame | None = None, measurements: DataFrame | None = None) -> DataFrame:
    """``cell_id, feature`` (JSON): one for each cell that has an outline.

    ``cell_rings`` and ``nucleus_rings`` hold ``cell_id`` and ``ring``, or ``rings`` with the holes behind the outer one;
    ``measurements`` holds ``cell_id, measurements``.
    A cell without a nucleus outline has no such member; missing labels are null.
    """
    rows = cells.join(cell_rings.select("cell_id", _rings(cell_rings).alias("_cell")), "cell_id")
    rows = rows.join(nucleus_rings.select("cell_id", _rings(nucleus_rings).alias("_nucleus")), "cell_id", "left") if nucleus_rings is not None else rows.withColumn("_nucleus", F.lit(None).cast("array<array<struct<x:double,y:double>>>"))
    properties = [F.lit("cell").alias("objectType"), F.col("cell_id").alias("id"), F.col("nucleus_label"), F.col("whole_cell_label"), F.col("match_source")]
    if measurements is not None:
        rows = rows.join(measurements, "cell_id", "left")
        properties.append(F.coalesce("measurements", F.create_map().cast("map<string,double>")).alias("measurements"))
    base = [F.lit("Feature").alias("type"), F.concat(F.lit("cell-"), "cell_id").alias("id"), _polygon(F.col("_cell")).alias("geometry"), F.struct(*properties).alias("properties")]
    text = lambda parts: F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})
    feature = F.when(F.col("_nucleus").isNull(), text(base)).otherwise(text([*base, _polygon(F.col("_nucleus")).alias("nucleusGeometry")]))
    return rows.select("cell_id", feature.alias("feature"))


def annotation(size: tuple[int, int]) -> dict:
    """The whole image as a rectangle."""
    h, w = size
    ring = [[0, 0], [w, 0], [w, h], [0, h], [0, 0]]
    return {"type": "Feature", "id": "annotation-whole-image", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"objectType": "annotation", "type": "annotation", "name": "whole_image"}}


def write_geojson(rows: DataFrame, size: tuple[int, int], path: str, pretty: bool = False, compressed: bool = False) -> int:
    """One file: the annotation, then ``features`` by ascending cell. Tasks write the features of their cells, and the
    pieces are then put together; ``.gz`` is added to the name of a compressed file. Returns the number of cells."""
    if compressed and not path.endswith(".gz"):
        path += ".gz"
    shown = lambda x: json.dumps(json.loads(x), indent=2, ensure_ascii=False) if pretty else x
    between = "," + ("\n" if pretty else "")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int]]:
        for batch in batches:
            yield 0, "".join(between + shown(x) for x in batch.column("feature").to_pylist()).encode(), batch.num_rows

    made = Parts(rows.orderBy("cell_id").select("feature"), texts, compressed)
    head = '{"type":"FeatureCollection","features":[' + shown(json.dumps(annotation(size), separators=(",", ":")))
    packed = (lambda text: gzip.compress(text.encode(), mtime=0)) if compressed else str.encode
    made.join(path, [packed(head), *made.pieces, packed("]}")])
    return sum(p.n for p in made.pieces)


def write_features(rows: DataFrame, path: str, compressed: bool = False) -> None:
    """The same features, one to a line, in part files whose order is that of the cells; for results too large for one file."""
    rows.orderBy("cell_id").select("feature").write.option("compression", "gzip" if compressed else "none").text(path)


def write_measurements(maps: DataFrame, path: str) -> None:
    """``{"cell_id":..,"measurements":{..}}`` to a line, by ascending cell."""
    maps.orderBy("cell_id").select(F.to_json(F.struct("cell_id", "measurements"))).write.text(path)


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ``write_measurements``; blank ones are skipped, and what is no object has no measurements."""
    kind = "struct<cell_id:bigint,measurements:map<string,double>>"
    rows = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", kind).alias("j"))
    return rows.select("j.cell_id", F.coalesce("j.measurements", F.create_map().cast("map<string,double>")).alias("measurements"))
