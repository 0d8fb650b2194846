"""Overlay of final polygons: pairs that share an area, cells trimmed until none does, parts of one inside another, unions.

Polygons travel as well-known binary with their boxes; pairs are found by joins, and each pair or group is overlaid by
the exact small functions of ``functions.polygons``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window

from cellweave.functions import polygons as pg
from cellweave.functions.groups import spread
from cellweave.functions.tables import written
from cellweave.sources import boundaries as bd

from . import outlines as ol, raster as ra

SHAPES = "label bigint, geometry binary, area double, x0 double, y0 double, x1 double, y1 double"
_NAMES = ["label", "geometry", "area", "x0", "y0", "x1", "y1"]
_KINDS = [pa.int64(), pa.binary(), *[pa.float64()] * 5]
#: Two polygons that share less than this don't overlap.
LEAST_AREA = 1e-10


def _row(label: int, polygon: pg.Polygon) -> tuple:
    outer = np.array(pg.closed(polygon[0]))
    return label, bd.well_known([pg.closed(r) for r in polygon]), pg.area(polygon), *outer.min(axis=0).tolist(), *outer.max(axis=0).tolist()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _rings(geometry: bytes) -> list[pg.Ring]:
    """All rings of a geometry on the grid, to be taken by the even-odd rule."""
    return pg.snapped(r for polygon in bd.polygons(geometry) for r in polygon)


def shapes_of(outlines: DataFrame) -> DataFrame:
    """SHAPES of ``label, ring``: each outline made valid, of which the largest piece stays. What has no area is gone."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, ring in zip(batch.column("label").to_pylist(), batch.column("ring").to_pylist(), strict=True):
                if pieces := pg.repaired(pg.snapped([[(p["x"], p["y"]) for p in ring or []]])):
                    rows.append(_row(label, pieces[0]))
            yield _batch(rows)

    return outlines.select("label", "ring").mapInArrow(made, SHAPES)


def boundary_shapes(boundaries: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """SHAPES of a boundary table (``label, geometry``): the largest polygon of each, made valid, simplified without crossings.

    Self-crossing rings are split and taken by the even-odd rule, of which the largest piece stays, with its holes.
    Null, empty and flat geometries are gone.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, data in zip(batch.column("label").to_pylist(), batch.column("geometry").to_pylist(), strict=True):
                valid = [p for own in bd.polygons(data) for p in pg.repaired(pg.snapped(own))[:1]] if data else []
                if valid:
                    rings = [np.array(pg.closed(r)[:-1]) for r in max(valid, key=pg.area)]
                    if pieces := pg.repaired(pg.snapped(ol.simplified_rings(rings, tolerance))):
                        rows.append(_row(label, pieces[0]))
            yield _batch(rows)

    return boundaries.select(F.col("label").cast("long").alias("label"), F.col("geometry").cast("binary").alias("geometry")).mapInArrow(made, SHAPES)


def overlaps(shapes: DataFrame, least: float = LEAST_AREA, square: int = 64) -> DataFrame:
    """``i, j, area`` (i < j) of polygons that share at least that area; those that only touch give no row.

    Boxes are dealt to grid squares for the candidates; the two polygons of each then meet in a join.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [sum(map(pg.area, pg.intersection(_rings(a), _rings(b)))) for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(shared, pa.float64())], names=["i", "j", "area"])

    box = [F.floor("y0").alias("row_min"), F.floor("y1").alias("row_max"), F.floor("x0").alias("col_min"), F.floor("x1").alias("col_max")]
    pairs = ra.candidate_pairs(shapes.select(F.col("label").alias("id"), *box), square)
    both = pairs.join(shapes.select(F.col("label").alias("i"), F.col("geometry").alias("a")), "i").join(shapes.select(F.col("label").alias("j"), F.col("geometry").alias("b")), "j")
    return both.select("i", "j", "a", "b").mapInArrow(measured, "i bigint, j bigint, area double").filter(F.col("area") >= least)


def _trimmed_block(key: tuple, pairs: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """The pairs of one block, as far as nothing outside comes before them: rows of cells that have changed, and of pairs that are done."""
    shapes = {label: _rings(g) if g is not None else [] for label, g in zip(cells["label"].tolist(), cells["geometry"], strict=True)}
    areas = dict(zip(cells["label"].tolist(), cells["area"].tolist(), strict=True))
    turn: dict[int, int] = {}
    changed, done = set(), []
    for i, j, ki, kj in pairs.sort_values(["i", "j"])[["i", "j", "ki", "kj"]].itertuples(index=False):
        if turn.get(i, 1) != ki or turn.get(j, 1) != kj:
            continue
        turn[i], turn[j] = ki + 1, kj + 1
        done.append((i, j, None, None, None))
        large, small = (i, j) if areas[i] >= areas[j] else (j, i)
        both = pg.Arrangement(shapes[large], shapes[small])
        if sum(map(pg.area, both.take(lambda m: m == 3))) < LEAST_AREA:
            continue
        rest, other = both.take(lambda m: m == 1), both.take(lambda m: m >= 2)
        shapes[large], areas[large] = (rest[0], pg.area(rest[0])) if rest else ([], 0.0)
        shapes[small] = other[0]  # with the corners that both now have in common
        changed |= {large, small}
    rows = [(None, None, x, bd.well_known([pg.closed(r) for r in shapes[x]]) if shapes[x] else None, areas[x]) for x in sorted(changed)]
    frame = pd.DataFrame([*done, *rows], columns=["i", "j", "label", "geometry", "area"], dtype=object)
    return frame.astype({"i": "Int64", "j": "Int64", "label": "Int64", "area": "Float64"})


def trimmed(shapes: DataFrame, square: float = 2048.0) -> DataFrame:
    """SHAPES of which no two share an area; labels are in the order of the cells.

    Pairs are taken in the order of their labels. Of two that still overlap the larger loses what is shared (of equal
    ones the first) and keeps its largest piece, with holes where it surrounds the other; cells that lose all are gone.

    Each round deals the open pairs to squares of the image. A square's task takes its pairs in order, as far as all
    earlier pairs of both cells are done or its own, so that a chain of cells takes one round unless it leaves its
    square; squares are moved by half a side from round to round. What a task holds is bounded by the square, not by
    the chain. A cell that lies over very many others still takes them one after another.
    """
    shapes = written(shapes.select(*_NAMES), "polygons")
    open_ = written(overlaps(shapes).select("i", "j"), "pairs")
    corner = shapes.select("label", "x0", "y0")
    ends = open_.select(F.col("i").alias("label")).unionByName(open_.select(F.col("j").alias("label"))).distinct()
    calm = shapes.join(ends, "label", "left_anti").select("label", "geometry", "area")
    busy = written(shapes.join(ends, "label", "left_semi").select("label", "geometry", "area"), "busy")
    shift = 0.0
    while not open_.isEmpty():
        at = open_.join(corner.withColumnRenamed("label", "i"), "i")
        at = at.select("i", "j", *[F.floor((F.col(c) + shift) / square).alias(n) for c, n in (("y0", "by"), ("x0", "bx"))])
        turns = at.select("i", "j", F.explode(F.array("i", "j")).alias("label")).withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("i", "j")))
        turn = lambda n: turns.filter(F.col("label") == F.col(n)).select("i", "j", F.col("k").alias(f"k{n}"))  # noqa: E731, B023
        dealt = written(at.join(turn("i"), ["i", "j"]).join(turn("j"), ["i", "j"]), "dealt")
        needed = dealt.select(F.col("by").alias("cy"), F.col("bx").alias("cx"), F.explode(F.array("i", "j")).alias("label")).distinct().join(busy, "label")
        made = written(dealt.groupBy("by", "bx").cogroup(needed.groupBy("cy", "cx")).applyInPandas(_trimmed_block, "i bigint, j bigint, label bigint, geometry binary, area double"), "trimmed")
        new = made.filter("label is not null").select("label", "geometry", "area")
        busy = written(busy.join(new, "label", "left_anti").unionByName(new), "busy")
        open_ = written(open_.join(made.filter("i is not null").select("i", "j"), ["i", "j"], "left_anti"), "pairs")
        shift = square / 2 - shift
    return _measured(calm.unionByName(busy.filter("geometry is not null")))


def _measured(polygons: DataFrame) -> DataFrame:
    """SHAPES of ``label, geometry, area``."""

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            outer = [bd.polygons(g)[0][0] for g in batch.column("geometry").to_pylist()]
            box = np.array([[*r.min(axis=0), *r.max(axis=0)] for r in outer]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _NAMES[:3]), *(pa.array(box[:, k]) for k in range(4))], names=_NAMES)

    return polygons.select(*_NAMES[:3]).mapInArrow(boxed, SHAPES)


def clipped(shapes: DataFrame, frames: DataFrame) -> DataFrame:
    """SHAPES of the largest piece of each polygon inside the one of the same label in ``frames``; what has none is gone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for label, a, b in zip(*(batch.column(c).to_pylist() for c in ("label", "a", "b")), strict=True):
                if pieces := pg.intersection(_rings(a), _rings(b)):
                    rows.append(_row(label, pieces[0]))
            yield _batch(rows)

    both = shapes.select("label", F.col("geometry").alias("a")).join(frames.select("label", F.col("geometry").alias("b")), "label")
    return both.select("label", "a", "b").mapInArrow(cut, SHAPES)


def united(parts: DataFrame, square: float = 2048.0) -> DataFrame:
    """``label, geometry, area, pieces``: what the polygons (``label, geometry``) of each label cover together, as one multipolygon.

    Parts of a label are united by squares of the image first, so that a label of very many parts is spread over
    tasks, and what is left of the squares then for the whole label.
    """

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) == 1 and "pieces" in rows:  # a label in one square is united already
            return rows[["label", "geometry", "area", "pieces"]]
        found = pg.union([_rings(g) for g in rows["geometry"]])
        data = bd.multi([[pg.closed(r) for r in p] for p in found])
        return pd.DataFrame({"label": [int(rows["label"].iloc[0])], "geometry": [data], "area": [sum(map(pg.area, found))], "pieces": [len(found)]})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, spots = [], []
            for k, g in enumerate(batch.column("geometry").to_pylist()):
                if g and (found := bd.polygons(g)):
                    keep.append(k)
                    spots.append(np.floor(found[0][0].min(axis=0) / square))
            spots_ = np.array(spots).reshape(-1, 2).astype(np.int64)
            own = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("label"), own.column("geometry"), pa.array(spots_[:, 1]), pa.array(spots_[:, 0])], names=["label", "geometry", "by", "bx"])

    made = "label bigint, geometry binary, area double, pieces long"
    dealt = parts.select(F.col("label").cast("long").alias("label"), F.col("geometry").cast("binary").alias("geometry")).mapInArrow(placed, "label bigint, geometry binary, by long, bx long")
    within = spread(dealt, "label", "by", "bx").groupBy("label", "by", "bx").applyInPandas(unite, made)
    return spread(within, "label").groupBy("label").applyInPandas(unite, made)


def rings_of(shapes: DataFrame) -> DataFrame:
    """``label, rings``: the outer ring and the holes of each polygon."""
    rows = bd.rings(shapes.select("label", "geometry")).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("hole", "part", "ring"))).alias("_r"))
    return rows.select("label", F.transform("_r", lambda r: r["ring"]).alias("rings"))
