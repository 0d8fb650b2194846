"""Outlines of labels as polygons, and boundaries grown around nuclei that no whole cell claims."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellweave.functions import polygons as pg
from cellweave.functions.groups import grouped, spread
from cellweave.functions.tables import written

from .clipping import pieces
from .labels import label_stats

RING = "array<struct<x:double,y:double>>"
#: Segments between the midpoints of a square's sides (top, right, bottom, left), for each pattern of its corners
#: (top left 1, top right 2, bottom right 4, bottom left 8); corners that touch only across are kept apart.
SEGMENTS = {1: ["lt"], 2: ["tr"], 3: ["lr"], 4: ["rb"], 5: ["lt", "rb"], 6: ["tb"], 7: ["lb"], 8: ["bl"], 9: ["bt"], 10: ["tr", "bl"], 11: ["br"], 12: ["rl"], 13: ["rt"], 14: ["tl"]}
SIDE = {"t": (0.0, 0.5), "r": (0.5, 1.0), "b": (1.0, 0.5), "l": (0.5, 0.0)}


#: A label's box may have so many times its pixels before its pieces are traced one by one.
SPARSE = 64


def rings(mask: np.ndarray) -> list[np.ndarray]:
    """Closed outlines ``(n, 2)`` of ``x, y`` between true and false pixels, through the midpoints of pixel centres."""
    m = np.pad(mask.astype(np.uint8), 1)
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, 1:] + 8 * m[1:, :-1]
    following: dict[tuple[float, float], tuple[float, float]] = {}
    for r, c in zip(*(x.tolist() for x in np.nonzero((code > 0) & (code < 15))), strict=True):
        for a, b in SEGMENTS[int(code[r, c])]:
            (ay, ax), (by, bx) = SIDE[a], SIDE[b]
            following[c - 1 + ax, r - 1 + ay] = (c - 1 + bx, r - 1 + by)
    out = []
    while following:
        start, at = following.popitem()
        ring = [start]
        while at != start:
            ring.append(at)
            at = following.pop(at)
        out.append(np.array(ring))
    return out


def area(ring: np.ndarray) -> float:
    x, y = ring[:, 0], ring[:, 1]
    return abs(float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1)))) / 2


def kept(ring: np.ndarray, tolerance: float) -> set[int]:
    """The places that Douglas and Peucker's rule keeps, from the first one and the one farthest from it."""
    n = len(ring)
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    closed, keep = np.vstack([ring, ring[:1]]), {0, far}
    stack = [(0, far), (far, n)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        k, off = _farthest(closed, a, b)
        if off > tolerance:
            keep.add(k)
            stack += [(a, k), (k, b)]
    return keep


def _farthest(closed: np.ndarray, a: int, b: int) -> tuple[int, float]:
    """The place between a and b that is farthest from the line through them, and its distance."""
    p, q, inner = closed[a], closed[b], closed[a + 1 : b]
    d = q - p
    length = float(np.hypot(*d))
    off = np.hypot(*(inner - p).T) if length == 0 else np.abs(d[0] * (inner[:, 1] - p[1]) - d[1] * (inner[:, 0] - p[0])) / length
    k = int(np.argmax(off))
    return a + 1 + k, float(off[k])


def simplified_rings(rings_: list[np.ndarray], tolerance: float) -> list[np.ndarray]:
    """The rings of a polygon with fewer corners, three at least; they neither cross themselves nor one another unless they did before.

    Where sides that Douglas and Peucker's rule has made meet others, the corner farthest from each is put back, until
    none meets another.
    """
    keep = [kept(r, tolerance) if tolerance > 0 and len(r) > 4 else set(range(len(r))) for r in rings_]
    closed = [np.vstack([r, r[:1]]) for r in rings_]
    while True:
        places = [sorted(k) if len(k) >= 3 else list(range(len(r))) for k, r in zip(keep, rings_, strict=True)]
        keep = [set(p) for p in places]
        made = [r[p] for p, r in zip(places, rings_, strict=True)]
        if all(len(m) == len(r) for m, r in zip(made, rings_, strict=True)):
            return made
        back = 0
        for k, i in pg.crossed(made):
            a, b = places[k][i], places[k][i + 1] if i + 1 < len(places[k]) else len(rings_[k])
            if b - a > 1:
                keep[k].add(_farthest(closed[k], a, b)[0])
                back += 1
        if not back:
            return made


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    return simplified_rings([ring], tolerance)[0]


def outlines(pixels: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """``label, ring, area``: the largest outline of each label, closed, without holes; in single precision like stored ones."""

    def largest(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        mask = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1), bool)
        mask[r - r.min(), c - c.min()] = True
        return max(rings(mask), key=area) + [c.min(), r.min()]

    def trace(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        if (int(r.max()) - int(r.min()) + 1) * (int(c.max()) - int(c.min()) + 1) > SPARSE * len(r) + 65_536:  # far pieces: each in a box of its own
            found = pieces(r, c)
            ring = max((largest(r[found == k], c[found == k]) for k in range(found.max() + 1)), key=area)
        else:
            ring = largest(r, c)
        low = ring.min(axis=0)
        ring = simplified(ring - low, tolerance) + low
        return np.vstack([ring, ring[:1]]).astype(np.float32).astype(float)

    def made(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        found = [trace(r, c) for r, c in zip(*(np.split(table[x].to_numpy(), starts[1:]) for x in ("r", "c")), strict=True)]
        corners = np.concatenate(found)
        points = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], names=["x", "y"])
        rings_ = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), points)
        areas = pa.array([area(ring[:-1]) for ring in found], pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(table["label"].to_numpy()[starts], pa.int64()), rings_, areas], names=["label", "ring", "area"])

    return grouped(pixels.filter("label <> 0").select("label", "r", "c"), ["label"], made, f"label bigint, ring {RING}, area double")


def squared_distance(seed: np.ndarray, radius: int) -> np.ndarray:
    """The squared distance of each place to the nearest seed, right up to ``radius``: first along columns, then the best of each row."""
    far = 2 * radius + 2
    along = np.where(seed, 0, far)
    for k in range(1, along.shape[0]):
        along[k] = np.minimum(along[k], along[k - 1] + 1)
    for k in range(along.shape[0] - 2, -1, -1):
        along[k] = np.minimum(along[k], along[k + 1] + 1)
    square = np.minimum(along, far).astype(np.int64) ** 2
    out = square.copy()
    for k in range(1, radius + 1):
        np.minimum(out[:, k:], square[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], square[:, k:] + k * k, out=out[:, :-k])
    return out


def flood(seeds: np.ndarray, zone: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
    """Labels of a zone flooded from labelled seeds, and the steps of the longest way.

    Places are taken by their squared distance to the nearest seed (inside the zone or not), equally far ones in the
    order in which they were reached; seeds start in the order of rows and columns, and a place reaches those above,
    left, right and below. A place belongs to the one that reaches it first.
    """
    height, width = seeds.shape
    step = width + 2
    value = np.pad(squared_distance(seeds > 0, radius), 1).ravel().tolist()
    start = np.pad(np.where(zone, seeds, 0), 1).ravel()
    label, free = start.tolist(), np.pad(zone, 1).ravel().tolist()
    queue = [(value[k], age, k, 0) for age, k in enumerate(np.flatnonzero(start).tolist())]
    age, deepest = len(queue), 0
    heapq.heapify(queue)
    while queue:
        _, _, k, steps = heapq.heappop(queue)
        for n in (k - step, k - 1, k + 1, k + step):
            if free[n] and not label[n]:
                label[n] = label[k]
                deepest = max(deepest, steps + 1)
                heapq.heappush(queue, (value[n], age, n, steps + 1))
                age += 1
    return np.array(label, np.int64).reshape(height + 2, step)[1:-1, 1:-1], deepest


def _tile_flood(radius: int, tile: int, halo: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """Floods one tile's window (``r, c, label``; 0 for places of the zone): its own places, or one row without any if the halo may be too narrow."""

    def flooded_tile(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        r, c, label = (group[x].to_numpy() for x in ("r", "c", "label"))
        core = (label == 0) & (r // tile == ty) & (c // tile == tx)
        if not core.any():
            return pd.DataFrame({x: np.zeros(0, np.int64) for x in ("r", "c", "label", "ty", "tx")})
        top, left, side = ty * tile - halo, tx * tile - halo, tile + 2 * halo
        seed, free = np.zeros((side, side), np.int64), np.zeros((side, side), bool)
        seed[r[label > 0] - top, c[label > 0] - left] = label[label > 0]
        free[r[label == 0] - top, c[label == 0] - left] = True
        found, deepest = flood(seed, free, radius)
        inner = np.zeros_like(free)
        inner[halo : halo + tile, halo : halo + tile] = True
        missed = free & (found == 0)
        if (missed & inner).any():  # a way may come in from outside
            rim = missed.copy()
            rim[1:-1, 1:-1] = False
            deepest = side if (flood(rim.astype(np.int64), missed, 1)[0][inner] > 0).any() else deepest
        if 2 * deepest > halo:
            return pd.DataFrame({"r": [None], "c": [None], "label": [None], "ty": [ty], "tx": [tx]}).astype("Int64")
        got = found[r[core] - top, c[core] - left]
        return pd.DataFrame({"r": r[core][got > 0], "c": c[core][got > 0], "label": got[got > 0], "ty": ty, "tx": tx})

    return flooded_tile


def flooded(seeds: DataFrame, zone: DataFrame, radius: int, tile: int = 256, halo: int | None = None) -> DataFrame:
    """``r, c, label``: the zone's places that seeds (``r, c, label``) reach, growing over side neighbours, nearest first, as in ``flood``.

    Tiles are flooded on their own, each with a halo from its neighbours of which it tells nothing. What a place gets
    follows from the ways that lead to it; where the longest way in a tile's window has more than half as many steps
    as the halo is wide, or a way from outside may reach a place of the tile that none inside does, the tile is
    flooded again with twice the halo, so that tiles of any size agree.
    """
    halo = max(2 * radius, 8 * radius + 8 if halo is None else halo)
    rows = seeds.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.col("label").cast("long").alias("label"))
    rows = written(rows.unionByName(zone.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), F.lit(0).cast("long").alias("label"))), "flood")
    own, todo = None, None
    while True:
        near = lambda x, halo=halo: F.explode(F.sequence(F.floor((F.col(x) - halo) / tile), F.floor((F.col(x) + halo) / tile)))
        dealt = rows.withColumn("ty", near("r")).withColumn("tx", near("c"))
        if todo is not None:
            dealt = dealt.join(todo, ["ty", "tx"], "left_semi")
        made = written(spread(dealt, "ty", "tx").groupBy("ty", "tx").applyInPandas(_tile_flood(radius, tile, halo), "r int, c int, label long, ty long, tx long"), "flooded")
        done = made.filter("label is not null").select("r", "c", "label")
        own = done if own is None else own.unionByName(done)
        todo = made.filter("label is null").select("ty", "tx")
        if todo.isEmpty():
            return own
        halo *= 2


def synthesised(seeds: DataFrame, zone: DataFrame, distance: float, first_id: int) -> tuple[DataFrame, DataFrame]:
    """Cells grown around unmatched nuclei, and their pixels ``r, c, label``.

    Ids follow the nuclei in ascending order from ``first_id``; a nucleus without a free pixel keeps its id unused.
    """
    from .labels import centroid
    from cellweave.functions.tables import numbered

    grown = written(flooded(seeds, zone, max(1, int(distance))), "grown")
    ids = numbered(seeds.select("label").distinct(), [F.col("label")], "cell_id", first_id)
    nuclei = label_stats(seeds).select("label", F.col("area").alias("nucleus_area_px"))
    rows = centroid(label_stats(grown)).join(ids, "label").join(nuclei, "label")
    cells = rows.select(
        "cell_id", F.col("label").alias("nucleus_label"), F.lit(None).cast("long").alias("whole_cell_label"), "row_min", "col_min",
        (F.col("row_max") + 1).alias("row_max_excl"), (F.col("col_max") + 1).alias("col_max_excl"), "centroid_r", "centroid_c",
        "nucleus_area_px", F.col("area").alias("cell_area_px"), F.lit(0).cast("long").alias("overlap_px"), F.lit(0.0).alias("overlap_fraction"), F.lit("watershed_synth").alias("match_source"),
    )
    return cells, grown
