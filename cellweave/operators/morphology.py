"""Inward and outward rings of cells. Erosion and dilation by a cross are steps over side neighbours, which are taken
for all cells of a batch at once; nothing is held but places."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellweave.functions.groups import grouped

from .compartments import pack

BINS = 5


class Places:
    """Places of numbered groups as sorted whole numbers, each beside its side neighbours; a rim of ``margin`` is free."""

    def __init__(self, g: np.ndarray, r: np.ndarray, c: np.ndarray, margin: int = 1):
        self.r0, self.c0 = int(r.min()) - margin, int(c.min()) - margin
        self.rows, self.columns = int(r.max()) - self.r0 + margin + 1, int(c.max()) - self.c0 + margin + 1
        self.key = (g.astype(np.int64) * self.rows + (r.astype(np.int64) - self.r0)) * self.columns + (c.astype(np.int64) - self.c0)
        self.sides = (1, -1, self.columns, -self.columns)

    def split(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group, row and column."""
        line, c = np.divmod(key, self.columns)
        g, r = np.divmod(line, self.rows)
        return g, r + self.r0, c + self.c0


def _at(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where ``wanted`` stands in sorted ``known``, or -1."""
    k = np.searchsorted(known, wanted)
    k[k == len(known)] = 0
    return np.where(known[k] == wanted, k, -1) if len(known) else np.full(len(wanted), -1)


def inner_depths(g: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The city-block distance of each place to the nearest one outside its group."""
    key = Places(g, r, c)
    order = np.argsort(key.key, kind="stable")
    sorted_ = key.key[order]
    beside = np.stack([_at(sorted_, sorted_ + s) for s in key.sides])
    depth = np.where((beside < 0).any(axis=0), 1, 0)
    left, d = np.flatnonzero(depth == 0), 1
    while len(left):
        near = (depth[beside[:, left]] == d).any(axis=0)
        d += 1
        depth[left[near]] = d
        left = left[~near]
    out = np.empty(len(depth), np.int64)
    out[order] = depth
    return out


def outer_places(g: np.ndarray, r: np.ndarray, c: np.ndarray, reach: int, size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Group, row, column and distance of the places within ``reach`` of each group, but outside it and inside the image."""
    key = Places(g, r, c, reach + 1)
    own = np.unique(key.key)
    before, now, found = own, own, []
    for d in range(1, reach + 1):
        near = np.unique(np.concatenate([now + s for s in key.sides]))
        near = near[(_at(before, near) < 0) & (_at(now, near) < 0)]
        _, y, x = key.split(near)
        near = near[(y >= 0) & (y < size[0]) & (x >= 0) & (x < size[1])]
        before, now = now, near
        found.append(near)
    depth = np.repeat(np.arange(1, reach + 1), [len(x) for x in found])
    return *key.split(np.concatenate(found)), depth


def shells(g: np.ndarray, depth: np.ndarray, outermost: bool) -> np.ndarray:
    """Depths of each group dealt into five shells of about equal area: inward ones, the outermost first, or outward ones, the innermost first."""
    if not len(g):
        return np.zeros(0, np.int64)
    deep = int(depth.max()) + 1
    level, at, n = np.unique(g * deep + depth, return_inverse=True, return_counts=True)
    own = level // deep
    total = np.bincount(own, n)[own]
    run = np.cumsum(n)
    first = np.searchsorted(own, own)
    less = run - n - (run - n)[first]
    out = np.full(len(level), BINS)
    for b in range(BINS - 1, 0, -1):
        out[total - less > np.floor(total * (1.0 - b / BINS)) if outermost else less < np.floor(total * (b / BINS))] = b
    return out[at]


def numbers(table: pa.Table, starts: np.ndarray) -> np.ndarray:
    """The number of each row's group."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))


def _rings(pixels: DataFrame, by: list[str], made, squares: bool) -> DataFrame:
    kinds = ", ".join(f"{x} {pixels.schema[x].dataType.simpleString()}" for x in by)

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        g, r, c, depth, bins = made(numbers(table, starts), table["r"].to_numpy(), table["c"].to_numpy())
        keys = table.select(by).take(pa.array(starts[g]))
        columns = [keys[x].combine_chunks() for x in by] + [pa.array(x, pa.int32()) for x in (r, c, depth, bins)]
        rows = pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in columns], names=[*by, "r", "c", "depth", "bin"])
        return pack(pa.Table.from_batches([rows]), [*by, "bin"], []) if squares else rows

    return grouped(pixels.select(*by, "r", "c"), by, run, f"{kinds}, bin int, by_ int, bx_ int, at array<smallint>" if squares else f"{kinds}, r int, c int, depth int, bin int")


def inward(pixels: DataFrame, by: list[str], squares: bool = False) -> DataFrame:
    """``by, r, c, depth, bin``: 1 at the border of each group's mask, and the shell; outside is background, at the image's edge too.

    With ``squares`` the places are ``packed`` by ``by`` and ``bin``, as ``compartments.sampled`` takes them.
    """

    def made(g, r, c):
        depth = inner_depths(g, r, c)
        return g, r, c, depth, shells(g, depth, True)

    return _rings(pixels, by, made, squares)


def outward(pixels: DataFrame, by: list[str], reach: int, size: tuple[int, int], squares: bool = False) -> DataFrame:
    """``by, r, c, depth, bin`` of the places within ``reach`` of each group's mask but outside it, inside the image; ``squares`` as in ``inward``.

    One group's ring may cover another's pixels.
    """

    def made(g, r, c):
        g, r, c, depth = outer_places(g, r, c, reach, size)
        return g, r, c, depth, shells(g, depth, False)

    return _rings(pixels, by, made, squares)


def reach_px(pixel_size: float, microns: float = 20.0) -> int:
    return max(1, round(microns / pixel_size))


def rings(places: DataFrame, by: list[str]) -> DataFrame:
    """``by, depth, n, bin``: the depths of ``inward`` or ``outward`` with their numbers of places and shells."""
    return places.groupBy(*by, "depth", "bin").agg(F.count(F.lit(1)).alias("n")).select(*by, "depth", "n", "bin")


def erosion_rings(places: DataFrame, by: list[str]) -> DataFrame:
    return rings(places, by)


def expansion_rings(places: DataFrame, by: list[str]) -> DataFrame:
    return rings(places, by)
