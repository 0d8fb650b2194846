"""Cells that share no place: overlapping pairs are trimmed one after another, as far as one depends on another."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cellweave.functions.tables import written

PIXELS = "label bigint, r int, c int"


def pieces(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A number for each pixel of a shape, from 0 by the piece's first pixel; pieces are linked over sides.

    Runs of pixels in a row are joined with those of the next one that they touch, so that far pieces need no common box.
    """
    order = np.lexsort((c, r))
    y, x = r[order], c[order]
    begin = np.append(True, (np.diff(y) != 0) | (np.diff(x) != 1))
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(y)) - 1
    rows, left, right = y[first], x[first], x[last]
    parent = list(range(len(first)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above = 0
    for k in range(len(first)):
        while above < k and (rows[above] < rows[k] - 1 or rows[above] == rows[k] - 1 and right[above] < left[k]):
            above += 1
        j = above
        while j < k and rows[j] == rows[k] - 1 and left[j] <= right[k]:
            a, b = root(j), root(k)
            parent[max(a, b)] = min(a, b)
            j += 1
    _, number = np.unique([root(k) for k in range(len(first))], return_inverse=True)
    out = np.empty(len(y), np.int64)
    out[order] = number[np.cumsum(begin) - 1]
    return out


def largest_pieces(pixels: DataFrame) -> DataFrame:
    """``label, r, c`` of each label's largest piece that is linked over sides; of equal ones that with the first place."""

    def largest(rows: pd.DataFrame) -> pd.DataFrame:
        found = pieces(rows["r"].to_numpy(), rows["c"].to_numpy())
        return rows[found == np.argmax(np.bincount(found))]

    return pixels.select(F.col("label").cast("long"), F.col("r").cast("int"), F.col("c").cast("int")).groupBy("label").applyInPandas(largest, PIXELS)


def overlapping(pixels: DataFrame) -> DataFrame:
    """``i, j, px`` (i < j) of labels that share places, and how many: a place lists the few labels over it."""
    over = pixels.groupBy("r", "c").agg(F.sort_array(F.collect_set("label")).alias("l")).filter(F.size("l") > 1)
    pairs = over.select(F.explode("l").alias("i"), "l").select("i", F.explode("l").alias("j")).filter("i < j")
    return pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("px"))


def trimmed(pixels: DataFrame) -> DataFrame:
    """``label, r, c`` without shared places; labels are in the order of the cells.

    Pairs are taken in the order of their labels. Of two that still share a place the larger loses what is shared (of
    equal ones the first), and keeps its largest piece. Pairs without a common label don't touch each other's cells,
    so a round takes every pair that is the first one left for both of its cells. Cells that lose all are gone.
    """
    pixels = written(pixels.select("label", "r", "c").distinct(), "shapes")
    open_ = written(overlapping(pixels).select("i", "j"), "pairs")
    ends = open_.select(F.col("i").alias("label")).unionByName(open_.select(F.col("j").alias("label"))).distinct()
    calm = pixels.join(ends, "label", "left_anti")
    busy = written(pixels.join(ends, "label", "left_semi"), "busy")
    while not open_.isEmpty():
        pair = F.struct("i", "j")
        both = open_.select(pair.alias("p"), F.explode(F.array("i", "j")).alias("label"))
        first = both.groupBy("label").agg(F.min("p").alias("p")).groupBy("p").count().filter("count = 2")
        ready = written(first.select("p.i", "p.j"), "ready")
        area = busy.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        sides = ready.join(area.select(F.col("label").alias("i"), F.col("n").alias("ni")), "i").join(area.select(F.col("label").alias("j"), F.col("n").alias("nj")), "j")
        loses = sides.select(F.when(F.col("ni") >= F.col("nj"), F.col("i")).otherwise(F.col("j")).alias("label"), F.when(F.col("ni") >= F.col("nj"), F.col("j")).otherwise(F.col("i")).alias("_winner"))
        theirs = loses.join(busy.select(F.col("label").alias("_winner"), "r", "c"), "_winner").select("label", "r", "c")
        shared = written(busy.join(theirs, ["label", "r", "c"], "left_semi").select("label", "r", "c"), "shared")
        cut = shared.select("label").distinct()
        rest = busy.join(cut, "label", "left_semi").join(shared, ["label", "r", "c"], "left_anti")
        busy = written(busy.join(cut, "label", "left_anti").select("label", "r", "c").unionByName(largest_pieces(rest)), "busy")
        open_ = written(open_.join(ready, ["i", "j"], "left_anti"), "pairs")
    return calm.select("label", "r", "c").unionByName(busy.select("label", "r", "c"))


def nuclei_inside(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """``label, r, c``: what of each nucleus lies inside the cell of the same label, in however many pieces."""
    return nuclei.select("label", "r", "c").join(cells.select("label", "r", "c"), ["label", "r", "c"], "left_semi")


def clipped_nuclei(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """``label, r, c``: the largest piece of each nucleus inside the cell of the same label; nuclei without one are gone."""
    return largest_pieces(nuclei_inside(nuclei, cells))
