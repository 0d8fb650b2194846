"""One-to-one matching of nuclei and whole cells: by overlap, then by distance of the centroids.

Both are stable matchings. Taking the largest overlap first is the same as taking, round by round, all pairs that
are each other's best. Serving nuclei in order of their ids, each with its nearest free cell, is the same as letting
every nucleus ask its nearest cell and every cell keep the lowest id that asks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellweave.functions.tables import numbered, written

from .labels import centroid, label_stats, overlap_fraction


def overlap_counts(nuclei: DataFrame, cells: DataFrame) -> DataFrame:
    """``nuc, wc, px``: pixels that each nucleus and whole cell share."""
    a = nuclei.filter("label > 0").select("r", "c", F.col("label").alias("nuc"))
    b = cells.filter("label > 0").select("r", "c", F.col("label").alias("wc"))
    return a.join(b, ["r", "c"]).groupBy("nuc", "wc").agg(F.count(F.lit(1)).alias("px"))


def greedy_match(overlaps: DataFrame) -> DataFrame:
    """The pairs ``nuc, wc, px`` taken in the order (-px, nuc, wc), each nucleus and cell once."""
    open_, taken = written(overlaps, "overlaps"), None
    while not open_.isEmpty():
        rank = F.struct((-F.col("px")).alias("a"), F.col("nuc").alias("b"), F.col("wc").alias("d"))
        best_n = open_.groupBy("nuc").agg(F.min(rank).alias("best_n"))
        best_w = open_.groupBy("wc").agg(F.min(rank).alias("best_w"))
        mutual = written(open_.join(best_n, "nuc").join(best_w, "wc").filter((rank == F.col("best_n")) & (rank == F.col("best_w"))).select("nuc", "wc", "px"), "mutual")
        taken = mutual if taken is None else taken.unionByName(mutual)
        open_ = written(open_.join(mutual.select("nuc"), "nuc", "left_anti").join(mutual.select("wc"), "wc", "left_anti"), "overlaps")
    return taken if taken is not None else open_


def near_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``a_id, b_id, d2`` of points (``id, y, x``) no farther apart than ``radius``: a join on grid squares of that size."""
    square = lambda v: F.floor(F.col(v) / radius)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = a.select(F.col("id").alias("a_id"), F.col("y").alias("ay"), F.col("x").alias("ax"), square("y").alias("gy"), square("x").alias("gx"))
    left = left.withColumn("dy", F.explode(around)).withColumn("dx", F.explode(around)).select("a_id", "ay", "ax", (F.col("gy") + F.col("dy")).alias("gy"), (F.col("gx") + F.col("dx")).alias("gx"))
    right = b.select(F.col("id").alias("b_id"), F.col("y").alias("by"), F.col("x").alias("bx"), square("y").alias("gy"), square("x").alias("gx"))
    dy, dx = F.col("ay") - F.col("by"), F.col("ax") - F.col("bx")
    return left.join(right, ["gy", "gx"]).withColumn("d2", dy * dy + dx * dx).filter(F.col("d2") <= radius * radius).select("a_id", "b_id", "d2")


def distance_match(nuclei: DataFrame, cells: DataFrame, radius: float) -> DataFrame:
    """``nuc, wc`` for points (``id, y, x``) within ``radius``: nuclei by ascending id, each with its nearest free cell (ties: lower id)."""
    open_ = written(near_pairs(nuclei, cells, radius).select(F.col("a_id").alias("nuc"), F.col("b_id").alias("wc"), "d2"), "near")
    while True:
        asked = open_.groupBy("nuc").agg(F.min(F.struct("d2", "wc"))["wc"].alias("wc"))
        kept = asked.groupBy("wc").agg(F.min("nuc").alias("kept"))
        asked = written(asked.join(kept, "wc"), "asked")
        refused = asked.filter("nuc <> kept").select("nuc", "wc")
        if refused.isEmpty():
            return asked.select("nuc", "wc")
        open_ = written(open_.join(refused, ["nuc", "wc"], "left_anti"), "near")


def _points(stats: DataFrame) -> DataFrame:
    rows = centroid(stats)
    return rows.select(F.col("label").alias("id"), F.col("centroid_r").alias("y"), F.col("centroid_c").alias("x"))


def unmatched(stats: DataFrame, matched: DataFrame, column: str) -> DataFrame:
    return stats.join(matched.select(F.col(column).alias("label")), "label", "left_anti")


def _stats(nuclei: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statistics of both masks, written, as they are read several times."""
    return written(label_stats(nuclei), "nucleus-stats"), written(label_stats(cells), "cell-stats")


def match_pairs(nuclei: DataFrame, cells: DataFrame, radius: float = 10.0, stats: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``nuc, wc, px, phase``: matches by overlap (phase 1), then of what is left by distance (phase 2)."""
    by_overlap = written(greedy_match(overlap_counts(nuclei, cells)), "by-overlap")
    of_nuclei, of_cells = stats or (label_stats(nuclei), label_stats(cells))
    left_n = unmatched(of_nuclei, by_overlap, "nuc")
    left_w = unmatched(of_cells, by_overlap, "wc")
    by_distance = distance_match(_points(left_n), _points(left_w), radius)
    rows = by_overlap.withColumn("phase", F.lit(1))
    return rows.unionByName(by_distance.select("nuc", "wc", F.lit(0).cast("long").alias("px"), F.lit(2).alias("phase")))


def matched_cells(nuclei: DataFrame, cells: DataFrame, radius: float = 10.0) -> DataFrame:
    """The cell records of all matches; ids in order of acceptance. ``by_distance`` tells the two kinds apart."""
    stats = _stats(nuclei, cells)
    pairs = match_pairs(nuclei, cells, radius, stats)
    order = [F.col("phase"), F.col("px").desc(), F.col("nuc"), F.col("wc")]
    pairs = numbered(pairs, order, "cell_id")
    n, w = (centroid(p).select(*[F.col(c).alias(f"{x}_{c}") for c in ("label", "area", "row_min", "row_max", "col_min", "col_max", "centroid_r", "centroid_c")]) for p, x in zip(stats, "nw", strict=True))
    rows = pairs.join(n, pairs["nuc"] == n["n_label"]).join(w, pairs["wc"] == w["w_label"])
    return rows.select(
        "cell_id", F.col("nuc").alias("nucleus_label"), F.col("wc").alias("whole_cell_label"),
        F.least("n_row_min", "w_row_min").alias("row_min"), F.least("n_col_min", "w_col_min").alias("col_min"),
        (F.greatest("n_row_max", "w_row_max") + 1).alias("row_max_excl"), (F.greatest("n_col_max", "w_col_max") + 1).alias("col_max_excl"),
        F.col("w_centroid_r").alias("centroid_r"), F.col("w_centroid_c").alias("centroid_c"),
        F.col("n_area").alias("nucleus_area_px"), F.col("w_area").alias("cell_area_px"), F.col("px").alias("overlap_px"),
        overlap_fraction(F.col("px"), F.col("n_area")).alias("overlap_fraction"), F.lit("overlap_1to1").alias("match_source"), (F.col("phase") == 2).alias("by_distance"),
    )
