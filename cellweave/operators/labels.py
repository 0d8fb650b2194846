"""Statistics of labels, and cells made from one mask alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.tables import numbered

CELL_COLUMNS = (
    "cell_id", "nucleus_label", "whole_cell_label", "row_min", "col_min", "row_max_excl", "col_max_excl", "centroid_r", "centroid_c",
    "nucleus_area_px", "cell_area_px", "overlap_px", "overlap_fraction", "match_source",
)


def label_stats(pixels: DataFrame) -> DataFrame:
    """``label, area, row_min, row_max, col_min, col_max, row_sum, col_sum`` of each label; 0 is background."""
    return pixels.filter("label <> 0").groupBy("label").agg(
        F.count(F.lit(1)).alias("area"),
        F.min("r").cast("long").alias("row_min"),
        F.max("r").cast("long").alias("row_max"),
        F.min("c").cast("long").alias("col_min"),
        F.max("c").cast("long").alias("col_max"),
        F.sum("r").cast("double").alias("row_sum"),
        F.sum("c").cast("double").alias("col_sum"),
    )


def centroid(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"centroid_r": F.col("row_sum") / F.col("area"), "centroid_c": F.col("col_sum") / F.col("area")})


def overlap_fraction(overlap: Column, area: Column) -> Column:
    return F.when(area > 0, overlap / area).otherwise(F.lit(0.0))


def single_mask_cells(pixels: DataFrame, source: str) -> DataFrame:
    """One cell for each label, numbered from 1 in label order; ``source`` is ``wc_only`` or ``nuc_only``.

    Both areas hold the label's own area, as only one mask is known.
    """
    rows = numbered(centroid(label_stats(pixels)), [F.col("label")], "cell_id")
    nucleus = F.col("label") if source == "nuc_only" else F.lit(None).cast("long")
    whole = F.col("label") if source == "wc_only" else F.lit(None).cast("long")
    return rows.select(
        "cell_id", nucleus.alias("nucleus_label"), whole.alias("whole_cell_label"), "row_min", "col_min",
        (F.col("row_max") + 1).alias("row_max_excl"), (F.col("col_max") + 1).alias("col_max_excl"), "centroid_r", "centroid_c",
        F.col("area").alias("nucleus_area_px"), F.col("area").alias("cell_area_px"), F.lit(0).cast("long").alias("overlap_px"),
        F.lit(0.0).alias("overlap_fraction"), F.lit(source).alias("match_source"),
    )


def digest(pixels: DataFrame) -> DataFrame:
    """An order-free fingerprint of a mask: count, sum and exclusive or of the pixels' hashes."""
    h = F.xxhash64("r", "c", "label")
    return pixels.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s"), F.bit_xor(h).alias("x"))


def tiles(cells: DataFrame, size: int = 2048) -> DataFrame:
    """``cell_id, tile_r, tile_c``: the tile that holds the centroid."""
    return cells.select("cell_id", F.floor(F.col("centroid_r") / size).cast("long").alias("tile_r"), F.floor(F.col("centroid_c") / size).cast("long").alias("tile_c"))


def batches(stats: DataFrame, size: int = 2000) -> DataFrame:
    """``label, batch``: labels in ascending order, ``size`` to a batch."""
    return numbered(stats.select("label"), [F.col("label")], "_n", 0).select("label", F.floor(F.col("_n") / size).cast("long").alias("batch"))
