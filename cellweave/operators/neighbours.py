"""Nearest neighbours of cells within a distance, and means of their measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .matching import near_pairs


def nearest(cells: DataFrame, k: int, radius: float) -> DataFrame:
    """``cell_id, neighbour_id, d2, rank``: up to ``k`` other cells within ``radius`` pixels, nearest first (ties: lower id)."""
    points = cells.select(F.col("cell_id").alias("id"), F.col("centroid_r").alias("y"), F.col("centroid_c").alias("x"))
    pairs = near_pairs(points, points, radius).filter("a_id <> b_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("a_id").orderBy("d2", "b_id"))).filter(F.col("rank") <= k)
    return ranked.select(F.col("a_id").alias("cell_id"), F.col("b_id").alias("neighbour_id"), "d2", "rank")


def neighbour_means(neighbours: DataFrame, long: DataFrame) -> DataFrame:
    """``cell_id, key, value``: the mean of each key over the neighbours that have a finite value for it."""
    finite = ~F.isnan("value") & (F.abs("value") != float("inf"))
    known = long.filter(F.col("value").isNotNull() & finite & ~F.col("key").startswith("Neighbours: ")).select(F.col("cell_id").alias("neighbour_id"), "key", "value")
    rows = neighbours.select("cell_id", "neighbour_id").join(known, "neighbour_id")
    return rows.groupBy("cell_id", F.concat(F.lit("Neighbours: Mean: "), "key").alias("key")).agg((F.sum("value") / F.count("value")).alias("value"))
