"""Masks and images on coarser grids, and masks painted from shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def step_of(factor: float) -> int:
    """The whole step of a downsampling factor, rounded half to even; 1 leaves all as it is."""
    return max(1, round(factor)) if factor > 1 else 1


def _blocks(pixels: DataFrame, size: tuple[int, int], step: int) -> DataFrame:
    h, w = (x // step * step for x in size)
    return pixels.filter((F.col("r") < h) & (F.col("c") < w)).withColumns({"r": F.floor(F.col("r") / step).cast("int"), "c": F.floor(F.col("c") / step).cast("int")})


def downsample_mask(pixels: DataFrame, size: tuple[int, int], factor: float) -> DataFrame:
    """The largest label of each block; rows and columns beyond the last whole block go. Too small a mask stays as it is."""
    step = step_of(factor)
    if step < 2 or min(size) < step:
        return pixels.select("r", "c", "label")
    return _blocks(pixels.filter("label <> 0"), size, step).groupBy("r", "c").agg(F.max("label").alias("label"))


def downsample_image(image: DataFrame, size: tuple[int, int], factor: float) -> DataFrame:
    """The mean of each block of each channel, in single precision. ``image`` has every place."""
    step = step_of(factor)
    if step < 2 or min(size) < step:
        return image.select("ch", "r", "c", F.col("v").cast("float").alias("v"))
    return _blocks(image, size, step).groupBy("ch", "r", "c").agg((F.sum("v") / F.count("v")).cast("float").alias("v"))


def painted(places: DataFrame) -> DataFrame:
    """``r, c, label``: of the shapes (``ord, label, r, c``) over a place the smallest wins; of equal ones the last."""
    area = places.groupBy("ord").agg(F.count(F.lit(1)).alias("area"))
    first = F.row_number().over(Window.partitionBy("r", "c").orderBy(F.col("area"), F.col("ord").desc()))
    return places.join(area, "ord").withColumn("_k", first).filter("_k = 1").select("r", "c", "label")


def filled(edges: DataFrame, centre: float = 0.0) -> DataFrame:
    """``id, r, c``: places inside polygons given as edges (``id, y0, x0, y1, x1``), by the even-odd rule along each row.

    A place stands for the point at its index plus ``centre``. Points on a left border are inside, on a right one out.
    """
    y = F.col("r") + F.lit(centre)
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.filter("y0 <> y1").withColumn("r", F.explode(F.sequence(F.ceil(low - centre).cast("int"), F.ceil(high - centre).cast("int"))))
    rows = rows.filter((y >= low) & (y < high)).withColumn("x", F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    ordered = Window.partitionBy("id", "r").orderBy("x")
    spans = rows.withColumns({"k": F.row_number().over(ordered), "until": F.lead("x").over(ordered)}).filter("k % 2 = 1 and until is not null")
    first, last = F.ceil(F.col("x") - centre).cast("int"), (F.ceil(F.col("until") - centre) - 1).cast("int")
    return spans.filter(first <= last).select("id", "r", F.explode(F.sequence(first, last)).alias("c"))


def grown(seeds: DataFrame, radius: int, size: tuple[int, int]) -> DataFrame:
    """``r, c``: places within ``radius`` (Euclidean) of a seed, inside the image."""
    reach = [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]
    spots = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in reach]))
    rows = seeds.select("r", "c").distinct().select("r", "c", spots.alias("o")).select((F.col("r") + F.col("o.a")).alias("r"), (F.col("c") + F.col("o.b")).alias("c"))
    return rows.filter(F.col("r").between(0, size[0] - 1) & F.col("c").between(0, size[1] - 1)).distinct()


def growth_zone(seeds: DataFrame, claimed: DataFrame, distance: float, size: tuple[int, int]) -> DataFrame:
    """Where unmatched nuclei may grow: around their pixels, but not over those of matched cells."""
    return grown(seeds, max(1, int(distance)), size).join(claimed.select("r", "c"), ["r", "c"], "left_anti")


def candidate_pairs(boxes: DataFrame, square: int = 64) -> DataFrame:
    """``i, j`` (i < j) of boxes (``id, row_min, row_max, col_min, col_max``, inclusive) that meet, over grid squares."""
    at = lambda a, b: F.sequence(F.floor(F.col(a) / square), F.floor(F.col(b) / square))
    dealt = boxes.withColumn("gy", F.explode(at("row_min", "row_max"))).withColumn("gx", F.explode(at("col_min", "col_max")))
    a = dealt.select("gy", "gx", *[F.col(c).alias(f"a_{c}") for c in boxes.columns])
    b = dealt.select("gy", "gx", *[F.col(c).alias(f"b_{c}") for c in boxes.columns])
    meet = (F.col("a_id") < F.col("b_id")) & (F.col("a_row_min") <= F.col("b_row_max")) & (F.col("b_row_min") <= F.col("a_row_max")) & (F.col("a_col_min") <= F.col("b_col_max")) & (F.col("b_col_min") <= F.col("a_col_max"))
    return a.join(b, ["gy", "gx"]).filter(meet).select(F.col("a_id").alias("i"), F.col("b_id").alias("j")).distinct()
