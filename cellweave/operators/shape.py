"""Shape of cells: area, axes and perimeter from pixel relations, solidity through convex hulls."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cellweave.functions.groups import grouped

#: The length that a border pixel adds, by the sum of its border neighbours' weights (2 a side, 10 a corner, 1 itself).
PERIMETER_WEIGHTS = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}


def moments(pixels: DataFrame) -> DataFrame:
    """``cell_id, area`` and the sums of ``r, c, r*r, c*c, r*c`` (long)."""
    r, c = F.col("r").cast("long"), F.col("c").cast("long")
    return pixels.groupBy("cell_id").agg(F.count(F.lit(1)).alias("area"), *[F.sum(x).alias(n) for x, n in ((r, "sr"), (c, "sc"), (r * r, "srr"), (c * c, "scc"), (r * c, "src"))])


def axes(sums: DataFrame) -> DataFrame:
    """``cell_id, major, minor``: four times the roots of the eigenvalues of the covariance, each pixel a unit square."""
    n = F.col("area").cast("double")
    mu = lambda a, b, ab: (F.col(ab) * F.col("area") - F.col(a) * F.col(b)).cast("double") / (n * n)
    rows = sums.select("cell_id", (mu("sr", "sr", "srr") + 1 / 12).alias("a"), (mu("sc", "sc", "scc") + 1 / 12).alias("b"), mu("sr", "sc", "src").alias("m"))
    root = F.sqrt(4 * F.col("m") * F.col("m") + (F.col("a") - F.col("b")) * (F.col("a") - F.col("b")))
    value = lambda sign: 4 * F.sqrt(F.greatest((F.col("a") + F.col("b") + sign * root) / 2, F.lit(0.0)))
    return rows.select("cell_id", value(1).alias("major"), value(-1).alias("minor"))


def perimeter(border: DataFrame) -> DataFrame:
    """``cell_id, perimeter`` from the border pixels (``cell_id, r, c``), by the weights of their neighbours on the border."""
    offsets = [(dr, dc, 1 if not dr and not dc else 2 if not dr or not dc else 10) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    spots = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(w).alias("w")) for dr, dc, w in offsets]))
    spread = border.select("cell_id", "r", "c", spots.alias("o")).select("cell_id", (F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"), F.col("o.w").alias("w"))
    codes = spread.groupBy("cell_id", "r", "c").agg(F.sum("w").alias("code"), F.max(F.when(F.col("w") == 1, 1)).alias("own")).filter("own = 1")
    length = F.lit(0.0)
    for value, members in PERIMETER_WEIGHTS.items():
        length = F.when(F.col("code").isin(*members), F.lit(value)).otherwise(length)
    return codes.groupBy("cell_id").agg(F.sum(length).alias("perimeter"))


def circularity(area: Column, length: Column) -> Column:
    """Between 0 and 1; 0 for less than five pixels or no perimeter."""
    round_ = 4 * math.pi * area / (length * length)
    return F.when((area < 5) | (length <= 0), F.lit(0.0)).otherwise(F.least(F.greatest(round_, F.lit(0.0)), F.lit(1.0)))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def solidity(pixels: DataFrame) -> DataFrame:
    """``cell_id, solidity``: pixels over those whose centre lies in the convex hull of all pixels' edge midpoints.

    Only the first and last column of each row of a cell are sent to the hull, and pixels in it are counted by row, so
    that a cell of far pieces needs no more memory than it has rows.
    """
    rows = pixels.groupBy("cell_id", "r").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("n"))

    def made(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        columns = [np.split(table[x].to_numpy(), starts[1:]) for x in ("r", "c0", "c1", "n")]
        found = [_solidity(*own) for own in zip(*columns, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(table["cell_id"].to_numpy()[starts], pa.int64()), pa.array(found, pa.float64())], names=["cell_id", "solidity"])

    return grouped(rows, ["cell_id"], made, "cell_id long, solidity double")


def _solidity(r: np.ndarray, c0: np.ndarray, c1: np.ndarray, n: np.ndarray) -> float:
    r, c0, c1 = (x.astype(float) for x in (r, c0, c1))
    points = np.concatenate([np.stack([r + dr, c + dc], axis=1) for c in (c0, c1) for dr, dc in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))])
    hull = convex_hull(points - [r.min(), c0.min()])
    ys = np.arange(r.max() - r.min() + 1)
    low, high = np.full(len(ys), -np.inf), np.full(len(ys), np.inf)
    for (ay, ax), (by, bx) in zip(hull, np.roll(hull, -1, axis=0), strict=True):  # a side bounds each row on one side
        if by > ay:
            high = np.minimum(high, ax + ((bx - ax) * (ys - ay) + 1e-9) / (by - ay))
        elif by < ay:
            low = np.maximum(low, ax + ((bx - ax) * (ys - ay) + 1e-9) / (by - ay))
        else:
            high = np.where((bx - ax) * (ys - ay) < -1e-9, -np.inf, high)
    inside = np.maximum(np.floor(high) - np.ceil(low) + 1, 0).sum()
    return float(n.sum() / max(inside, 1))


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of ``(y, x)`` points, counter-clockwise in x, y (monotone chain)."""
    p = np.unique(points[:, ::-1], axis=0)

    def chain(ps: np.ndarray) -> list:
        out: list = []
        for q in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))[:, ::-1] if len(p) > 2 else p[:, ::-1]


def shape_measurements(areas: DataFrame, pixel_size: float) -> DataFrame:
    """``cell_id, key, value`` from ``cell_id, compartment, area, perimeter, major, minor, solidity`` in pixels."""
    name = F.initcap("compartment")
    values = {
        "Area µm^2": F.col("area") * (pixel_size * pixel_size),
        "Circularity": circularity(F.col("area"), F.col("perimeter")),
        "Length µm": F.col("perimeter") * pixel_size,
        "Max diameter µm": F.col("major") * pixel_size,
        "Min diameter µm": F.col("minor") * pixel_size,
        "Solidity": F.col("solidity"),
    }
    pairs = F.explode(F.array(*[F.struct(F.concat(name, F.lit(f": {k}")).alias("key"), v.cast("double").alias("value")) for k, v in values.items()]))
    rows = areas.select("cell_id", pairs.alias("p")).select("cell_id", "p.key", "p.value")
    both = areas.groupBy("cell_id").agg(F.max(F.when(F.col("compartment") == "NUCLEUS", F.col("area"))).alias("n"), F.max(F.when(F.col("compartment") == "CELL", F.col("area"))).alias("w"))
    part = both.filter("n is not null").select("cell_id", F.lit("Nucleus/Cell area ratio").alias("key"), ratio(F.col("n"), F.col("w")).alias("value"))
    return rows.unionByName(part)
