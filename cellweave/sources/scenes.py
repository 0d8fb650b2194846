"""Deterministic scenes of disks, derived from the tables ``supplier`` and ``lineitem``, as pixel relations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellweave.functions.groups import grouped
from cellweave.functions.tables import table, written
from cellweave.operators.compartments import SQUARE

WIDTH, CELL = 160, 16
#: Disks of one task: the table of suppliers is a small file, but each of its rows makes a hundred pixels.
DISKS = 4096


@dataclass(frozen=True)
class Scene:
    """Nuclei and whole cells as ``(r, c, label)``, two channels of integer intensities as ``(ch, r, c, v)``."""

    spark: SparkSession
    sf_dir: str

    @cached_property
    def centres(self) -> DataFrame:
        k = F.col("s_suppkey").cast("int")
        rows = table(self.spark, self.sf_dir, "supplier").select(k.alias("k"), (k % 10).alias("gc"), F.floor(k / 10).cast("int").alias("gr"))
        if (parts := -(-self._extent[1] // DISKS)) > 1:
            rows = rows.repartition(parts, "gr")
        return rows.select("k", "gr", (F.col("gr") * CELL + 8 + F.col("k") * 7 % 5 - 2).alias("cy"), (F.col("gc") * CELL + 8 + F.col("k") * 11 % 5 - 2).alias("cx"))

    @cached_property
    def _extent(self) -> tuple[int, int]:
        """The last row of the grid, and the number of its places."""
        return tuple(table(self.spark, self.sf_dir, "supplier").agg(F.max(F.floor(F.col("s_suppkey").cast("int") / 10).cast("int")), F.count(F.lit(1))).first())

    @property
    def height(self) -> int:
        return (self._extent[0] + 1) * CELL

    @cached_property
    def cell_disks(self) -> DataFrame:
        """``label, cy, cx, rad``; every thirtieth disk is moved over its neighbour."""
        rad = F.when(F.col("k") % 13 == 7, 3).otherwise(4 + F.col("k") % 3)
        moved = F.col("cx") + F.when(F.col("k") % 30 == 3, 10).otherwise(0)
        return self.centres.filter("k % 17 <> 5").select((F.col("k") + 1).alias("label"), "cy", moved.alias("cx"), rad.alias("rad"))

    @cached_property
    def nucleus_disks(self) -> DataFrame:
        shift = F.floor(F.col("k") / 3).cast("int") % 3 - 1 + F.when(F.col("k") % 13 == 7, 6).otherwise(0)
        large = self.centres.filter("k % 11 <> 3").select((F.col("k") + 1).alias("label"), (F.col("cy") + F.col("k") % 3 - 1).alias("cy"), (F.col("cx") + shift).alias("cx"), F.lit(2).alias("rad"))
        small = self.centres.filter("k % 7 = 2").select((F.col("k") + 100000).alias("label"), (F.col("cy") - 3).alias("cy"), F.col("cx"), F.lit(1).alias("rad"))
        return large.unionByName(small)

    def disk_pixels(self, disks: DataFrame) -> DataFrame:
        """Every pixel of every disk inside the image: ``label, r, c``."""
        offsets = F.sequence(-F.col("rad"), F.col("rad"))
        rows = disks.select("label", "cy", "cx", "rad", F.explode(offsets).alias("a")).select("*", F.explode(offsets).alias("b"))
        rows = rows.filter("a * a + b * b <= rad * rad").select("label", (F.col("cy") + F.col("a")).alias("r"), (F.col("cx") + F.col("b")).alias("c"))
        return rows.filter(F.col("r").between(0, self.height - 1) & F.col("c").between(0, WIDTH - 1))

    def _mask(self, disks: DataFrame) -> DataFrame:
        return self.disk_pixels(disks).groupBy("r", "c").agg(F.max("label").cast("long").alias("label"))

    @cached_property
    def cells(self) -> DataFrame:
        return self._mask(self.cell_disks)

    @cached_property
    def nuclei(self) -> DataFrame:
        return self._mask(self.nucleus_disks)

    @cached_property
    def masks(self) -> tuple[DataFrame, DataFrame]:
        """Nuclei and whole cells as written tables, for plans that read them several times."""
        return written(self.nuclei, "nuclei"), written(self.cells, "whole")

    @cached_property
    def squares(self) -> DataFrame:
        """Both channels on the whole grid, cut into squares as ``compartments.sampled`` takes them: the sums of a band of rows meet in one task, which adds the rest."""
        h = self.height
        q = table(self.spark, self.sf_dir, "lineitem").groupBy((F.col("l_orderkey") % h).cast("int").alias("r"), (F.col("l_partkey") % WIDTH).cast("int").alias("c"))
        q = q.agg(F.sum(F.col("l_quantity").cast("long")).alias("q")).filter("r >= 0 and c >= 0 and q is not null")
        every = self.spark.range(0, h, SQUARE).select(F.col("id").cast("int").alias("r"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("q"))  # a row for each band
        rows = q.unionByName(every).select(F.floor(F.col("r") / SQUARE).cast("int").alias("by_"), "r", "c", "q")

        def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            bands, g = rows["by_"].to_numpy()[starts], np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
            sums = np.zeros((len(starts), SQUARE, WIDTH), np.int64)
            np.add.at(sums, (g, rows["r"].to_numpy() % SQUARE, rows["c"].to_numpy()), rows["q"].to_numpy())
            parts = []
            for band, own in zip(bands.tolist(), sums, strict=True):
                r = np.arange(band * SQUARE, min((band + 1) * SQUARE, h))[:, None]
                for ch in (1, 2):
                    v = (r * 31 + np.arange(WIDTH) * 17 + ch * 97) % 251 + ch * own[: len(r)]
                    for left in range(0, WIDTH, SQUARE):
                        part = v[:, left : left + SQUARE]
                        at = np.arange(len(part))[:, None] * SQUARE + np.arange(part.shape[1])
                        parts.append((ch, band, left // SQUARE, at.ravel(), part.ravel()))
            ends = pa.array(np.append(0, np.cumsum([len(x[3]) for x in parts])), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in parts]), kind)) for k, kind in ((3, pa.int16()), (4, pa.int64()))]
            return pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in parts], pa.int32()) for k in range(3)), *lists], names=["ch", "by_", "bx_", "at", "v"])

        return grouped(rows, ["by_"], made, "ch int, by_ int, bx_ int, at array<smallint>, v array<bigint>")

    @cached_property
    def image(self) -> DataFrame:
        """Both channels on the whole grid."""
        rows = self.squares.select("ch", "by_", "bx_", F.inline(F.arrays_zip("at", "v")))
        r, c = F.col("by_") * SQUARE + F.shiftright("at", SQUARE.bit_length() - 1), F.col("bx_") * SQUARE + F.col("at") % SQUARE
        return rows.select("ch", r.cast("int").alias("r"), c.cast("int").alias("c"), "v")
