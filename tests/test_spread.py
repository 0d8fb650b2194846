"""Work on many small groups is spread over tasks, and holds places instead of boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cellweave.functions.groups import grouped
from cellweave.operators import compartments as cp, morphology as mo, outlines as ol, overlay as ov, shape as sh
from cellweave.plans import catalog
from cellweave.sources import boundaries as bd
from cellweave.sources.scenes import Scene
from pyspark.sql import functions as F


def test_rings_of_far_pieces_need_no_box(spark):
    far = 10**6
    pixels = spark.createDataFrame([(1, 10, 10), (1, far, far)], "cell_id long, r int, c int")
    around = mo.outward(pixels, ["cell_id"], 3, (far + 10, far + 10)).collect()
    assert len(around) == 2 * 24 and {(r.r, r.c) for r in around if r.depth == 3} >= {(7, 10), (far, far + 3)}
    assert [r.depth for r in mo.inward(pixels, ["cell_id"]).collect()] == [1, 1]


def test_values_travel_as_a_row_for_each_square(spark):
    places = spark.range(40 * 130).select(F.lit(7).cast("long").alias("cell_id"), F.floor(F.col("id") / 130).cast("int").alias("r"), (F.col("id") % 130).cast("int").alias("c"))
    image = spark.range(40 * 128).select(F.lit(1).alias("ch"), F.floor(F.col("id") / 128).cast("int").alias("r"), (F.col("id") % 128).cast("int").alias("c"), F.col("id").alias("v"))
    rows = cp.sampled(places, image, ["cell_id"]).collect()
    assert len(rows) == 2 and sorted(v for r in rows for v in r.vals) == list(range(40 * 128))
    got = cp.intensity(places, image, ["cell_id"]).first()
    assert (got.n, got["min"], got["max"], got.median) == (5120, 0, 5119, 2559.5) and abs(got["std"] - np.arange(5120).std()) < 1e-9


def test_image_and_rings_travel_packed(spark, tmp_path):
    spark.range(85).select(F.col("id").alias("s_suppkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    items = [(k * 37 % 500, k * 13 % 400, float(k % 50)) for k in range(3000)] + [(-1, 5, 9.0), (None, 5, 9.0), (3, 3, None)]
    spark.createDataFrame(items, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    scene, sums = Scene(spark, str(tmp_path)), {}
    for order, part, n in items[:3000]:
        at = order % 144, part % 160
        sums[at] = sums.get(at, 0) + int(n)
    expected = {(ch, r, c): (r * 31 + c * 17 + ch * 97) % 251 + ch * sums.get((r, c), 0) for ch in (1, 2) for r in range(144) for c in range(160)}
    got = scene.image.collect()
    assert scene.height == 144 and len(got) == len(expected) and {(p.ch, p.r, p.c): p.v for p in got} == expected
    assert scene.squares.count() == 2 * 3 * 3  # not a row for each pixel
    pixels = spark.createDataFrame([(k, 16 * k + y, 60 + x) for k in range(1, 9) for y in range(4) for x in range(9)], "cell_id long, r int, c int")
    rings = mo.outward(pixels, ["cell_id"], 3, (144, 160), True)
    assert rings.count() < 8 * 5 * 4 < mo.outward(pixels, ["cell_id"], 3, (144, 160)).count()
    told = [{(r.cell_id, r.bin, r.ch): tuple(r)[3:] for r in cp.intensity(places, image, ["cell_id", "bin"]).collect()} for places in (rings, mo.outward(pixels, ["cell_id"], 3, (144, 160))) for image in (scene.squares, scene.image)]
    assert len(told[0]) == 2 * rings.select("cell_id", "bin").distinct().count() and all(x == told[0] for x in told)


def test_masks_of_a_scene_are_made_once(spark):
    scene = Scene(spark, "/root/testdata/sf0.001")
    assert scene.masks[0] is scene.masks[0]
    plan = "".join(catalog._outward(scene, True)._jdf.queryExecution().toString().split("Physical Plan")[-1:])
    assert "supplier" not in plan and "is_nuc" not in plan


def test_groups_stay_whole_over_batches(spark):
    def sizes(table, starts):
        return pa.RecordBatch.from_arrays([pa.array(table["k"].to_numpy()[starts]), pa.array(np.diff(np.append(starts, table.num_rows)))], names=["k", "n"])

    rows = spark.range(50_000).select(F.when(F.col("id") < 30_000, 0).otherwise(F.col("id") % 500).cast("long").alias("k"))
    made = grouped(rows, ["k"], sizes, "k long, n long")
    assert {r.k: r.n for r in made.collect()} == {0: 30_040} | {k: 40 for k in range(1, 500)}


def test_small_rows_dont_end_in_one_task(spark):
    pixels = spark.createDataFrame([(k, k, c) for k in range(1, 61) for c in range(2)], "cell_id long, r int, c int")
    diamonds = spark.createDataFrame([(k, bd.well_known([[(k + 1, 0), (k, 1), (k - 1, 0), (k, -1), (k + 1, 0)]])) for k in range(1, 61)], "label long, geometry binary")
    for made, name in ((sh.solidity(pixels), "cell_id"), (ol.outlines(pixels.withColumnRenamed("cell_id", "label")), "label"), (ov.united(diamonds), "label")):
        tasks = made.select(F.spark_partition_id().alias("p"), name).collect()
        assert len(tasks) == 60 and len({r.p for r in tasks}) > 6
