"""Registered queries on small tables of suppliers that hold what the small scale factors lack."""

from __future__ import annotations

from cellweave.plans import catalog
from cellweave.sources import scenes


def suppliers(spark, path, keys):
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def test_a_nucleus_cut_in_two_counts_whole(spark, tmp_path):
    # cell 814 loses a bite that leaves one pixel of its nucleus on either side
    there = suppliers(spark, tmp_path, range(812, 817))
    found = {r.label: r.px for r in catalog.QUERIES["clipped_nuclei"](spark, there).collect()}
    assert found[814] == 2


def test_disks_are_spread_over_tasks(spark, tmp_path):
    scene = scenes.Scene(spark, suppliers(spark, tmp_path, range(3 * scenes.DISKS)))
    assert scene.disk_pixels(scene.cell_disks).rdd.getNumPartitions() == 3
    assert scene.height == (3 * scenes.DISKS // 10 + 1) * scenes.CELL
    labels = scene.cells.select("label").distinct().count()
    assert labels == sum(k % 17 != 5 for k in range(3 * scenes.DISKS))


def test_overlapping_cells_read_each_pixel_once(spark, tmp_path):
    there = suppliers(spark, tmp_path, range(3, 65))
    rows = catalog.QUERIES["overlapping_cells"](spark, there)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # pixels that a join sends whole to every task outgrow it
    assert {(r.i, r.j): r.px for r in rows.collect()} == shared(spark, there)


def shared(spark, there):
    """Shared places by brute force."""
    scene, over = scenes.Scene(spark, there), {}
    for r in scene.disk_pixels(scene.cell_disks).collect():
        over.setdefault((r.r, r.c), []).append(r.label)
    pairs = [(i, j) for labels in over.values() for i in labels for j in labels if i < j]
    return {p: pairs.count(p) for p in set(pairs)}
