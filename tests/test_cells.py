"""Matching, measurement and raster operators on small masks with known results."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cellweave.operators import clipping as cl, compartments as cp, labels as lb, matching as mt, measure as me, morphology as mo, neighbours as nb, outlines as ol, raster as ra, shape as sh
from cellweave.functions.tables import numbered
from cellweave.sources import slides
from pyspark.sql import functions as F

MASK = "r int, c int, label long"


def mask(spark, rows):
    return spark.createDataFrame([(r, c, int(v)) for r, row in enumerate(rows) for c, v in enumerate(row) if v], MASK)


def image(spark, array):
    return spark.createDataFrame([(1, r, c, int(v)) for (r, c), v in np.ndenumerate(np.array(array))], "ch int, r int, c int, v long")


def test_overlaps_and_greedy_ties(spark):
    nuc, wc = mask(spark, [[1, 1, 2, 2]]), mask(spark, [[10, 10, 10, 10]])
    assert sorted(map(tuple, mt.overlap_counts(nuc, wc).collect())) == [(1, 10, 2), (2, 10, 2)]
    pairs = spark.createDataFrame([(1, 10, 4), (2, 10, 4), (2, 20, 3), (3, 20, 9)], "nuc long, wc long, px long")
    assert sorted(map(tuple, mt.greedy_match(pairs).collect())) == [(1, 10, 4), (3, 20, 9)]
    assert mt.greedy_match(pairs.limit(0)).count() == 0


def test_matched_cell_record(spark):
    nuc = mask(spark, [[0] * 6, [0, 0, 0, 1, 1, 0], [0, 0, 0, 1, 1, 0]])
    wc = mask(spark, [[0, 0, 7, 7, 7, 7]] * 4)
    r = mt.matched_cells(nuc, wc).first()
    assert (r.row_min, r.col_min, r.row_max_excl, r.col_max_excl) == (0, 2, 4, 6)
    assert (r.overlap_px, r.overlap_fraction, r.match_source, r.by_distance) == (4, 1.0, "overlap_1to1", False)


@pytest.mark.parametrize(("radius", "found"), [(2.5, 1), (1.0, 0)])
def test_distance_fallback(spark, radius, found):
    nuc, wc = mask(spark, [[0, 1, 1, 0, 0]] * 2), mask(spark, [[0, 0, 0, 5, 5]] * 2)
    cells = mt.matched_cells(nuc, wc, radius).collect()
    assert len(cells) == found and all(c.by_distance and c.overlap_px == 0 for c in cells)


def test_deferred_acceptance_is_serving_by_id(spark):
    rng = np.random.default_rng(3)
    a = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(0, 12, (14, 2)))]
    b = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(0, 12, (12, 2)))]
    free, expected = dict((i, (y, x)) for i, y, x in b), []
    for i, y, x in a:
        near = sorted(((y - v) ** 2 + (x - w) ** 2, j) for j, (v, w) in free.items() if (y - v) ** 2 + (x - w) ** 2 <= 16)
        if near:
            expected.append((i, near[0][1]))
            del free[near[0][1]]
    frame = lambda rows: spark.createDataFrame(rows, "id long, y double, x double")
    assert sorted(map(tuple, mt.distance_match(frame(a), frame(b), 4.0).collect())) == sorted(expected)


def test_single_mask_cells_and_numbers(spark):
    cells = lb.single_mask_cells(mask(spark, [[3, 3, 0, 9]]), "wc_only").orderBy("cell_id").collect()
    assert [(c.cell_id, c.whole_cell_label, c.nucleus_label, c.cell_area_px) for c in cells] == [(1, 3, None, 2), (2, 9, None, 1)]
    rows = numbered(spark.range(1000).repartition(7), [F.col("id").desc()], "n").collect()
    assert sorted((r.n, r.id) for r in rows) == [(i + 1, 999 - i) for i in range(1000)]


def test_compartments_and_intensity(spark):
    wc = [[0] * 7] + [[0] + [4] * 5 + [0]] * 5 + [[0] * 7]
    nuc = [[0] * 7] * 2 + [[0, 0, 2, 2, 2, 0, 0]] * 3 + [[0] * 7] * 2
    cells = mt.matched_cells(mask(spark, nuc), mask(spark, wc))
    places = cp.compartments(cp.cell_pixels(cells, mask(spark, nuc), mask(spark, wc)), cells)
    sizes = {r["compartment"]: r["count"] for r in places.groupBy("compartment").count().collect()}
    assert sizes == {"CELL": 25, "NUCLEUS": 9, "CYTOPLASM": 16, "MEMBRANE": 16}
    values = np.arange(49).reshape(7, 7)
    got = {r["compartment"]: r for r in cp.intensity(places, image(spark, values), ["cell_id", "compartment"]).collect()}
    inner = values[2:5, 2:5].ravel()
    assert got["NUCLEUS"]["mean"] == inner.mean() and got["NUCLEUS"]["std"] == pytest.approx(inner.std()) and got["NUCLEUS"]["median"] == np.median(inner)
    pixels = cp.cell_pixels(cells, mask(spark, nuc), mask(spark, wc))
    once = {r["compartment"]: r for r in cp.compartment_intensity(pixels, cells, image(spark, values)).collect()}
    assert {k: r.asDict() for k, r in once.items()} == {k: r.asDict() for k, r in got.items()}
    p = cp.compartment_percentiles(pixels, cells, image(spark, values), [33.0]).filter("compartment = 'NUCLEUS'").first()
    assert p["value"] == pytest.approx(np.percentile(inner, 33.0))
    assert cp.compartment_percentiles(pixels, cells, image(spark, values), [50.0], 25).select("compartment").distinct().count() == 4
    assert cp.compartment_percentiles(pixels, cells, image(spark, values), [50.0], 26).count() == 0
    keyed = cp.keyed(cp.intensity(places, image(spark, values), ["cell_id", "compartment"]), spark.createDataFrame([(1, "CD3")], "ch int, name string"))
    assert {"CD3: Cell: Mean", "CD3: Nucleus: Std.Dev."} <= set(cp.as_map(keyed).first()["measurements"])


def test_deviation_neither_overflows_nor_loses_constants(spark):
    one = spark.range(60000).select(F.lit(1).alias("cell_id"), F.lit(0).alias("r"), F.col("id").cast("int").alias("c"))
    long = one.select(F.lit(1).alias("ch"), "r", "c", F.lit(65535).cast("long").alias("v"))
    assert cp.intensity(one, long, ["cell_id"]).first()["std"] == 0.0
    for value, n in ((70000.3, 7), (636.96, 3)):
        constant = long.filter(F.col("c") < n).withColumn("v", F.lit(value))
        assert cp.intensity(one, constant, ["cell_id"]).first()["std"] == 0.0


def test_a_nucleus_outside_its_cell_leaves_no_cytoplasm(spark):
    nuc, wc = mask(spark, [[0, 1, 1, 0, 0]] * 2), mask(spark, [[0, 0, 0, 5, 5]] * 2)
    cells = mt.matched_cells(nuc, wc, 5.0)
    pixels = cp.cell_pixels(cells, nuc, wc)
    assert {r[0] for r in cp.compartments(pixels, cells).select("compartment").distinct().collect()} == {"CELL", "MEMBRANE"}
    assert {r["compartment"] for r in cp.compartment_intensity(pixels, cells, image(spark, [[1] * 5] * 2)).collect()} == {"CELL", "MEMBRANE"}


def test_one_mask_alone_has_no_cytoplasm(spark):
    wc = mask(spark, [[1] * 5] * 5)
    cells = lb.single_mask_cells(wc, "wc_only")
    names = {r[0] for r in cp.compartments(cp.cell_pixels(cells, wc.limit(0), wc), cells).select("compartment").distinct().collect()}
    assert names == {"CELL", "MEMBRANE"}
    cells = lb.single_mask_cells(wc, "nuc_only")
    names = {r[0] for r in cp.compartments(cp.cell_pixels(cells, wc, wc.limit(0)), cells).select("compartment").distinct().collect()}
    assert names == {"CELL", "NUCLEUS"}


def _loop_depths(m):
    depth, k, now = np.zeros(m.shape, int), 0, np.pad(m, 1)
    while now.any():
        k += 1
        inner = now.copy()
        for axis in (0, 1):
            for s in (1, -1):
                inner &= np.roll(now, s, axis)
        depth[(now & ~inner)[1:-1, 1:-1]] = k
        now = inner
    return depth


@pytest.mark.parametrize("seed", range(3))
def test_rings_equal_iterated_morphology(spark, seed):
    m = np.random.default_rng(seed).random((9, 11)) < 0.8
    pixels = spark.createDataFrame([(1, r, c) for r, c in zip(*(x.tolist() for x in np.nonzero(m)), strict=True)], "cell_id long, r int, c int")
    expected = _loop_depths(m)
    inward = mo.inward(pixels, ["cell_id"])
    assert {(r.r, r.c): r.depth for r in inward.collect()} == {(r, c): expected[r, c] for r, c in zip(*np.nonzero(m), strict=True)}
    rings = mo.erosion_rings(inward, ["cell_id"]).collect()
    assert sum(r.n for r in rings) == m.sum() and all(1 <= r.bin <= 5 for r in rings)
    assert [r.bin for r in sorted(rings, key=lambda r: r.depth)] == sorted(r.bin for r in rings)
    outward = mo.outward(pixels, ["cell_id"], 3, m.shape).collect()
    rows = np.array(np.nonzero(m)).T
    near = {(r, c): int(np.abs(rows - [r, c]).sum(axis=1).min()) for r, c in np.ndindex(*m.shape) if not m[r, c]}
    assert {(r.r, r.c): r.depth for r in outward} == {k: d for k, d in near.items() if d <= 3}


def test_shape_of_a_square(spark):
    m = np.ones((5, 5), bool)
    pixels = cp.with_membrane(spark.createDataFrame([(1, r, c) for r, c in np.ndindex(*m.shape)], "cell_id long, r int, c int"))
    axes = sh.axes(sh.moments(pixels)).first()
    assert axes.major == pytest.approx(4 * np.sqrt(2 + 1 / 12)) and axes.minor == pytest.approx(axes.major)
    assert sh.perimeter(pixels.filter("is_membrane")).first().perimeter == pytest.approx(16.0)
    assert sh.solidity(pixels).first().solidity == 1.0
    assert spark.range(1).select(sh.circularity(F.lit(3.0), F.lit(2.0)), sh.ratio(F.lit(1), F.lit(0))).first()[:] == (0.0, 0.0)


def test_neighbours(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 3.0), (3, 0.0, 100.0), (4, 0.0, 0.0)], "cell_id long, centroid_r double, centroid_c double")
    near = nb.nearest(cells, 1, 20.0)
    assert {(r.cell_id, r.neighbour_id) for r in near.collect()} == {(1, 4), (4, 1), (2, 1)}
    long = spark.createDataFrame([(1, "a", 9.0), (4, "a", float("nan")), (2, "a", 4.0)], "cell_id long, key string, value double")
    assert {(r.cell_id, r.value) for r in nb.neighbour_means(near, long).collect()} == {(4, 9.0), (2, 9.0)}


def test_downsampling(spark):
    assert [ra.step_of(f) for f in (1.0, 1.4, 1.5, 2.5, 3.5)] == [1, 1, 2, 2, 4]
    whole = ra.downsample_image(image(spark, np.arange(1, 17).reshape(4, 4)), (4, 4), 4.0).collect()
    assert [(r.r, r.c, r.v) for r in whole] == [(0, 0, 8.5)]
    assert ra.downsample_mask(mask(spark, [[5, 0, 1], [10, 0, 1]]), (2, 3), 2.0).collect() == [(0, 0, 10)]
    assert ra.downsample_mask(mask(spark, [[5]]), (1, 1), 10.0).collect() == [(0, 0, 5)]


def test_painting_smaller_wins_and_later_of_equals(spark):
    square = lambda o, r0, c0, n: [(o, o + 10, r, c) for r in range(r0, r0 + n) for c in range(c0, c0 + n)]
    rows = square(1, 0, 0, 5) + square(2, 1, 1, 2) + square(3, 1, 1, 2)
    got = {(r.r, r.c): r.label for r in ra.painted(spark.createDataFrame(rows, "ord int, label int, r int, c int")).collect()}
    assert got[1, 1] == 13 and got[0, 0] == 11 and len(got) == 25


@pytest.mark.parametrize(("centre", "expected"), [(0.0, {(1, 1), (1, 2), (2, 1), (2, 2)}), (0.5, {(1, 1), (1, 2), (2, 1), (2, 2)})])
def test_filled_polygon(spark, centre, expected):
    ring = [(1.0, 1.0), (1.0, 3.0), (3.0, 3.0), (3.0, 1.0)]
    edges = [(1, *ring[i], *ring[(i + 1) % 4]) for i in range(4)]
    got = ra.filled(spark.createDataFrame(edges, "id int, y0 double, x0 double, y1 double, x1 double"), centre)
    assert {(r.r, r.c) for r in got.collect()} == expected


def test_outline_of_labels(spark):
    ring = ol.rings(np.ones((2, 3), bool))[0]
    assert ol.area(ring) == pytest.approx(6 - 0.5)
    assert len(ol.rings(np.eye(2, dtype=bool))) == 2
    rows = ol.outlines(mask(spark, [[1, 1, 1, 0, 2], [1, 1, 1, 0, 0]]), 0.0).orderBy("label").collect()
    assert [r.label for r in rows] == [1, 2] and rows[1].area == pytest.approx(0.5)
    assert rows[0].ring[0] == rows[0].ring[-1]
    line = np.array([(0, 0), (1, 0.1), (2, 0), (3, 0.1), (4, 0), (4, 4), (0, 4)], float)
    assert len(ol.simplified(line, 0.5)) == 4


def test_growing_cells_around_nuclei(spark):
    seeds = mask(spark, [[0] * 9, [0, 1, 0, 0, 0, 0, 0, 2, 0], [0] * 9])
    zone = ra.growth_zone(seeds, mask(spark, [[0] * 9]).limit(0), 3.0, (3, 9))
    cells, grown = ol.synthesised(seeds, zone, 3.0, 5)
    got = {(r.r, r.c): r.label for r in grown.collect()}
    assert got[1, 3] == 1 and got[1, 5] == 2 and len(got) == zone.count()
    assert [(c.cell_id, c.match_source) for c in cells.orderBy("cell_id").collect()] == [(5, "watershed_synth"), (6, "watershed_synth")]
    claimed = mask(spark, [[0] * 9, [0, 7] + [0] * 7])
    cells, _ = ol.synthesised(seeds, ra.growth_zone(seeds, claimed, 3.0, (3, 9)), 3.0, 5)
    assert [c.cell_id for c in cells.collect()] == [6]


def plain_flood(seeds, zone, radius):
    """One queue over the whole image: by distance to the nearest seed, then by the order of reaching."""
    value = {p: min(((p[0] - s[0]) ** 2 + (p[1] - s[1]) ** 2 for s in seeds), default=0) for p in zone}
    label = {p: k for p, k in seeds.items() if p in zone}
    queue = [(value[p], age, p) for age, p in enumerate(sorted(label))]
    age = len(queue)
    while queue:
        entry = min(queue)
        queue.remove(entry)
        r, c = entry[2]
        for p in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
            if p in zone and p not in label:
                label[p] = label[r, c]
                queue.append((value[p], age, p))
                age += 1
    return label


@pytest.mark.parametrize(("tile", "halo", "seed"), [(256, None, 1), (16, None, 2), (8, 4, 3), (5, 2, 4)])
def test_floods_by_tiles_are_one_flood(spark, tile, halo, seed):
    rng, radius = random.Random(seed), 4
    seeds = {}
    for k in range(1, 40):
        y, x = rng.randrange(50), rng.randrange(50)
        seeds |= {(y + a, x + b): k for a in range(rng.choice([1, 2, 3])) for b in range(rng.choice([1, 2]))}
    walls = {(rng.randrange(52), x) for x in range(0, 52, 1) for _ in range(12)}
    zone = {(r, c) for r in range(52) for c in range(52) if (r, c) not in walls and any((r - y) ** 2 + (c - x) ** 2 <= radius * radius for y, x in seeds)}
    table = spark.createDataFrame([(r, c, k) for (r, c), k in seeds.items()], "r int, c int, label long")
    got = ol.flooded(table, spark.createDataFrame(sorted(zone), "r int, c int"), radius, tile, halo)
    assert sorted((r.r, r.c, r.label) for r in got.collect()) == sorted((r, c, k) for (r, c), k in plain_flood(seeds, zone, radius).items())
    assert ol.flooded(table.limit(0), spark.createDataFrame(sorted(zone), "r int, c int"), radius).collect() == []


def test_candidate_pairs(spark):
    boxes = spark.createDataFrame([(1, 0, 5, 0, 5), (2, 5, 9, 5, 9), (3, 200, 300, 0, 5), (4, 0, 250, 3, 4)], "id long, row_min long, row_max long, col_min long, col_max long")
    assert sorted(map(tuple, ra.candidate_pairs(boxes).collect())) == [(1, 2), (1, 4), (3, 4)]


def test_digest_ignores_order(spark):
    m = mask(spark, [[1, 2], [3, 4]])
    assert lb.digest(m).first() == lb.digest(m.orderBy(F.desc("label"))).first() != lb.digest(mask(spark, [[1, 2], [4, 3]])).first()


def square(label, r0, c0, n):
    return [(label, r, c) for r in range(r0, r0 + n) for c in range(c0, c0 + n)]


def areas(frame):
    return {r.label: r["count"] for r in frame.groupBy("label").count().collect()}


def test_trimming_takes_pairs_in_order(spark):
    shapes = lambda rows: spark.createDataFrame(rows, "label long, r int, c int")
    # the larger loses; of equal ones the first; what was cut free is dropped
    assert areas(cl.trimmed(shapes(square(1, 0, 0, 4) + square(2, 2, 2, 3)))) == {1: 12, 2: 9}
    assert areas(cl.trimmed(shapes(square(1, 0, 0, 3) + square(2, 2, 2, 3)))) == {1: 8, 2: 9}
    bar = [(1, 0, c) for c in range(7)] + [(2, r, 4) for r in range(-1, 2)]
    assert areas(cl.trimmed(shapes(bar))) == {1: 4, 2: 3}
    assert areas(cl.trimmed(shapes(square(3, 0, 0, 2) + square(1, 0, 0, 2)))) == {3: 4}
    assert cl.trimmed(shapes(square(1, 0, 0, 2)).limit(0)).count() == 0
    assert areas(cl.trimmed(shapes(square(1, 0, 0, 2) + square(2, 5, 5, 2)))) == {1: 4, 2: 4}


@pytest.mark.parametrize("seed", range(2))
def test_trimming_in_rounds_is_trimming_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    cells = {i: {(r, c) for _, r, c in square(i, int(rng.integers(0, 12)), int(rng.integers(0, 12)), int(rng.integers(2, 6)))} for i in range(1, 9)}
    rows = [(i, r, c) for i, places in cells.items() for r, c in places]
    pairs = [(i, j) for i in cells for j in cells if i < j and cells[i] & cells[j]]
    for i, j in pairs:
        if cells[i] & cells[j]:
            lose, win = (i, j) if len(cells[i]) >= len(cells[j]) else (j, i)
            rest, best = cells[lose] - cells[win], set()
            while rest:
                piece, edge = set(), [min(rest)]
                while edge:
                    r, c = edge.pop()
                    if (r, c) in rest:
                        rest.discard((r, c))
                        piece.add((r, c))
                        edge += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
                best = max(best, piece, key=len)
            cells[lose] = best
    got: dict = {}
    for r in cl.trimmed(spark.createDataFrame(rows, "label long, r int, c int")).collect():
        got.setdefault(r.label, set()).add((r.r, r.c))
    assert got == {i: p for i, p in cells.items() if p}


def test_nuclei_are_clipped_to_their_cells(spark):
    shapes = lambda rows: spark.createDataFrame(rows, "label long, r int, c int")
    nuclei = square(1, 0, 0, 3) + square(2, 20, 20, 2)
    cells = [(1, r, c) for r in range(3) for c in (0, 2)] + [(1, 0, 1)] + square(2, 0, 5, 2)
    assert areas(cl.clipped_nuclei(shapes(nuclei), shapes(cells))) == {1: 7}


def test_a_whole_run(spark):
    wc = [[0] * 12, [0, 5, 5, 5, 5] + [0] * 7] + [[0, 5, 5, 5, 5, 0, 0, 0, 0, 0, 0, 0]] * 3 + [[0] * 12]
    nuc = [[0] * 12] * 2 + [[0, 0, 2, 2, 0, 0, 0, 0, 0, 9, 9, 0]] * 2 + [[0] * 12] * 2
    values = np.arange(72).reshape(6, 12)
    channels = spark.createDataFrame([(1, "CD3")], "ch int, name string")
    options = me.Options(percentiles=me.parse_percentiles("10, ,90"), neighbours=1, environment_expansion=True, pixel_size_microns=4.0)
    cells, long = me.run(mask(spark, nuc), mask(spark, wc), image(spark, values), channels, (6, 12), options)
    rows = {r.cell_id: r for r in cells.collect()}
    assert {i: (r.nucleus_label, r.whole_cell_label, r.match_source) for i, r in rows.items()} == {1: (2, 5, "overlap_1to1"), 2: (9, None, "watershed_synth")}
    got: dict = {}
    for r in long.collect():
        assert r.value == r.value and (r.cell_id, r.key) not in got
        got[r.cell_id, r.key] = r.value
    cell = np.array(wc) == 5
    inner = np.array(nuc) == 2
    assert got[1, "Cell: Area µm^2"] == 16 * 16.0 and got[1, "Nucleus: Area µm^2"] == 4 * 16.0 and got[1, "Nucleus/Cell area ratio"] == 0.25
    assert got[1, "CD3: Cytoplasm: Mean"] == pytest.approx(values[cell & ~inner].mean()) and got[1, "CD3: Cell: Std.Dev."] == pytest.approx(values[cell].std())
    assert got[1, "CD3: Cell: Percentile: 10.0"] == pytest.approx(np.percentile(values[cell], 10))
    assert {k for i, k in got if i == 1 and "Bin_1" in k} == {f"CD3: {x}: {s}" for x in ("Cell: ErosionBin_1", "Nucleus: ErosionBin_1", "Cell: ExpansionBin_1") for s in ("Mean", "Median")}
    assert {k for i, k in got if i == 1 and "Environment" in k} == {f"CD3: Cell: Environment_20um: {s}" for s in ("Mean", "Median", "Min", "Max", "Std.Dev.")}
    assert (2, "CD3: Membrane: Mean") in got and (2, "CD3: Cytoplasm: Mean") in got  # a grown cell has a boundary
    cells, long = me.run(mask(spark, nuc), None, image(spark, values), channels, (6, 12), me.Options(downsample_factor=2.0, performance_mode="fast", erosion_steps=False, expansion_steps=False))
    keys = {r.key for r in long.collect()}
    assert cells.count() == 2 and "CD3: Nucleus: Mean" in keys and not {k for k in keys if "Median" in k or "Bin" in k or "Membrane" in k or "Percentile" in k}
    assert me.run(None, mask(spark, wc), None, None, (6, 12))[1] is None


@pytest.mark.parametrize("wrong", [{"neighbours": -1}, {"downsample_factor": 0.0}, {"performance_mode": "quick"}, {"pixel_size_microns": 0.0}, {"estimate_cell_boundary_dist": 0.0}, {"dist_threshold": -1.0}, {"dist_threshold": 0.0}])
def test_options_are_checked(wrong):
    with pytest.raises(ValueError, match=next(iter(wrong))):
        me.Options(**wrong)


def test_masks_are_checked(spark):
    m = mask(spark, [[1, 2]])
    assert me.check_masks(m, m, {"nuclear mask": (1, 2), "image": (3, 1, 2)}) == (1, 2)
    for sizes, message in (({"a": (1, 2), "image": (1, 1, 3)}, "differ"), ({"a": (1, 2, 3)}, "axes")):
        with pytest.raises(ValueError, match=message):
            me.check_masks(m, None, sizes)
    with pytest.raises(ValueError, match="mask"):
        me.check_masks(None, None, {})
    with pytest.raises(ValueError, match="outside"):
        me.check_inside(m, (1, 1), "mask")
    with pytest.raises(ValueError, match="percentiles"):
        me.parse_percentiles("101")
    inside = lambda r, c: spark.range(1).select(me.contains(*[F.lit(x) for x in (r, c, 0, 0, 2, 2)])).first()[0]
    assert inside(1, 1) and not inside(2, 1)


def test_two_channels_of_one_name(spark):
    wc = mask(spark, [[1, 1]])
    both = image(spark, [[1, 1]]).unionByName(image(spark, [[5, 5]]).withColumn("ch", F.lit(2)))
    channels = spark.createDataFrame([(1, "X"), (2, "X")], "ch int, name string")
    long = me.measure(lb.single_mask_cells(wc, "wc_only"), wc.limit(0), wc, both, channels, (1, 2), me.Options(erosion_steps=False, expansion_steps=False))
    assert [r.value for r in long.filter("key = 'X: Cell: Mean'").collect()] == [5.0]


def test_far_pieces_need_no_common_box(spark):
    rows = [(1, r, c) for r in range(4) for c in range(6)] + [(1, 2_000_000 + r, 3_000_000 + c) for r in range(5) for c in range(7)] + [(1, 10, 10)]
    pixels = spark.createDataFrame(rows, "label long, r int, c int")
    kept = cl.largest_pieces(pixels).collect()
    assert len(kept) == 35 and min(x.r for x in kept) == 2_000_000
    outline = ol.outlines(pixels, 0.0).first()
    assert outline.area == 34.5  # a rectangle of pixels without half a pixel at its corners
    near = ol.outlines(spark.createDataFrame([(1, 2_000_000 + r, 3_000_000 + c) for r in range(5) for c in range(7)], "label long, r int, c int"), 0.0).first()
    assert sorted(map(tuple, near.ring[:-1])) == sorted(map(tuple, outline.ring[:-1]))
    solid = sh.solidity(pixels.withColumnRenamed("label", "cell_id")).first()["solidity"]
    assert 0 < solid < 1e-4


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pieces_of_runs(seed):
    rng = np.random.default_rng(seed)
    mask = rng.random((20, 25)) < 0.55
    r, c = np.nonzero(mask)
    turn = rng.permutation(len(r))
    got, names = cl.pieces(r[turn], c[turn]), {}
    for start in zip(r.tolist(), c.tolist(), strict=True):
        stack = [start] if start not in names else []
        number = len(set(names.values()))
        while stack:
            y, x = stack.pop()
            if 0 <= y < 20 and 0 <= x < 25 and mask[y, x] and (y, x) not in names:
                names[y, x] = number
                stack += [(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)]
    assert got.tolist() == [names[p] for p in zip(r[turn].tolist(), c[turn].tolist(), strict=True)]


def test_slides_lie_apart():
    stack = slides.Stack((slides.Slide("a", (10, 10), 1), slides.Slide("b", (10, 10), 1)), gap=41)
    stack.check(me.Options(dist_threshold=39.0))
    for wrong in ({"dist_threshold": 41.0}, {"pixel_size_microns": 0.4}, {"estimate_cell_boundary_dist": 50.0}):
        with pytest.raises(ValueError, match="reaches"):
            stack.check(me.Options(**wrong))
    with pytest.raises(ValueError, match="fewer"):
        slides.Stack(tuple(slides.Slide(str(k), (21_006, 39_138), 1) for k in range(101_000)))
