"""Exact overlay of polygons, trimming of overlapping cells, repair, unions, simplification without crossings."""

from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest

from cellweave.functions import polygons as pg
from cellweave.operators import measure as me, outlines as ol, overlay as ov
from cellweave.plans import job
from cellweave.sources import boundaries as bd, tiff


def total(pieces):
    return sum(map(pg.area, pieces))


def flat(pieces):
    return [r for p in pieces for r in p]


def holds(rings, x, y):
    return sum(pg._holds(r, x, y) for r in rings) % 2 == 1


def check_valid(pieces):
    """Rings that cross nothing, without a corner twice, outer ones and holes turned against each other."""
    for p in pieces:
        assert not pg.crossed([np.array(pg.closed(r)[:-1]) for r in p])
        assert all(len(set(r)) == len(r) for r in p) and pg.area(p) > 0
        assert pg._turned(p[0]) > 0 and all(pg._turned(h) < 0 for h in p[1:])


@pytest.mark.parametrize("span", [2, 4, 8, 0])
def test_overlay_of_random_polygons(span):
    """Few places to lie on make many common sides, corners on sides and crossings of rings with themselves; 0: any places."""
    rng = random.Random(span)
    for _ in range(60):
        n = rng.choice([3, 4, 6, 10])
        place = (lambda: rng.randrange(span) / 2) if span else (lambda: rng.random() * 5)
        a, b = (pg.snapped([[(place(), place()) for _ in range(n)] for _ in range(rng.choice([1, 2]))]) for _ in "ab")
        own = [pg.repaired(a), pg.repaired(b)]
        rest, common, both = pg.difference(a, b), pg.intersection(a, b), pg.union([a, b])
        for pieces in (*own, rest, common, both):
            check_valid(pieces)
        assert total(own[0]) + total(own[1]) == pytest.approx(total(both) + total(common), abs=1e-8)
        assert total(own[0]) == pytest.approx(total(common) + total(rest), abs=1e-8)
        for _ in range(10):
            x, y = (rng.randrange((span or 10) * pg.UNIT) for _ in "xy")
            ina, inb = holds(a, x, y), holds(b, x, y)
            assert [holds(flat(p), x, y) for p in (rest, common, both)] == [ina and not inb, ina and inb, ina or inb]


def square(x, y, w, h=None):
    h = w if h is None else h
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_bow_ties_and_touching_rings():
    bow = pg.repaired(pg.snapped([[(0, 0), (4, 4), (4, 0), (0, 4)]]))
    check_valid(bow)
    assert [pg.area(p) for p in bow] == [4.0, 4.0]
    hole_at_side = pg.repaired(pg.snapped([square(0, 0, 4), [(0, 2), (2, 1), (2, 3)]]))
    check_valid(hole_at_side)
    assert total(hole_at_side) == 14.0 and len(hole_at_side) == 1
    corner = pg.union([pg.snapped([square(0, 0, 2)]), pg.snapped([square(2, 2, 2)])])
    assert len(corner) == 2  # a common corner joins nothing
    assert pg.repaired(pg.snapped([[(0, 0), (1, 1), (2, 2)], [(5, 5), (5, 5), (6, 6)]])) == []
    ring = pg.difference(pg.snapped([square(0, 0, 10)]), pg.snapped([square(3, 3, 2)]))
    assert len(ring) == 1 and len(ring[0]) == 2 and pg.area(ring[0]) == 96.0
    assert pg.union([]) == [] and pg.intersection([], pg.snapped([square(0, 0, 1)])) == []


def band(rng, n, wave, width):
    """A thin band along a wavy line, forth and back."""
    y = [100 + wave * rng.random() for _ in range(n)]
    there = [(10.0 + k, v) for k, v in enumerate(y)]
    return np.array(there + [(x, v + width) for x, v in reversed(there)])


def test_simplified_rings_stay_simple():
    rng, would_cross = random.Random(7), 0
    for _ in range(150):
        ring = band(rng, rng.choice([6, 20, 45]), rng.choice([1, 4, 9]), rng.choice([0.2, 1.0]))
        assert not pg.crossed([ring])
        tolerance = rng.choice([0.5, 2.0, 6.0])
        plain = ring[sorted(ol.kept(ring, tolerance))]
        would_cross += len(plain) >= 3 and bool(pg.crossed([plain]))
        made = ol.simplified(ring, tolerance)
        assert not pg.crossed([made]) and len(made) >= 3 and {tuple(p) for p in made} <= {tuple(p) for p in ring}
    assert would_cross > 5
    circle = np.array([(math.cos(math.pi * k / 30), math.sin(math.pi * k / 30)) for k in range(60)])
    made = ol.simplified_rings([30 * circle, 29.7 * circle], 2.0)  # a hole close to the outer ring
    assert len(made[0]) < 60 and not pg.crossed(made)


def outlines(spark, rings):
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in [*r, r[0]]] if r else None) for k, r in rings]
    return spark.createDataFrame(rows, f"label long, ring {ol.RING}").repartition(3)


def areas(shapes):
    return {r.label: r.area for r in shapes.collect()}


def rings_of(shapes):
    return {r.label: pg.snapped(x for p in bd.polygons(bytes(r.geometry)) for x in p) for r in shapes.collect()}


def shared(shapes):
    found = list(rings_of(shapes).values())
    return max((total(pg.intersection(a, b)) for a, b in itertools.combinations(found, 2)), default=0.0)


@pytest.mark.parametrize(
    ("rings", "want"),
    [
        ([(1, square(0, 0, 10)), (2, square(8, 0, 6))], {1: 88.0, 2: 36.0}),  # the larger loses
        ([(1, square(0, 0, 4)), (2, square(2, 0, 4))], {1: 8.0, 2: 16.0}),  # of equal ones the first
        ([(1, square(0, 0, 4)), (2, square(4, 0, 4)), (3, square(4, 4, 2))], {1: 16.0, 2: 16.0, 3: 4.0}),  # touching is not overlapping
        ([(1, square(0, 0, 10)), (2, square(2, 2, 3))], {1: 91.0, 2: 9.0}),  # surrounded: a hole
        ([(1, square(0, 0, 10, 3)), (2, square(3, -1, 2, 5))], {1: 15.0, 2: 10.0}),  # two pieces: the larger stays
        ([(1, square(0, 0, 4)), (2, square(0, 0, 4))], {2: 16.0}),  # one that loses all is gone
        ([(1, square(0, 0, 4)), (2, None), (3, [(0, 0), (1, 1), (2, 2)])], {1: 16.0}),  # nothing and flat ones
    ],
)
def test_trimming_of_polygons(spark, rings, want):
    made = ov.trimmed(ov.shapes_of(outlines(spark, rings)))
    assert areas(made) == pytest.approx(want) and shared(made) < 1e-10


def one_by_one(rings):
    """Pairs in order, one after another, each by the overlay of two."""
    shapes = {k: flat(pg.repaired(pg.snapped([r]))[:1]) for k, r in rings}
    size = {k: total([v]) for k, v in shapes.items()}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(shapes), 2) if total(pg.intersection(shapes[i], shapes[j])) >= ov.LEAST_AREA]
    for i, j in pairs:
        if total(pg.intersection(shapes[i], shapes[j])) < ov.LEAST_AREA:
            continue
        a, b = (i, j) if size[i] >= size[j] else (j, i)
        pieces = pg.difference(shapes[a], shapes[b])
        shapes[a], size[a] = (pieces[0], pg.area(pieces[0])) if pieces else ([], 0.0)
    return {k: v for k, v in size.items() if v}


@pytest.mark.parametrize("side", [4.0, 20.0, 2048.0])
def test_trimming_by_squares_is_trimming_one_by_one(spark, side):
    rng = random.Random(11)
    rings = []
    for k in range(45):
        cx, cy, r, n = rng.random() * 40, rng.random() * 40, 2 + 4 * rng.random(), rng.choice([5, 9, 16])
        rings.append((k, [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]))
    made = ov.trimmed(ov.shapes_of(outlines(spark, rings)), side)
    assert areas(made) == pytest.approx(one_by_one(rings), abs=1e-7) and shared(made) < 1e-10


def test_a_chain_takes_one_round(spark, monkeypatch):
    rounds = []
    plain = ov.written
    monkeypatch.setattr(ov, "written", lambda df, label: (rounds.append(label), plain(df, label))[1])
    chain = [(k, square(3 * k, 0, 4)) for k in range(20)]
    made = ov.trimmed(ov.shapes_of(outlines(spark, chain)))
    assert areas(made) == pytest.approx({k: 16.0 if k == 19 else 12.0 for k in range(20)}) and rounds.count("trimmed") == 1


def test_overlaps_and_clipping(spark):
    shapes = ov.shapes_of(outlines(spark, [(1, square(0, 0, 100)), (2, square(90, 90, 20)), (3, square(100, 0, 5)), (4, square(20, 20, 2)), (5, square(300, 300, 1))]))
    assert sorted(map(tuple, ov.overlaps(shapes).collect())) == [(1, 2, 100.0), (1, 4, 4.0)]
    frames = ov.shapes_of(outlines(spark, [(1, square(50, 50, 100)), (3, square(0, 0, 1)), (4, square(20, 20, 9))]))
    assert areas(ov.clipped(shapes, frames)) == {1: 2500.0, 4: 4.0}
    assert ov.overlaps(shapes.limit(0)).collect() == [] and ov.trimmed(shapes.limit(0)).collect() == [] and ov.clipped(shapes, frames.limit(0)).collect() == []


def test_unions(spark):
    """Pieces of tiles make the whole again, and its area is that of the pixels."""
    rng = np.random.default_rng(2)
    mask = rng.random((24, 24)) < 0.6
    rows = [(1, bd.well_known([[*square(float(c), float(r), 1.0), (float(c), float(r))]])) for r, c in zip(*np.nonzero(mask), strict=True)]
    rows += [(2, bd.well_known([[*square(x, 0.0, 3.0), (x, 0.0)]])) for x in (0.0, 3.0, 10.0)] + [(3, None)]
    made = {r.label: r for r in ov.united(spark.createDataFrame(rows, "label long, geometry binary").repartition(3), 8.0).collect()}
    assert made[1].area == mask.sum() and (made[2].area, made[2].pieces) == (27.0, 2) and 3 not in made
    found = bd.polygons(bytes(made[1].geometry))
    assert len(found) == made[1].pieces and all(holds(pg.snapped(r for p in found for r in p), int((2 * c + 1) * pg.UNIT), int((2 * r + 1) * pg.UNIT)) == mask[r, c] for r in range(24) for c in range(24))


def test_boundaries_are_made_valid(spark):
    bow = [(0.0, 0.0), (4.0, 4.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]
    many = bd.multi([[[*square(0.0, 0.0, 1.0), (0.0, 0.0)]], [[*square(5.0, 5.0, 6.0), (5.0, 5.0)], [*square(7.0, 7.0, 1.0), (7.0, 7.0)]]])
    rows = [(1, bd.well_known([bow])), (2, many), (3, None), (4, bd.well_known([[(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (0.0, 0.0)]]))]
    made = ov.boundary_shapes(spark.createDataFrame(rows, "label long, geometry binary"), 0.0)
    assert areas(made) == {1: 4.0, 2: 35.0}
    assert {r.label: len(r.rings) for r in ov.rings_of(made).collect()} == {1: 1, 2: 2}


def test_final_outlines_of_a_job_share_nothing(spark, tmp_path):
    """A tessellation whose simplified outlines would overlap, and a cell around another one, which keeps its hole."""
    rng = np.random.default_rng(5)
    spots = rng.integers(0, 40, (12, 2))
    grid = np.stack(np.meshgrid(np.arange(40), np.arange(40), indexing="ij"), axis=-1)
    mask = (((grid[:, :, None] - spots[None, None]) ** 2).sum(axis=-1).argmin(axis=-1) + 1).astype(np.uint16)
    tiff.save_tiff(tmp_path / "wc.tif", [mask])
    pixels = spark.createDataFrame([(int(mask[r, c]), r, c) for r in range(40) for c in range(40)], "label long, r int, c int")
    assert shared(ov.shapes_of(ol.outlines(pixels))) > 0.1
    made = job.run(spark, job.Job(whole_cell_mask=str(tmp_path / "wc.tif"), output_file=str(tmp_path / "o.geojson"), output_mask=str(tmp_path / "m.tif")))
    assert shared(made.shapes) < 1e-10 and made.shapes.count() == len(np.unique(mask))
    around = np.zeros((40, 40), np.uint16)
    around[5:25, 5:25], around[12:16, 12:16] = 1, 2
    tiff.save_tiff(tmp_path / "ring.tif", [around])
    made = job.run(spark, job.Job(whole_cell_mask=str(tmp_path / "ring.tif"), output_file=str(tmp_path / "o.geojson"), output_mask=str(tmp_path / "m.tif"), simplify_rois=False))
    found = {f["id"]: f["geometry"]["coordinates"] for f in json.loads((tmp_path / "o.geojson").read_text())["features"]}
    assert [len(found[k]) for k in ("cell-1", "cell-2")] == [2, 1] and areas(made.shapes)[1] == pytest.approx(399.5 - 15.5)
    tiff.register(spark)
    painted = spark.read.format("labelmask").load(str(tmp_path / "m.tif"))
    assert {(r.r, r.c): r.label for r in painted.collect()} == {(int(r), int(c)): int(around[r, c]) for r, c in zip(*np.nonzero(around), strict=True)}


def test_a_job_keeps_given_boundaries(spark, tmp_path):
    there = tmp_path / "cells.zarr" / "images" / "slide" / "0"
    there.mkdir(parents=True)
    (there / ".zarray").write_text(json.dumps({"shape": [1, 30, 30], "chunks": [1, 30, 30], "dtype": "|u1", "compressor": None, "fill_value": 0}))
    rings = [[(2.3, 2.3), (12.6, 2.3), (12.6, 12.6), (2.3, 12.6), (2.3, 2.3)], [(11.1, 11.1), (20.2, 11.1), (20.2, 20.2), (11.1, 20.2), (11.1, 11.1)]]
    spark.createDataFrame([(bd.well_known([r]),) for r in rings], "geometry binary").coalesce(1).write.parquet(str(tmp_path / "cells.zarr" / "shapes"))
    made = job.run(spark, job.Job(whole_cell_mask=str(tmp_path / "cells.zarr"), parquet_path="shapes", options=me.Options(measurements=False)))
    assert areas(made.shapes) == pytest.approx({1: 10.3**2 - 1.5**2, 2: 9.1**2})
