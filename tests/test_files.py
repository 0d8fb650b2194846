"""TIFF sources and sinks, GeoJSON, measurement rows and resumed outlines."""

from __future__ import annotations

import gzip
import json
import struct
import zlib

import numpy as np
import pytest

from cellweave.plans import job, outline_store
from cellweave.operators import labels as lb
from cellweave.sources import boundaries, export, masks, slides, tiff, zarr
from pyspark.sql import functions as F


def test_mask_round_trip(spark, tmp_path):
    tiff.register(spark)
    m = np.random.default_rng(1).integers(0, 70000, (130, 33)).astype(np.uint32) * (np.random.default_rng(2).random((130, 33)) < 0.5)
    tiff.save_tiff(tmp_path / "a.tif", [m.astype(np.uint32)])
    pixels = spark.read.format("labelmask").load(str(tmp_path / "a.tif"))
    assert pixels.count() == (m > 0).sum()
    assert tiff.write_mask(pixels, m.shape, str(tmp_path / "b.tif")) == 3
    again = {(r.r, r.c): r.label for r in spark.read.format("labelmask").load(str(tmp_path / "b.tif")).collect()}
    assert again == {(int(r), int(c)): int(m[r, c]) for r, c in zip(*np.nonzero(m), strict=True)}


@pytest.mark.parametrize(("array", "message"), [(np.zeros((4, 4), np.float32), "integer"), (np.zeros((4, 4), np.uint64), "32-bit")])
def test_masks_that_are_refused(spark, tmp_path, array, message):
    tiff.register(spark)
    tiff.save_tiff(tmp_path / "x.tif", [array])
    with pytest.raises(Exception, match=message):
        spark.read.format("labelmask").load(str(tmp_path / "x.tif")).count()


def test_image_channels_and_names(spark, tmp_path):
    tiff.register(spark)
    a = np.arange(24, dtype=np.uint16).reshape(2, 3, 4)
    ome = '<OME xmlns="x"><Image><Pixels SizeC="2"><Channel Name="DNA"/><Channel ID="c2"/></Pixels></Image></OME>'
    tiff.save_tiff(tmp_path / "o.tif", list(a), [ome, ""])
    assert tiff.inspect(str(tmp_path / "o.tif")) == {"shape": (2, 3, 4), "names": ["DNA", "c2"]}
    rows = spark.read.format("cyximage").load(str(tmp_path / "o.tif")).collect()
    assert {(r.ch - 1, r.r, r.c): r.v for r in rows} == {k: float(v) for k, v in np.ndenumerate(a)}
    tiff.save_tiff(tmp_path / "j.tif", list(a), [json.dumps({"channel.target": n}) for n in ("CD3", "CD8")])
    assert tiff.inspect(str(tmp_path / "j.tif"))["names"] == ["CD3", "CD8"]
    tiff.save_tiff(tmp_path / "k.tif", list(a), [json.dumps({"channel.target": n}) for n in ("CD3", "")])
    assert tiff.inspect(str(tmp_path / "k.tif"))["names"] == ["Channel 1", "Channel 2"]
    tiff.save_tiff(tmp_path / "p.tif", [a[0], a[0, :2, :2]])  # a smaller level is no channel
    assert tiff.inspect(str(tmp_path / "p.tif"))["shape"] == (1, 3, 4)


def test_layouts():
    assert tiff.channel_axis((3, 9, 9), "CYX") == (0, 1, 2) and tiff.channel_axis((9, 9, 3), "YXS") == (2, 0, 1)
    assert tiff.channel_axis((9, 9)) == (None, 0, 1) and tiff.channel_axis((9, 9, 2)) == (2, 0, 1)
    with pytest.raises(ValueError, match="axis T"):
        tiff.channel_axis((2, 3, 9, 9), "TCYX")
    assert tiff.is_comet('<OME><Instrument><Microscope Manufacturer="Lunaphore" Model="COMET"/></Instrument></OME>') and not tiff.is_comet("no xml")
    assert not tiff.is_comet('<OME><Instrument><Microscope Manufacturer="Lunaphore"/><Detector Model="COMET"/></Instrument></OME>')


def test_deflate_with_differencing(tmp_path):
    a = np.random.default_rng(0).integers(0, 60000, (5, 7)).astype("<u2")
    raw = zlib.compress(np.diff(a, axis=1, prepend=np.zeros((5, 1), "<u2")).astype("<u2").tobytes())
    page = tiff.Page("<", {256: (7,), 257: (5,), 258: (16,), 259: (8,), 317: (2,), 278: (5,), 273: (0,), 279: (len(raw),)})
    assert (page.decoded(raw, 5, 7)[:, :, 0] == a).all()
    with pytest.raises(ValueError, match="compression"):
        tiff.Page("<", page.tags | {259: (7,)}).decoded(raw, 5, 7)


def test_mask_kinds():
    assert tiff.mask_kind(65535) == "u2" and tiff.mask_kind(65536) == "u4"
    with pytest.raises(ValueError, match="32 bits"):
        tiff.mask_kind(1 << 32)
    assert struct.calcsize("<2sHHHQ") == 16


def test_geojson_and_measurements(spark, tmp_path):
    cells = spark.createDataFrame([(2, 5, None, "nuc_only"), (1, 4, 9, "overlap_1to1"), (3, 6, 8, "overlap_1to1")], "cell_id long, nucleus_label long, whole_cell_label long, match_source string")
    ring = [(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, ring), (2, ring)], "cell_id long, ring array<struct<x:double,y:double>>")
    maps = spark.createDataFrame([(1, {"Cell: Area µm^2": 6.25})], "cell_id long, measurements map<string,double>")
    rows = export.features(cells, rings, rings.filter("cell_id = 1"), maps)
    assert export.write_geojson(rows, (10, 20), str(tmp_path / "x.geojson"), compressed=True) == 2
    with gzip.open(tmp_path / "x.geojson.gz", "rt") as f:
        found = json.load(f)["features"]
    assert [x["id"] for x in found] == ["annotation-whole-image", "cell-1", "cell-2"]
    assert found[0]["geometry"]["coordinates"][0][2] == [20, 10] and "nucleusGeometry" not in found[2] and found[2]["properties"]["whole_cell_label"] is None
    assert found[1]["properties"]["measurements"] == {"Cell: Area µm^2": 6.25} and found[1]["geometry"]["coordinates"] == [[list(p) for p in ring]]
    assert export.write_geojson(rows, (10, 20), str(tmp_path / "y.geojson"), pretty=True) == 2 and len(json.load(open(tmp_path / "y.geojson"))["features"]) == 3
    export.write_measurements(maps, str(tmp_path / "m"))
    assert export.read_measurements(spark, str(tmp_path / "m")).collect() == maps.collect()


def test_outlines_resume_and_discard(spark, tmp_path):
    pixels = spark.createDataFrame([(12 * i + a, 12 * j + b, 6 * i + j + 1) for i in range(2) for j in range(6) for a in range(8) for b in range(8)], "r int, c int, label long")
    path = str(tmp_path / "store")
    assert outline_store.outlines(pixels, path, batch_size=5).count() == 12
    spark.read.parquet(path + "/outlines").filter("batch <> 1").withColumn("area", F.lit(-1.0)).write.partitionBy("batch").parquet(path + "/kept")
    import shutil

    shutil.rmtree(path + "/outlines")
    shutil.move(path + "/kept", path + "/outlines")
    rows = outline_store.outlines(pixels, path, batch_size=5)
    assert {(r.batch, r.area < 0) for r in rows.collect()} == {(0, True), (1, False), (2, True)} and rows.count() == 12
    assert outline_store.outlines(pixels, path, tolerance=0.0, batch_size=5).filter("area < 0").count() == 0


RING = [(1.0, 1.0), (5.0, 1.0), (5.0, 5.0), (1.0, 5.0), (1.0, 1.0)]
HOLE = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]


def test_boundary_tables(spark, tmp_path):
    multi = struct.pack("<BII", 1, 6, 2) + boundaries.well_known([[(8.0, 8.0), (9.0, 8.0), (9.0, 9.0), (8.0, 8.0)]]) + boundaries.well_known([RING, HOLE])
    big = struct.pack(">BIII", 0, 3, 1, 5) + b"".join(struct.pack(">dd", *p) for p in RING)
    made = [[multi], [None], [boundaries.well_known([HOLE])], [big], [boundaries.well_known([RING[:3]])]]
    spark.createDataFrame(made, "geometry binary").coalesce(1).write.parquet(str(tmp_path / "b.parquet"))
    table = boundaries.read_boundaries(spark, str(tmp_path / "b.parquet"))
    assert sorted((r.label, r.geometry is None) for r in table.collect()) == [(1, False), (2, True), (3, False), (4, False), (5, False)]
    rings = boundaries.rings(table).cache()
    assert sorted((r.label, r.part, r.hole) for r in rings.collect()) == [(1, 0, False), (1, 1, False), (1, 1, True), (3, 0, False), (4, 0, False)]
    got = {(r.r, r.c): r.label for r in boundaries.burned(rings.filter("label <> 4"), (20, 20)).collect()}
    inner = {(r, c) for r in (2, 3) for c in (2, 3)}
    assert {k for k, v in got.items() if v == 3} == inner and {k for k, v in got.items() if v == 1 and k[0] < 6} == {(r, c) for r in range(1, 5) for c in range(1, 5)} - inner
    assert set(boundaries.burned(rings, (3, 20)).select("r").distinct().collect()) == {(1,), (2,)}
    found = {r.label: (len(r.ring), r.area) for r in boundaries.outlines(rings).collect()}
    assert found == {1: (5, 16.0), 3: (5, 4.0), 4: (5, 16.0)}
    with pytest.raises(ValueError, match="no polygon"):
        boundaries.polygons(struct.pack("<BIdd", 1, 1, 0.0, 0.0))


def test_final_polygons_as_a_mask(spark):
    table = spark.createDataFrame([(1, boundaries.well_known([RING, HOLE])), (2, boundaries.well_known([HOLE])), (3, boundaries.well_known([[(3.0, 1.0), (5.0, 1.0), (5.0, 3.0), (3.0, 3.0), (3.0, 1.0)]]))], "label long, geometry binary")
    got = {(r.r, r.c): r.label for r in boundaries.painted(boundaries.rings(table), (10, 10)).collect()}
    assert got[1, 1] == 1 and got[3, 3] == 2 and got[2, 4] == 3 and (0, 0) not in got


@pytest.mark.parametrize("version", [2, 3])
def test_chunked_arrays(spark, tmp_path, version):
    a = np.random.default_rng(4).integers(0, 9, (7, 5)).astype("<u2")
    at = tmp_path / "store" / "labels" / "0"
    at.mkdir(parents=True)
    if version == 2:
        (at / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": [7, 5], "chunks": [4, 3], "dtype": "<u2", "compressor": {"id": "zlib"}, "fill_value": 0, "order": "C", "filters": None}))
    else:
        (at / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": [7, 5], "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [4, 3]}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "gzip"}], "fill_value": 0}))
    for i in range(2):
        for j in range(2):
            chunk = np.zeros((4, 3), "<u2")
            own = a[4 * i : 4 * i + 4, 3 * j : 3 * j + 3]
            chunk[: own.shape[0], : own.shape[1]] = own
            there = at / f"{i}.{j}" if version == 2 else at / "c" / str(i) / str(j)
            there.parent.mkdir(parents=True, exist_ok=True)
            there.write_bytes(zlib.compress(chunk.tobytes()) if version == 2 else gzip.compress(chunk.tobytes()))
    pixels, size = zarr.read_mask(spark, str(tmp_path / "store"))
    assert size == (7, 5) and {(r.r, r.c): r.label for r in pixels.collect()} == {(int(r), int(c)): int(a[r, c]) for r, c in zip(*np.nonzero(a), strict=True)}
    image, shape = zarr.read_image(spark, str(at), "YX")
    assert shape == (1, 7, 5) and {(r.r, r.c): r.v for r in image.collect()} == {k: float(v) for k, v in np.ndenumerate(a)}
    if version == 2:
        there = tmp_path / "spatial" / "images" / "slide" / "0"
        there.mkdir(parents=True)
        (there / ".zarray").write_text(json.dumps({"shape": [3, 70, 50], "chunks": [3, 70, 50], "dtype": "<f4", "compressor": None, "fill_value": 0}))
        (there / "0.0.0").write_bytes(np.arange(3 * 70 * 50, dtype="<f4").tobytes())
        assert zarr.image_size(spark, str(tmp_path / "spatial")) == (70, 50)
        image, shape = zarr.read_image(spark, str(there))
        assert shape == (3, 70, 50) and image.filter("ch = 2 and r = 0 and c = 1").first()["v"] == 3501.0
        with pytest.raises(ValueError, match="2D"):
            zarr.read_mask(spark, str(there))
    with pytest.raises(ValueError, match="no array"):
        zarr.find_array(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError, match="no image"):
        zarr.image_size(spark, str(tmp_path / "nothing"))


def test_windows_reach_the_reader(spark, tmp_path):
    tiff.register(spark)
    a = np.arange(3 * 200 * 20, dtype=np.uint16).reshape(3, 200, 20)
    tiff.save_tiff(tmp_path / "f.tif", list(a))
    read = lambda **window: tiff.windowed(spark.read.format("cyximage"), str(tmp_path / "f.tif"), **window)
    got = read(ch=(2, 2), r=(5, 6), c=(3, 7)).collect()
    assert {(r.ch, r.r, r.c): r.v for r in got} == {(2, r, c): float(a[1, r, c]) for r in (5, 6) for c in range(3, 8)}
    assert [p.page for p in tiff.ImageReader(str(tmp_path / "f.tif"), {"ch": (2, 2), "r": (0, 500)}).partitions()] == [1]
    assert tiff.ImageReader(str(tmp_path / "f.tif"), {"r": (201, 300)}).partitions() == [] and read(r=(201, 300)).count() == 0
    image = read()  # filters of one scan leave the next whole
    assert image.filter("r < 3").count() == 180 and image.count() == a.size and image.filter("r < 3").unionByName(image).count() == a.size + 180


def test_axes_of_descriptions(spark, tmp_path):
    a = np.arange(3 * 5 * 7, dtype=np.uint16).reshape(3, 5, 7)
    ome = '<OME xmlns="x"><Image><Pixels DimensionOrder="XYCZT" SizeX="7" SizeY="5" SizeC="{c}" SizeZ="{z}" SizeT="1"><Channel Name="A"/><Channel Name="B"/><Channel Name="D"/></Pixels></Image></OME>'
    tiff.register(spark)
    read = lambda name: {(r.ch, r.r, r.c): r.v for r in spark.read.format("cyximage").load(str(tmp_path / name)).collect()}
    whole = {(k + 1, r, c): float(v) for (k, r, c), v in np.ndenumerate(a)}
    tiff.save_tiff(tmp_path / "ome.tif", [*a, a[0]], [ome.format(c=3, z=1), "", "", ""])  # a fourth page of the same size is another image
    assert tiff.inspect(str(tmp_path / "ome.tif")) == {"shape": (3, 5, 7), "names": ["A", "B", "D"]} and tiff.kind_of(str(tmp_path / "ome.tif")) == "ome" and read("ome.tif") == whole
    tiff.save_tiff(tmp_path / "deep.tif", list(a), [ome.format(c=1, z=3), "", ""])
    with pytest.raises(ValueError, match="axis Z has 3"):
        tiff.inspect(str(tmp_path / "deep.tif"))
    tiff.save_tiff(tmp_path / "short.tif", list(a[:2]), [ome.format(c=3, z=1), ""])
    with pytest.raises(ValueError, match="3 planes"):
        tiff.inspect(str(tmp_path / "short.tif"))
    # one directory before a long run of planes, by ImageJ's description or a shape
    for k, text in enumerate(("ImageJ=1.53\nimages=3\nchannels=3\n", "ImageJ=1.53\nimages=3\n", '{"shape": [3, 5, 7]}', '{"shape": [3, 5, 7], "axes": "CYX"}')):
        tiff.save_tiff(tmp_path / f"{k}.tif", [a.reshape(15, 7)], [text])
        raw = bytearray((tmp_path / f"{k}.tif").read_bytes())
        for i in range(11):  # rows, rows of a strip and bytes of a strip are those of one plane
            at = 10 + 12 * i
            tag = struct.unpack_from("<H", raw, at)[0]
            raw[at + 8 : at + 12] = struct.pack("<I", {257: 5, 278: 5, 279: 70}.get(tag, struct.unpack_from("<I", raw, at + 8)[0]))
        (tmp_path / f"{k}.tif").write_bytes(raw)
        assert tiff.inspect(str(tmp_path / f"{k}.tif"))["shape"] == (3, 5, 7) and read(f"{k}.tif") == whole
    page = tiff.Page("<", {256: (7,), 257: (5,), 270: tuple(b"ImageJ=1\nimages=6\nchannels=3\nslices=2\n\0")})
    assert tiff.leading_axes([page]) == ("TZC", (1, 2, 3)) and tiff.leading_axes([tiff.Page("<", page.tags | {270: tuple(b"text\0")})]) is None
    with pytest.raises(ValueError, match="axis Z"):
        tiff.check_axes([page])


def test_files_of_many_pieces(spark, tmp_path):
    pixels = spark.createDataFrame([(r, r % 9, r + 1) for r in range(0, 200, 3)], "r int, c int, label long").repartition(7)
    assert tiff.write_mask(pixels, (300, 9), str(tmp_path / "m.tif"), 16) == 19
    tiff.register(spark)
    assert {(x.r, x.c, x.label) for x in spark.read.format("labelmask").load(str(tmp_path / "m.tif")).collect()} == {(r, r % 9, r + 1) for r in range(0, 200, 3)}
    assert tiff.write_mask(pixels.limit(0), (20, 9), str(tmp_path / "e.tif"), 16) == 2 and tiff.inspect(str(tmp_path / "e.tif"))["shape"] == (1, 20, 9)
    rows = spark.range(100).select(F.col("id").alias("cell_id"), F.format_string('{"id":%d}', F.col("id")).alias("feature")).repartition(9)
    for name, compressed in (("f.geojson", False), ("f.geojson.gz", True)):
        assert export.write_geojson(rows, (5, 5), str(tmp_path / name), compressed=compressed) == 100
        with (gzip.open if compressed else open)(tmp_path / name, "rt") as f:
            assert [x["id"] for x in json.load(f)["features"][1:]] == list(range(100))
    assert export.write_geojson(rows.limit(0), (5, 5), str(tmp_path / "g.geojson")) == 0 and len(json.loads((tmp_path / "g.geojson").read_text())["features"]) == 1


def test_labels_of_a_stack():
    for order, magic, kind, text in ((">", b"IJIJ", b"labl", "utf-16-be"), ("<", b"JIJI", b"lbal", "utf-16-le")):
        names = ["DNA", "CD3"]
        blobs = [b"info"] + [n.encode(text) for n in names]
        head = magic + struct.pack(f"{order}4sI", b"info" if order == ">" else b"ofni", 1) + struct.pack(f"{order}4sI", kind, 2)
        page = tiff.Page(order, {tiff.IJ_COUNTS: (len(head), *map(len, blobs)), tiff.IJ_DATA: tuple(head + b"".join(blobs))})
        assert tiff.stack_names(page) == names
    assert tiff.stack_names(tiff.Page("<")) == []


def test_slides_are_measured_together(spark):
    one = [("a", 1, 1, 1), ("a", 1, 2, 1), ("b", 0, 0, 1), ("b", 3, 3, 2), ("c", 0, 0, 9)]
    stack = slides.Stack((slides.Slide("a", (4, 5), 1), slides.Slide("b", (6, 4), 2)))
    assert stack.size == (4 + 6 + 2 * slides.GAP, 5)
    pixels = stack.stacked(spark.createDataFrame(one, "image_id string, r int, c int, label long"))
    assert sorted(map(tuple, pixels.collect())) == [(1, 1, 1), (1, 2, 1), (260, 0, 2), (263, 3, 3)]
    cells = lb.single_mask_cells(pixels, "wc_only")
    back = stack.slide_of(cells.select("whole_cell_label", "centroid_r", "row_min"), F.col("centroid_r"), ["whole_cell_label"], ["centroid_r", "row_min"])
    assert sorted(map(tuple, back.collect())) == [("a", 1, 1.0, 1), ("b", 1, 0.0, 0), ("b", 2, 3.0, 3)]
    with pytest.raises(ValueError, match="names"):
        slides.Stack((slides.Slide("a", (1, 1), 1),) * 2)


def test_a_job_from_files_to_files(spark, tmp_path):
    wc, nuc = np.zeros((40, 40), np.uint16), np.zeros((40, 40), np.uint16)
    wc[5:15, 5:15], wc[20:30, 20:30] = 3, 4
    nuc[8:12, 8:12], nuc[33:36, 5:8] = 7, 9
    image = np.arange(2 * 1600, dtype=np.uint16).reshape(2, 40, 40)
    for name, pages in (("wc", [wc]), ("nuc", [nuc]), ("image", list(image)), ("small", [wc[:20]])):
        tiff.save_tiff(tmp_path / f"{name}.tif", pages)
    at = lambda name: str(tmp_path / name)
    made = job.Job(at("nuc.tif"), at("wc.tif"), tiff_file=at("image.tif"), output_file=at("out.geojson"), output_mask=at("out.tif"), gzip=True, geometry_checkpoint_dir=at("store"), geometry_batch_size=1)
    result = job.run(spark, made)
    assert sorted((r.cell_id, r.match_source) for r in result.cells.collect()) == [(1, "overlap_1to1"), (2, "watershed_synth")]
    with gzip.open(tmp_path / "out.geojson.gz", "rt") as f:
        found = json.load(f)["features"]
    assert [x["id"] for x in found] == ["annotation-whole-image", "cell-1", "cell-2"] and all("nucleusGeometry" in x for x in found[1:])
    assert found[1]["properties"]["measurements"]["Cell: Area µm^2"] == 25.0 and "Channel 2: Cytoplasm: Median" in found[1]["properties"]["measurements"]
    mask, size = masks.load_mask(spark, at("out.tif"))
    assert size == (40, 40) and {r.label: r["count"] for r in mask.groupBy("label").count().collect()}[1] == 100
    alone = job.run(spark, job.Job(whole_cell_mask=at("wc.tif"), simplify_rois=False, constrain_overlaps=False))
    assert alone.measurements is None and alone.features.count() == 2 == alone.cells.count()
    with pytest.raises(ValueError, match="differ in size"):
        job.run(spark, job.Job(at("nuc.tif"), at("small.tif")))
    for wrong, message in (({}, "mask"), ({"nuclear_mask": "x", "tolerance": -1.0}, "tolerance"), ({"nuclear_mask": "x", "geometry_batch_size": 0}, "batch")):
        with pytest.raises(ValueError, match=message):
            job.Job(**wrong)
    with pytest.raises(ValueError, match="no mask"):
        masks.load_mask(spark, "labels.png")


def test_a_store_with_boundaries(spark, tmp_path):
    there = tmp_path / "cells.zarr" / "images" / "slide" / "0"
    there.mkdir(parents=True)
    (there / ".zarray").write_text(json.dumps({"shape": [1, 9, 8], "chunks": [1, 9, 8], "dtype": "|u1", "compressor": None, "fill_value": 0}))
    spark.createDataFrame([(boundaries.well_known([RING]),), (boundaries.well_known([HOLE]),)], "geometry binary").coalesce(1).write.parquet(str(tmp_path / "cells.zarr" / "shapes"))
    pixels, size = masks.load_mask(spark, str(tmp_path / "cells.zarr"), "shapes")
    assert size == (9, 8) and {r.label: r["count"] for r in pixels.groupBy("label").count().collect()} == {1: 12, 2: 4}
