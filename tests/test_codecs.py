"""Decoders against plain encoders, chunk stores with absent chunks, shards, checksums, and reads of windows."""

from __future__ import annotations

import json
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from cellweave.functions import codecs as cd
from cellweave.sources import tiff, zarr


def lzw_encoded(data: bytes) -> bytes:
    bits, table, width, at = [], {bytes([i]): i for i in range(256)}, 9, b""

    def put(code):
        bits.extend(code >> k & 1 for k in reversed(range(width)))

    put(256)
    n = 258
    for byte in data:
        more = at + bytes([byte])
        if more in table:
            at = more
            continue
        put(table[at])
        table[more] = n
        n += 1
        if n == 4095:
            put(256)
            table, width, n = {bytes([i]): i for i in range(256)}, 9, 258
        elif n >= 1 << width:
            width += 1
        at = bytes([byte])
    if at:
        put(table[at])
        n += 1
        width += n >= 1 << width and width < 12
    put(257)
    bits += [0] * (-len(bits) % 8)
    return np.packbits(bits).tobytes()


def test_lzw_and_packbits():
    rng = random.Random(3)
    for data in (b"", b"a", b"a" * 5000, bytes(rng.randrange(4) for _ in range(30_000)), rng.randbytes(20_000), bytes(range(256)) * 40):
        assert cd.lzw(lzw_encoded(data)) == data
    # fixed values: the example of the format's description
    assert cd.packbits(bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA")) == bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA")
    assert cd.packbits(b"\x80\x00a\x80") == b"a"


@pytest.mark.parametrize(("code", "pack"), [(1, bytes), (5, lzw_encoded), (32773, lambda b: b"".join(bytes([0, x]) for x in b)), (50000, lambda b: zstandard.compress(b))])
def test_compressed_pages(spark, tmp_path, code, pack):
    a = np.random.default_rng(0).integers(0, 300, (9, 14)).astype("<u2")
    raw = pack(np.diff(a, axis=1, prepend=np.zeros((9, 1), "<u2")).astype("<u2").tobytes())
    fields = [(256, 14), (257, 9), (258, 16), (259, code), (273, 8 + 2 + 12 * 9 + 4), (277, 1), (278, 9), (279, len(raw)), (317, 2)]
    head = struct.pack("<2sHIH", b"II", 42, 8, len(fields)) + b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in fields) + struct.pack("<I", 0)
    (tmp_path / "a.tif").write_bytes(head + raw)
    tiff.register(spark)
    got = {(r.r, r.c): r.label for r in spark.read.format("labelmask").load(str(tmp_path / "a.tif")).collect()}
    assert got == {(int(r), int(c)): int(a[r, c]) for r, c in zip(*np.nonzero(a), strict=True)}


def blosc_encoded(data: bytes, size: int, block: int, code: int, shuffle: int, split: bool) -> bytes:
    """One frame, block by block: shuffled by bytes (1) or bits (2), in a stream for each byte of an element or in one."""
    pack = {1: lambda b: pa.Codec("lz4_raw").compress(b).to_pybytes(), 2: lambda b: pa.Codec("snappy").compress(b).to_pybytes(), 3: zlib.compress, 4: zstandard.compress}[code]
    blocks = []
    for at in range(0, len(data), block):
        own = data[at : at + block]
        n = len(own) // size if shuffle == 1 else len(own) // size // 8 * 8
        a = np.frombuffer(own, np.uint8, n * size).reshape(n, size)
        if shuffle == 1:
            own = b"".join(a[:, k].tobytes() for k in range(size)) + own[n * size :]
        elif shuffle == 2:
            planes = [np.packbits(a[:, k] >> b & 1, bitorder="little").tobytes() for k in range(size) for b in range(8)]
            own = b"".join(planes) + own[n * size :]
        k = size if split and len(own) == block else 1
        out = b""
        for i in range(k):
            part = own[i * len(own) // k : (i + 1) * len(own) // k]
            packed = pack(part)
            packed = part if len(packed) >= len(part) else packed
            out += struct.pack("<I", len(packed)) + packed
        blocks.append(out)
    flags = {0: 0, 1: 1, 2: 4}[shuffle] | (0 if split else 0x10) | code << 5
    places = np.cumsum([16 + 4 * len(blocks), *map(len, blocks)])
    return struct.pack("<4B3I", 2, 1, flags, size, len(data), block, int(places[-1])) + struct.pack(f"<{len(blocks)}I", *places[:-1].tolist()) + b"".join(blocks)


@pytest.mark.parametrize("code", [1, 2, 3, 4])
@pytest.mark.parametrize(("shuffle", "split"), [(0, False), (1, True), (1, False), (2, False)])
def test_blosc_frames(code, shuffle, split):
    rng = np.random.default_rng(1)
    for data in (rng.integers(0, 50, 3000).astype("<u2").tobytes(), rng.bytes(4096), np.arange(999, dtype="<u4").tobytes(), b"abc"):
        assert cd.blosc(blosc_encoded(data, 4, 1024, code, shuffle, split)) == data
    assert cd.blosc(struct.pack("<4B3I", 2, 1, 0x02, 1, 3, 3, 19) + b"xyz") == b"xyz"
    with pytest.raises(ValueError, match="blosclz"):
        cd.blosc(blosc_encoded(b"a" * 100, 1, 100, 1, 0, False).replace(struct.pack("<B", 0x10 | 1 << 5), b"\x10", 1))


def test_checksums():
    def plain(data):
        value = 0xFFFFFFFF
        for x in data:
            value ^= x
            for _ in range(8):
                value = value >> 1 ^ (cd.CRC32C if value & 1 else 0)
        return value ^ 0xFFFFFFFF

    assert cd.crc32c(b"123456789") == 0xE3069283  # fixed value: the checksum's published test
    rng = random.Random(1)
    for n in (0, 1, 1024, 2047, 2048, 5000, 16384):
        data = rng.randbytes(n)
        assert cd.crc32c(data) == plain(data)


def store(path, a, chunks, fill, left_out=(), pack=bytes, compressor=None):
    path.mkdir(parents=True)
    (path / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunks, "dtype": a.dtype.str, "compressor": compressor, "fill_value": fill, "order": "C", "filters": None}))
    for at in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunks, strict=True))):
        if at in left_out:
            continue
        whole = np.full(chunks, fill, a.dtype)
        own = a[tuple(slice(i * c, (i + 1) * c) for i, c in zip(at, chunks, strict=True))]
        whole[tuple(slice(0, n) for n in own.shape)] = own
        (path / ".".join(map(str, at))).write_bytes(pack(whole.tobytes()))


def test_absent_chunks_have_the_fill_value(spark, tmp_path):
    a = np.random.default_rng(2).integers(1, 9, (2, 7, 5)).astype("<u2")
    gone = [(0, 0, 1), (1, 1, 0)]
    want = a.copy()
    want[0, :4, 3:], want[1, 4:, :3] = 3, 3
    store(tmp_path / "image", a, (1, 4, 3), 3, gone, lambda b: blosc_encoded(b, 2, 16, 1, 1, True), {"id": "blosc"})
    image, shape = zarr.read_image(spark, str(tmp_path / "image"))
    assert shape == (2, 7, 5) and {(r.ch - 1, r.r, r.c): r.v for r in image.collect()} == {k: float(v) for k, v in np.ndenumerate(want)}
    store(tmp_path / "mask", a[0], (4, 3), 0, [(0, 0)])
    mask, _ = zarr.read_mask(spark, str(tmp_path / "mask"))
    assert {(r.r, r.c): r.label for r in mask.collect()} == {k: int(v) for k, v in np.ndenumerate(a[0]) if k[0] >= 4 or k[1] >= 3}
    store(tmp_path / "full", a[0], (4, 3), 7, list(np.ndindex(2, 2)))
    assert zarr.read_mask(spark, str(tmp_path / "full"))[0].filter("label = 7").count() == 35
    store(tmp_path / "nan", np.zeros((2, 2), "<f4"), (2, 2), "NaN", [(0, 0)])
    assert [r.v != r.v for r in zarr.read_image(spark, str(tmp_path / "nan"))[0].collect()] == [True] * 4


def test_paths_of_any_form(spark, tmp_path):
    a = np.arange(1, 13, dtype="<u2").reshape(3, 4)
    store(tmp_path / "a b", a, (2, 2), 0)
    for path in (str(tmp_path / "a b"), f"file://{tmp_path}/a b", f"file:{tmp_path}/a b/"):
        assert zarr.read_mask(spark, path)[0].count() == 12
    assert zarr.qualified(spark, "x/y").startswith("file:/") and zarr.qualified(spark, "x/y").endswith("/x/y")


def test_only_chunks_of_the_window_are_opened(spark, tmp_path):
    a = np.arange(3 * 40 * 30, dtype="<i4").reshape(3, 40, 30)
    store(tmp_path / "image", a, (1, 10, 10), 0)
    for broken in ("0.0.0", "1.0.0", "1.3.0", "1.1.2"):  # read, these would be an error
        (tmp_path / "image" / broken).write_bytes(b"?")
    got = zarr.read_image(spark, str(tmp_path / "image"), ch=(2, 2), r=(12, 25), c=(0, 14))[0].collect()
    assert {(r.ch, r.r, r.c): r.v for r in got} == {(2, r, c): float(a[1, r, c]) for r in range(12, 26) for c in range(15)}
    assert zarr.read_image(spark, str(tmp_path / "image"), r=(40, 50))[0].count() == 0
    options = {"layout": json.dumps(zarr.asdict(zarr.find_array(spark, str(tmp_path / "image")))), "axes": "[0, 1, 2]"}
    for window, n in (({}, 36), ({"ch": "2:2", "r": "30:99"}, 3), ({"c": "3:14"}, 24), ({"r": "-9:-5"}, 0), ({"ch": "9:9"}, 0), ({"ch": "0:1", "r": "9:10", "c": "29:29"}, 2)):
        assert sum(p.last - p.first for p in zarr.ChunkedImageReader(options | window).partitions()) == n


def sharded(path, a, shard, chunks, gone):
    """Format 3: files of many chunks, compressed and checked one by one, with an index behind them."""
    path.mkdir(parents=True)
    inner = [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd"}, {"name": "crc32c"}]
    codec = {"name": "sharding_indexed", "configuration": {"chunk_shape": chunks, "codecs": inner, "index_codecs": [{"name": "bytes"}, {"name": "crc32c"}], "index_location": "end"}}
    (path / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": "uint16", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": shard}}, "chunk_key_encoding": {"name": "default"}, "codecs": [codec], "fill_value": 0}))
    for y in range(0, a.shape[0], shard[0]):
        for x in range(0, a.shape[1], shard[1]):
            data, index = b"", []
            for r in range(y, y + shard[0], chunks[0]):
                for c in range(x, x + shard[1], chunks[1]):
                    own = a[r : r + chunks[0], c : c + chunks[1]]
                    if not own.size or (r // chunks[0], c // chunks[1]) in gone:
                        index += [zarr.ABSENT, zarr.ABSENT]
                        continue
                    whole = np.zeros(chunks, a.dtype)
                    whole[: own.shape[0], : own.shape[1]] = own
                    packed = zstandard.compress(whole.tobytes())
                    packed += struct.pack("<I", cd.crc32c(packed))
                    index += [len(data), len(packed)]
                    data += packed
            table = struct.pack(f"<{len(index)}Q", *index)
            there = path / "c" / str(y // shard[0]) / str(x // shard[1])
            there.parent.mkdir(parents=True, exist_ok=True)
            there.write_bytes(data + table + struct.pack("<I", cd.crc32c(table)))


def test_shards(spark, tmp_path):
    a = np.random.default_rng(5).integers(1, 99, (13, 11)).astype("<u2")
    sharded(tmp_path / "s", a, (8, 8), (4, 2), [(1, 1)])
    want = a.copy()
    want[4:8, 2:4] = 0
    mask, size = zarr.read_mask(spark, str(tmp_path / "s"))
    assert size == (13, 11) and {(r.r, r.c): r.label for r in mask.collect()} == {k: int(v) for k, v in np.ndenumerate(want) if v}
    broken = tmp_path / "s" / "c" / "1" / "1"
    raw = bytearray(broken.read_bytes())
    raw[3] ^= 1
    broken.write_bytes(bytes(raw))
    assert zarr.read_mask(spark, str(tmp_path / "s"), r=(0, 7))[0].count() == int((want[:8] > 0).sum())
    with pytest.raises(Exception, match="checksum"):
        mask.count()
