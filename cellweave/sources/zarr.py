"""Chunked arrays of directories (formats 2 and 3) as pixel relations, read as Spark data sources.

A partition reads a run of chunks. Of a window (``r``, ``c`` and ``ch``, each as first and last) only the chunks are
opened, or, of sharded arrays, only the ranges of chunks. A chunk that is not there stands for the array's fill value.
Where an array lies is found through Spark's file systems; its chunks are read by those of pyarrow in the tasks.
"""

from __future__ import annotations

import gzip
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellweave.functions import codecs as cd
from cellweave.functions.tables import file_system

from .tiff import PARTITION_BYTES, bounds_of, channel_axis, windowed

#: Names under which a group keeps its array, in the order in which they are looked for.
PREFERRED = ("0", "data", "image")


#: The place and length of a chunk that a shard doesn't hold.
ABSENT = (1 << 64) - 1


@dataclass(frozen=True)
class Layout:
    """Where an array lies and how its chunks are written; ``shard`` is the shape of a file that holds many of them."""

    path: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: str
    codecs: tuple[str, ...]
    prefix: str  # of a chunk's name under the path
    separator: str
    fill: float = 0
    shard: tuple[int, ...] | None = None
    index_checked: bool = False
    index_first: bool = False

    def name(self, at: tuple[int, ...]) -> str:
        """The file of a chunk, or of the shard that holds it."""
        if self.shard:
            at = tuple(i * c // s for i, c, s in zip(at, self.chunks, self.shard, strict=True))
        return self.prefix + self.separator.join(map(str, at))

    def place(self, at: tuple[int, ...]) -> tuple[int, int]:
        """The number of a chunk in its shard, and how many the shard has."""
        inside = tuple(s // c for c, s in zip(self.chunks, self.shard, strict=True))
        return int(np.ravel_multi_index(tuple(i % n for i, n in zip(at, inside, strict=True)), inside)), int(np.prod(inside))


def _fill(value: object) -> float:
    return float(value) if value is not None else 0.0  # names of infinite ones and of no number too


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, there, there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark takes it, relative ones and those without a scheme too, as an address for tasks."""
    _, there, system = _files(spark, path)
    return system.makeQualified(there).toString()


def _text(spark: SparkSession, path: str) -> dict | None:
    jvm, there, system = _files(spark, path)
    if not system.exists(there):
        return None
    stream = system.open(there)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _children(spark: SparkSession, path: str) -> list[str]:
    _, there, system = _files(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(there) if s.isDirectory()) if system.exists(there) else []


def _layout(spark: SparkSession, path: str) -> Layout | None:
    """The array at a path, if there is one."""
    if found := _text(spark, f"{path}/.zarray"):
        if found.get("filters") or found.get("order", "C") != "C":
            raise ValueError(f"{path}: filters and column order are not supported")
        codec = (found["compressor"] or {}).get("id", "none")
        return Layout(path, tuple(found["shape"]), tuple(found["chunks"]), found["dtype"], (codec,), "", found.get("dimension_separator", "."), _fill(found.get("fill_value")))
    found = _text(spark, f"{path}/zarr.json")
    if not found or found.get("node_type") != "array":
        return None
    chunks, listed, shard = tuple(found["chunk_grid"]["configuration"]["chunk_shape"]), found["codecs"], {}
    if listed[0]["name"] == "sharding_indexed":
        own = listed[0]["configuration"]
        shard = {"shard": chunks, "index_checked": any(c["name"] == "crc32c" for c in own.get("index_codecs", [])), "index_first": own.get("index_location") == "start"}
        chunks, listed = tuple(own["chunk_shape"]), own["codecs"]
    codecs, order = [], "<"
    for c in listed:
        if c["name"] == "bytes":
            order = ">" if (c.get("configuration") or {}).get("endian") == "big" else "<"
        else:
            codecs.append(c["name"])
    kind = np.dtype(found["data_type"]).newbyteorder(order).str
    key = found.get("chunk_key_encoding", {"name": "default"})
    default = key["name"] == "default"
    cut = (key.get("configuration") or {}).get("separator", "/" if default else ".")
    return Layout(path, tuple(found["shape"]), chunks, kind, tuple(codecs), "c" + cut if default else "", cut, _fill(found.get("fill_value")), **shard)


def find_array(spark: SparkSession, path: str) -> Layout:
    """The array at a path or in the group there: under ``0``, ``data`` or ``image``, else the first child array by name, else in a child group."""

    def inside(at: str) -> Layout | None:
        if (found := _layout(spark, at)) is not None:
            return found
        children = _children(spark, at)
        ranked = [c for c in PREFERRED if c in children] + [c for c in children if c not in PREFERRED]
        for c in ranked:
            if (found := _layout(spark, f"{at}/{c}")) is not None:
                return found
        return next((f for c in ranked if (f := inside(f"{at}/{c}")) is not None), None)

    found = inside(path.rstrip("/"))
    if found is None:
        raise ValueError(f"no array under {path}")
    return found


def image_size(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and columns of the first image in a store of images and shapes, at its finest scale."""
    images = f"{path.rstrip('/')}/images"
    names = _children(spark, images)
    if not names:
        raise ValueError(f"no image under {path}: the size of its mask is not known")
    scales = _children(spark, f"{images}/{names[0]}")
    finest = next((s for s in ("scale0", "0") if s in scales), None)
    found = find_array(spark, f"{images}/{names[0]}/{finest}" if finest else f"{images}/{names[0]}")
    return found.shape[-2], found.shape[-1]


def _decoded(data: bytes, layout: Layout) -> np.ndarray:
    for codec in reversed(layout.codecs):
        if codec == "zlib":
            data = zlib.decompress(data)
        elif codec == "gzip":
            data = gzip.decompress(data)
        elif codec == "zstd":
            data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        elif codec == "blosc":
            data = cd.blosc(data)
        elif codec == "lz4":
            data = pa.Codec("lz4_raw").decompress(data[4:], struct.unpack_from("<I", data)[0]).to_pybytes()
        elif codec == "crc32c":
            if cd.crc32c(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
                raise ValueError(f"{layout.path}: a chunk is not what its checksum says")
            data = data[:-4]
        elif codec != "none":
            raise ValueError(f"{layout.path}: codec {codec} is not supported")
    return np.frombuffer(data, layout.dtype).reshape(layout.chunks)


class Run(InputPartition):
    """Chunks number ``first`` to ``last`` of the grid between the corners ``low`` and ``high`` (excluded)."""

    def __init__(self, low: tuple[int, ...], high: tuple[int, ...], first: int, last: int):
        self.low, self.high, self.first, self.last = low, high, first, last


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = json.loads(options["layout"])
        self.layout = Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
        self.channel, self.row, self.column = json.loads(options["axes"])
        self.bounds = bounds_of(options)

    def partitions(self) -> list[Run]:
        shape, chunks = self.layout.shape, self.layout.chunks
        low, high = [0] * len(shape), [-(-s // c) for s, c in zip(shape, chunks, strict=True)]
        for name, axis, first in (("ch", self.channel, 1), ("r", self.row, 0), ("c", self.column, 0)):
            if axis is not None and name in self.bounds:
                least, most = self.bounds[name]
                low[axis] = max(0, least - first) // chunks[axis]
                high[axis] = min(high[axis], (most - first) // chunks[axis] + 1)
        if self.channel is None and not self.bounds.get("ch", (1, 1))[0] <= 1 <= self.bounds.get("ch", (1, 1))[1]:
            return []
        n = int(np.prod([max(0, h - a) for a, h in zip(low, high, strict=True)]))
        step = max(1, PARTITION_BYTES // max(1, int(np.prod(chunks)) * np.dtype(self.layout.dtype).itemsize))
        return [Run(tuple(low), tuple(high), k, min(n, k + step)) for k in range(0, n, step)]

    def chunks(self, part: Run | None) -> Iterator[tuple[tuple[int, ...], np.ndarray | None]]:
        """The place of the first pixel and the pixels of each chunk, None where it is not there."""
        if part is None:  # what Spark asks for where there are no partitions
            return
        there, path = file_system(self.layout.path)
        size, index = tuple(h - a for a, h in zip(part.low, part.high, strict=True)), ("", None)
        for k in range(part.first, part.last):
            at = tuple(int(i) + a for i, a in zip(np.unravel_index(k, size), part.low, strict=True))
            name = f"{path}/{self.layout.name(at)}"
            data = None
            try:
                if not self.layout.shard:
                    with there.open_input_file(name) as f:
                        data = f.read()
                else:
                    own, n = self.layout.place(at)
                    with there.open_input_file(name) as f:
                        if index[0] != name:
                            index = (name, self._index(f, n))
                        start, length = index[1][own].tolist()
                        data = f.read_at(length, start) if (start, length) != (ABSENT, ABSENT) else None
            except FileNotFoundError:
                pass
            first = tuple(i * c for i, c in zip(at, self.layout.chunks, strict=True))
            inner = tuple(slice(0, max(0, s - a)) for s, a in zip(self.layout.shape, first, strict=True))
            yield first, None if data is None else _decoded(data, self.layout)[inner]

    def _index(self, f: pa.NativeFile, n: int) -> np.ndarray:
        """Place and length of each chunk of a shard."""
        size = 16 * n + 4 * self.layout.index_checked
        raw = f.read_at(size, 0 if self.layout.index_first else f.size() - size)
        if self.layout.index_checked and cd.crc32c(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"{self.layout.path}: a shard's index is not what its checksum says")
        return np.frombuffer(raw, "<u8", 2 * n).reshape(n, 2)

    def filled(self, first: tuple[int, ...], values: np.ndarray | None) -> np.ndarray:
        if values is not None:
            return values
        size = tuple(min(c, s - a) for a, s, c in zip(first, self.layout.shape, self.layout.chunks, strict=True))
        return np.full(size, self.layout.fill, self.layout.dtype)


class ChunkedMaskReader(_ChunkReader):
    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        for at, values in self.chunks(part):
            if values is None and not self.layout.fill:
                continue
            values = self.filled(at, values)
            r, c = np.nonzero(values)
            yield pa.RecordBatch.from_arrays([pa.array((r + at[0]).astype(np.int32)), pa.array((c + at[1]).astype(np.int32)), pa.array(values[r, c].astype(np.int64))], names=["r", "c", "label"])


class ChunkedImageReader(_ChunkReader):
    def read(self, part: Run) -> Iterator[pa.RecordBatch]:
        for at, values in self.chunks(part):
            values = self.filled(at, values)
            ends = (-2, -1) if self.channel is None else (-3, -2, -1)
            values = np.moveaxis(values, [x for x in (self.channel, self.row, self.column) if x is not None], ends)
            first = 0 if self.channel is None else at[self.channel]
            for k, plane in enumerate(values.reshape(-1, *values.shape[-2:])):
                r, c = np.indices(plane.shape).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(r.size, first + k + 1, np.int32)), pa.array((r + at[self.row]).astype(np.int32)), pa.array((c + at[self.column]).astype(np.int32)), pa.array(plane.ravel().astype(np.float64))], names=["ch", "r", "c", "v"])


class ChunkedMask(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunkedmask"

    def schema(self) -> str:
        return "r int, c int, label bigint"

    def reader(self, schema) -> DataSourceReader:
        return ChunkedMaskReader(self.options)


class ChunkedImage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunkedimage"

    def schema(self) -> str:
        return "ch int, r int, c int, v double"

    def reader(self, schema) -> DataSourceReader:
        return ChunkedImageReader(self.options)


def _loaded(spark: SparkSession, source: type[DataSource], layout: Layout, axes: tuple[int | None, int, int], window: dict[str, tuple[int, int] | None]) -> DataFrame:
    spark.dataSource.register(source)
    layout = replace(layout, path=qualified(spark, layout.path))
    return windowed(spark.read.format(source.name()).option("layout", json.dumps(asdict(layout))).option("axes", json.dumps(axes)), **window)


def read_mask(spark: SparkSession, path: str, r: tuple[int, int] | None = None, c: tuple[int, int] | None = None) -> tuple[DataFrame, tuple[int, int]]:
    """``r, c, label`` without background, and the mask's size; labels are whole numbers of 32 bits at most, in two dimensions. ``r`` and ``c`` ask for a window."""
    layout = find_array(spark, path)
    kind = np.dtype(layout.dtype)
    if len(layout.shape) != 2:
        raise ValueError(f"a label mask is a 2D image, not {layout.shape}")
    if kind.kind not in "ui":
        raise ValueError("a label mask holds integer labels")
    if kind.itemsize > 4:
        raise ValueError("a label mask has labels of 32-bit at most")

    return _loaded(spark, ChunkedMask, layout, (None, 0, 1), {"r": r, "c": c}), layout.shape


def read_image(spark: SparkSession, path: str, axes: str | None = None, **window: tuple[int, int] | None) -> tuple[DataFrame, tuple[int, int, int]]:
    """``ch, r, c, v`` of an image of two or three axes, named by letters or told by their sizes, and (channels, rows, columns); ``ch``, ``r``, ``c`` ask for a window."""
    layout = find_array(spark, path)
    channel, row, column = axes_ = channel_axis(layout.shape, axes)
    size = (1 if channel is None else layout.shape[channel], layout.shape[row], layout.shape[column])
    return _loaded(spark, ChunkedImage, layout, axes_, window), size
