"""TIFF label masks and multi-channel images as Spark data sources; a partition reads some strips or tiles of one page.

Uncompressed, deflate, LZW, PackBits and zstd data, with or without horizontal differencing, classic and large files. Register with ``register(spark)``,
then ``spark.read.format("labelmask").load(path)`` gives ``r, c, label`` without background and
``spark.read.format("cyximage").load(path)`` gives ``ch, r, c, v``. ``windowed`` reads a window of either: strips,
tiles and pages outside are not read. Windows are options of a relation of their own, as Spark keeps what a filter has
pushed into a Python source for all later scans of the same relation, which would then lose rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cellweave.functions import codecs as cd

from .parts import Parts

#: Fixed values of the TIFF format: bytes of each field type, and the tags that are read.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8, 17: 8, 18: 8}
TYPE_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, LENGTH, BITS, COMPRESSION, DESCRIPTION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 270, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, ZSTD = (1,), (5,), (8, 32946), (32773,), (50000,)
#: Where a stack written by ImageJ keeps its labels, and under which name.
IJ_COUNTS, IJ_DATA, IJ_LABELS = 50838, 50839, b"labl"
#: Bytes of pixels that one partition reads.
PARTITION_BYTES = 32 << 20


@dataclass
class Page:
    order: str
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default: int | None = None) -> int:
        value = self.tags.get(tag)
        if value is None and default is None:
            raise ValueError(f"the page has no tag {tag}")
        return int(value[0]) if value is not None else default

    @property
    def shape(self) -> tuple[int, int]:
        return self.one(LENGTH), self.one(WIDTH)

    @property
    def samples(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def description(self) -> str:
        return bytes(self.tags.get(DESCRIPTION, ())).split(b"\0")[0].decode("utf-8", "replace")

    @property
    def dtype(self) -> np.dtype:
        kind = {1: "u", 2: "i", 3: "f"}[self.one(SAMPLE_FORMAT, 1)]
        return np.dtype(f"{self.order}{kind}{self.one(BITS, 1) // 8}")

    def segments(self) -> list[tuple[int, int, int, int, int, int, int]]:
        """(first row, first column, rows, columns, first sample, place, bytes) of each strip or tile."""
        h, w = self.shape
        planes = self.samples if self.one(PLANAR, 1) == 2 else 1
        if TILE_OFFSETS in self.tags:
            th, tw = self.one(TILE_LENGTH), self.one(TILE_WIDTH)
            spots = [(p, r, c, th, tw) for p in range(planes) for r in range(0, h, th) for c in range(0, w, tw)]
            places, counts = self.tags[TILE_OFFSETS], self.tags[TILE_COUNTS]
        else:
            rows = min(self.one(ROWS_PER_STRIP, h), h)
            spots = [(p, r, 0, min(rows, h - r), w) for p in range(planes) for r in range(0, h, rows)]
            places, counts = self.tags[STRIP_OFFSETS], self.tags[STRIP_COUNTS]
        return [(r, c, n, m, p, int(a), int(b)) for (p, r, c, n, m), a, b in zip(spots, places, counts, strict=True)]

    def decoded(self, raw: bytes, rows: int, columns: int) -> np.ndarray:
        """(rows, columns, samples in the segment)"""
        if self.one(COMPRESSION, 1) in DEFLATE:
            raw = zlib.decompress(raw)
        elif self.one(COMPRESSION, 1) in LZW:
            raw = cd.lzw(raw)
        elif self.one(COMPRESSION, 1) in PACKBITS:
            raw = cd.packbits(raw)
        elif self.one(COMPRESSION, 1) in ZSTD:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        elif self.one(COMPRESSION, 1) not in NONE:
            raise ValueError(f"TIFF compression {self.one(COMPRESSION)} is not supported")
        deep = self.samples if self.one(PLANAR, 1) == 1 else 1
        out = np.frombuffer(raw, self.dtype, rows * columns * deep).reshape(rows, columns, deep)
        if self.one(PREDICTOR, 1) == 2:
            out = np.cumsum(out, axis=1, dtype=self.dtype)
        elif self.one(PREDICTOR, 1) != 1:
            raise ValueError("TIFF predictor is not supported")
        return out


def pages(path: str) -> list[Page]:
    with open(path, "rb") as f:
        start = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None:
            raise ValueError(f"{path} is no TIFF file")
        large = struct.unpack(order + "H", start[2:4])[0] == 43
        entry, number, pointer = (20, "Q", "Q") if large else (12, "H", "I")
        at = struct.unpack(order + pointer, start[8:16] if large else start[4:8])[0]
        out = []
        while at:
            f.seek(at)
            n = struct.unpack(order + number, f.read(struct.calcsize(number)))[0]
            entries, tail = f.read(n * entry), f.read(struct.calcsize(pointer))
            page = Page(order)
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HH" + pointer, entries, i * entry)
                inline = entries[i * entry + entry - struct.calcsize(pointer) : (i + 1) * entry]
                size = TYPE_BYTES.get(kind, 1) * count
                if size > len(inline):
                    f.seek(struct.unpack(order + pointer, inline)[0])
                    inline = f.read(size)
                page.tags[tag] = tuple(inline[:size]) if kind in (2, 7) or kind not in TYPE_CODES else struct.unpack_from(f"{order}{count}{TYPE_CODES[kind]}", inline)
            out.append(page)
            at = struct.unpack(order + pointer, tail)[0]
    return out


def channel_axis(shape: tuple[int, ...], names: str | None = None) -> tuple[int | None, int, int]:
    """The channel's, row's and column's axis of an array: by axis letters if they are given, else by its shape."""
    if names is not None and len(names) == len(shape):
        for n, size in zip(names, shape, strict=True):
            if n not in "CSQIYX" and size != 1:
                raise ValueError(f"axis {n} of {names} has {size} places")
        if "Y" not in names or "X" not in names:
            raise ValueError(f"no rows or columns in {names}")
        return next((names.index(c) for c in "CSQI" if c in names), None), names.index("Y"), names.index("X")
    if len(shape) == 2:
        return None, 0, 1
    if len(shape) == 3 and shape[0] <= min(shape[1:]):
        return 0, 1, 2
    if len(shape) == 3 and shape[2] <= min(shape[:2]):
        return 2, 0, 1
    raise ValueError(f"shape {shape} is no image")


def ome_names(description: str) -> list[str]:
    try:
        root = ElementTree.fromstring(description)
    except ElementTree.ParseError:
        return []
    found = [e.get("Name") or e.get("ID") for e in root.iter() if e.tag.rpartition("}")[2] == "Channel"]
    return [n for n in found if n]


def is_comet(description: str) -> bool:
    """Whether the instrument described is a Comet by Lunaphore: one of its parts names both."""
    try:
        root = ElementTree.fromstring(description)
    except ElementTree.ParseError:
        return False
    parts = [e for e in root.iter() if e.tag.rpartition("}")[2] in ("Microscope", "Detector", "Objective")]
    return any("lunaphore" in (e.get("Manufacturer") or "").lower() and "comet" in (e.get("Model") or "").lower() for e in parts)


def json_names(found: list[Page]) -> list[str]:
    """Names from a JSON description on every page, under the literal key ``channel.target``."""
    try:
        return [n for n in (str(json.loads(p.description).get("channel.target", "")) for p in found) if n]
    except (ValueError, AttributeError):
        return []


def stack_names(page: Page) -> list[str]:
    """The labels of a stack's slices: a table of (kind, number), then the entries, whose lengths stand in a tag of their own."""
    counts, data = page.tags.get(IJ_COUNTS), bytes(page.tags.get(IJ_DATA, ()))
    if not counts or data[:4] not in (b"IJIJ", b"JIJI"):
        return []
    order, text = (">", "utf-16-be") if data[:4] == b"IJIJ" else ("<", "utf-16-le")
    kinds = [struct.unpack_from(f"{order}4sI", data, 4 + 8 * i) for i in range((counts[0] - 4) // 8)]
    ends = list(np.cumsum(counts))
    out, k = [], 0
    for kind, n in kinds:
        name = kind if order == ">" else kind[::-1]
        out += [data[ends[k + i] : ends[k + i + 1]].decode(text) for i in range(n)] if name == IJ_LABELS else []
        k += n
    return [n for n in out if n]


def is_json(found: list[Page]) -> bool:
    try:
        return "channel.target" in json.loads(found[0].description)
    except (ValueError, TypeError, IndexError):
        return False


def _stack_counts(description: str) -> dict[str, int]:
    """The whole numbers of an ImageJ description, by name."""
    if not description.startswith("ImageJ="):
        return {}
    return {k: int(v) for k, _, v in (line.partition("=") for line in description.splitlines()) if v.isdigit()}


def leading_axes(found: list[Page]) -> tuple[str, tuple[int, ...]] | None:
    """Letters and sizes of the axes before a page's rows and columns, as the first page's description tells them.

    OME tells them by the order and the sizes of its first image, ImageJ by the numbers of channels, slices and frames,
    and a JSON description by ``shape`` (with ``axes``, or without names). None where there is no such description.
    """
    first = found[0]
    try:
        pixels = next((e for e in ElementTree.fromstring(first.description).iter() if e.tag.rpartition("}")[2] == "Pixels"), None)
    except ElementTree.ParseError:
        pixels = None
    if pixels is not None and pixels.get("DimensionOrder", "").startswith("XY"):
        inside = first.samples if first.samples > 1 else 1
        sizes = {x: int(pixels.get(f"Size{x}", 1)) for x in "ZCT"} | {"C": max(1, int(pixels.get("SizeC", 1)) // inside)}
        letters = pixels.get("DimensionOrder")[:1:-1]
        return letters, tuple(sizes[x] for x in letters)
    counts = _stack_counts(first.description)
    if counts:
        sizes = {"T": counts.get("frames", 1), "Z": counts.get("slices", 1), "C": counts.get("channels", 1)}
        n = counts.get("images", 1)
        if n != sizes["T"] * sizes["Z"] * sizes["C"]:  # a plain stack
            return "I", (n,)
        return "TZC", tuple(sizes[x] for x in "TZC")
    try:
        told = json.loads(first.description)
        shape = tuple(map(int, told["shape"]))
    except (ValueError, TypeError, KeyError):
        return None
    inner = (*first.shape, *([first.samples] if first.samples > 1 else []))
    if shape[len(shape) - len(inner) :] != inner or len(shape) == len(inner):
        return None
    names = str(told.get("axes", ""))
    lead = shape[: len(shape) - len(inner)]
    return (names[: len(lead)] if len(names) == len(shape) else "?" * len(lead)), lead


def series(found: list[Page]) -> list[Page]:
    """The pages of the first image, one for each plane: of a stack that is one long run of bytes behind a single directory, pages of its planes."""
    told = leading_axes(found)
    n = int(np.prod(told[1])) if told else len(found)
    if told and len(found) == 1 < n and found[0].one(COMPRESSION, 1) in NONE and TILE_OFFSETS not in found[0].tags:
        page = found[0]
        h, w = page.shape
        plane = h * w * page.samples * page.dtype.itemsize
        start = int(page.tags[STRIP_OFFSETS][0])
        return [Page(page.order, page.tags | {STRIP_OFFSETS: (start + k * plane,), STRIP_COUNTS: (plane,), ROWS_PER_STRIP: (h,)}) for k in range(n)]
    return found


def check_axes(found: list[Page]) -> None:
    """Planes are channels: another axis of more than one place, or fewer pages than planes, is an error."""
    told = leading_axes(found)
    if told is None or is_json(found):
        return
    for letter, n in zip(*told, strict=True):
        if letter in "ZT" and n != 1:
            raise ValueError(f"axis {letter} has {n} places: no image of channels, rows and columns")
    full = [p for p in found if p.shape == found[0].shape]
    if len(full) < int(np.prod(told[1])):
        raise ValueError(f"{int(np.prod(told[1]))} planes are described, but there are {len(full)}")


@dataclass(frozen=True)
class Channel:
    page: int
    sample: int
    name: str


def channels(found: list[Page]) -> list[Channel]:
    """Channels in order: pages of the first one's size (all of them in a file described in JSON), and their samples."""
    check_axes(found)
    full = [i for i, p in enumerate(found) if is_json(found) or p.shape == found[0].shape]
    if (told := leading_axes(found)) and not is_json(found):
        full = full[: int(np.prod(told[1]))]  # pages of other images, such as labels or thumbnails, stand behind
    spots = [(i, s) for i in full for s in range(found[i].samples)]
    names = ome_names(found[0].description) or json_names(found) or stack_names(found[0])
    if len(names) != len(spots):
        names = [f"Channel {i + 1}" for i in range(len(spots))]
    return [Channel(i, s, n) for (i, s), n in zip(spots, names, strict=True)]


def inspect(path: str) -> dict:
    """Size and channel names, from the directories alone."""
    found = series(pages(path))
    return {"shape": (len(channels(found)), *found[0].shape), "names": [c.name for c in channels(found)]}


def kind_of(path: str) -> str:
    """What describes a file: ``json``, ``comet``, ``ome``, ``stack`` or, where nothing does, ``plain``."""
    found = pages(path)
    text = found[0].description
    told = {"json": is_json(found), "comet": is_comet(text), "ome": "<OME" in text, "stack": text.startswith("ImageJ=")}
    return next((k for k, yes in told.items() if yes), "plain")


class Part(InputPartition):
    def __init__(self, page: int, segments: list):
        self.page, self.segments = page, segments


def bounds_of(options: dict[str, str]) -> dict[str, tuple[int, int]]:
    """The window that options ``ch``, ``r`` and ``c`` ask for, each as ``first:last``."""
    return {x: tuple(map(int, options[x].split(":"))) for x in ("ch", "r", "c") if options.get(x)}


def windowed(reader: DataFrameReader, path: str | None = None, **window: tuple[int, int] | None) -> DataFrame:
    """The rows of a source between the first and last ``ch``, ``r`` and ``c`` (included) that are given; no more is read than holds them."""
    given = {x: span for x, span in window.items() if span is not None}
    rows = reader.options(**{x: f"{a}:{b}" for x, (a, b) in given.items()}).load(path)
    for x, (a, b) in given.items():
        rows = rows.filter(F.col(x).between(a, b))
    return rows


class _Reader(DataSourceReader):
    def __init__(self, path: str, bounds: dict[str, tuple[int, int]] | None = None):
        self.path = path
        self.found = series(pages(path))
        self.bounds = bounds or {}

    def within(self, name: str, first: int, last: int) -> bool:
        low, high = self.bounds.get(name, (-np.inf, np.inf))
        return first <= high and last >= low

    def used(self) -> list[int]:
        return [0]

    def partitions(self) -> list[Part]:
        out = []
        for i in self.used():
            page, held, size = self.found[i], [], 0
            for s in page.segments():
                if not (self.within("r", s[0], s[0] + s[2] - 1) and self.within("c", s[1], s[1] + s[3] - 1)):
                    continue
                held.append(s)
                size += s[2] * s[3] * page.dtype.itemsize * page.samples
                if size >= PARTITION_BYTES:
                    out.append(Part(i, held))
                    held, size = [], 0
            if held:
                out.append(Part(i, held))
        return out

    def blocks(self, part: Part | None) -> Iterator[tuple[int, int, int, np.ndarray]]:
        if part is None:  # what Spark asks for where there are no partitions
            return
        page = self.found[part.page]
        h, w = page.shape
        with open(self.path, "rb") as f:
            for r, c, rows, columns, sample, place, count in part.segments:
                f.seek(place)
                values = page.decoded(f.read(count), rows, columns)
                yield r, c, sample, values[: h - r, : w - c]


class MaskReader(_Reader):
    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        for r0, c0, _, values in self.blocks(part):
            r, c = np.nonzero(values[:, :, 0])
            yield pa.RecordBatch.from_arrays([pa.array((r + r0).astype(np.int32)), pa.array((c + c0).astype(np.int32)), pa.array(values[r, c, 0].astype(np.int64))], names=["r", "c", "label"])


class ImageReader(_Reader):
    def used(self) -> list[int]:
        return list(dict.fromkeys(c.page for i, c in enumerate(channels(self.found)) if self.within("ch", i + 1, i + 1)))

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        number = {(c.page, c.sample): i + 1 for i, c in enumerate(channels(self.found))}
        for r0, c0, sample, values in self.blocks(part):
            rows, columns, deep = values.shape
            r, c = np.repeat(np.arange(rows) + r0, columns), np.tile(np.arange(columns) + c0, rows)
            for s in range(deep):
                ch = np.full(len(r), number[part.page, sample + s])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ch.astype(np.int32), r.astype(np.int32), c.astype(np.int32), values[:, :, s].ravel().astype(np.float64))], names=["ch", "r", "c", "v"])


class MaskSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "labelmask"

    def schema(self) -> str:
        return "r int, c int, label bigint"

    def reader(self, schema) -> DataSourceReader:
        path = self.options["path"]
        if not path.lower().endswith((".tif", ".tiff")):
            raise ValueError("a label mask is a .tif or .tiff file")
        found = MaskReader(path, bounds_of(self.options))
        page = found.found[0]
        if page.samples != 1:
            raise ValueError("a label mask is a 2D image")
        if page.dtype.kind not in "ui":
            raise ValueError("a label mask holds integer labels")
        if page.dtype.itemsize > 4:
            raise ValueError("a label mask has labels of 32-bit at most")
        return found


class ImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cyximage"

    def schema(self) -> str:
        return "ch int, r int, c int, v double"

    def reader(self, schema) -> DataSourceReader:
        return ImageReader(self.options["path"], bounds_of(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MaskSource)
    spark.dataSource.register(ImageSource)


def channel_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(inspect(path)["names"])], "ch int, name string")


def mask_kind(largest: int) -> str:
    """The narrowest type that holds all labels."""
    if largest <= 0xFFFF:
        return "u2"
    if largest <= 0xFFFFFFFF:
        return "u4"
    raise ValueError(f"label {largest} is over 32 bits")


def write_mask(pixels: DataFrame, size: tuple[int, int], path: str, strip_rows: int = 64) -> int:
    """``r, c, label`` as an uncompressed TIFF; a large file (64-bit places) from 4 GiB on. Tasks write the strips that
    hold labels, and the file is then put together from them. Returns the number of strips."""
    h, w = size
    largest = pixels.agg(F.max("label")).first()[0] or 0
    kind = mask_kind(largest)

    def strip(rows):
        import pandas as pd

        k = int(rows["strip"].iloc[0])
        out = np.zeros((min(strip_rows, h - k * strip_rows), w), f"<{kind}")
        out[rows["r"].to_numpy() - k * strip_rows, rows["c"].to_numpy()] = rows["label"].to_numpy()
        return pd.DataFrame({"strip": [k], "data": [out.tobytes()]})

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes, int]]:
        for batch in batches:
            yield from ((k.as_py(), data.as_py(), 1) for k, data in zip(batch.column("strip"), batch.column("data"), strict=True))

    made = pixels.select("r", "c", "label", F.floor(F.col("r") / strip_rows).cast("int").alias("strip")).groupBy("strip").applyInPandas(strip, "strip int, data binary")
    item, n = int(kind[1]), -(-h // strip_rows)
    counts = [min(strip_rows, h - k * strip_rows) * w * item for k in range(n)]
    large = sum(counts) >= (1 << 32) - (1 << 20)
    pointer, code = ("Q", 16) if large else ("I", 4)
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) if large else struct.pack("<2sHI", b"II", 42, 8)
    fields = [(WIDTH, 4, [w]), (LENGTH, 4, [h]), (BITS, 3, [item * 8]), (COMPRESSION, 3, [1]), (262, 3, [1]), (STRIP_OFFSETS, code, [0] * n), (SAMPLES, 3, [1]), (ROWS_PER_STRIP, 4, [strip_rows]), (STRIP_COUNTS, code, counts), (SAMPLE_FORMAT, 3, [1])]
    width = struct.calcsize(pointer)
    after = len(head) + (8 if large else 2) + len(fields) * (20 if large else 12) + width
    spare = sum(len(v) * TYPE_BYTES[k] for _, k, v in fields if len(v) * TYPE_BYTES[k] > width)
    first = after + spare
    fields[5] = (STRIP_OFFSETS, code, [first + sum(counts[:k]) for k in range(n)])
    entries, extra = b"", b""
    for tag, k, values in fields:
        body = struct.pack(f"<{len(values)}{TYPE_CODES[k]}", *values)
        if len(body) > width:
            body, extra = struct.pack("<" + pointer, after + len(extra)), extra + body
        entries += struct.pack("<HH" + pointer, tag, k, len(values)) + body.ljust(width, b"\0")
    parts = Parts(made, strips)
    there = {p.key: p for p in parts.pieces}
    top = head + struct.pack("<Q" if large else "<H", len(fields)) + entries + struct.pack("<" + pointer, 0) + extra
    parts.join(path, [top, *(there.get(k, counts[k]) for k in range(n))])
    return n


def save_tiff(path: str | Path, arrays: list[np.ndarray], descriptions: list[str] | None = None) -> None:
    """Small uncompressed pages of one strip each, for fixtures and exports."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for i, a in enumerate(arrays):
        text = (descriptions[i] if descriptions else "").encode() + b"\0"
        kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
        start = len(out)
        data_at = start + 2 + 12 * 11 + 4
        text_at = data_at + a.nbytes
        text = text.ljust(5, b"\0")
        end = text_at + len(text) + len(text) % 2
        fields = [(WIDTH, 4, a.shape[1]), (LENGTH, 4, a.shape[0]), (BITS, 3, a.itemsize * 8), (COMPRESSION, 3, 1), (262, 3, 1), (DESCRIPTION, 2, text_at), (STRIP_OFFSETS, 4, data_at), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, a.shape[0]), (STRIP_COUNTS, 4, a.nbytes), (SAMPLE_FORMAT, 3, kind)]
        out += struct.pack("<H", len(fields))
        for tag, k, value in fields:
            out += struct.pack("<HHII", tag, k, len(text) if k == 2 else 1, value)
        out += struct.pack("<I", end if i + 1 < len(arrays) else 0) + a.astype(a.dtype.newbyteorder("<")).tobytes() + text
        out += b"\0" * (end - len(out))
    Path(path).write_bytes(bytes(out))
