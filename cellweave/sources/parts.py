"""One file from many tasks: they write its pieces to the shared folder, and the pieces are then copied one behind another.

What the driver holds is a row for each piece and one buffer. A task that runs again writes another file; only those
of the runs that count are copied.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from cellweave.functions.tables import file_system, shared_dir

#: Bytes that are copied at once.
BUFFER = 8 << 20


@dataclass(frozen=True)
class Piece:
    """Bytes ``offset`` to ``offset + length`` of a file of the folder; ``key`` and ``n`` are the maker's."""

    key: int
    file: str
    offset: int
    length: int
    n: int


class Parts:
    """The pieces that ``made`` gives for the rows of a table, in the order of its partitions."""

    def __init__(self, rows: DataFrame, made: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bytes, int]]], compressed: bool = False):
        """``made`` gives ``key``, bytes and a number for each piece; with ``compressed`` each task's pieces are one gzip member."""
        self.folder = folder = f"{shared_dir(rows.sparkSession)}/parts-{uuid.uuid4().hex}"

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            there, path = file_system(folder)
            there.create_dir(path, recursive=True)
            name, told, at = uuid.uuid4().hex, [], 0
            with there.open_output_stream(f"{path}/{name}", compression=None) as out:
                packed = gzip.GzipFile(fileobj=out, mode="wb", mtime=0) if compressed else None
                for key, data, n in made(batches):
                    (packed or out).write(data)
                    told.append((key, name, at, len(data), n))
                    at += len(data)
                if packed:
                    packed.close()
                    told = [(t[0], name, 0, out.tell(), sum(x[4] for x in told)) for t in told[:1]]
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pylist([{"part": part, "key": k, "file": f, "at": a, "length": b, "n": n} for k, f, a, b, n in told], pa.schema([(x, pa.string() if x == "file" else pa.int64()) for x in ("part", "key", "file", "at", "length", "n")]))

        found = rows.mapInArrow(put, "part long, key long, file string, at long, length long, n long").collect()
        self.pieces = [Piece(r["key"], r["file"], r["at"], r["length"], r["n"]) for r in sorted(found, key=lambda r: (r["part"], r["at"]))]

    def join(self, path: str, content: Iterable[bytes | Piece | int]) -> None:
        """Writes bytes, pieces and numbers of noughts to ``path`` (or an address that pyarrow knows), and drops the pieces' files."""
        there, folder = file_system(self.folder)
        target, name = file_system(path)
        with target.open_output_stream(name, compression=None) as out:
            for x in content:
                if isinstance(x, bytes):
                    out.write(x)
                    continue
                left, source = (x, None) if isinstance(x, int) else (x.length, there.open_input_file(f"{folder}/{x.file}"))
                if source:
                    source.seek(x.offset)
                while left:
                    data = source.read(min(left, BUFFER)) if source else bytes(min(left, BUFFER))
                    out.write(data)
                    left -= len(data)
                if source:
                    source.close()
        if there.get_file_info(folder).type != fs.FileType.NotFound:
            there.delete_dir(folder)
