"""Web archives: records written with an index beside them, and read back from it by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from .common import written
from cellweave.functions.tables import shared_dir

RESPONSE, REVISIT = "response", "revisit"
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 128 << 20
#: Records of one archive with no more than GAP bytes between them are read at once, up to about RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20
INDEX = "record_id string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, offset long, length long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, intact boolean"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None) -> str:
    """A record's id: pages without one get a name of their own."""
    return f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"


def _shown(url: str) -> str:
    """An address that fits into a header line: control characters, spaces and what isn't ASCII percent-encoded."""
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode()


def _member(kind: str, record_id: str, date: str, block: bytes, more: list[tuple[str, str]]) -> bytes:
    """One record as a gzip member of its own."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *more, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str, str]:
    """A response, or a revisit of the page ``refers_to`` without the payload; its id and payload digest.

    Both hold the HTTP head of the payload, so that a revisit tells the payload's length too.
    """
    name, digest = _name(page_id), base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    more = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    more += [("WARC-Target-URI", _shown(url))] if url else []
    if refers_to is None:
        return _member(RESPONSE, name, date, http + payload, more), name, digest
    return _member(REVISIT, name, date, http, [*more, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", _name(refers_to))]), name, digest


def _headers(text: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:] if ": " in line)


def parsed(member: bytes) -> dict:
    """The fields of RECORDS from one gzip member. The digest of a response is that of its payload as read; ``intact`` tells if the header says the same."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _headers(head)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    told, length = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(_headers(http)["Content-Length"])
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    out = {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number("WARC-Refers-To")}
    if kind == REVISIT:
        return out | {"payload_bytes": length, "payload_digest": told, "payload": None, "intact": rest.endswith(b"\r\n\r\n")}
    digest = base32_sha1(payload)
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload, "intact": digest == told and len(payload) == length}


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to``: of pages with equal payloads of ``least_bytes`` or more, all but that with the largest id refer to it.

    A null html is an empty payload. Rows that repeat the largest id of their payload are responses all; null ids
    come before all others, and refer to nothing where there are no others. Payloads are told by SHA-256 and length.
    Only ids and digests are grouped; a payload travels with its digest where the table of repeated ones is too
    large to send to every task, and one that many pages share is then split over tasks.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("_key", F.concat(F.sha2("payload", 256), F.lit("-"), F.octet_length("payload").cast("string")))
    told = rows.filter(F.octet_length("payload") >= least_bytes)
    shared = written(told.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_last")).filter("_n > 1 and _last is not null").select("_key", "_last"), "shared")
    joined = rows.join(shared, "_key", "left")
    return joined.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("_last")), F.lit(None)).otherwise(F.col("_last")).alias("refers_to"))


def write_archives(rows: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``page_id, url, payload, refers_to`` as archives under ``folder`` and gives their index (INDEX), as a written table.

    Every task writes archives of its own, one gzip member to a record, and tells each record's place. A task that
    runs again writes under other names; the index names those of the run that counts, and the rest is not read.
    ``folder`` is a path or address that every executor reaches and pyarrow's file systems know.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, path = fs.FileSystem.from_uri(folder)
        there.create_dir(path, recursive=True)
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in INDEX.split(", ")]
        out, name, at = None, "", 0
        try:
            for batch in batches:
                told = []
                for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = there.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(info := _member("warcinfo", _name(None), date, b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")]))
                        at = len(info)
                    page_id, url, payload, refers_to = page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()
                    member, record_id, digest = record(page_id, url, payload, refers_to, date)
                    out.write(member)
                    told.append((record_id, page_id, url, RESPONSE if refers_to is None else REVISIT, digest, len(payload), refers_to, name, at, len(member)))
                    at += len(member)
                if told:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(put, INDEX), "warc-index")


def byte_ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """``file, start, stop, members``: the index's records in the order of their places, near ones in one range.

    A range ends before a gap of more than ``gap`` bytes and where the records of ``most`` bytes of the archive end;
    ``members`` has ``offset, length``. Archives are bounded in size, and so is what is sorted for each.
    """
    order = Window.partitionBy("file").orderBy("offset")
    ends = F.lag(F.col("offset") + F.col("length")).over(order)
    apart = ends.isNull() | (F.col("offset") - ends > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(order) / most))
    runs = index.select("file", "offset", "length").distinct().withColumn("_new", apart.cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    members = F.sort_array(F.collect_list(F.struct("offset", "length")))
    return runs.groupBy("file", "_run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), members.alias("members")).drop("_run")


def read_records(index: DataFrame, folder: str, payloads: bool = True, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """The records (RECORDS) that ``index`` names, from their archives under ``folder``.

    ``index`` may be any selection of rows of the index. Each range is one read; a record that is named more than
    once is read once. Without ``payloads`` they are checked and left out. An empty index gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there, path = fs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_()]
        names = [x.split()[0] for x in RECORDS.split(", ")]
        for batch in batches:
            for file, start, stop, members in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "stop", "members")), strict=True):
                with there.open_input_file(f"{path}/{file}") as source:
                    data = source.read_at(stop - start, start)
                found = [parsed(data[m["offset"] - start : m["offset"] - start + m["length"]]) for m in members]
                if not payloads:
                    found = [f | {"payload": None} for f in found]
                yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)], names=names)

    ranges = byte_ranges(index, gap, most)
    return ranges.repartition("file", "start").mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """``pages`` (``page_id, url, html``) written as archives and read back: RECORDS without payloads, one row for each page.

    Very long pages are one record each; an empty table writes nothing and gives no rows. Other columns of the table
    are not looked at. ``folder`` is a new one in the shared folder unless given.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_records(write_archives(with_revisits(pages, least_bytes), folder), folder, payloads=False)
