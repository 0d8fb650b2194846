"""Web archives: exact round trips, revisits against plain code, places in the files, selective reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from pathlib import Path

import pytest

from cellweave.functions.tables import written
from cellweave.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, _key string, file string"


@pytest.fixture(scope="module")
def rows():
    out = [(i, f"http://a.com/{i}", f"<p>page {i % 20}</p>" * (i % 9 + 1)) for i in range(120)]
    out += [(200 + i, "http://hot.com", "same text everywhere") for i in range(90)]
    out += [(300, None, None), (301, "http://e.com/", ""), (302, "http://x.com/a b\r\nWARC-Type: evil", "Ünïcode 漢字 \r\n\r\n WARC/1.1\r\n"), (303, "u", "long " * 400_000)]
    return [*out, (None, "http://n.com", "nobody"), (None, "http://n.com", "nobody"), (None, "http://n.com", "same text everywhere"), (303, "again", "long " * 400_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "k", "f") for r in rows], SCHEMA).repartition(3)


def plain(rows, least):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        of = last.get(html or "") if len(raw) >= least else None
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out.append((i, len(raw), digest, "response" if of is None or of == i else "revisit", None if of == i else of))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 30])
def test_round_trip(spark, rows, least):
    got = warc.round_trip(table(spark, rows), least)
    fields = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.select(*fields).collect()), key=str) == plain(rows, least)
    assert got.filter("intact and payload is null").count() == len(rows)
    assert warc.round_trip(table(spark, rows).limit(0)).collect() == []


def test_archives_are_whole_and_the_index_tells_places(spark, rows, tmp_path):
    index = warc.write_archives(warc.with_revisits(table(spark, rows)), str(tmp_path / "a"), archive_bytes=2000)
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 3
    told = index.collect()
    assert {r.file for r in told} == {f.name for f in files} and len(told) == len(rows)
    for f in files:  # records follow one another without a gap, behind a first one that tells of the file
        places = sorted((r.offset, r.length) for r in told if r.file == f.name)
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and sum(places[-1]) == f.stat().st_size
        text = gzip.decompress(f.read_bytes())
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")
    evil = next(r for r in told if r.page_id == 302)
    data = zlib.decompress((tmp_path / "a" / evil.file).read_bytes()[evil.offset : evil.offset + evil.length], 31)
    assert data.partition(b"\r\n\r\n")[0].count(b"WARC-Type") == 2 and b"\r\nWARC-Type: evil" not in data and evil.url == "http://x.com/a b\r\nWARC-Type: evil"


def test_reads_of_a_selection(spark, rows, tmp_path):
    folder = str(tmp_path / "b")
    index = warc.write_archives(warc.with_revisits(table(spark, rows)), folder)
    some = index.filter("page_id % 10 = 3 or page_id in (302, 303) and url <> 'again'")
    got = {r.page_id: r for r in warc.read_records(some, folder).collect()}
    html = {i: h for i, _, h in rows if i is not None}
    assert set(got) == {r.page_id for r in some.collect()} and all(r.intact for r in got.values())
    for i, r in got.items():
        assert (bytes(r.payload).decode() == html[i]) if r.record_type == "response" else r.payload is None
    twice = some.unionByName(some)
    assert warc.read_records(twice, folder).count() == some.count()
    assert warc.read_records(index.limit(0), folder).collect() == []


def test_ranges_join_near_records_only(spark):
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 25, 5), ("a", 100, 10), ("a", 1005, 10), ("b", 20, 5)]
    index = spark.createDataFrame(rows, "file string, offset long, length long")
    got = sorted((r.file, r.start, r.stop, [tuple(m) for m in r.members]) for r in warc.byte_ranges(index, gap=5, most=1000).collect())
    assert got == [("a", 0, 30, [(0, 10), (10, 10), (25, 5)]), ("a", 100, 110, [(100, 10)]), ("a", 1005, 1015, [(1005, 10)]), ("b", 20, 25, [(20, 5)])]
    assert len(warc.byte_ranges(index, gap=5000, most=1000).collect()) == 3


def test_a_changed_payload_is_told(spark, rows, tmp_path):
    folder = tmp_path / "c"
    index = written(warc.write_archives(warc.with_revisits(table(spark, rows[:3])), str(folder)), "index")
    r = index.filter("page_id = 1").first()
    path = Path(folder / r.file)
    raw = path.read_bytes()
    member = zlib.decompress(raw[r.offset : r.offset + r.length], 31).replace(b"<p>page 1</p>", b"<p>page X</p>", 1)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    changed = packer.compress(member) + packer.flush()
    path.write_bytes(raw[: r.offset] + changed)
    only = index.filter("page_id = 1").drop("length").selectExpr("*", f"CAST({len(changed)} AS BIGINT) length")
    assert [x.intact for x in warc.read_records(only, str(folder)).collect()] == [False]
