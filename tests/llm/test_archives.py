from __future__ import annotations

import base64
import glob
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import archives as A

PAGES = "page_id long, url string, html string, archive string, record int"


def made():
    draw = random.Random(4)
    rows = [(i, f"http://a.org/{i}", "<p>é" + "x" * draw.randrange(3000)) for i in range(60)]
    long = "<html>" + "WARC/1.1\r\n\r\nfiledesc://x 1 2 text/plain 5\n" * 40
    rows += [(100 + i, "http://b.org/a b\nc", long) for i in range(30)]
    rows += [(7, None, long), (129, "", long), (129, "http://c.org", long), (None, "http://n.org", long), (None, "http://n.org", long)]
    rows += [(200 + i, "http://s.org", "short") for i in range(5)] + [(300, "http://e.org", None), (301, "http://e.org", ""), (301, "http://e.org", "")]
    rows += [(400, "http://k.org", "y" * 999), (401, "http://k.org", "y" * 999), (402, "http://k.org", "y" * 1000), (403, "http://k.org", "y" * 1000), (404, "u", "z\x00\r\n\r\n" * 50_000)]
    rows += [(-5, "http://m.org", "negative " * 200), (-9, "http://m.org", "negative " * 200)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(parts)


def brute(rows):
    groups = {}
    for page_id, _, html in rows:
        if len((html or "").encode()) >= 1000:
            groups.setdefault(html, []).append(page_id)
    left = {html: max(ids, key=lambda i: (i is not None, i or 0)) for html, ids in groups.items()}
    first, out = dict(left), []
    for page_id, _, html in rows:
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and not (html in left and left[html] == page_id)
        if not revisit and html in left:
            del left[html]  # the others with this number revisit it
        out.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first[html] if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [A.ARCHIVE_BYTES, 5000])
def test_pages_come_back(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", limit)
    monkeypatch.setattr(A, "BATCH_BYTES", 3000)
    rows = made()
    got = A.archived(frame(spark, rows))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def parsed(data):
    """A plain reader of WARC records."""
    out = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        assert lines[0] == "WARC/1.1"
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        out.append((fields, rest[:n]))
        data = rest[n + 4 :]
    return out


def test_files_are_archives(spark, tmp_path):
    rows = made()
    arc, warc = str(tmp_path / "arc"), str(tmp_path / "warc")
    A.write_arc(frame(spark, rows, 2), arc, archive_bytes=20_000)
    assert len(glob.glob(f"{arc}/archive=*")) > 4
    for path in glob.glob(f"{arc}/archive=*/part-*"):
        data = gzip.decompress(open(path, "rb").read())
        name = os.path.basename(os.path.dirname(path)).removeprefix("archive=")
        assert data.startswith(f"filedesc://{name} ".encode())
        for r in A.arc_records(data):
            line = data[r.offset : data.index(b"\n", r.offset)]
            assert r.problem is None and data[r.offset + len(line) + 1 :].startswith(r.block)
            if r.version == 2 and not r.url.startswith(b"filedesc"):
                *_, checksum, _, offset, of_name, length = line.split()
                assert (int(offset), of_name.decode(), int(length)) == (r.offset, name, len(r.block)) and checksum.decode() == hashlib.md5(r.block).hexdigest()
    read = A.read_arc(spark, arc)
    assert {r.version for r in read.select("version").distinct().collect()} == {1, 2}
    assert read.where("problem is not null").count() == 0 and read.count() == len(rows)
    A.convert(spark, arc, warc)
    seen = {}
    for path in glob.glob(f"{warc}/archive=*/part-*"):
        records = parsed(gzip.decompress(open(path, "rb").read()))
        assert [f["WARC-Type"] for f, _ in records].count("warcinfo") == 1 and records[0][0]["WARC-Type"] == "warcinfo"
        for fields, block in records:
            assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert fields["WARC-Record-ID"].startswith("<urn:uuid:") and fields["WARC-Record-ID"] not in seen
            assert fields["WARC-Date"] == "2000-01-01T00:00:00Z"
            seen[fields["WARC-Record-ID"]] = fields, block
    for fields, block in seen.values():
        if fields["WARC-Type"] == "revisit":
            to, payload = seen[fields["WARC-Refers-To"]]
            assert to["WARC-Type"] == "response" and to["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            assert fields["WARC-Refers-To-Target-URI"] == to["WARC-Target-URI"] and block.endswith(b"\r\n\r\n") and len(block) < len(payload)
    back = A.read_warc(spark, warc)
    assert back.where("problem is not null").count() == 0
    texts = [bytes(r.block).split(b"\r\n\r\n", 1)[1].decode() for r in back.where("record_type = 'response'").collect()]
    assert sorted(texts) == sorted([h or "" for _, _, h in rows if len((h or "").encode()) < 1000] + list({h for _, _, h in rows if h and len(h.encode()) >= 1000}))


def old(version, *records, block=True):
    """An ARC file by hand."""
    out = A.version_block("old", version, "19961104142103") + b"\n" if block else b""
    for line, content in records:
        out += line + b"\n" + content + b"\n"
    return out


def test_lines_of_both_versions():
    http = b"HTTP/1.0 200 OK\nServer: x\n\nhello"
    one = old(1, (b"http://x.org/a b 1.2.3.4 19961104142103 text/html; charset=x %d" % len(http), http), (b"dns:x.org 1.2.3.4 199611041421 text/dns 4", b"abc\n"))
    two = old(2, (b"http://x.org/ 1.2.3.4 19970131000000 text/html 302 - http://y.org/ 200 file.arc 3", b"abc"))
    found = list(A.arc_records(one))[1:]
    assert [(r.url, r.date, r.content_type, r.payload) for r in found] == [
        (b"http://x.org/a b", b"19961104142103", b"text/html; charset=x", b"hello"), (b"dns:x.org", b"199611041421", b"text/dns", b"abc\n")
    ]
    assert b"WARC-Type: resource" in A.warc_record("old", found[1]) and b"WARC-Date: 1996-11-04T14:21:00Z" in A.warc_record("old", found[1])
    assert [(r.version, r.url, r.block) for r in A.arc_records(two)][1:] == [(2, b"http://x.org/", b"abc")]
    # a line of the other version is no record
    assert [r.problem for r in A.arc_records(old(2, (b"http://x.org/ 1.2.3.4 19970131000000 text/html 3", b"abc")))] == [None, "no record"]
    assert A.iso_time(b"19961399000000") == "1970-01-01T00:00:00Z"


def test_damage_is_told_and_passed_over():
    line = b"http://x.org/%d 1.2.3.4 19961104142103 text/html %d"
    data = old(1, (line % (1, 3), b"abc"), (b"garbage", b"more\n"), (line % (2, 2), b"abc"), (line % (3, 3), b"xyz"), (line % (4, 90), b"cut"))
    found = list(A.arc_records(data))
    assert [(r.url, r.problem) for r in found] == [
        (b"filedesc://old", None), (b"http://x.org/1", None), (b"", "no record"), (b"http://x.org/3", None), (b"", "no record")
    ]
    assert found[2].block.startswith(b"garbage") and found[2].block.endswith(b"abc\n") and found[4].block.startswith(b"http://x.org/4")
    assert [r.problem for r in A.arc_records(old(1, (line % (1, 3), b"abc"), block=False))] == ["no record"]
    assert list(A.arc_records(b"")) == [] and list(A.warc_records(b"")) == []
    good = A.warc_record("old", found[1])
    assert [p for *_, p in A.warc_records(good + b"\r\n\r\n" + good.replace(b"abc", b"abd") + b"\r\n\r\n")] == [None, "other block than declared"]
    assert [p for *_, p in A.warc_records(b"nothing")] == ["no record"]


def test_damaged_files_are_converted_as_far_as_they_can_be_read(spark, tmp_path):
    line = b"http://x.org/%d 1.2.3.4 19961104142103 text/html %d"
    os.makedirs(tmp_path / "in")
    (tmp_path / "in" / "a.arc").write_bytes(old(1, (line % (1, 3), b"abc"), (b"garbage", b"more"), (line % (3, 3), b"xyz")))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(old(1, (line % (5, 3), b"abc"))) + gzip.compress(line % (6, 2) + b"\nhi\n"))
    A.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert A.read_arc(spark, str(tmp_path / "in")).where("problem is not null").count() == 1
    got = A.read_warc(spark, str(tmp_path / "out")).where("record_type = 'resource'").select("archive", "url", F.col("block").cast("string")).collect()
    assert sorted(tuple(r) for r in got) == [("a.arc", "http://x.org/1", "abc"), ("a.arc", "http://x.org/3", "xyz"), ("b.arc.gz", "http://x.org/5", "abc"), ("b.arc.gz", "http://x.org/6", "hi")]


def test_empty(spark):
    assert A.archived(frame(spark, [])).count() == 0
