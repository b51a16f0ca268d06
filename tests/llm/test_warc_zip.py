import base64
import hashlib
import io
import struct
import zipfile
import zlib

import pytest
from casetriage.llm import warc_zip
from casetriage.llm.warc_zip import (DATA, INDEX, ArchiveWriter, ZipDirectory, archive_records, parsed_record, read_archives,
                                     record_bytes, round_trip, write_archives)


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def zip64_bytes(members, comment=b""):
    """A ZIP file whose sizes, offsets and counts stand in ZIP64 fields only."""
    out, central = b"", b""
    for name, data in members:
        at, name = len(out), name.encode()
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra)) + name + extra + data
        wide = struct.pack("<HHI", 0x5455, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0, 0, 0, 0, zlib.crc32(data), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(wide), 0, 0, 0, 0, 0xFFFFFFFF) + name + wide
    at = len(out)
    end64 = struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, len(members), len(members), len(central), at)
    out += central + end64 + struct.pack("<IIQI", 0x07064B50, 0, at + len(central), 1)
    return out + struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, len(comment)) + comment


def test_zip64_directory_and_ranges():
    raw = zip64_bytes([("archive/a", b"0123456789"), ("indexes/b", b"xyz")])
    d = ZipDirectory(Bytes(raw))
    assert d.read("archive/a", 3, 4) == b"3456" and d.read("indexes/b") == b"xyz"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:  # the fixture is a ZIP file for others too
        assert z.read("archive/a") == b"0123456789"


def test_plain_directory_comments_and_faults():
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w") as z:
        z.writestr("a", b"stored")
        z.writestr("b", b"deflated" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"with PK\x05\x06 inside and more than twenty-two bytes"
    d = ZipDirectory(Bytes(sink.getvalue()))
    assert d.read("a") == b"stored"
    with pytest.raises(ValueError, match="not stored"):
        d.read("b")
    with pytest.raises(ValueError):
        ZipDirectory(Bytes(sink.getvalue()[:30]))
    with pytest.raises(ValueError):
        ZipDirectory(Bytes(b""))


def test_archive_round_trip(tmp_path, monkeypatch):
    monkeypatch.setattr(warc_zip, "RANGE", 300)
    w = ArchiveWriter(f"{tmp_path}/x/one.wacz")
    payloads = [b"", b"\r\n\r\n WARC/1.1", bytes(range(256)) * 20, "ü".encode()]
    for i, p in enumerate(payloads):
        w.add(str(i), record_bytes(i, "http://a/ü\r\nX: y", p, digest(p), None if i else 9, str(i)), {"digest": digest(p)})
    w.close()
    got = list(archive_records(f"{tmp_path}/x/one.wacz"))
    assert [g[3] for g in got] == [b"", *payloads[1:]]
    assert [g[1]["warc-type"] for g in got] == ["revisit"] + ["response"] * 3
    assert got[1][1]["warc-target-uri"] == "http://a/%C3%BC%0D%0AX:%20y" and "x" not in got[1][1]
    assert got[2][2]["content-length"] == "5120"
    with zipfile.ZipFile(f"{tmp_path}/x/one.wacz") as z:
        assert {DATA, INDEX} < set(z.namelist()) and z.testzip() is None


def test_a_changed_payload_is_found(spark, tmp_path):
    w = ArchiveWriter(f"{tmp_path}/bad.wacz")
    w.add("1", record_bytes(1, None, b"payload", digest(b"other"), None, "1"), {})
    w.close()
    with pytest.raises(Exception, match="digest"):
        read_archives(spark, spark.createDataFrame([(f"{tmp_path}/bad.wacz",)], "path string")).collect()


ROWS = [(1, "http://a/1", "same"), (5, "http://a/5", "same"), (3, None, "same"), (2, "http://b", None), (4, "u", ""), (6, "ü?x", "ünï\x00"),
        (6, "ü?x", "ünï\x00"), (None, "http://n", "alone"), (None, "http://n", "same"), (7, "l", "long " * 300_000)]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as sha1", "1 as refers_to", "2 as path", "3 as n")


def test_pages_come_back(spark):
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in round_trip(pages(spark, ROWS)).collect()), key=str)
    want = []
    for i, _, html in ROWS:
        raw = (html or "").encode()
        last = max((x[0] for x in ROWS if (x[2] or "") == (html or "") and x[0] is not None), default=None)
        again = last is not None and i != last
        want.append((i or 0, len(raw), digest(raw), "revisit" if again else "response", last if again else None))
    assert got == sorted(want, key=str)


def test_payloads_and_least_bytes(spark, tmp_path):
    manifest = write_archives(pages(spark, ROWS).repartition(3), f"{tmp_path}/w", least_bytes=1)
    got = read_archives(spark, manifest).collect()
    assert sum(r.records for r in manifest.collect()) == len(ROWS) == len(got)
    assert sorted(bytes(r.payload) for r in got if r.record_type == "response") == sorted(
        [b"same", b"", b"", "ünï\x00".encode(), "ünï\x00".encode(), b"alone", b"long " * 300_000])


def test_empty_table(spark):
    assert round_trip(pages(spark, [])).collect() == []
