"""WARC records in ZIP-packaged archives: written by tasks, read by range without extraction.

An archive is a ZIP file with stored members: ``archive/data.warc.gz`` (one gzip
member per record), ``indexes/index.cdxj`` (a line per record) and
``datapackage.json``.  The reader finds the members through the central
directory, ZIP64 fields included, and reads index and records by byte range.
Paths go through pyarrow's file systems: local, HDFS or object stores.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import written

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: A task starts another archive beyond this; the reader fetches records in ranges of about RANGE bytes.
ARCHIVE_BYTES, RANGE = 64 << 20, 1 << 20

# Fixed values of the ZIP format: signatures, and the values that refer to ZIP64 fields.
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
FULL16, FULL32, ZIP64_EXTRA = 0xFFFF, 0xFFFFFFFF, 0x0001


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


# ------------------------------------------------------------------ ZIP ----

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


class ZipDirectory:
    """Central directory of a ZIP file open for random access."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = min(size, 22 + FULL16)
        end = self._at(size - tail, tail)
        at = end.rfind(struct.pack("<I", END))
        while at >= 0 and at + 22 + struct.unpack_from("<H", end, at + 20)[0] != len(end):
            at = end.rfind(struct.pack("<I", END), 0, at)  # the signature inside a comment
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, start = struct.unpack_from("<HII", end, at + 10)
        where = size - tail + at
        if FULL16 == count or FULL32 in (length, start):
            mark, _, where64, _ = struct.unpack("<IIQI", self._at(where - 20, 20))
            if mark != LOCATOR64:
                raise ValueError("no ZIP64 locator")
            rec = self._at(where64, 56)
            if struct.unpack_from("<I", rec)[0] != END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", rec, 32)
        self.members = {m.name: m for m in self._entries(self._at(start, length), count)}

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        got = self.file.read(n)
        if len(got) != n:
            raise ValueError("archive is cut short")
        return got

    @staticmethod
    def _entries(raw: bytes, count: int) -> Iterator[Member]:
        at = 0
        for _ in range(count):
            mark, _, _, _, method, _, _, _, packed, size, n, extra, note, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
            if mark != CENTRAL:
                raise ValueError("bad central directory entry")
            name = raw[at + 46:at + 46 + n].decode("utf-8")
            x, last = at + 46 + n, at + 46 + n + extra
            while x + 4 <= last:
                kind, length = struct.unpack_from("<HH", raw, x)
                if kind == ZIP64_EXTRA:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", raw, x + 4))
                    size = wide.pop(0) if size == FULL32 else size
                    packed = wide.pop(0) if packed == FULL32 else packed
                    header = wide.pop(0) if header == FULL32 else header
                x += 4 + length
            yield Member(name, method, packed, header)
            at = last + note

    def start(self, name: str) -> int:
        """Offset of the bytes of a stored member."""
        m = self.members[name]
        if m.method != zipfile.ZIP_STORED:
            raise ValueError(f"{name} is not stored")
        mark, n, extra = struct.unpack("<I22xHH", self._at(m.header, 30))
        if mark != LOCAL:
            raise ValueError("bad local header")
        return m.header + 30 + n + extra

    def read(self, name: str, offset: int = 0, n: int | None = None) -> bytes:
        """A byte range of a stored member."""
        n = self.members[name].size - offset if n is None else n
        return self._at(self.start(name) + offset, n)


# ----------------------------------------------------------------- WARC ----

def digest_text(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to, serial: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:record:{serial}>",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
    block = rest[:int(warc["content-length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in head.decode("latin-1").split("\r\n")[1:])}
    return warc, http, payload


class ArchiveWriter:
    """One archive file; members are stored and written in one pass."""

    def __init__(self, path: str):
        system, place = opened(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.path, self.sink = path, system.open_output_stream(place)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index: list[str] = []
        self.bytes = 0

    def add(self, key: str, raw: bytes, facts: dict) -> None:
        packed = gzip.compress(raw, 4, mtime=0)
        self.data.write(packed)
        self.index.append(f"{key} {json.dumps(facts | {'offset': self.bytes, 'length': len(packed)}, sort_keys=True)}\n")
        self.bytes += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, "".join(self.index).encode())
        self.zip.writestr(PACKAGE, json.dumps({"profile": "data-package", "resources": [DATA, INDEX], "records": len(self.index)}))
        self.zip.close()
        self.sink.close()
        return self.path, len(self.index), self.bytes


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least_bytes: int = 0) -> DataFrame:
    """Write a WARC record per row into archives under ``folder``; returns the manifest (path, records, bytes).

    Of rows with equal payloads of ``least_bytes`` or more, that with the
    largest id is the response and the others are revisits of it.  A null
    payload is empty; a row without id can't be referred to unless all its
    equals have none (then all are responses).  Files carry the attempt in
    their name; only those of finished tasks are in the manifest, which is
    written as a table, so a lost executor never leads to a second set.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    facts = rows.where(F.octet_length("html") >= least_bytes).select("page_id", "sha1")
    last = facts.groupBy("sha1").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = facts.join(last, "sha1").where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "sha1", "refers_to").distinct()
    again = written(spark, again, "revisits").select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to")
    rows = rows.join(again, (F.col("sha1") == F.col("s")) & F.col("page_id").eqNullSafe(F.col("p")), "left")
    rows = rows.select("page_id", "url", "html", "sha1", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, writer, done, serial = f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}", None, [], 0
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(len(batch)):
                page_id, url, text, sha1, refers_to = (c[i].as_py() for c in cols)
                if writer is None:
                    writer = ArchiveWriter(f"{name}-{len(done):04d}.wacz")
                digest = digest_text(sha1)
                serial += 1
                raw = record_bytes(page_id, url, text.encode("utf-8"), digest, refers_to, f"{task.partitionId()}-{task.taskAttemptId()}-{serial}")
                writer.add(str(page_id), raw, {"digest": digest, "type": "response" if refers_to is None else "revisit"})
                if writer.bytes >= ARCHIVE_BYTES:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return written(spark, rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def archive_records(path: str) -> Iterator[tuple[dict, dict[str, str], dict[str, str], bytes]]:
    """(index entry, WARC header, HTTP header, payload) of an archive's records, by byte ranges."""
    system, place = opened(path)
    with system.open_input_file(place) as file:
        directory = ZipDirectory(file)
        start = directory.start(DATA)
        entries = [json.loads(x.partition(" ")[2]) for x in directory.read(INDEX).decode("utf-8").splitlines()]
        lo = 0
        while lo < len(entries):
            hi, first = lo + 1, entries[lo]["offset"]
            while hi < len(entries) and entries[hi]["offset"] + entries[hi]["length"] - first <= RANGE:
                hi += 1
            raw = directory._at(start + first, entries[hi - 1]["offset"] + entries[hi - 1]["length"] - first)
            for e in entries[lo:hi]:
                at = e["offset"] - first
                yield e, *parsed_record(zlib.decompress(raw[at:at + e["length"]], wbits=31))
            lo = hi


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``manifest(path)``: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (both of the full payload) and, with ``payloads``, payload.

    A response's digest is taken from its payload again and must be the stated one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * payloads

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for _, warc, http, payload in archive_records(path):
                    digest = warc["warc-payload-digest"].removeprefix("sha1:")
                    if warc["warc-type"] == "response" and digest_text(hashlib.sha1(payload).hexdigest()) != digest:
                        raise ValueError(f"payload of {warc['warc-record-id']} doesn't have its digest")
                    page, refers = warc.get("x-page-id"), warc.get("warc-refers-to")
                    rows.append((None if page is None else int(page), warc.get("warc-target-uri"), warc["warc-type"],
                                 None if refers is None else int(refers.strip("<>").rpartition(":")[2]),
                                 int(http["content-length"]), digest) + ((payload,) if payloads else ()))
                    held += len(payload) if payloads else 64
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    spread = manifest.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path")
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
                             + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back, without payloads."""
    spark = pages.sparkSession
    manifest = write_archives(pages, scratch_path(spark, "wacz"), least_bytes=least_bytes)
    return read_archives(spark, manifest, payloads=False)
