"""WARC records inside ZIP packages, read in place.

Writing: every task streams its records, each its own gzip member, into a
stored archive member of a ZIP package, followed by a stored CDXJ index.
Packages get names of their own per attempt, and only those that the manifest
lists are read, so a lost executor's half-written package is never seen.

Reading: the end-of-central-directory record (and its ZIP64 form) leads to the
central directory, a member's local header to its data; then the index gives
record ranges, which are read without unpacking anything else.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.arrow import bound_batches
from loomwork.scratch import Scratch

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no time
REVISIT_FROM = 100  # bytes; smaller equal payloads are all responses


@dataclass
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def open_fs(uri: str):
    return pafs.FileSystem.from_uri(uri)


def read_at(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    out = f.read(n)
    if len(out) != n:
        raise ValueError("truncated archive")
    return out


def directory(f, size: int) -> dict[str, Member]:
    """The members of a ZIP file of ``size`` bytes, by name; ZIP64 included."""
    tail_at = max(0, size - 65557 - 20)
    tail = read_at(f, tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, count, length, start = struct.unpack("<HHHHII", tail[at + 4 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end64 = read_at(f, where, 56)
        if end64[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    raw, p, out = read_at(f, start, length), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        flags, method = struct.unpack("<HH", raw[p + 8 : p + 12])
        crc, packed, plain, n, m, k = struct.unpack("<IIIHHH", raw[p + 16 : p + 34])
        (header,) = struct.unpack("<I", raw[p + 42 : p + 46])
        name = raw[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, end = p + 46 + n, p + 46 + n + m
        while q + 4 <= end:
            tag, width = struct.unpack("<HH", raw[q : q + 4])
            if tag == 1:
                wide = list(struct.unpack(f"<{width // 8}Q", raw[q + 4 : q + 4 + width // 8 * 8]))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            q += 4 + width
        out[name] = Member(name, method, crc, packed, plain, header)
        p = end + k
    return out


def data_start(f, member: Member) -> int:
    """Offset of a stored member's first byte."""
    if member.method:
        raise ValueError(f"{member.name} is compressed as a whole; only stored members can be read by range")
    head = read_at(f, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("bad local header")
    n, m = struct.unpack("<HH", head[26:30])
    return member.header + 30 + n + m


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record: a response, or a revisit of another page's equal payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = head if refers_to is not None else head + payload
    clean = "".join(c if " " < c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    if len(rest) < n:
        raise ValueError("truncated record")
    return fields, rest[:n].partition(b"\r\n\r\n")[2]


class Package:
    """Writer of one ZIP package; ``zip64`` forces 64-bit sizes for tests."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.uri = uri
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.stream = self.fs.open_output_stream(self.path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id, url, payload: bytes, digest: str, refers_to) -> None:
        raw = gzip.compress(record(page_id, url, payload, digest, refers_to), 6, mtime=0)
        self.member.write(raw)
        self.lines.append(json.dumps({"id": page_id, "offset": self.at, "length": len(raw)}))
        self.at += len(raw)

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        self.zip.writestr(INDEX, "".join(x + "\n" for x in self.lines))
        self.zip.close()
        self.stream.close()
        return self.uri, len(self.lines), self.at


def write(records: DataFrame, folder: str, roll_records: int = 20_000, roll_bytes: int = 512 << 20) -> DataFrame:
    """Manifest (path, records, bytes) of the packages written.

    ``records``: id long, url string, payload binary, digest string, refers_to
    long.  Materialise the manifest before reading: evaluating it writes.
    """
    bound_batches(records.sparkSession)
    src = records.select("id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.zip")
                package.add(*r)
                if len(package.lines) >= roll_records or package.at >= roll_bytes:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["path", "records", "bytes"])

    return src.mapInArrow(run, "path string, records long, bytes long")


def read_index(manifest: DataFrame) -> DataFrame:
    """(path, offset, length) of every record: offsets within the package file."""

    def run(batches):
        for b in batches:
            for uri in b.column("path").to_pylist():
                fs, path = open_fs(uri)
                with fs.open_input_file(path) as f:
                    members = directory(f, f.size())
                    start = data_start(f, members[ARCHIVE])
                    m = members[INDEX]
                    raw = read_at(f, data_start(f, m), m.size)
                if zlib.crc32(raw) != m.crc:
                    raise ValueError(f"damaged index in {uri}")
                rows = [json.loads(x) for x in raw.splitlines()]
                cols = [[uri] * len(rows), [start + r["offset"] for r in rows], [r["length"] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["path", "offset", "length"])

    return manifest.select("path").mapInArrow(run, "path string, offset long, length long")


def read_records(index: DataFrame, gap: int = 8 << 20) -> DataFrame:
    """The records at the index's ranges; neighbouring ranges share a read of at most ``gap`` bytes.

    (id, url, record_type, refers_to, payload_bytes, digest, payload).  A
    response's length and digest are taken from the payload as read and
    checked against its header; a revisit's come from its header.
    """
    bound_batches(index.sparkSession)

    def runs(rows):
        group = []
        for r in rows:
            if group and (r[0] != group[0][0] or r[1] != group[-1][1] + group[-1][2] or r[1] + r[2] - group[0][1] > gap):
                yield group
                group = []
            group.append(r)
        if group:
            yield group

    def run(batches):
        for b in batches:
            for group in runs(list(zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length"))))):
                fs, path = open_fs(group[0][0])
                with fs.open_input_file(path) as f:
                    raw = read_at(f, group[0][1], group[-1][1] + group[-1][2] - group[0][1])
                out = []
                for _, offset, length in group:
                    at = offset - group[0][1]
                    h, payload = parse(gzip.decompress(raw[at : at + length]))
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                    number = lambda s: int(s[len("<urn:page:") : -1]) if s and s != "<urn:page:>" else None
                    kind = h["WARC-Type"]
                    if kind == "response":
                        own = hashlib.sha256(payload).hexdigest()
                        if (own, len(payload)) != (digest, size):
                            raise ValueError(f"record at {offset} of {group[0][0]} does not match its digest")
                    out.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind, number(h.get("WARC-Refers-To", "")), size, digest, payload if kind == "response" else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["id", "url", "record_type", "refers_to", "payload_bytes", "digest", "payload"])

    return index.mapInArrow(run, "id long, url string, record_type string, refers_to long, payload_bytes long, digest string, payload binary")


def plan_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records to write: equal payloads of at least REVISIT_FROM bytes refer to the smallest id.

    Null html is an empty payload, a null url an empty one.  Rows that share
    the smallest id, and rows with a null id, are responses.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    narrow = own.where(F.octet_length("payload") >= REVISIT_FROM).select("id", "digest")
    # payloads stay out of the grouping; a hot payload is one pre-aggregated row
    first = narrow.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = narrow.join(first, "digest").where("id > first").select("id", "digest", F.col("first").alias("refers_to")).distinct()
    return own.join(later, ["id", "digest"], "left")


def round_trip(pages: DataFrame, folder: str, scratch: Scratch, **columns) -> DataFrame:
    """Write ``pages`` as WARC packages under ``folder`` and read them back."""
    spark = pages.sparkSession
    manifest = scratch.save(write(plan_revisits(pages, **columns), folder), "manifest")
    total = manifest.agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(2 * spark.sparkContext.defaultParallelism, (total["b"] or 0) // (64 << 20) + 1)
    index = read_index(manifest.repartition(min(tasks, max(1, total["n"])), "path"))
    block = F.floor(F.col("offset") / (8 << 20))
    return read_records(index.repartition(tasks, "path", block).sortWithinPartitions("path", "offset"))


def op5_warc_zip(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    out = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("packages"), scratch)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP5_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {REVISIT_FROM} GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
