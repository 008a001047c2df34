"""Web records in ZIP-packaged archives: written by tasks, read back by range.

An archive is a ZIP file whose members are stored, not deflated: archive/data.warc.gz, in which each record
is a gzip member of its own, and indexes/index.cdxj, one line a record with its place. A reader takes the
end of the file, follows the (ZIP64) central directory to the members, reads the index, and then reads the
byte range of each record; nothing is unpacked to disk.
"""

from __future__ import annotations

import base64
import binascii
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, settle

DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
_BIG = 0xFFFFFFFF


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, is_revisit: bool) -> bytes:
    """A WARC/1.1 response or revisit record, uncompressed. A revisit has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        head += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers (lower-case names) and the HTTP payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields | {"payload": payload, "payload_bytes": size}


class ZipWriter:
    """Writes stored members one after another to a stream that can't seek, sizes in data descriptors; with
    zip64 records where a size or place needs them, or always if `always64`."""

    def __init__(self, out: BinaryIO, always64: bool = False) -> None:
        self.out, self.at, self.members, self.always64 = out, 0, [], always64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        self.name, self.start, self.crc, self.size = name.encode(), self.at, 0, 0
        self._write(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, _BIG, _BIG, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)
        self._write(data)

    def end(self) -> None:
        self._write(struct.pack("<IIQQ", 0x08074B50, self.crc, self.size, self.size))
        self.members.append((self.name, self.crc, self.size, self.start))

    def close(self) -> None:
        begin = self.at
        for name, crc, size, start in self.members:
            big = self.always64 or size >= _BIG or start >= _BIG
            extra = struct.pack("<HHQQQ", 1, 24, size, size, start) if big else b""
            low = (_BIG, _BIG, _BIG) if big else (size, size, start)
            self._write(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, crc, low[0], low[1], len(name), len(extra), 0, 0, 0, 0, low[2]) + name + extra)
        size, n = self.at - begin, len(self.members)
        big = self.always64 or begin >= _BIG or size >= _BIG or n >= 0xFFFF
        if big:
            at = self.at
            self._write(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, begin) + struct.pack("<IIQI", 0x07064B50, 0, at, 1))
        self._write(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 0xFFFF if big else n, 0xFFFF if big else n, _BIG if big else size, _BIG if big else begin, 0))


def directory(f: BinaryIO, size: int) -> dict[str, tuple[int, int]]:
    """{member: (first byte of its data, its length)} of the stored members of a ZIP file, from its central
    directory; ZIP64 records are followed where a field says so. Members that are deflated are left out."""
    back = min(size, 22 + 65535 + 20)
    f.seek(size - back)
    tail = f.read(back)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, begin = struct.unpack_from("<HII", tail, at + 10)
    if 0xFFFF == n or _BIG in (length, begin):
        place = struct.unpack_from("<IIQI", tail, at - 20) if at >= 20 else (0, 0, 0, 0)
        if place[0] == 0x07064B50:
            f.seek(place[2])
            n, length, begin = struct.unpack_from("<QQQ", f.read(56), 32)
    f.seek(begin)
    table, out, p = f.read(length), {}, 0
    for _ in range(n):
        if table[p : p + 4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        method, packed, plain = struct.unpack_from("<H", table, p + 10)[0], *struct.unpack_from("<II", table, p + 20)
        k, x, c, start = *struct.unpack_from("<HHH", table, p + 28), struct.unpack_from("<I", table, p + 42)[0]
        name, extra = table[p + 46 : p + 46 + k].decode("utf-8", "replace"), table[p + 46 + k : p + 46 + k + x]
        e = 0
        while e + 4 <= len(extra):
            kind, many = struct.unpack_from("<HH", extra, e)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{many // 8}Q", extra, e + 4))
                plain = next(wide) if plain == _BIG else plain
                packed = next(wide) if packed == _BIG else packed
                start = next(wide) if start == _BIG else start
            e += 4 + many
        if method == 0:
            f.seek(start)
            local = f.read(30)
            out[name] = (start + 30 + sum(struct.unpack_from("<HH", local, 26)), packed)
        p += 46 + k + x + c
    return out


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, sha1, refers_to): what each row is to be written as. refers_to is the smallest
    page_id of equal payloads, null where that is the row itself or the payload has under least_bytes.

    What refers to what is found from ids and digests alone; payloads then meet it by their own id and digest, so
    that no task gets all copies of a common payload. Null html is empty. A null page_id comes last: it is a
    response only if no row of its payload has an id. An empty table gives no rows.
    """
    html = F.coalesce(payload if payload is not None else F.col("html"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"))
    firsts = rows.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"))
    each = rows.select("page_id", "sha1").distinct().join(firsts, "sha1").where(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull())
    refers = each.select(F.struct("page_id", "sha1").alias("key"), F.col("first").alias("refers_to"))
    return rows.withColumn("key", F.struct("page_id", "sha1")).join(refers, "key", "left").select("page_id", "url", "html", "sha1", "refers_to")


def write_archives(rows: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes what planned() gives to archives in `folder`, one for a partition, in one pass and bounded
    memory; returns (path, bytes, records), a row for each archive. The folder can be any that pyarrow's file
    systems reach. A task that is run again writes another file, and only that of its last run is returned.
    A task holds one record at a time, so its memory is that of the longest payload. No rows: no archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for page_id, url, html, sha1, refers_to in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if out is None:
                    task = TaskContext.get()
                    path = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.wacz"
                    fs, inner = _file_system(path)
                    fs.create_dir(inner.rpartition("/")[0])
                    out = fs.open_output_stream(inner, buffer_size=1 << 20)
                    z, lines = ZipWriter(out), []
                    z.begin(DATA)
                payload = html.encode("utf-8", "surrogatepass")
                digest = base64.b32encode(binascii.unhexlify(sha1)).decode()
                packer = zlib.compressobj(level, wbits=31)
                raw = packer.compress(record(page_id, url, payload, digest, len(payload), refers_to, refers_to is not None)) + packer.flush()
                lines.append(json.dumps({"url": url, "digest": f"sha1:{digest}", "offset": z.size, "length": len(raw)}))
                z.write(raw)
        if out is None:
            return
        z.end()
        z.begin(INDEX)
        z.write("\n".join(lines).encode("utf-8", "surrogatepass"))
        z.end()
        z.begin(PACKAGE)
        z.write(json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())
        z.end()
        z.close()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([z.at]), pa.array([len(lines)])], ["path", "bytes", "records"])

    return settle(rows.select("page_id", "url", "html", "sha1", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "archives")


def read_archives(archives: DataFrame, path_col: str = "path", run_records: int = 512) -> DataFrame:
    """The records of the archives whose paths are given: page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload (empty for a revisit), archive. Ranges of records, run_records each, are dealt out
    to tasks, so that a large archive is read by many: to as many as the session has slots, and to more where
    each would get over eight ranges. No archives: no rows. Payloads of any length are read whole, one at a time."""

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inner = _file_system(path)
                with fs.open_input_file(inner) as f:
                    members = directory(f, f.size())
                    data, (begin, length) = members[DATA][0], members[INDEX]
                    f.seek(begin)
                    places = [(data + x["offset"], x["length"]) for x in map(json.loads, f.read(length).decode("utf-8", "surrogatepass").splitlines())]
                for k in range(0, len(places), run_records):
                    part = places[k : k + run_records]
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([[p[0] for p in part]], pa.list_(pa.int64())), pa.array([[p[1] for p in part]], pa.list_(pa.int64()))], ["path", "offsets", "lengths"])

    def page(urn: str | None) -> int | None:
        number = (urn or "").rpartition(":")[2].rstrip(">")
        return int(number) if number else None

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offsets, lengths in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, inner = _file_system(path)
                rows, size = [], 0
                with fs.open_input_file(inner) as f:
                    for i, (at, length) in enumerate(zip(offsets, lengths, strict=True)):
                        f.seek(at)
                        r = parse_record(zlib.decompress(f.read(length), wbits=31))
                        rows.append((page(r["warc-record-id"]), r.get("warc-target-uri"), r["warc-type"], page(r.get("warc-refers-to")), r["payload_bytes"], r["warc-payload-digest"].removeprefix("sha1:"), r["payload"], path))
                        size += len(r["payload"])
                        if size > 4 << 20 or i == len(offsets) - 1:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "archive"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
    ranges = settle(archives.select(path_col).mapInArrow(located, "path string, offsets array<long>, lengths array<long>"), "ranges")
    many = ranges.count()
    tasks = max(1, min(many, max(archives.sparkSession.sparkContext.defaultParallelism, -(-many // 8))))
    spread = ranges.repartition(tasks, F.xxhash64("path", F.get("offsets", F.lit(0))))
    return spread.mapInArrow(fetched, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, archive string")


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Writes every row of pages (page_id, url, html) to archives and reads their records back.

    Null html: an empty payload. Of rows with equal payloads of least_bytes bytes or more the one with the
    smallest page_id is a response, the others are revisits that refer to it; rows that repeat that page_id
    are responses too, and with a null page_id a row is a revisit if its payload has an id, else a response.
    A null url has no target line. An empty table writes no archive and gives no rows.
    """
    return read_archives(write_archives(planned(pages, least_bytes=least_bytes), folder or new_path(pages.sparkSession, "wacz")))
