"""WARC records in ZIP packages: a writer with revisit records and a reader that never unpacks.

A package is a ZIP file whose members are stored, not deflated:
``archive/data.warc.gz`` (one gzip member for each record) and ``indexes/index.cdxj``
(offset and length of every record). The reader finds the central directory through
the end record, or its ZIP64 form, then reads byte ranges: the directory, the index,
the records.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from almanac.llm.common import materialize, new_path, utf8

#: A package is closed once its archive member is this long.
PACKAGE_BYTES = 64 << 20
#: Records closer than this are fetched by one range read.
RANGE_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{payload_digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit of page ``refers_to`` whose payload is left out."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, name),
        "WARC-Date": "2026-01-01T00:00:00Z",
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{name}",
        "X-Page-Id": "" if page_id is None else str(page_id),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, name), "X-Refers-To-Page-Id": str(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + utf8(lines) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields, HTTP header and payload of one record."""
    top, _, rest = record.partition(b"\r\n\r\n")
    lines = top.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = {k.decode().lower(): v.strip().decode("utf-8", "surrogatepass") for k, _, v in (x.partition(b":") for x in lines[1:])}
    block = rest[: int(head["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return head, http, payload


class PackageWriter:
    """Writes one package to an output stream; the archive member is held in memory up to PACKAGE_BYTES."""

    def __init__(self, zip64: bool = False) -> None:
        self.body, self.index, self.zip64 = io.BytesIO(), [], zip64

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = packer.compress(make_record(page_id, url, payload, refers_to)) + packer.flush()
        self.index.append(f"{json.dumps(url or '')} {json.dumps({'offset': self.body.tell(), 'length': len(data)})}\n")
        self.body.write(data)

    def close(self, out: io.RawIOBase) -> None:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, data in ((ARCHIVE, self.body.getbuffer()), (INDEX, "".join(self.index).encode("utf-8", "surrogatepass"))):
                with z.open(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), "w", force_zip64=self.zip64) as member:
                    member.write(data)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def read_directory(read_at: Callable[[int, int], bytes], size: int) -> dict[str, Member]:
    """Members of a ZIP file, by range reads of its tail and its central directory; ZIP64 fields are followed where they are marked."""
    tail_at = max(0, size - 65_557)
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(_EOCD)
    while at >= 0 and len(tail) - at >= 22 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(_EOCD, 0, at)
    if at < 0 or len(tail) - at < 22:
        raise ValueError("no end of a central directory: not a ZIP file, or cut short")
    entries, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        (at64,) = struct.unpack_from("<Q", tail, at - 12)
        end64 = read_at(at64, 56)
        if end64[:4] != _EOCD64:
            raise ValueError("the ZIP64 locator points nowhere")
        entries, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, p, found = read_at(start, length), 0, {}
    for _ in range(entries):
        if directory[p : p + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        (method,) = struct.unpack_from("<H", directory, p + 10)
        stored, plain = struct.unpack_from("<II", directory, p + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, p + 28)
        (header_at,) = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra, q = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                stored = next(wide) if stored == 0xFFFFFFFF else stored
                header_at = next(wide) if header_at == 0xFFFFFFFF else header_at
            q += 4 + n
        found[name] = Member(name, method, stored, header_at)
        p += 46 + n_name + n_extra + n_note
    return found


def data_start(read_at: Callable[[int, int], bytes], member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed in the package; only stored members can be read by range")
    head = read_at(member.header_at, 30)
    if head[:4] != _LOCAL:
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header_at + 30 + n_name + n_extra


def read_records(read_at: Callable[[int, int], bytes], size: int) -> Iterator[bytes]:
    """Every record that the package's index names; neighbours share a range read."""
    members = read_directory(read_at, size)
    index_at, archive_at = data_start(read_at, members[INDEX]), data_start(read_at, members[ARCHIVE])
    places = []
    for line in read_at(index_at, members[INDEX].size).split(b"\n"):
        if line:
            x = json.loads(line[line.rindex(b"{") :])
            places.append((x["offset"], x["length"]))
    places.sort()
    i = 0
    while i < len(places):
        first = j = i
        while j + 1 < len(places) and places[j + 1][0] + places[j + 1][1] - places[first][0] <= RANGE_BYTES:
            j += 1
        begin, end = places[first][0], places[j][0] + places[j][1]
        chunk = memoryview(read_at(archive_at + begin, end - begin))
        for offset, length in places[first : j + 1]:
            yield zlib.decompress(chunk[offset - begin : offset - begin + length], 31)
        i = j + 1


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write ``page_id, url, html, refers_to`` as packages under ``folder``; returns the manifest (``path``, ``records``).

    The manifest is written before it is returned, so packages of tasks that failed or
    ran twice are never read.
    """

    def write(batches):
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, made, now = TaskContext.get().partitionId(), [], PackageWriter()

        def close(writer: PackageWriter) -> None:
            path = f"{root}/part-{part:05d}-{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(path) as out:
                writer.close(out)
            made.append((path, len(writer.index)))

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                now.add(page_id, url, utf8(html), refers_to)
                if now.body.tell() >= package_bytes:
                    close(now)
                    now = PackageWriter()
        if now.index:
            close(now)
        yield pa.RecordBatch.from_pydict({"path": pa.array([x[0] for x in made], pa.string()), "records": pa.array([x[1] for x in made], pa.int64())})

    return materialize(pages.select("page_id", "url", "html", "refers_to").mapInArrow(write, "path string, records long"), "warc-manifest")


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's packages: ``page_id, url, record_type, refers_to, payload_bytes, payload_digest, digest_ok, payload``."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def read(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with fs.open_input_file(path) as f:
                    rows, weight = [], 0
                    for record in read_records(lambda at, n: f.read_at(n, at), f.size()):
                        head, http, payload = parse_record(record)
                        page, refers, kind = head["x-page-id"], head.get("x-refers-to-page-id"), head["warc-type"]
                        name = head["warc-payload-digest"].removeprefix("sha1:")
                        full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        rows.append((int(page) if page else None, head["warc-target-uri"], kind, int(refers) if refers else None, full, name, kind == "revisit" or digest(payload) == name and len(payload) == full, payload if kind == "response" else None))
                        weight += len(payload) + 300
                        if weight > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, weight = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return manifest.select("path").mapInArrow(read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean, payload binary")


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record for each page, read the packages back; returns the rows of ``read_packages``.

    Of pages with equal payloads of ``min_revisit_bytes`` or more, the one with the
    smallest page_id becomes a response and the others revisit it; shorter payloads are
    all responses. A null html has an empty payload; a null url reads back as ''. Rows that repeat the smallest
    page_id with the same payload are responses too; a page without id never is referred
    to, unless no page of its payload has one: then all are responses. An empty table gives no rows;
    other columns are not read.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    small = keyed.filter(F.octet_length(body) >= min_revisit_bytes).select("page_id", F.sha2(body, 256).alias("key"))
    firsts = small.groupBy("key").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "first")
    again = small.join(firsts, "key").filter("first is not null and (page_id is null or page_id <> first)").select("page_id", "key", F.col("first").alias("refers_to")).distinct()
    # Ids are matched together with the payload's key, as an id may repeat with another payload.
    joined = keyed.withColumn("key", F.sha2(body, 256)).alias("p").join(again.alias("a"), F.col("p.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("p.key") == F.col("a.key")), "left")
    folder = new_path(pages.sparkSession, "warc")
    manifest = write_packages(joined.select("p.page_id", "p.url", "p.html", "a.refers_to"), folder)
    return read_packages(manifest.repartition(max(1, min(10_000, manifest.count()))), folder)
