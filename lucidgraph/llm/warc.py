"""WARC records in ZIP packages: written per partition, read back by ranges.

A package is a ZIP file with a stored member ``archive/data.warc.gz`` (a gzip
member a record) and a stored index ``indexes/index.cdxj``.  The reader never
extracts: it reads the end of the file, the central directory (ZIP64 where the
32-bit fields are full), finds the stored members, reads the index and then only
the bytes of each record.

Of records with equal payloads the one with the smallest page_id is a response,
the others are revisits that refer to it; below ``min_bytes`` all are responses.
A null html is an empty payload.  Rows with a null page_id are responses; rows
that repeat the smallest page_id with the same payload are responses too.
Control characters of a url are percent-encoded; a null url has no header.
Extra columns are ignored.  No rows: no package, and no records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed once its records take so many bytes.
PACKAGE_BYTES = 256 << 20
#: Neighbouring records within so many bytes are read by one task.
READ_BYTES = 4 << 20
#: Packed bytes that a task reads, on average; a task for each package at least.
TASK_BYTES = 16 << 20
# Fixed values of the WARC and ZIP formats.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_LOCAL, _DESCRIPTOR = 0x04034B50, 0x08074B50
_CENTRAL, _END, _END64, _LOCATOR = 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; Spark writes ``file:/x`` for ``file:///x``."""
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


# --- records -----------------------------------------------------------------


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One WARC record; ``refers_to`` is None for a response."""
    name = "null" if page_id is None else page_id
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def parse_record(data: bytes) -> dict:
    """The fields of one record; the payload of a response is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    response = fields["warc-type"] == "response"
    name = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(_fields(http)["content-length"])
    if response and (len(payload) != size or digest(payload) != name):
        raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": name,
        "record_type": fields["warc-type"],
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload": payload if response else None,
    }


# --- ZIP packages ------------------------------------------------------------


class Package:
    """A ZIP file of stored members, written front to back."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.members = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def member(self, name: str, chunks) -> None:
        """Sizes are not known before, so they follow the data in a descriptor."""
        raw, start, crc, size = name.encode(), self.at, 0, 0
        head = struct.pack("<IHHHHHIIIHH", _LOCAL, 45, 8, 0, 0, 0x21, 0, 0, 0, len(raw), 0)
        self._put(head + raw)
        for chunk in chunks:
            crc, size = zlib.crc32(chunk, crc), size + len(chunk)
            self._put(chunk)
        wide = "Q" if self.zip64 or size >= _FULL32 else "I"
        self._put(struct.pack(f"<II{wide}{wide}", _DESCRIPTOR, crc, size, size))
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        start = self.at
        for raw, crc, size, offset in self.members:
            wide = self.zip64 or size >= _FULL32 or offset >= _FULL32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, offset) if wide else b""
            small, place = (_FULL32, _FULL32) if wide else (size, offset)
            head = struct.pack(
                "<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45, 8, 0, 0, 0x21, crc, small, small,
                len(raw), len(extra), 0, 0, 0, 0, place,
            )
            self._put(head + raw + extra)
        size, n = self.at - start, len(self.members)
        if wide := self.zip64 or start >= _FULL32 or n >= _FULL16:
            end = self.at
            self._put(struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", _LOCATOR, 0, end, 1))
        n16, s32, o32 = (_FULL16, _FULL32, _FULL32) if wide else (n, size, start)
        self._put(struct.pack("<IHHHHIIH", _END, 0, 0, n16, n16, s32, o32, 0))


def directory(source) -> dict[str, tuple[int, int]]:
    """(first byte, size) of each stored member of an open ZIP file."""
    total = source.size()
    tail_at = max(0, total - 22 - _FULL16)
    tail = source.read_at(total - tail_at, tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(struct.pack("<I", _END), 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    _, _, _, _, n, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if _FULL16 == n or _FULL32 in (size, start):
        locator = source.read_at(20, tail_at + at - 20)
        mark, _, end64, _ = struct.unpack("<IIQI", locator)
        if mark != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        fields = struct.unpack("<IQHHIIQQQQ", source.read_at(56, end64))
        if fields[0] != _END64:
            raise ValueError("no ZIP64 end of the central directory")
        n, size, start = fields[7], fields[8], fields[9]
    found, at, listed = {}, 0, source.read_at(size, start)
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, plain, names, extras, comments, _, _, _, local = (
            struct.unpack_from("<IHHHHHHIIIHHHHHII", listed, at)
        )
        if mark != _CENTRAL:
            raise ValueError("broken central directory")
        name = listed[at + 46 : at + 46 + names].decode()
        extra = listed[at + 46 + names : at + 46 + names + extras]
        while len(extra) >= 4:
            kind, length = struct.unpack_from("<HH", extra)
            if kind == 1:  # only the fields that are full are there, in this order
                wide = [x for (x,) in struct.iter_unpack("<Q", extra[4 : 4 + length // 8 * 8])]
                plain = wide.pop(0) if plain == _FULL32 else plain
                packed = wide.pop(0) if packed == _FULL32 else packed
                local = wide.pop(0) if local == _FULL32 else local
            extra = extra[4 + length :]
        if method == 0:
            head = struct.unpack("<IHHHHHIIIHH", source.read_at(30, local))
            if head[0] != _LOCAL:
                raise ValueError("broken local header")
            found[name] = (local + 30 + head[9] + head[10], packed)
        at += 46 + names + extras + comments
    return found


# --- Spark -------------------------------------------------------------------


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the rows that repeat a payload of a smaller page_id."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("bytes"),
    ).where(F.col("page_id").isNotNull() & (F.col("bytes") >= min_bytes))
    ids = rows.select("page_id", "digest").distinct()
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    repeated = first.where(F.col("n") > 1).drop("n")
    return ids.join(repeated, "digest").where(F.col("page_id") != F.col("refers_to"))


def write_packages(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 0,
    package_bytes: int = PACKAGE_BYTES,
    zip64: bool = False,
) -> DataFrame:
    """Writes all pages and returns (path, records) of the packages.

    A task writes under a name of its own and renames when it is whole; only
    files of tasks that ended well are listed, so a retried task does no harm.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    rows = rows.join(revisits(pages, min_bytes), ["page_id", "digest"], "left").drop("digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = _rows(batches)
        following = next(source, None)
        while following is not None:
            files, base = open_fs(folder)
            files.create_dir(base, recursive=True)
            name = uuid.uuid4().hex
            index: list[dict] = []

            def members():
                nonlocal following
                at = 0
                while following is not None and at < package_bytes:
                    page_id, url, payload, refers_to = following
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = packer.compress(record(page_id, url, payload, refers_to)) + packer.flush()
                    index.append({"id": page_id, "offset": at, "length": len(data)})
                    at += len(data)
                    yield data
                    following = next(source, None)

            with files.open_output_stream(f"{base}/{name}.part") as sink:
                package = Package(sink, zip64)
                package.member(DATA, members())
                package.member(INDEX, ((json.dumps(x) + "\n").encode() for x in index))
                package.close()
            files.move(f"{base}/{name}.part", f"{base}/{name}.wacz")
            yield pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}.wacz"], "records": [len(index)]}
            )

    return stored(rows.mapInArrow(write, "path string, records long"), "packages")


def _rows(batches):
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "refers_to")]
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in columns)


def _located(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files, place = open_fs(path)
            with files.open_input_file(place) as source:
                members = directory(source)
                data, (at, left) = members[DATA], members[INDEX]
                rest = b""
                while left:
                    chunk = source.read_at(min(left, 1 << 20), at)
                    at, left = at + len(chunk), left - len(chunk)
                    *lines, rest = (rest + chunk).split(b"\n")
                    if lines:
                        found = [json.loads(line) for line in lines]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "path": [path] * len(found),
                                "offset": [data[0] + x["offset"] for x in found],
                                "length": [x["length"] for x in found],
                            }
                        )


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _read(batches):
    opened, source = None, None
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("path", "offset", "length"))
        found, size = [], 0
        for path, offset, length in zip(*columns):
            if path != opened:
                if source is not None:
                    source.close()
                files, place = open_fs(path)
                opened, source = path, files.open_input_file(place)
            found.append(parse_record(zlib.decompress(source.read_at(length, offset), 31)))
            size += found[-1]["payload_bytes"]
            if size > READ_BYTES:
                yield pa.RecordBatch.from_pylist(found, schema=_RECORD)
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_RECORD)
    if source is not None:
        source.close()


def read_packages(packages: DataFrame) -> DataFrame:
    """All records of the packages in column ``path``."""
    # index rows are few bytes for much to read: numbers of partitions that stay
    files = packages.agg(F.count_distinct("path")).first()[0]
    where = stored(
        packages.select("path").repartition(max(1, files), "path").mapInArrow(
            _located, "path string, offset long, length long"
        ),
        "located",
    )
    total = where.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, files, math.ceil(total / TASK_BYTES))
    near = where.repartitionByRange(tasks, "path", "offset")
    return near.sortWithinPartitions("path", "offset").mapInArrow(
        _read,
        "page_id long, url string, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long, payload binary",
    )
