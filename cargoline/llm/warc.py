"""WARC records in ZIP packages: written once, then read by ranges without unpacking.

A package is a ZIP file with two stored members: the records, each compressed by itself, and an index of their places. The reader takes
the end of the file, finds the central directory (by way of the ZIP64 record where the plain fields are full), locates the stored members,
reads the index and then only the ranges of records, neighbouring ones in one read. Packages live in the shared folder; a table of the
packages that finished tasks have written is kept beside them, so that what a lost or repeated task has left behind is never read.

Of the pages with equal payloads (digest of the HTML in UTF-8; null counts as empty) of ``least`` bytes or more, that with the smallest id
has the response record, and the others revisit it; smaller payloads always get a response. Repeated rows get a record each. A null id is never
the smallest; a payload that only null ids have gets a response for each. The folder's scheme must be one that Arrow opens.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from cargoline.llm.batches import add_columns, chunks, ship
from cargoline.session import materialize, scratch_path

#: Bytes of records after which a package is closed.
PACKAGE_BYTES = 16 << 20
#: Records closer than this are read together.
READ_BYTES = 4 << 20
RECORDS, INDEX = "records.warc.gz", "records.idx"
_NO_ID = "null"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, own_digest: str, refers_to, revisit: bool, date: str) -> bytes:
    name = _NO_ID if page_id is None else page_id
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{name}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{own_digest}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers by lower-case name, ``payload`` (empty for a revisit) and ``payload_bytes`` of the full payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out["payload"] = payload
    out["payload_bytes"] = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    return out


@dataclass(frozen=True)
class Member:
    name: str
    offset: int  # of the local header
    size: int
    method: int


def central_directory(read, size: int) -> list[Member]:
    """Members of a ZIP file of ``size`` bytes; ``read(offset, n)`` gives its bytes."""
    tail_size = min(size, 65_535 + 22 + 20)
    tail = read(size - tail_size, tail_size)
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    if 0xFFFF in (count,) or 0xFFFFFFFF in (length, start):
        if end < 20 or tail[end - 20 : end - 16] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        record = read(int.from_bytes(tail[end - 12 : end - 4], "little"), 56)
        if record[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack("<QQQ", record[32:56])
    listed, at, members = read(start, length), 0, []
    for _ in range(count):
        if listed[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack("<H", listed[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_comment = struct.unpack("<IIHHH", listed[at + 20 : at + 34])
        offset, = struct.unpack("<I", listed[at + 42 : at + 46])
        name = listed[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra, wide = listed[at + 46 + n_name : at + 46 + n_name + n_extra], b""
        while len(extra) >= 4:
            tag, n = struct.unpack("<HH", extra[:4])
            wide, extra = (extra[4 : 4 + n] if tag == 1 else wide), extra[4 + n :]
        values = list(struct.unpack(f"<{len(wide) // 8}Q", wide[: len(wide) // 8 * 8]))  # only of the fields that are full, in order
        plain = values.pop(0) if plain == 0xFFFFFFFF else plain
        packed = values.pop(0) if packed == 0xFFFFFFFF else packed
        offset = values.pop(0) if offset == 0xFFFFFFFF else offset
        members.append(Member(name, offset, packed, method))
        at += 46 + n_name + n_extra + n_comment
    return members


def member_start(read, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method:
        raise ValueError(f"{member.name} is compressed as a member; only stored ones can be read by ranges")
    head = read(member.offset, 30)
    if head[:4] != b"PK\3\4":
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return member.offset + 30 + n_name + n_extra


def read_package(read, size: int) -> Iterator[dict]:
    """The records of a package in the order of its index."""
    members = {m.name: m for m in central_directory(read, size)}
    index = members[INDEX]
    places = [tuple(map(int, line.split())) for line in read(member_start(read, index), index.size).decode().splitlines()]
    start, k = member_start(read, members[RECORDS]), 0
    while k < len(places):
        first, last = k, k + 1
        while last < len(places) and places[last][0] == sum(places[last - 1]) and sum(places[last]) - places[first][0] <= READ_BYTES:
            last += 1
        block = read(start + places[first][0], sum(places[last - 1]) - places[first][0])
        for offset, length in places[first:last]:
            at = offset - places[first][0]
            yield parse_record(gzip.decompress(block[at : at + length]))
        k = last


def package(records: list[bytes], zip64: bool = False) -> bytes:
    """A ZIP file with the compressed records and their index, both stored."""
    out, places, at = io.BytesIO(), [], 0
    for r in records:
        places.append(f"{at} {len(r)}\n")
        at += len(r)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((RECORDS, b"".join(records)), (INDEX, "".join(places).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                f.write(data)
    return out.getvalue()


def write_packages(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0,
                   date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write the records of ``pages`` to packages in ``folder``; the table (path, n_records) of the packages."""
    ship(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(f"`{html}`", F.lit("")).alias("html"))

    def digests(column: pa.Array) -> dict[str, pa.Array]:
        return {"digest": pa.array([digest(t.encode()) for t in column.to_pylist()], type=pa.string())}

    named = add_columns(rows, "html", digests, {"digest": "string"})
    small = materialize(named.select("page_id", "digest", F.octet_length("html").alias("size")), "page-digests")
    firsts = small.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    roles = small.join(firsts, "digest").where("first IS NOT NULL AND NOT (page_id <=> first)").select(
        F.col("page_id").alias("id"), F.col("digest").alias("same"), "first").distinct()
    sized = named.join(roles, named.page_id.eqNullSafe(roles.id) & (named.digest == roles.same), "left").select("page_id", "url", "html", "digest", "first")

    def write(batches):
        held: list[bytes] = []
        made: list[tuple[str, int]] = []

        def close() -> None:
            if held:
                place, path = fs.FileSystem.from_uri(folder)
                target = f"{path}/{uuid.uuid4().hex}.zip"
                place.create_dir(path, recursive=True)
                with place.open_output_stream(target) as out:
                    out.write(package(held))
                made.append((f"{folder}/{target.rsplit('/', 1)[1]}", len(held)))
                held.clear()

        size = 0
        for batch in chunks(batches, "html"):
            for row in batch.to_pylist():
                payload = row["html"].encode()
                raw = _record(row["page_id"], row["url"], payload, row["digest"], row["first"], row["first"] is not None, date)
                held.append(gzip.compress(raw, 1, mtime=0))
                size += len(held[-1])
                if size >= PACKAGE_BYTES:
                    close()
                    size = 0
        close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in made], pa.string()), "n_records": pa.array([n for _, n in made], pa.int64())})

    return materialize(sized.mapInArrow(write, "path string, n_records bigint"), "packages")


def read_packages(packages: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, html) of every record; ``html`` is null for a revisit.

    A response's payload is checked against its digest.
    """
    ship(packages.sparkSession)

    def read(batches):
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                place, path = fs.FileSystem.from_uri(uri)
                with place.open_input_file(path) as f:
                    out: list[dict] = []
                    held = 0
                    for r in read_package(lambda offset, n: f.read_at(n, offset), f.size()):
                        revisit = r["warc-type"] == "revisit"
                        told = r["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (digest(r["payload"]) != told or len(r["payload"]) != r["payload_bytes"]):
                            raise ValueError(f"a payload in {uri} does not fit its digest")
                        name = r["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
                        out.append({"page_id": None if name == _NO_ID else int(name), "url": r["warc-target-uri"], "payload_bytes": r["payload_bytes"], "payload_digest": told,
                                    "record_type": r["warc-type"], "refers_to": int(r["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")) if revisit else None,
                                    "html": None if revisit else r["payload"].decode()})
                        held += len(r["payload"])
                        if held > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                            out, held = [], 0
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return packages.repartition(max(1, packages.sparkSession.sparkContext.defaultParallelism * 2), "path").mapInArrow(
        read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string")


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                     ("refers_to", pa.int64()), ("html", pa.string())])


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write ``pages`` to packages in the shared folder and read the records back."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder and ":" in folder:
        folder = folder.replace("file:", "file://", 1)
    return read_packages(write_packages(pages, folder, id_col, url, html, least))
