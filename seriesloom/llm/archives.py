"""WARC records inside ZIP packages: written by tasks, read by byte range, never unpacked.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and
``indexes/index.cdxj`` as stored members, so that a record is one range of the package.
Packages lie in a folder that driver and executors share; any file system that
``pyarrow.fs`` opens by URI will do.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.store import arrow_map, materialize, scratch_path, shuffle_width

WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
#: A task closes a package once it holds so many bytes, so a writer's memory stays bounded.
PACKAGE_BYTES = 16 << 20
#: Neighbouring records are read in one request of at most about so many bytes.
READ_BYTES = 4 << 20
#: Payloads shorter than this are never written as revisits.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

# Fixed values of the ZIP format.
END, END_SIZE = b"PK\x05\x06", 22
END64_LOCATOR, END64_LOCATOR_SIZE = b"PK\x06\x07", 20
END64, END64_SIZE = b"PK\x06\x06", 56
CENTRAL, CENTRAL_SIZE = b"PK\x01\x02", 46
LOCAL, LOCAL_SIZE = b"PK\x03\x04", 30
ZIP64_EXTRA, ALL32, COMMENT_MAX = 1, 0xFFFFFFFF, 0xFFFF
STORED = 0


class Member(NamedTuple):
    name: str
    method: int
    offset: int  # of the first data byte in the package
    size: int  # bytes stored


# Reading ZIP directories -------------------------------------------------------------------


def zip_members(file, size: int) -> list[Member]:
    """The members of a ZIP package from its central directory, ZIP64 included.

    ``file`` needs ``read_at(nbytes, offset)``.  Reads the package's end, its directory and the
    local headers only.  Raises ``ValueError`` where there is no directory.
    """
    tail_size = min(size, END_SIZE + COMMENT_MAX + END64_LOCATOR_SIZE)
    tail = file.read_at(tail_size, size - tail_size)
    at = len(tail) - END_SIZE
    while at >= 0 and not (tail[at : at + 4] == END and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] <= len(tail)):
        at = tail.rfind(END, 0, at + 3) if at else -1
    if at < 0:
        raise ValueError("no ZIP directory")
    _, _, _, count, directory_size, directory_at, _ = struct.unpack_from("<4HIIH", tail, at + 4)
    end_at = size - tail_size + at
    wide_at = end_at - END64_LOCATOR_SIZE
    if wide_at >= END64_SIZE and (locator := file.read_at(END64_LOCATOR_SIZE, wide_at))[:4] == END64_LOCATOR:
        end_at = struct.unpack_from("<Q", locator, 8)[0]
        end64 = file.read_at(END64_SIZE, end_at)
        if end64[:4] != END64:  # bytes stand before the package
            end_at = wide_at - END64_SIZE
            end64 = file.read_at(END64_SIZE, end_at)
        if end64[:4] != END64:
            raise ValueError("no ZIP64 directory end")
        count, directory_size, directory_at = struct.unpack_from("<3Q", end64, 32)
    shift = end_at - directory_size - directory_at  # bytes before the package, 0 as a rule
    directory = file.read_at(directory_size, directory_at + shift)
    members, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != CENTRAL:
            raise ValueError("broken ZIP directory")
        flags, method = struct.unpack_from("<HH", directory, at + 8)
        packed, full = struct.unpack_from("<II", directory, at + 20)
        name_size, extra_size, comment_size = struct.unpack_from("<3H", directory, at + 28)
        local_at = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + CENTRAL_SIZE : at + CENTRAL_SIZE + name_size]
        extra = directory[at + CENTRAL_SIZE + name_size : at + CENTRAL_SIZE + name_size + extra_size]
        packed, local_at = _wide(extra, full, packed, local_at)
        head = file.read_at(LOCAL_SIZE, local_at + shift)
        if head[:4] != LOCAL:
            raise ValueError("broken ZIP member")
        skip = sum(struct.unpack_from("<HH", head, 26))
        members.append(
            Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, local_at + shift + LOCAL_SIZE + skip, packed)
        )
        at += CENTRAL_SIZE + name_size + extra_size + comment_size
    return members


def _wide(extra: bytes, full: int, packed: int, local_at: int) -> tuple[int, int]:
    """(packed size, local offset) with what a ZIP64 extra field holds in place of all-ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == ZIP64_EXTRA:
            wide = list(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            if full == ALL32:
                wide.pop(0)
            if packed == ALL32:
                packed = wide.pop(0)
            if local_at == ALL32:
                local_at = wide.pop(0)
        at += 4 + length
    return packed, local_at


# Records -----------------------------------------------------------------------------------


def _one_line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(row: dict, date: str) -> bytes:
    """One record; a revisit keeps the HTTP header with the payload's length, but no payload."""
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    digest = base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()
    head = [
        "WARC/1.0",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:page:{_id(row['page_id'])}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_one_line(row['url'] or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{_id(row['refers_to'])}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _id(page: int | None) -> str:
    return "none" if page is None else str(page)


def _page(urn: str | None) -> int | None:
    found = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if found in ("", "none") else int(found)


def parse_record(data: bytes) -> dict:
    """What a record says; the digest of a response is that of its payload and must agree with its header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
    if fields["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
        if digest != said:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    else:
        lengths = [x.partition(":")[2] for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")]
        size, digest, payload = int(lengths[0]), said, None
    return {
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "payload": payload,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": _page(fields.get("warc-refers-to")),
    }


def package(records: list[tuple[dict, bytes]]) -> bytes:
    """A ZIP package of records with an index line each."""
    body, index = io.BytesIO(), []
    for row, data in records:
        member = gzip.compress(data, 1, mtime=0)
        said = {"offset": str(body.tell()), "length": str(len(member)), "filename": "data.warc.gz"}
        said |= {"url": row["url"], "digest": f"sha1:{row['payload_digest']}", "type": row["record_type"]}
        index.append(f"{_id(row['page_id'])} {json.dumps(said)}\n")
        body.write(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((WARC_MEMBER, body.getvalue()), (INDEX_MEMBER, "".join(index).encode())):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=True) as f:
                f.write(data)
    return out.getvalue()


# Spark -------------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` per row of ``pages``.

    Of equal payloads of at least ``least`` bytes the rows with the largest page_id are
    responses (a repeated row is a repeated response), the others revisit it.  A null html is
    an empty payload; a null page_id counts as smaller than any.
    """
    payload = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest")
    )
    groups = (
        rows.filter(F.col("payload_bytes") >= least)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter("_n > 1")
        .drop("_n")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return rows.join(groups, ["payload_digest", "payload_bytes"], "left").select(
        *rows.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_packages(records: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", most: int = PACKAGE_BYTES) -> DataFrame:
    """Write records as packages below ``folder``; returns ``package, records``, stored.

    Each attempt of a task writes under names of its own and only the attempt that succeeds is
    listed, so a lost executor leaves no record twice.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close(held):
            name = f"part-{uuid.uuid4().hex}.wacz"
            with store.open_output_stream(f"{base}/{name}") as out:
                out.write(package(held))
            return pa.record_batch([[f"{folder}/{name}"], pa.array([len(held)], pa.int64())], ["package", "records"])

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
                data = warc_record(row, date)
                held.append(({k: v for k, v in row.items() if k != "payload"}, data))
                size += len(data)
                if size >= most:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    columns = ["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"]
    return materialize(records.select(*columns).mapInArrow(work, "package string, records bigint"))


class _Opened:
    """The package a task reads from; one at a time."""

    def __init__(self):
        self.name = self.file = None

    def __call__(self, name: str):
        if name != self.name:
            if self.file:
                self.file.close()
            store, path = fs.FileSystem.from_uri(name)
            self.file, self.name = store.open_input_file(path), name
        return self.file


def index_records(packages: DataFrame) -> DataFrame:
    """``package, offset, length`` of every record, by the packages' own indexes.

    A package without an index has its WARC member walked record by record.  Only stored
    members are read; a package without a stored WARC member raises ``ValueError``.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        opened = _Opened()
        for name in batch.column("package").to_pylist():
            file = opened(name)
            members = {m.name: m for m in zip_members(file, file.size()) if m.method == STORED}
            data = next((m for n, m in members.items() if n.endswith((".warc.gz", ".warc"))), None)
            if data is None:
                raise ValueError(f"{name}: no stored WARC member")
            if INDEX_MEMBER in members:
                m = members[INDEX_MEMBER]
                lines = [json.loads(x[x.index("{") :]) for x in file.read_at(m.size, m.offset).decode().splitlines() if "{" in x]
                found = [(int(x["offset"]), int(x["length"])) for x in lines]
            else:
                found = list(_walk(file, data))
            offsets = pa.array([data.offset + a for a, _ in found], pa.int64())
            yield pa.record_batch([[name] * len(found), offsets, pa.array([b for _, b in found], pa.int64())], ["package", "offset", "length"])

    return arrow_map(packages.select("package"), work, "package string, offset bigint, length bigint")


def _walk(file, member: Member) -> Iterator[tuple[int, int]]:
    """(offset, length) of the gzip members one after the other, read in steps."""
    at, ahead, pos = 0, b"", 0
    while at < member.size:
        unpack, used = zlib.decompressobj(31), 0
        while not unpack.eof:
            if not ahead:
                if pos >= member.size:
                    raise ValueError("WARC member ends inside a record")
                ahead = file.read_at(min(READ_BYTES, member.size - pos), member.offset + pos)
                pos += len(ahead)
            unpack.decompress(ahead)
            used += len(ahead) - len(unpack.unused_data)
            ahead = unpack.unused_data
        yield at, used
        at += used


RECORD = (
    "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
)


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records of ``index(package, offset, length)``; ``payload`` keeps the payload column (null for revisits).

    Ranges are dealt out by stretches of a package, so one large package is read by many tasks,
    and neighbours come in one request.
    """
    schema = RECORD + (", payload binary" if payload else "")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        opened, out, held = _Opened(), [], 0
        names, offsets, lengths = (batch.column(c).to_pylist() for c in ("package", "offset", "length"))
        i = 0
        while i < len(names):
            j = i
            while j + 1 < len(names) and names[j + 1] == names[i] and offsets[j + 1] == offsets[j] + lengths[j] and offsets[j + 1] - offsets[i] < READ_BYTES:
                j += 1
            data = opened(names[i]).read_at(offsets[j] + lengths[j] - offsets[i], offsets[i])
            for k in range(i, j + 1):
                at = offsets[k] - offsets[i]
                found = parse_record(gzip.decompress(data[at : at + lengths[k]]))
                if payload:
                    held += len(found["payload"] or b"")
                else:
                    del found["payload"]
                out.append(found)
            if held >= READ_BYTES:
                yield _batch(out, payload)
                out, held = [], 0
            i = j + 1
        if out:
            yield _batch(out, payload)

    dealt = index.withColumn("_stretch", F.floor(F.col("offset") / READ_BYTES)).repartition(shuffle_width(index), "package", "_stretch")
    return arrow_map(dealt.sortWithinPartitions("package", "offset").select("package", "offset", "length"), work, schema)


def _batch(rows: list[dict], payload: bool) -> pa.RecordBatch:
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64())]
    fields += [("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def archive_pages(spark: SparkSession, pages: DataFrame, payload: bool = False) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as packages into the shared folder and read the records back.

    Empty tables give empty results; other columns of ``pages`` are ignored.
    """
    packages = write_packages(mark_revisits(pages), scratch_path(spark, "packages"))
    return read_records(index_records(packages), payload)
