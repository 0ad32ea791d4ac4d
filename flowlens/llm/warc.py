"""WARC archives inside ZIP packages: a distributed writer, and a reader by range.

A package is a ZIP file with stored members: `archive/data.warc.gz`, in which every record is a gzip
member of its own, and `indexes/index.cdxj`, one line per record with its offset and length. The
reader looks at the end of a package, follows the (ZIP64) central directory to its members, reads
the index and then single records by range; nothing is unpacked.

Scale: each task writes packages of bounded size into the shared folder, under names no other attempt
uses; the names of the attempts that count come back as rows. Reading deals records, not packages,
over the tasks. Of a payload only digest and length are compared, and the payload moves once.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm.shared import width
from flowlens.operators.lineage import cut, new_path

REVISIT_BYTES, PACKAGE_BYTES = 1000, 32 << 20
DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Signatures and limits of the public ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


# --- ZIP packages ---


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; `zip64` forces the 64-bit structures, which large files get anyway."""
    out, central = io.BytesIO(), []
    for name, data in members:
        at, raw, crc = out.tell(), name.encode(), zlib.crc32(data)
        big = zip64 or len(data) >= MAX32 or at >= MAX32
        size, extra = (MAX32, struct.pack("<HHQQ", 1, 16, len(data), len(data))) if big else (len(data), b"")
        out.write(LOCAL + struct.pack("<HHHHHIIIHH", 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra)
        out.write(data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central.append(
            CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45 if big else 20, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, MAX32 if big else at)
            + raw + extra
        )
    at, directory = out.tell(), b"".join(central)
    out.write(directory)
    if zip64 or at >= MAX32 or len(members) >= MAX16:
        end = out.tell()
        out.write(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at))
        out.write(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        out.write(END + struct.pack("<HHHHIIH", 0, 0, MAX16, MAX16, MAX32, MAX32, 0))
    else:
        out.write(END + struct.pack("<HHHHIIH", 0, 0, len(members), len(members), len(directory), at, 0))
    return out.getvalue()


def read_range(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"the file ends inside a range: {at}+{size}")
    return data


def zip_directory(file, size: int) -> dict[str, tuple[int, int]]:
    """Start and length of the data of each member, from the central directory alone; all must be stored."""
    tail_at = max(0, size - 22 - MAX16)
    tail = read_range(file, tail_at, size - tail_at)
    end = tail.rfind(END)
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(END, 0, end)  # the signature may also occur inside the comment
    if end < 0:
        raise ValueError("not a ZIP file")
    _, _, _, count, length, at = struct.unpack_from("<HHHHII", tail, end + 4)
    if count == MAX16 or length == MAX32 or at == MAX32:
        locator = read_range(file, tail_at + end - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 locator missing")
        record = read_range(file, struct.unpack_from("<IQ", locator, 4)[1], 56)
        if record[:4] != END64:
            raise ValueError("ZIP64 end record missing")
        count, length, at = struct.unpack_from("<QQQ", record, 32)
    directory, members, p = read_range(file, at, length), {}, 0
    for _ in range(count):
        if directory[p : p + 4] != CENTRAL:
            raise ValueError("central directory broken")
        method, packed, plain = struct.unpack_from("<H", directory, p + 10)[0], *struct.unpack_from("<II", directory, p + 20)
        n_name, n_extra, n_comment = struct.unpack_from("<HHH", directory, p + 28)
        start = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode()
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # the values that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain, packed, start = (next(wide) if v == MAX32 else v for v in (plain, packed, start))
            extra = extra[4 + n :]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        own_name, own_extra = struct.unpack_from("<HH", read_range(file, start, 30), 26)
        members[name] = (start + 30 + own_name + own_extra, packed)
        p += 46 + n_name + n_extra + n_comment
    return members


# --- WARC records ---


def _head(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in lines), "\r\n"]).encode()


def warc_record(page_id, url: str, payload: bytes, size: int, sha1: str, refers_to) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    http = _head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))], "HTTP/1.1 200 OK")
    block = http + (payload if refers_to is None else b"")
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        lines += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_head(lines, "WARC/1.1") + block + b"\r\n\r\n", 1, mtime=0)


def parse_head(data: bytes, at: int = 0) -> tuple[dict[str, str], int]:
    """Fields of a header block by lower-case name, and where the block ends."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def parse_record(member: bytes) -> dict:
    data = gzip.decompress(member)
    head, at = parse_head(data)
    block = data[at : at + int(head["content-length"])]
    http, start = parse_head(block)
    return head | {"http": http, "payload": block[start:]}


def _page(urn: str | None) -> int | None:
    value = urn[len("<urn:page:") : -1] if urn else "null"
    return None if value == "null" else int(value)


# --- Spark ---


def _one_line(url: str | None) -> str:
    """A URL as a header value: what would end the line is percent-encoded; the index keeps the URL as it is."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")


def _write(folder: str, package_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        data, index = io.BytesIO(), []

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.wacz"
            lines = "".join(json.dumps(x) + "\n" for x in index).encode()
            package = zip_stored([(ARCHIVE, data.getvalue()), (INDEX, lines)])
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(package)
            return pa.RecordBatch.from_pydict({"name": [name], "size": [len(package)], "records": [len(index)]})

        columns = ("page_id", "url", "payload", "payload_bytes", "sha1", "refers_to")
        for batch in batches:
            # Arrow keeps ids exact next to nulls.
            for page_id, url, payload, size, sha1, refers in zip(*(batch.column(c) for c in columns), strict=True):
                page = "null" if page_id.as_py() is None else page_id.as_py()
                at = data.tell()
                data.write(warc_record(page, _one_line(url.as_py()), payload.as_py() or b"", size.as_py(), sha1.as_py(), refers.as_py()))
                index.append({"url": url.as_py(), "offset": at, "length": data.tell() - at})
                if data.tell() >= package_bytes:
                    yield close()
                    data, index = io.BytesIO(), []
        if index:
            yield close()

    return run


def write_packages(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write a record per row of (page_id, url, html) and return the packages: name, size, records.

    Of equal payloads of at least `revisit_bytes` the one with the largest page_id is the response and
    the others revisit it; rows that repeat its id and payload are responses too. A null html is an
    empty payload, a null id never stands for others while there is an id, a null url stays null.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes")).withColumns(
        {"sha1": F.sha1("payload"), "sha256": F.unhex(F.sha2("payload", 256))}
    )
    # The full payload is compared by length, SHA-1 and SHA-256; groups of one need no row here.
    first = cut(
        rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("sha256", "payload_bytes", "sha1")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and first_id is not null")
        .select("sha256", "first_id")
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    marked = rows.join(first, "sha256", "left").select(
        "page_id", "url", "payload_bytes", "sha1", refers.alias("refers_to"),
        F.when(refers.isNull(), F.col("payload")).alias("payload"),
    )
    return cut(marked.mapInArrow(_write(folder, package_bytes), "name string, size long, records long"))


def _locate(folder: str):
    """Where each record of a package lies, a package after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size in zip(batch.column("name").to_pylist(), batch.column("size").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    members = zip_directory(file, size)
                    start = members[ARCHIVE][0]
                    lines = read_range(file, *members[INDEX]).decode("utf-8", "surrogatepass").splitlines()
                entries = [json.loads(x) for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(entries), pa.string()), pa.array([x["url"] for x in entries], pa.string()),
                        pa.array([start + x["offset"] for x in entries], pa.int64()), pa.array([x["length"] for x in entries], pa.int64()),
                    ],
                    names=["name", "url", "at", "length"],
                )

    return run


def _fetch(folder: str, payloads: bool):
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    kinds += [("payload", pa.binary())] * payloads

    def record(file, name: str, url, at: int, length: int) -> tuple:
        r = parse_record(read_range(file, at, length))
        sha1 = base64.b32decode(r["warc-payload-digest"].removeprefix("sha1:")).hex()
        size, kind = int(r["http"]["content-length"]), r["warc-type"]
        if kind == "response" and (len(r["payload"]) != size or hashlib.sha1(r["payload"]).hexdigest() != sha1):
            raise ValueError(f"{name}: the payload at {at} does not match its digest")
        return (_page(r["warc-record-id"]), url, size, sha1, kind, _page(r.get("warc-refers-to"))) + ((r["payload"],) if payloads else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("name", "url", "at", "length")), strict=True)
            for name, part in itertools.groupby(rows, key=lambda r: r[0]):
                with store.open_input_file(f"{root}/{name}") as file:
                    out += [record(file, *r) for r in part]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    return run


def read_packages(packages: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Every record of the packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    `payloads` adds the bytes of responses. A response is checked against its digest; a package that
    is no ZIP file, has compressed members or ends early raises.
    """
    n = width(packages.sparkSession)
    entries = packages.select("name", "size").repartition(n).mapInArrow(_locate(folder), "name string, url string, at long, length long")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return entries.mapInArrow(_fetch(folder, payloads), schema + ", payload binary" * payloads)


def archive(pages: DataFrame) -> DataFrame:
    """Write the pages into packages in the session's shared folder and read every record back.

    One row per page: page_id, url, payload_bytes, payload_digest, record_type, refers_to. A null html is
    an empty payload; null ids and urls come back as null; of rows that repeat id and payload all are
    responses. A page of any length is one record. An empty table gives an empty result; other columns
    are not read, whatever their names.
    """
    folder = new_path(pages.sparkSession, "warc")
    return read_packages(write_packages(pages, folder), folder)


SQL = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as digest, coalesce(html, '') as html from pages),
w as (select *, case when n >= 1000 then max(page_id) over (partition by html) end as top from p)
select page_id, url, n as payload_bytes, digest as payload_digest,
  case when top is null or page_id is not distinct from top then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from top then top end as refers_to from w
"""
