"""WARC records in ZIP packages: writer and range reader (operator 8).

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdx``,
both stored without compression, so a record is a byte range of the package. The reader
takes the end records and the central directory (ZIP64 where fields overflow), finds the stored
members, reads the index, and then reads ranges of records; nothing is extracted.

Writing tasks make packages of bounded size in memory and put each into the shared folder
under a name of its own. Only packages of tasks that ended well are listed, so lost executors and
repeated attempts leave files that nobody reads.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from pulsegate.llm.common import arrow_rows, small_batches, staged
from pulsegate.staging import shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Compressed bytes after which a package is closed, and of one range read.
PACKAGE_BYTES, RANGE_BYTES = 16 << 20, 2 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else urllib.parse.quote(str(page_id), safe='')}>"


def _from_urn(urn: str) -> str | None:
    return urllib.parse.unquote(urn.removeprefix("<urn:page:").removesuffix(">")) or None


def record(page_id, url: str | None, payload: bytes | None, size: int, digest: str,
           refers_to) -> bytes:
    """One gzip member; a revisit (``payload`` is None) has the HTTP head only."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {size}\r\n\r\n").encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}",
            f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(
            map(chr, range(0x21, 0x7F)))))
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(raw: bytes) -> tuple[str | None, int, str, str, str | None]:
    """page_id, payload bytes, payload digest, type, refers_to of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n")
                    if x.lower().startswith("content-length:")).split(":")[1])
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response":
        if len(payload) != size or base64.b32encode(
                hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {fields['warc-record-id']} is damaged")
    refers = _from_urn(fields["warc-refers-to"]) if kind == "revisit" else None
    return _from_urn(fields["warc-record-id"]), size, digest, kind, refers


def package(records: list[bytes], zip64: bool = False) -> bytes:
    """A ZIP of the records and of an index of their places; both members are stored."""
    lines, at = [], 0
    for raw in records:
        lines.append(f"{at} {len(raw)}\n")
        at += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as file:
        for name, content in ((DATA, b"".join(records)), (INDEX, "".join(lines).encode())):
            with file.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as member:
                member.write(content)
    return out.getvalue()


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    got = file.read(length)
    if len(got) != length:
        raise ValueError("the archive is cut off")
    return got


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """Fields of 0xFFFFFFFF replaced by those of the ZIP64 extra field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            more = iter(struct.unpack_from(f"<{length // 8}Q", extra, at + 4))
            return [next(more) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + length
    return values


def stored_members(file, size: int) -> dict[str, tuple[int, int]]:
    """Place and length of each stored member, from the central directory.

    Archives with a comment and ZIP64 archives are read; compressed or encrypted
    members and other than single-disk archives are refused.
    """
    tail_at = max(0, size - 65_557)
    tail = _range(file, tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end record: not a ZIP archive")
    disk, _, _, count, length, start, _ = struct.unpack_from("<4H2IH", tail, end + 4)
    if 0xFFFF in (disk, count) or 0xFFFFFFFF in (length, start):
        mark, _, wide_at, _ = struct.unpack("<4sIQI", _range(file, tail_at + end - 20, 20))
        if mark != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        wide = _range(file, wide_at, 56)
        if wide[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        disk, _, _, count, length, start = struct.unpack_from("<2I4Q", wide, 16)
    if disk:
        raise ValueError("archives of several disks are not read")
    central, at, out = _range(file, start, length), 0, {}
    for _ in range(count):
        if central[at:at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack_from("<2H", central, at + 8)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<2I3H", central, at + 20)
        local = struct.unpack_from("<I", central, at + 42)[0]
        name = central[at + 46:at + 46 + n_name].decode()
        extra = central[at + 46 + n_name:at + 46 + n_name + n_extra]
        plain, packed, local = _wide(extra, [plain, packed, local])
        if method or flags & 1:
            raise ValueError(f"{name} is not stored")
        head = _range(file, local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        out[name] = (local + 30 + sum(struct.unpack_from("<2H", head, 26)), packed)
        at += 46 + n_name + n_extra + n_note
    return out


def write_packages(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) below ``folder``; a table of package paths.

    Of rows with equal payloads of at least ``least`` bytes that with the smallest page_id
    becomes a response and the others revisits of it; rows that share this smallest id are
    one page repeated and are all responses, as are rows with a null id where all ids of the
    payload are null. Null html is an empty payload. Other columns are not read.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(html.cast("binary")).alias("digest"),
                        F.octet_length(html).cast("long").alias("size"))
    firsts = rows.filter(F.col("size") >= least).groupBy("digest").agg(
        F.min("page_id").alias("first"))
    marked = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "digest", "size", (F.col("first").isNotNull()
            & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"), "first",
        "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)

        def close(records: list[bytes]) -> pa.RecordBatch:
            path = f"{root}/{uuid.uuid4().hex}.wacz"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(path) as file:
                file.write(package(records))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{path.rsplit('/', 1)[1]}"]), pa.array([len(records)])],
                names=["path", "records"])

        records, held = [], 0
        for batch in batches:
            for row in zip(*(column for column in batch.columns)):
                page_id, url, digest, size, revisit, first, text = (x.as_py() for x in row)
                short = base64.b32encode(bytes.fromhex(digest)).decode()
                raw = record(page_id, url, None if revisit else (text or "").encode(), size, short,
                             first)
                records.append(raw)
                held += len(raw)
                if held >= PACKAGE_BYTES:
                    yield close(records)
                    records, held = [], 0
        if records:
            yield close(records)

    small_batches(pages)
    return staged(marked.mapInArrow(write, "path string, records long"), "packages")


def read_packages(paths: DataFrame, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the
    packages of ``paths`` (column ``path``). Payloads of responses are checked against their
    digests; a damaged package raises ValueError."""
    def locate(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, starts, lengths = [], [], []
        for path in batch.column("path").to_pylist():
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as file:
                members = stored_members(file, file.size())
                index = _range(file, *members[INDEX]).decode().splitlines()
            base, held = members[DATA][0], None
            for line in index:
                at, length = map(int, line.split())
                if held is None or lengths[held] + length > RANGE_BYTES:
                    held = len(found)
                    found.append(path)
                    starts.append(base + at)
                    lengths.append(0)
                lengths[held] += length
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array(starts, pa.int64()),
             pa.array(lengths, pa.int64())], names=["path", "start", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as file:
                    raw, rows = _range(file, start, length), []
                while raw:
                    member = zlib.decompressobj(31)
                    rows.append(parse(member.decompress(raw) + member.flush()))
                    raw = member.unused_data
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type",
                           "refers_to"])

    ranges = arrow_rows(paths.select("path"), locate, "path string, start long, length long")
    # a stated number of tasks: by the bytes of these short rows all would be put into one
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = ranges.repartition(tasks, F.xxhash64("path", "start"))
    return spread.mapInArrow(
        read, "page_id string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to string").withColumns({
            "page_id": F.col("page_id").cast(id_type),
            "refers_to": F.col("refers_to").cast(id_type)})


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to packages in the shared folder and read the packages back."""
    folder = f"{shared_folder(pages.sparkSession)}/packages/{uuid.uuid4().hex}"
    return read_packages(write_packages(pages, folder, least),
                         pages.schema["page_id"].dataType.simpleString())
