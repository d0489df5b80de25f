"""WARC records in ZIP archives of stored members: writing, and reading by ranges without extraction."""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir, cut

#: Bytes of records after which an archive is closed, and of one range that is read at once.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 4 << 20
#: Places of records in a batch.
PLACES = 10_000
#: Tasks that read archives, at the most; each has more then.
READERS = 65_536
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Members that hold records, and those that say where they are.
_RECORDS, _INDEXES = re.compile(r"archive/.+\.warc(?:\.gz)?"), re.compile(r"indexes/.+\.cdxj?(?:\.gz)?")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE, _NO_ID = 0x7061_6765_0000_4000, 0x7061_6765_0000_4001  # upper halves of the record ids of pages, and of those without an id


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    low = 0 if page_id is None else page_id & (2**64 - 1)
    return f"<urn:uuid:{uuid.UUID(int=(_NO_ID if page_id is None else _PAGE) << 64 | low)}>"


def page_of(record: str) -> int | None:
    """The page of a record written here; None for any other's id."""
    found = re.fullmatch(r"<?urn:uuid:([0-9a-fA-F-]{36})>?", record)
    high, low = divmod(uuid.UUID(found[1]).int if found else 0, 2**64)
    return None if high != _PAGE else low - 2**64 if low >= 2**63 else low


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}"] if url is not None else []
    head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"] if revisit else []
    head += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """Fields of a record, one gzip member or plain. A gzip member's checksum is tested, and a payload against the SHA-1
    that its record names. A record of HTTP has the body as its payload, any other (warcinfo, metadata) its whole block; a
    revisit has none, and null size or digest where it doesn't name them."""
    raw = zlib.decompress(member, 31) if member[:2] == b"\x1f\x8b" else member
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind, name, length = fields["warc-type"], fields["warc-record-id"], int(fields["content-length"])
    if len(rest) < length:
        raise ValueError(f"record {name} is cut off")
    block = rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    named = fields.get("warc-payload-digest", "")
    digest = named[5:] if named.lower().startswith("sha1:") else None
    if kind == "revisit":
        stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        size, payload = int(stated[1]) if stated else None, None
    else:
        size, made = len(payload), payload_digest(payload)
        if digest not in (None, made):
            raise ValueError(f"payload of {name} does not match its digest")
        digest = made
    return {
        "page_id": page_of(name), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
        "refers_to": page_of(fields.get("warc-refers-to", "")) if kind == "revisit" else None, "payload": payload,
    }


def build_zip(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of stored members with ZIP64 directories."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, raw, crc = len(out), name.encode(), zlib.crc32(data)
        out += struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, len(data), len(data)) + data
        central += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0x800, 0, 0, 33, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28, 0, 0, 0, 0, 0xFFFFFFFF) + raw + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
    start, n = len(out), len(members)
    out += central
    end64 = len(out)
    out += struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, len(central), start)
    out += struct.pack("<4sIQI", b"PK\6\7", 0, end64, 1)
    out += struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return bytes(out)


class Member(NamedTuple):
    """An entry of the central directory; offset is that of the local header."""

    method: int
    offset: int
    stored: int
    crc: int


def zip_directory(read, size: int) -> dict[str, Member]:
    """Members by name, from the central directory; read(offset, length)."""
    tail_at = max(0, size - 22 - 65535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\5\6")
    if end < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, end + 10)
    if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = read(tail_at + end - 20, 20)
        if locator[:4] != b"PK\6\7":
            raise ValueError("no ZIP64 locator")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", end64, 32)
    central, out, at = read(start, length), {}, 0
    for _ in range(n):
        if central[at : at + 4] != b"PK\1\2":
            raise ValueError("broken central directory")
        method, = struct.unpack_from("<H", central, at + 10)
        crc, stored, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", central, at + 16)
        offset, = struct.unpack_from("<I", central, at + 42)
        name = central[at + 46 : at + 46 + n_name].decode()
        extra, k = central[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while k + 4 <= len(extra):
            kind, size_of = struct.unpack_from("<HH", extra, k)
            if kind == 1:  # holds only those values that the entry itself can't
                values = iter(struct.unpack_from(f"<{size_of // 8}Q", extra, k + 4))
                plain = next(values) if plain == 0xFFFFFFFF else plain
                stored = next(values) if stored == 0xFFFFFFFF else stored
                offset = next(values) if offset == 0xFFFFFFFF else offset
            k += 4 + size_of
        out[name] = Member(method, offset, stored, crc)
        at += 46 + n_name + n_extra + n_comment
    return out


def member_start(read, entry: Member) -> int:
    """Where a stored member's bytes begin."""
    if entry.method:
        raise ValueError("member is compressed; ranges of it can't be read")
    return _bytes_at(read, entry)


def _bytes_at(read, entry: Member) -> int:
    local = read(entry.offset, 30)
    if local[:4] != b"PK\3\4":
        raise ValueError("no local header")
    return entry.offset + 30 + sum(struct.unpack_from("<HH", local, 26))


def _chunks(read, name: str, entry: Member) -> Iterator[bytes]:
    """A member's bytes, stored or deflated, by ranges; its checksum is tested at the end."""
    if entry.method not in (0, 8):
        raise ValueError(f"member {name} is packed by method {entry.method}")
    at, left, crc = _bytes_at(read, entry), entry.stored, 0
    inflate = zlib.decompressobj(-15) if entry.method else None
    while left:
        raw = read(at, min(left, RANGE_BYTES))
        if not raw:
            raise ValueError(f"member {name} is cut off")
        at, left = at + len(raw), left - len(raw)
        plain = inflate.decompress(raw) if inflate else raw
        crc = zlib.crc32(plain, crc)
        yield plain
    if crc != entry.crc:
        raise ValueError(f"member {name} does not match its checksum")


def _lines(chunks: Iterator[bytes], gzipped: bool) -> Iterator[str]:
    """Lines of a text, or of gzip members on end."""
    unzip, rest = zlib.decompressobj(31), b""
    for chunk in chunks:
        while chunk:
            if gzipped:
                plain = unzip.decompress(chunk)
                chunk = unzip.unused_data
                if unzip.eof:
                    unzip = zlib.decompressobj(31)
            else:
                plain, chunk = chunk, b""
            *whole, rest = (rest + plain).split(b"\n")
            yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


def places(read, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(first byte of the member, its length, offset in it, length) of each record that an archive's indexes name.

    An index may be plain or of gzip members, stored or deflated. A line names the member of its record (filename), unless
    there is but one. Lines without a place (headers) are passed over; a place named by several lines counts each time.
    """
    directory = zip_directory(read, size)
    data = {n: (member_start(read, e), e.stored) for n, e in directory.items() if _RECORDS.fullmatch(n)}
    for name, entry in directory.items():
        if not _INDEXES.fullmatch(name):
            continue
        for line in _lines(_chunks(read, name, entry), name.endswith(".gz")):
            brace = line.find("{")
            if brace < 0 or line.startswith("!"):
                continue
            found = json.loads(line[brace:])
            named = found.get("filename")
            member = data.get(f"archive/{named}", data.get(named)) if named else next(iter(data.values())) if len(data) == 1 else None
            if member is None:
                raise ValueError(f"index {name} names no member that there is: {named}")
            offset, length = int(found["offset"]), int(found["length"])
            if offset < 0 or length <= 0 or offset + length > member[1]:
                raise ValueError(f"index {name} names a place beyond its member")
            yield *member, offset, length


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def _uri(folder: str) -> str:
    return re.sub(r"^file:/(?!/)", "file:///", folder)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Archives under folder, which all executors share, and a table (archive, bytes, records) of them.

    Of pages with equal payloads of least bytes or more, those with the smallest id are responses and the others
    revisit them; a null payload is empty. A group without any id has responses only. An archive gets its name once it
    is whole, and names hold the task's attempt, so a task that is run again doesn't touch another's archive.
    """
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("same"))
    firsts = rows.filter(F.octet_length("payload") >= least).groupBy("same").agg(F.min("id").alias("first"))
    roles = rows.join(firsts, "same", "left").select("id", "url", "payload", "first")
    folder = _uri(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        context, part = TaskContext.get(), 0
        data, index, count = bytearray(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal part, data, index, count
            name = f"{context.partitionId():06d}-{part:04d}-{context.taskAttemptId()}.wacz"
            whole = build_zip([(DATA, bytes(data)), (INDEX, "".join(sorted(index)).encode())])
            store.create_dir(base, recursive=True)
            with store.open_output_stream(f"{base}/.{name}.tmp") as out:
                out.write(whole)
            store.move(f"{base}/.{name}.tmp", f"{base}/{name}")
            made = pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(whole)], pa.int64()), pa.array([count], pa.int64())], ["archive", "bytes", "records"])
            data, index, count, part = bytearray(), [], 0, part + 1
            return made

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, content, first = (batch.column(k)[i].as_py() for k in range(4))
                revisit = first is not None and page != first
                record = build_record(page, url, content, first, revisit)
                index.append(f"{(url or '-').split()[0] if (url or '').strip() else '-'} 20240101000000 {json.dumps({'url': url, 'offset': len(data), 'length': len(record)})}\n")
                data += record
                count += 1
                if len(data) >= ARCHIVE_BYTES:
                    yield close()
        if count:
            yield close()

    return roles.mapInArrow(write, "archive string, bytes long, records long")


def _opened(uri: str):
    store, path = _store(uri)
    f = store.open_input_file(path)

    def read(offset: int, length: int) -> bytes:
        f.seek(offset)
        return f.read(length)

    return f, read


def located(archives: DataFrame) -> DataFrame:
    """Rows (archive, start, size, offset, length) of the records of archives(archive), as their indexes name them."""
    names = ["archive", "start", "size", "offset", "length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                f, read = _opened(uri)
                with f:
                    found = places(read, f.size())
                    while some := list(itertools.islice(found, PLACES)):
                        yield pa.RecordBatch.from_arrays([pa.array([uri] * len(some)), *[pa.array(c, pa.int64()) for c in zip(*some, strict=True)]], names)

    return archives.select("archive").mapInArrow(run, "archive string, start long, size long, offset long, length long")


def _total_bytes(archives: DataFrame) -> int:
    """Bytes of the archives, from their column of that name or from the files."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                f, _ = _opened(uri)
                with f:
                    yield pa.RecordBatch.from_arrays([pa.array([f.size()], pa.int64())], ["bytes"])

    known = archives if "bytes" in archives.columns else archives.select("archive").mapInArrow(sizes, "bytes long")
    return known.agg(F.sum("bytes")).first()[0] or 0


def read_archives(archives: DataFrame, with_payload: bool = False) -> DataFrame:
    """Rows (page_id, url, payload_bytes, payload_digest, record_type, refers_to, archive) of all records of archives(archive).

    Archives may hold any number of record members and indexes (see places). The places are found first and dealt out by
    stretches of ARCHIVE_BYTES, so that many tasks read a large archive; each reads its records in the order of their
    bytes, whatever the order of the index.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("archive", pa.string())]
    kinds += [("payload", pa.binary())] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, f, read, rows, load = None, None, None, [], 0
        held_start, held_at, held = -1, 0, b""
        try:
            for batch in batches:
                for archive, start, size, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if archive != uri:
                        if f is not None:
                            f.close()
                        uri, held_start = archive, -1
                        f, read = _opened(archive)
                    if start != held_start or offset < held_at or offset + length > held_at + len(held):
                        stretch = ARCHIVE_BYTES - offset % ARCHIVE_BYTES
                        held_start, held_at, held = start, offset, read(start + offset, min(max(length, min(RANGE_BYTES, stretch)), size - offset))
                    record = parse_record(held[offset - held_at : offset - held_at + length])
                    payload = record.pop("payload")
                    load += 1024 + (len(payload or b"") if with_payload else 0)
                    rows.append(record | {"archive": archive} | ({"payload": payload} if with_payload else {}))
                    if load > RANGE_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
                        rows, load = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))
        finally:
            if f is not None:
                f.close()

    sql = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string" + ", payload binary" * with_payload
    readers = min(READERS, max(archives.sparkSession.sparkContext.defaultParallelism, -(-_total_bytes(archives) // ARCHIVE_BYTES)))  # places are small: their own size would leave few tasks
    dealt = located(archives).repartition(readers, "archive", "start", F.floor(F.col("offset") / ARCHIVE_BYTES)).sortWithinPartitions("archive", "start", "offset")
    return dealt.mapInArrow(run, sql)


def verified(archives: DataFrame) -> DataFrame:
    """Rows (archive, member, bytes, ok) of all members of archives(archive): whether each has the checksum that the
    directory names. Each is read whole, by ranges; reading records doesn't need this, as they have checksums of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                f, read = _opened(uri)
                with f:
                    for name, entry in zip_directory(read, f.size()).items():
                        try:
                            ok = all(True for _ in _chunks(read, name, entry))
                        except (ValueError, zlib.error):
                            ok = False
                        yield pa.RecordBatch.from_pylist([{"archive": uri, "member": name, "bytes": entry.stored, "ok": ok}])

    return archives.select("archive").mapInArrow(run, "archive string, member string, bytes long, ok boolean")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0, with_payload: bool = False) -> DataFrame:
    """Writes all pages to archives in the shared checkpoint folder and reads them back; see the two functions.

    Repeated rows each have a record; those that repeat the smallest id of a payload are all responses. An empty table
    makes no archive and gives no rows.
    """
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = cut(write_archives(pages, folder, id_col, url_col, payload_col, least))
    return read_archives(archives, with_payload)
