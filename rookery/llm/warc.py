"""WARC records in ZIP-packaged archives, written by tasks and read back by ranges.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz``, in which each record is
a gzip member of its own, and ``indexes/index.cdxj``, which has each record's offset and length. The reader finds the end
record, follows the ZIP64 locator where sizes demand it, parses the central directory, locates the two members
through their local headers, and range-reads records at the index's offsets; nothing is extracted.

Of rows with equal payloads of at least ``least`` bytes, those with the smallest page_id are responses and the others
revisit it. Null html is the empty payload. A null page_id is never the smallest beside others; where all
rows of a payload have null ids, all are responses, as are repeated rows of the smallest id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import shared_path, stored, table

#: An archive is closed at this many payload bytes or records; the next rows go to another.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64 << 20, 20_000
#: Neighbouring records are read in ranges of about this size.
RANGE_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_SPACE = uuid.UUID("6f1d43ac-8a30-5d0c-9a47-3b62d1a6f0b1")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _line(text: str) -> str:
    """A header value: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id, url: str | None, payload: bytes, first) -> bytes:
    """A record's bytes: a revisit of page ``first`` if given, else a response with the payload."""
    head = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "Payload-Length": str(len(payload)),
    }
    if url is not None:
        head["WARC-Target-URI"] = _line(url)
    if page_id is not None:
        head["Page-ID"] = str(page_id)
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n".encode()
    if first is None:
        block = http + payload
    else:
        block = http
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(_SPACE, str(first))}>", "Refers-To-Page-ID": str(first)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers and its payload, which is empty for revisits."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at the index's offset")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class _Sink:
    """A stream that can only be appended to, so archives may go to any store."""

    def __init__(self, stream):
        self.write, self.flush = stream.write, stream.flush


class ArchiveWriter:
    """One archive, written front to back."""

    def __init__(self, folder: str):
        files, base = _filesystem(folder)
        self.path = f"{folder}/{uuid.uuid4().hex}.zip"
        self.stream = files.open_output_stream(f"{base}/{self.path.rpartition('/')[2]}", compression=None)
        self.zip = zipfile.ZipFile(_Sink(self.stream), "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines, self.offset, self.bytes = [], 0, 0

    def add(self, page_id, url, payload, first) -> None:
        packed = gzip.compress(record(page_id, url, payload, first), 6, mtime=0)
        entry = {"offset": self.offset, "length": len(packed), "filename": DATA}
        self.lines.append(f"{_line(url or '-').replace(' ', '%20')} 19700101000000 {json.dumps(entry)}\n")
        self.data.write(packed)
        self.offset += len(packed)
        self.bytes += len(payload)

    def close(self) -> dict:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "".join(sorted(self.lines)))
        self.zip.close()
        size = self.stream.tell()
        self.stream.close()
        return {"path": self.path, "size": size, "records": len(self.lines)}


class ZipDirectory:
    """The members of a ZIP file, from its central directory, for a ``read(offset, length)`` function."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65_557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        count, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if 0xFFFF == count or 0xFFFFFFFF in (length, offset):
            magic, _, where, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
            if magic != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end = read(where, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = struct.unpack_from("<QQQ", end, 32)
        directory, at, self.members = read(offset, length), 0, {}
        for _ in range(count):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            method, packed, whole, n, m, k = struct.unpack_from("<H8xIIHHH", directory, at + 10)
            (local,) = struct.unpack_from("<I", directory, at + 42)
            name = directory[at + 46 : at + 46 + n].decode()
            extra = directory[at + 46 + n : at + 46 + n + m]
            while len(extra) >= 4:
                kind, wide = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: only the fields that are saturated, in this order
                    values = iter(struct.unpack_from(f"<{wide // 8}Q", extra, 4))
                    whole = next(values) if whole == 0xFFFFFFFF else whole
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    local = next(values) if local == 0xFFFFFFFF else local
                extra = extra[4 + wide :]
            self.members[name] = (method, local, packed)
            at += 46 + n + m + k

    def span(self, name: str) -> tuple[int, int]:
        """Offset and length of a stored member's bytes."""
        method, local, length = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header of {name}")
        n, m = struct.unpack_from("<HH", head, 26)
        return local + 30 + n + m, length


def records_of(read, size: int):
    """Headers and payload of every record of an archive, in file order."""
    directory = ZipDirectory(read, size)
    index_at, index_length = directory.span(INDEX)
    entries = sorted((e["offset"], e["length"]) for e in (json.loads(x[x.index(b"{") :]) for x in read(index_at, index_length).splitlines()))
    data_at, data_length = directory.span(DATA)
    lo = 0
    while lo < len(entries):
        hi, start = lo + 1, entries[lo][0]
        while hi < len(entries) and entries[hi][0] == sum(entries[hi - 1]) and sum(entries[hi]) - start <= RANGE_BYTES:
            hi += 1
        stop = sum(entries[hi - 1])
        if stop > data_length:
            raise ValueError("the index points past its archive member")
        data = read(data_at + start, stop - start)
        for offset, length in entries[lo:hi]:
            yield parse_record(gzip.decompress(data[offset - start : offset - start + length]))
        lo = hi


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archives of all rows in ``folder``, one or more to a task; returns the stored list of them (path, size, records).

    A task that is run again writes new files; only those that a finished task reports count.
    """
    files, base = _filesystem(folder)
    files.create_dir(base, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(firsts.where("n > 1").select("digest", "first"), "digest", "left")
    rows = rows.select("page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("first"))

    def run(batches):
        import pyarrow as pa

        done, writer = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "first"))):
                writer = writer or ArchiveWriter(folder)
                writer.add(*row)
                if writer.bytes >= ARCHIVE_BYTES or len(writer.lines) >= ARCHIVE_RECORDS:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        yield pa.RecordBatch.from_pylist(done, pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return stored(rows.mapInArrow(run, "path string, size bigint, records bigint"), "warc-archives")


def read_archives(archives: DataFrame, id_type: str = "bigint", payloads: bool = True) -> DataFrame:
    """Every record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and, if asked for, payload. A payload that does not have its digest is an error."""
    whole = int if id_type in {"bigint", "int", "smallint", "tinyint"} else str
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]

    def run(batches):
        import pyarrow as pa

        kind = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}.get(id_type, pa.string())
        kinds = [kind, pa.string(), pa.int64(), pa.string(), pa.string(), kind, *([pa.binary()] if payloads else [])]
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                files, base = _filesystem(path)
                with files.open_input_file(base) as f:
                    rows, held = [], 0
                    for head, payload in records_of(lambda at, n: f.read_at(n, at), size):
                        digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
                        if not revisit and (base32_sha1(payload) != digest or len(payload) != int(head["Payload-Length"])):
                            raise ValueError(f"damaged payload in {path}")
                        at, to = head.get("Page-ID"), head.get("Refers-To-Page-ID")
                        row = [at if at is None else whole(at), head.get("WARC-Target-URI"), int(head["Payload-Length"]), digest, head["WARC-Type"], to if to is None else whole(to)]
                        rows.append([*row, None if revisit else payload] if payloads else row)
                        held += len(payload)
                        if held >= RANGE_BYTES or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    tasks = min(20_000, max(1, archives.count()))
    kind = id_type if whole is int else "string"
    schema = f"page_id {kind}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to {kind}" + ", payload binary" * payloads
    return archives.repartition(tasks).mapInArrow(run, schema)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ZIP-packaged WARC archives and back."""
    pages = table(spark, sf_dir, "pages")
    archives = write_archives(pages, shared_path(spark, "warc"))
    return read_archives(archives, pages.schema["page_id"].dataType.simpleString(), payloads=False).drop("url")
