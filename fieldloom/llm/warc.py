"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package is a ZIP file with two stored members: archive/data.warc.gz, a gzip member a record, and indexes/index.cdxj,
a line a record with its offset and length in that member. The reader takes the tail of a package, its central
directory (ZIP64 or not) and the local headers, then reads just the byte ranges that the index names. Packages lie in
the shared folder and are opened through pyarrow's file systems, so a task reads ranges of local, HDFS or object storage.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD_SCHEMA = "uri string, offset long, record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
_PAGE = "urn:page:"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _header(name: str, fields: dict[str, str]) -> bytes:
    return "".join([name, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items()), "\r\n"]).encode()


def _clean(uri: str | None) -> str:
    """A URI that fits one header line: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else "urn:unknown"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, dict]:
    """A response, or a revisit without its payload; and what the index says of it."""
    digest, kind = base32_sha1(payload), "response" if refers_to is None else "revisit"
    block = _header("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(payload))})
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{_PAGE}{page_id}>", "WARC-Date": date, "WARC-Target-URI": _clean(url), "WARC-Payload-Digest": f"sha1:{digest}"}
    if refers_to is None:
        block += payload
    else:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{_PAGE}{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return _header("WARC/1.1", fields) + block + b"\r\n\r\n", {"url": fields["WARC-Target-URI"], "type": kind, "digest": digest}


class PackageWriter:
    """One package; records stream into it and only its index is held."""

    def __init__(self, uri: str):
        self.uri, self.index, self.at = uri, [], 0
        filesystem, path = pafs.FileSystem.from_uri(uri)
        filesystem.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = filesystem.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)

    def add(self, data: bytes, about: dict, level: int) -> None:
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed = z.compress(data) + z.flush()
        self.data.write(packed)
        self.index.append(json.dumps(about | {"offset": self.at, "length": len(packed)}))
        self.at += len(packed)

    def close(self) -> None:
        self.data.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            for line in self.index:
                f.write(line.encode() + b"\n")
        self.zip.close()
        self.out.close()


def write_packages(pages: DataFrame, folder: str, *, package_bytes: int = 64 << 20, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes rows (page_id, url, payload binary, refers_to) as packages; returns stored (uri, n_records).

    Names are new for each attempt of a task, and only packages that a finished attempt reports count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None

        def done() -> pa.RecordBatch:
            package.close()
            return pa.RecordBatch.from_pylist([{"uri": package.uri, "n_records": len(package.index)}])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in batch.columns)
                package = package or PackageWriter(f"{folder}/{uuid.uuid4().hex}.wacz")
                package.add(*record(page_id, url, payload or b"", refers_to, date), level)
                if package.at >= package_bytes:
                    yield done()
                    package = None
        if package:
            yield done()

    return stored(pages.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "uri string, n_records long"), "packages")


class PackageReader:
    """Range reads in one ZIP package with stored members."""

    def __init__(self, uri: str):
        filesystem, path = pafs.FileSystem.from_uri(uri)
        self.file = filesystem.open_input_file(path)
        self.size = self.file.size()
        self.members = self._directory()

    def close(self) -> None:
        self.file.close()

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise ValueError(f"range {at}+{n} lies outside a package of {self.size} bytes")
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name: method, size, offset of the local header."""
        n = min(self.size, 22 + 65535 + 20)
        tail = self.read(self.size - n, n)
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of central directory: not a ZIP package or cut short")
        disk, _, _, entries, length, start = struct.unpack("<HHHHII", tail[end + 4 : end + 20])
        if 0xFFFF in (disk, entries) or 0xFFFFFFFF in (length, start) or tail[max(0, end - 20) : end][:4] == b"PK\x06\x07":
            if tail[end - 20 : end - 16] != b"PK\x06\x07":
                raise ValueError("ZIP64 locator is missing")
            (at,) = struct.unpack("<Q", tail[end - 12 : end - 4])
            big = self.read(at, 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("ZIP64 end record is missing")
            entries, length, start = struct.unpack("<QQQ", big[32:56])
        data, at, out = self.read(start, length), 0, {}
        for _ in range(entries):
            if data[at : at + 4] != b"PK\x01\x02":
                raise ValueError("central directory is broken")
            method, packed, size, n_name, n_extra, n_note, local = struct.unpack("<10xH8xIIHHH8xI", data[at : at + 46])
            name = data[at + 46 : at + 46 + n_name].decode()
            extra, e = data[at + 46 + n_name : at + 46 + n_name + n_extra], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack("<HH", extra[e : e + 4])
                if kind == 1:  # ZIP64: the fields that overflowed, in this order
                    wide = list(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                    size = wide.pop(0) if size == 0xFFFFFFFF else size
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    local = wide.pop(0) if local == 0xFFFFFFFF else local
                e += 4 + n
            out[name] = (method, packed, local)
            at += 46 + n_name + n_extra + n_note
        return out

    def member(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the package, and how many there are."""
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self.read(local, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"no local header for {name}")
        return local + 30 + sum(struct.unpack("<HH", head[26:30])), size

    def index(self) -> list[dict]:
        return [json.loads(x) for x in self.read(*self.member(INDEX)).splitlines()]

    def records(self, lines: list[dict], gulp: int = 4 << 20) -> Iterator[tuple[int, bytes]]:
        """(offset, record) of index lines; neighbours are fetched in one read of about ``gulp`` bytes."""
        start, size = self.member(DATA)
        i = 0
        while i < len(lines):
            j, first = i + 1, lines[i]["offset"]
            while j < len(lines) and lines[j]["offset"] == lines[j - 1]["offset"] + lines[j - 1]["length"] and lines[j]["offset"] + lines[j]["length"] - first <= gulp:
                j += 1
            if lines[j - 1]["offset"] + lines[j - 1]["length"] > size:
                raise ValueError("the index points beyond its archive")
            block = self.read(start + first, lines[j - 1]["offset"] + lines[j - 1]["length"] - first)
            for line in lines[i:j]:
                at = line["offset"] - first
                yield line["offset"], zlib.decompress(block[at : at + line["length"]], 31)
            i = j


def _fields(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = block.partition(b"\r\n\r\n")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}, rest


def parse_record(data: bytes) -> dict:
    warc, rest = _fields(data)
    http, payload = _fields(rest[: int(warc["content-length"])])

    def page(field: str) -> int | None:
        x = warc.get(field, "").strip("<>").removeprefix(_PAGE)
        return int(x) if re.fullmatch(r"-?\d+", x) else None

    revisit, stated = warc["warc-type"] == "revisit", warc["warc-payload-digest"].removeprefix("sha1:")
    if not revisit and base32_sha1(payload) != stated:
        raise ValueError(f"payload of {warc['warc-record-id']} does not match its digest")
    return {
        "record_type": warc["warc-type"],
        "record_id": warc["warc-record-id"],
        "target_uri": warc.get("warc-target-uri"),
        "page_id": page("warc-record-id"),
        "refers_to": page("warc-refers-to"),
        "payload_digest": stated,
        "payload_bytes": int(http["content-length"]) if revisit else len(payload),
        "payload": None if revisit else payload,
    }


def read_packages(packages: DataFrame, *, slice_records: int = 500) -> DataFrame:
    """All records of packages (uri, n_records) as RECORD_SCHEMA; a task reads slices of slice_records records.

    A revisit has no payload; its payload_bytes are the length that its HTTP header states. Broken packages raise.
    """
    schema = pa.schema([("uri", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                package = PackageReader(uri)
                rows, held = [], 0
                for offset, data in package.records(package.index()[first : first + slice_records]):
                    rows.append({"uri": uri, "offset": offset} | parse_record(data))
                    held += len(data)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)
                package.close()

    step = F.sequence(F.lit(0), F.col("n_records").cast("int") - 1, F.lit(slice_records))
    slices = packages.filter("n_records > 0").select("uri", F.explode(step).alias("first"))
    # Slices are tiny rows that stand for much work, so their number, not their bytes, sets the number of tasks.
    total = packages.agg(F.sum("n_records")).first()[0] or 0
    return slices.repartition(max(1, -(-total // (4 * slice_records))), "uri", "first").mapInArrow(read, RECORD_SCHEMA)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): of equal payloads of at least least_bytes, the largest page_id's is no revisit.

    Null html is an empty payload. Null ids are smaller than others; a group of null ids only has no revisit. Rows that
    repeat the id which the others revisit are responses like it.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    groups = stored(groups.filter("n > 1 and top is not null"), "payloads")
    hot = groups.filter(F.col("n") >= F.greatest(F.lit(1000), F.lit(rows.count() // 1000)))  # at most 1000 payloads, by counting
    marked = rows.join(F.broadcast(hot.select("digest", F.col("top").alias("hot_top"))), "digest", "left")
    cold = groups.join(F.broadcast(hot.select("digest")), "digest", "left_anti").select("digest", F.col("top").alias("cold_top"))
    # Rows of hot payloads have found their page; a salted key spreads them over the join.
    marked = marked.withColumn("k", F.when(F.col("hot_top").isNull(), F.col("digest")).otherwise(F.concat_ws(":", F.lit("hot"), "page_id")))
    found = marked.join(cold.withColumnRenamed("digest", "k"), "k", "left")
    top = F.coalesce("hot_top", "cold_top")
    return found.select("page_id", "url", "payload", F.when(~top.eqNullSafe(F.col("page_id")), top).alias("refers_to"))


def archive_round_trip(pages: DataFrame, spark: SparkSession, **options) -> DataFrame:
    """Writes pages as packages into the shared folder and returns the records read back from them."""
    folder = scratch_path(spark, "wacz")
    folder = folder if "://" in folder else f"file://{folder}"
    return read_packages(write_packages(with_revisits(pages, **options), folder))


ORACLE = None  # base32 has no SQL function; see tests
