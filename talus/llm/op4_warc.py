"""WARC archives in ZIP packages: a writer, and a reader that reads ranges without extraction.

Writer: pages with equal payloads (at least ``min_bytes`` long) share a digest; the page with the smallest id is written as a
``response`` record, the others as ``revisit`` records that refer to it. Smallest ids are found with combined minima before
the shuffle, and a page's html moves at most once. Each task streams records into packages of at most ``records`` records: a
stored member ``archive/data.warc.gz`` (one gzip member a record), a stored index ``indexes/index.cdxj`` with offsets, and
a description. Files get new names, and only those of tasks that ended well are listed, so a repeated task does no harm.

Reader: finds the end of the central directory from the file's tail, follows the ZIP64 locator where there is one, reads the
central directory, and from local headers the place of stored members. The index gives a range for each record; ranges are
dealt out again, so one large package is read by many tasks, and each record is read alone with its own gzip member.

Archives of other writers are read too: record ids and types are kept as they stand (``page_id`` is null where the id names no
page), fields may lack a space after the colon, go on over lines or be missing, records may be uncompressed, and payloads of
records that are no HTTP messages are their whole blocks. Of revisits without a digest the digest is null.

Files are opened with Arrow's filesystems, so any shared folder whose scheme they know will do. Null html is an empty payload.
Urls with white space
or control characters are percent-encoded, which a field of the record says. A null page_id is written as such and is the smallest of its payload only if no other id is there. Rows that repeat the
smallest id and payload are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.llm.batches import bound_batches, tidy
from talus.llm.skew import join_counted
from talus.llm.storage import keep, new_path

RECORDS = 4000
#: Urls with these signs are percent-encoded, and a field says so.
_ODD_SIGNS = re.compile(r"[\x00-\x20\x7f]|^<|>$")
_SAFE, _ENCODED = "!#$&'()*+,/:;=?@[]~", "X-Target-Encoding"
_PAGE = re.compile("<?urn:page:([0-9]+)>?")
_DATE = "2024-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_RANGES = 50_000  # in a batch
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# writing


def _record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> bytes:
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", _DATE)]
    if url is not None:
        odd = bool(_ODD_SIGNS.search(url))
        head.append(("WARC-Target-URI", quote(url, safe=_SAFE) if odd else url))
        if odd:
            head.append((_ENCODED, "percent"))
    head.append(("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)))
    if revisit:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(first))]
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class _Package:
    """A ZIP package that grows record by record."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open("archive/data.warc.gz", "w", force_zip64=True)
        self.lines: list[str] = []
        self.at = 0

    def add(self, record: bytes, url: str | None, digest: str) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.member.write(packed)
        entry = {"url": url, "digest": digest, "filename": "data.warc.gz", "offset": self.at, "length": len(packed)}
        self.lines.append(f"{quote(url or '-', safe='/:.')} 20240101000000 {json.dumps(entry)}\n")
        self.at += len(packed)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.zip.writestr("indexes/index.cdxj", "".join(sorted(self.lines)))
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": ["archive/data.warc.gz", "indexes/index.cdxj"]}))
        self.zip.close()
        self.out.close()
        return self.path, len(self.lines)


def write_packages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, records: int = RECORDS) -> DataFrame:
    """Write pages (page_id, url, html); returns the packages (path, n_records)."""
    folder = folder or new_path(pages.sparkSession, "packages")
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    known = bound_batches(pages).select("page_id", "url", payload.alias("payload")).withColumn("key", F.sha1("payload"))
    counted = known.where(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = keep(counted.where("n > 1 and first is not null"), "firsts")
    planned = join_counted(known, firsts, "key").select("page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, body, first, revisit = (batch.column(c)[k].as_py() for c in range(5))
                package = package or _Package(folder)
                package.add(_record(page_id, url, body, first, revisit), url, base32_sha1(body))
                if len(package.lines) >= records:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "n_records"])

    return keep(planned.mapInArrow(tidy(write), "path string, n_records long"), "packages")


# reading


def _members(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Name to method, stored size and place of the data, from the central directory."""
    tail_at = max(0, size - 22 - 65535)
    f.seek(tail_at)
    tail = f.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP package")
    count, length, start = struct.unpack_from("<10xHLL", tail, end)
    if end >= 20 and tail[end - 20 : end - 16] == b"PK\x06\x07":
        (where,) = struct.unpack_from("<8xQ", tail, end - 20)
        f.seek(where)
        record = f.read(56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 locator points to no record")
        count, length, start = struct.unpack_from("<32xQQQ", record)
    f.seek(start)
    directory, at, out = f.read(length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, plain, n, extra, comment, offset = struct.unpack_from("<10xH8xLLHHH8xL", directory, at)
        name = directory[at + 46 : at + 46 + n].decode("utf-8", "replace")
        x, last = at + 46 + n, at + 46 + n + extra
        while x + 4 <= last:
            tag, width = struct.unpack_from("<HH", directory, x)
            if tag == 1:  # 64-bit values stand in for those that are all ones, in this order
                p = x + 4
                for field in ("plain", "packed", "offset"):
                    if {"plain": plain, "packed": packed, "offset": offset}[field] == 0xFFFFFFFF:
                        (value,) = struct.unpack_from("<Q", directory, p)
                        p += 8
                        plain, packed, offset = (value if field == "plain" else plain, value if field == "packed" else packed, value if field == "offset" else offset)
            x += 4 + width
        f.seek(offset)
        local = f.read(30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        n_local, extra_local = struct.unpack_from("<26xHH", local)
        out[name] = (method, packed, offset + 30 + n_local + extra_local)
        at = last + comment
    return out


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    f = system.open_input_file(inner)
    return f, f.size()


def record_ranges(packages: DataFrame) -> DataFrame:
    """(path, start, length) of every record that the packages' indexes name; packages: (path)."""

    def ranges_of(path: str, starts: list[int], lengths: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())], names=["path", "start", "length"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                f, size = _open(path)
                with f:
                    members = _members(f, size)
                    for name, (method, packed, at) in members.items():
                        if not name.startswith("indexes/") or "cdx" not in name:
                            continue
                        f.seek(at)
                        lines = f.read(packed)
                        if method == 8:
                            lines = zlib.decompress(lines, -15)
                        if name.endswith(".gz"):
                            lines = gzip.decompress(lines)
                        starts, lengths = [], []
                        for line in io.BytesIO(lines):
                            if b"{" not in line:
                                continue  # a heading
                            entry = json.loads(line[line.index(b"{") :])
                            kind, total, place = members["archive/" + entry["filename"]]
                            if kind != 0:
                                raise ValueError(f"{entry['filename']} is not stored: its records have no ranges")
                            if int(entry["offset"]) + int(entry["length"]) > total:
                                raise ValueError(f"{entry['filename']} is too short for its index")
                            starts.append(place + int(entry["offset"]))
                            lengths.append(int(entry["length"]))
                            if len(starts) == _RANGES:
                                yield ranges_of(path, starts, lengths)
                                starts, lengths = [], []
                        if starts:
                            yield ranges_of(path, starts, lengths)

    return packages.select("path").mapInArrow(tidy(find), "path string, start long, length long")


_FIELDS = "page_id long, url string, record_type string, refers_to long, digest string, payload binary, record_id string, refers_to_id string"


def _header(raw: bytes) -> tuple[dict[str, str], int]:
    """The fields of a record by lower-case name (of equal names the first counts), and where its block begins."""
    end = raw.find(b"\r\n\r\n")
    head = raw if end < 0 else raw[:end]
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        if last in fields:
            last = None  # a field may be repeated; what goes on over lines then belongs to the repeated one
        else:
            fields[last] = value.strip()
    return fields, len(raw) if end < 0 else end + 4


def parse_record(raw: bytes) -> tuple:
    """The columns of read_records() from one record."""
    fields, at = _header(raw)
    size = fields.get("content-length", "")
    block = raw[at : at + int(size)] if size.isdigit() else raw[at:]
    kind, record_id, refers_to = (fields.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to"))
    http = fields.get("content-type", "").lower().startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    page = lambda text: int(m[1]) if text and (m := _PAGE.fullmatch(text)) else None
    stated = fields.get("warc-payload-digest")
    revisit = kind == "revisit"
    url = fields.get("warc-target-uri")
    if url is not None:
        url = unquote(url) if fields.get(_ENCODED.lower()) == "percent" else url.removeprefix("<").removesuffix(">")
    return (
        page(record_id),
        url,
        kind,
        page(refers_to),
        (None if stated is None else stated.rpartition(":")[2]) if revisit else base32_sha1(payload),
        None if revisit else payload,
        record_id,
        refers_to,
    )


def read_records(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of ranges (path, start, length): page_id, url, record_type, refers_to, digest (computed from the payload; of a
    revisit the stated one), payload (null for revisits), or payload_bytes instead, record_id and refers_to_id."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, now = None, None
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                rows = []
                part = batch.slice(k, 200)
                for path, start, length in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                    if path != now:
                        if f:
                            f.close()
                        (f, _), now = _open(path), path
                    f.seek(start)
                    raw = f.read(length)
                    row = parse_record(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
                    rows.append(row if payloads else (*row[:5], None if row[5] is None else len(row[5]), *row[6:]))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary() if payloads else pa.int64(), pa.string(), pa.string()]
                names = ["page_id", "url", "record_type", "refers_to", "digest", "payload" if payloads else "payload_bytes", "record_id", "refers_to_id"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if f:
            f.close()

    schema = _FIELDS if payloads else _FIELDS.replace("payload binary", "payload_bytes long")
    n = ranges.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return ranges.repartition(int(n)).sortWithinPartitions("path", "start").mapInArrow(tidy(read), schema)


def resolve(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of responses and revisits; a revisit's bytes are those
    of what it refers to."""
    records = records.where("record_type in ('response', 'revisit')")
    held = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    joined = records.join(held, (F.col("refers_to") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
