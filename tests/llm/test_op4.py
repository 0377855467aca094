import gzip
import io
import zipfile

import pandas as pd
import pytest
from common import SF, table
from common_sql import rows_of, sorted_rows

from talus.llm import op4_warc as op4
from talus.llm import registry, sql

PAGES = "page_id long, url string, html string"
ROWS = [(3, "http://a/ü\n", "same"), (1, "http://b", "same"), (2, None, None), (4, "x", ""), (5, "y", "big " * 50000), (None, "z", "same"), (1, "http://b2", "same"), (6, "w", "one\r\n\r\ntwo")]


def test_query_equals_sql(spark):
    want = rows_of(sql.OP4_WARC, SF)
    assert sorted_rows(registry.op4_warc(spark, SF), list(want[0])) == want


def test_nulls_ties_repeats_equal_sql(spark, tmp_path):
    table(spark, [(*r, "extra") for r in ROWS], PAGES + ", payload string").write.parquet(f"file://{tmp_path}/pages.parquet")
    frame = pd.DataFrame(ROWS, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"})
    want = rows_of(sql.OP4_WARC, SF, pages=frame)
    assert sorted_rows(registry.op4_warc(spark, f"file://{tmp_path}"), list(want[0])) == want


def test_records_come_back_whole_from_small_packages(spark):
    packages = op4.write_packages(table(spark, ROWS, PAGES).repartition(2), min_bytes=5, records=2)
    assert packages.agg({"n_records": "sum"}).first()[0] == len(ROWS)
    records = op4.read_records(op4.record_ranges(packages)).collect()
    assert all(r.record_type == "response" for r in records)  # equal payloads are shorter than min_bytes
    got = sorted(((r.page_id, r.url, r.payload.decode()) for r in records), key=str)
    assert got == sorted(((i, u, h or "") for i, u, h in ROWS), key=str)


def test_packages_are_readable_by_the_standard_library(spark):
    (path,) = [r.path for r in op4.write_packages(table(spark, ROWS, PAGES).coalesce(1)).collect()]
    with zipfile.ZipFile(path.removeprefix("file://")) as z:
        assert z.testzip() is None
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read("archive/data.warc.gz")).count(b"WARC/1.1\r\n") == len(ROWS)


def test_empty_table(spark):
    packages = op4.write_packages(table(spark, [], PAGES))
    assert op4.resolve(op4.read_records(op4.record_ranges(packages), payloads=False)).count() == 0


def test_zip64_directories_comments_and_damage():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        with z.open("archive/a", "w", force_zip64=True) as m:
            m.write(b"hello")
        z.writestr("indexes/i", "x" * 10, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 a comment that looks like an end"
    raw = buffer.getvalue()
    members = op4._members(io.BytesIO(raw), len(raw))
    method, size, at = members["archive/a"]
    assert (method, raw[at : at + size]) == (0, b"hello") and members["indexes/i"][0] == 8
    # the same package with all values of the directory moved to ZIP64 fields
    import struct

    end = len(raw) - 22 - len(z.comment)
    count, length, start = struct.unpack_from("<10xHLL", raw, end)
    entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 9, 28, 0, 0, 0, 0, 0xFFFFFFFF)
    entry += b"archive/a" + struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    wide = raw[:start] + entry
    wide += struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), start)
    wide += struct.pack("<4sLQL", b"PK\x06\x07", 0, start + len(entry), 1)
    wide += struct.pack("<4s4H2LH", b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert op4._members(io.BytesIO(wide), len(wide)) == {"archive/a": (0, 5, at)}
    with pytest.raises(ValueError):
        op4._members(io.BytesIO(b"no package"), 10)


def foreign(kind, fields, block, version="WARC/1.0"):
    return f"{version}\r\n".encode() + "".join(f"{k}{v}\r\n" for k, v in [("WARC-Type:", kind), *fields, ("Content-Length:", len(block))]).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    import json

    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    records = [
        foreign("warcinfo", [("WARC-Record-ID: ", "<urn:uuid:0>")], b"software: x\r\n"),
        foreign("request", [("WARC-Record-ID:", "<urn:uuid:1>"), ("Content-Type:", "application/http;msgtype=request")], b"GET / HTTP/1.1\r\n\r\n"),
        foreign("response", [("WARC-Record-ID: ", "<urn:uuid:2>"), ("WARC-Target-URI: ", "http://a/x%20y"), ("content-type:", "application/http;\r\n msgtype=response")], http + b"one\r\n\r\ntwo"),
        foreign("revisit", [("WARC-Record-ID: ", "<urn:uuid:3>"), ("WARC-Refers-To: ", "<urn:uuid:2>"), ("Content-Type: ", "application/http")], http),
        foreign("resource", [("WARC-Record-ID: ", "<urn:page:7>"), ("Content-Type: ", "text/plain")], b"\xff\x00 raw"),
    ]
    data, lines = b"", ["!OpenWayback-CDXJ 1.0\n"]
    for k, r in enumerate(records):
        packed = r if k == 4 else gzip.compress(r)
        lines.append(f"a,b)/ 2024 {json.dumps({'filename': 'x.warc.gz', 'offset': str(len(data)), 'length': str(len(packed))})}\n")
        data += packed
    with zipfile.ZipFile(tmp_path / "f.wacz", "w") as z:
        z.writestr("archive/x.warc.gz", data)
        z.writestr("indexes/index.cdx.gz", gzip.compress("".join(lines).encode()), compress_type=zipfile.ZIP_DEFLATED)
        z.writestr("pages/pages.jsonl", "{}")
    ranges = op4.record_ranges(table(spark, [(f"file://{tmp_path}/f.wacz",)], "path string"))
    got = sorted(op4.read_records(ranges).collect(), key=lambda r: r.record_id)
    assert [(r.record_type, r.page_id, r.record_id) for r in got] == [("resource", 7, "<urn:page:7>"), ("warcinfo", None, "<urn:uuid:0>"), ("request", None, "<urn:uuid:1>"), ("response", None, "<urn:uuid:2>"), ("revisit", None, "<urn:uuid:3>")]
    assert bytes(got[0].payload) == b"\xff\x00 raw" and bytes(got[3].payload) == b"one\r\n\r\ntwo"
    assert got[3].url == "http://a/x%20y" and got[3].digest == op4.base32_sha1(b"one\r\n\r\ntwo")
    assert (got[4].digest, got[4].payload, got[4].refers_to_id) == (None, None, "<urn:uuid:2>")
    assert op4.resolve(op4.read_records(ranges, payloads=False)).count() == 2


def test_hot_and_long_payloads_and_clashing_columns_equal_sql(spark, tmp_path):
    rows = [(k, f"u{k}", "" if k % 3 else "hot") for k in range(3000)] + [(k, "v", f"cold {k // 2}") for k in range(3000, 3400)]
    rows += [(9001, "w", "é" * 3_000_000), (9000, "w", "é" * 3_000_000)]
    table(spark, [(*r, "x", 1) for r in rows], PAGES + ", first string, n int").write.parquet(f"file://{tmp_path}/pages.parquet")
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    want = rows_of(sql.OP4_WARC, SF, pages=frame)
    assert sorted_rows(registry.op4_warc(spark, f"file://{tmp_path}"), list(want[0])) == want
