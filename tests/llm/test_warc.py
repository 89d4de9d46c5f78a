import base64
import gzip
import hashlib
import io
import random
import struct
import zipfile

import pytest

from rookery.llm import warc


def brute(rows, least):
    out, firsts = [], {}
    for page, _, html in rows:
        p = (html or "").encode()
        if page is not None:
            firsts[p] = min(firsts.get(p, page), page)
    for page, _, html in rows:
        p = (html or "").encode()
        first = firsts.get(p)
        revisit = len(p) >= least and first is not None and page != first
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def through(spark, rows, least=0):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    archives = warc.write_archives(pages, warc.shared_path(spark, "warc-test"), least)
    return archives, warc.read_archives(archives)


@pytest.mark.parametrize("least", [0, 8])
def test_round_trip(spark, least):
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 7}/a b?{i}" if i % 5 else None, rng.choice(["", None, "<p>été</p>", "<b>" + "x" * rng.randrange(50), "\r\n\r\nWARC/1.1\r\n"]), 1) for i in rng.sample(range(1000), 200)]
    rows += [(5000, "u\nv\x01", "y" * 3_000_000, 1), (5001, "", "𝒳", 1), (None, "n", "only here", 1), (None, "n", "y" * 3_000_000, 1)]
    rows = [(*r[:3], 1) for r in rows]
    _, back = through(spark, rows, least)
    got = back.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute([r[:3] for r in rows], least)
    payloads = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert all(base64.b32encode(hashlib.sha1(p).digest()).decode() == d for d, p in payloads.items())
    assert {r.payload_digest for r in got} == set(payloads)


def test_archives_are_zip_files_of_stored_members(spark):
    archives, _ = through(spark, [(i, f"http://h/{i}", f"<p>{i % 3}</p>", 1) for i in range(10)])
    n = 0
    for r in archives.collect():
        with zipfile.ZipFile(r.path.removeprefix("file://").removeprefix("file:")) as z:
            assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
            data = gzip.decompress(z.read(warc.DATA))
            n += data.count(b"WARC/1.1\r\n")
            assert len(z.read(warc.INDEX).splitlines()) == r.records
    assert n == 10


def zip64(content: bytes) -> bytes:
    """An archive whose sizes and offsets are all in ZIP64 fields, as very large ones have them."""
    name = b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, len(content), len(content))
    body = b"junk" + local + content
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, len(content), len(content), 4)
    end = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(body))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(body) + len(central), 1)
    return body + central + end + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


def test_zip64_directories():
    raw = zip64(b"some bytes")
    directory = warc.ZipDirectory(lambda at, n: raw[at : at + n], len(raw))
    at, n = directory.span("m")
    assert raw[at : at + n] == b"some bytes"


def test_damaged_and_compressed_archives_are_errors():
    with pytest.raises(ValueError):
        warc.ZipDirectory(lambda at, n: b"x" * n, 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "a" * 100)
    raw = out.getvalue()
    with pytest.raises(ValueError):
        warc.ZipDirectory(lambda at, n: raw[at : at + n], len(raw)).span("m")


def test_empty_table_and_repeated_rows(spark):
    assert through(spark, [])[1].count() == 0
    got = [(r.page_id, r.record_type) for r in through(spark, [(1, None, "a", 1), (1, None, "a", 1), (2, None, "a", 1)])[1].collect()]
    assert sorted(got) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_the_query_agrees_with_its_sql(spark):
    import duckdb

    from rookery.llm.catalog import ORACLES

    con = duckdb.connect()
    con.execute("create view pages as select * from read_parquet('/root/testdata/sf0.001/pages.parquet')")
    found = con.execute(ORACLES["op6_warc"])
    names = [c[0] for c in found.description]
    got = warc.op6_warc(spark, "/root/testdata/sf0.001")
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(found.fetchall())
