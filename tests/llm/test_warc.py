import base64
import collections
import gzip
import hashlib
import os

from tessera.llm import warc as A
from tests.oracle import connect, rows_of, rows_of_sql

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string, archive string, offset string, sha string"
ODD = [
    (1, "http://a.b/x", None),
    (2, "http://a.b/x", ""),
    (3, None, "<p>é\r\n\r\n"),
    (4, "http://[bad", "<p>é\r\n\r\n"),
    (5, "HTTP://A.b:8080/q?x=1#f", "z" * 300_000),
    (5, "http://a.b/ y\n\t", "same"),
    (6, "http://ü.de", "same"),
    (6, "http://ü.de", "same"),
    (None, "", "same"),
    (None, None, "alone"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine", "mine") for r in rows], PAGES)


def brute(rows):
    top = collections.defaultdict(lambda: None)
    for i, _, h in rows:
        h = h or ""
        top[h] = i if top[h] is None else max(top[h], i if i is not None else top[h])
    out = []
    for i, _, h in rows:
        p = (h or "").encode()
        response = i == top[h or ""]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else top[h or ""]))
    return sorted(out, key=str)


def round_trip(frame):
    archive = A.write(frame)
    got = A.read(archive, A.lookup(archive, frame))
    return archive, got


def test_odd_rows(spark):
    _, got = round_trip(pages(spark, ODD))
    assert sorted((tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == brute(ODD)


def test_payloads_come_back(spark):
    archive, got = round_trip(pages(spark, ODD))
    held = {r.page_id: bytes(r.payload) for r in got.collect() if r.record_type == "response"}
    assert held[4] == "<p>é\r\n\r\n".encode() and held[2] == b"" and len(held[5]) == 300_000
    folder = archive.path.removeprefix("file://")
    files = [f for f in os.listdir(folder) if f.endswith(".warc.gz")]
    raw = b"".join(gzip.open(os.path.join(folder, f)).read() for f in files)
    assert raw.count(b"WARC/1.1\r\n") == len(ODD)


def test_many_blocks_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK_LINES", 4)
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 600)
    rows = [(i, f"http://h{i % 3}.org/{i % 5}", f"p{i % 11}") for i in range(60)] + [(7, "http://h1.org/2", f"q{i}") for i in range(13)]
    archive, got = round_trip(pages(spark, rows))
    assert archive.blocks().count() > 10
    assert got.count() == 73
    some = pages(spark, [(7, "http://h1.org/2", ""), (3, "http://none.org", ""), (8, "http://h1.org/2", "")])
    assert A.lookup(archive, some).count() == 14 - (7 % 3 != 1 or 7 % 5 != 2) + (8 % 3 == 1 and 8 % 5 == 2)


def test_nothing(spark):
    archive, got = round_trip(pages(spark, []))
    assert got.count() == 0
    assert A.lookup(archive, pages(spark, ODD)).count() == 0


def test_keys_sort_by_domain():
    assert A.url_key("http://www.Example.org/a?b#c") == "org,example,www)/a?b"
    assert A.url_key("https://example.org:443") == "org,example)/"
    assert A.url_key(None) == "-"
    assert "\n" not in A.url_key("http://a/\n\t x")


def test_matches_sql(spark):
    assert rows_of(A.op7_warc(spark, SF)) == rows_of_sql(connect(SF), A.OP7_SQL)
