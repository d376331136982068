import gzip
import hashlib
import zlib

import pytest

from lexmill.llm import warc
from lexmill.operators.ranking import scratch_path
from tests.llm.conftest import rows

SCHEMA = "page_id long, url string, html string, kind string, digest string"


def test_round_trip(spark):
    long = "é" * 40_000 + "WARC/1.1\r\n\r\n" + "x" * 70_000
    pages = [
        (5, "http://a", long), (3, "http://b", long), (9, "http://c", long), (1, None, None), (2, "u\r\nX: y", ""),
        (4, "s", "short"), (6, "s", "short"), (7, "e", "y" * 100), (7, "e", "y" * 100), (8, "e", "y" * 100), (None, "n", "y" * 100),
    ]
    path = scratch_path(spark)
    warc.write_archives(spark.createDataFrame([(*p, "k", "d") for p in pages], SCHEMA), path)
    found = warc.read_archives(spark, path)
    expected = []
    for page_id, _, html in pages:
        body = (html or "").encode()
        same = [p for p, _, h in pages if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 100 and page_id != min(same)
        expected.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(found, *names) == sorted(expected, key=repr)
    payloads = {r["page_id"]: bytes(r["payload"]) for r in found.where("record_type = 'response'").collect()}
    assert payloads[3] == long.encode() and payloads[1] == b""


def test_empty(spark):
    path = scratch_path(spark)
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert rows(warc.read_archives(spark, path)) == []


def test_segments_and_framing():
    parts = list(warc.records("urn:page:1:0", 1, "u", b"z" * 50_000, "0" * 64, None))
    assert len(parts) == -(-len(warc.chunked(b"z" * 50_000)) // warc.SEGMENT_BYTES) > 2
    parsed = list(warc.parse(b"".join(parts)))
    assert [p[6] for p in parsed] == list(range(1, len(parts) + 1)) and {p[1] for p in parsed} == {"urn:page:1:0"}
    assert [p[7] for p in parsed[:-1]] == [None] * (len(parts) - 1) and parsed[-1][7] == sum(len(p[8]) for p in parsed)
    for payload in (b"", b"a", b"\r\n0\r\n\r\n", bytes(range(256)) * 70):
        assert warc.dechunked(warc.chunked(payload)) == payload
    for broken in (b"5\r\nab\r\n0\r\n\r\n", b"1\r\na\r\n0\r\n\r\nx", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.dechunked(broken)


def test_missing_segment_fails(spark):
    path = scratch_path(spark)
    parts = list(warc.records("urn:page:1:0", 1, "u", b"z" * 50_000, hashlib.sha256(b"z" * 50_000).hexdigest(), None))
    text = b"".join(parts[:1] + parts[2:]).decode()[:-1]
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_archives(spark, path).collect()


def test_revisits_name_a_written_record(spark):
    path = scratch_path(spark)
    pages = [(3, "http://b", "y" * 200), (5, "http://a", "y" * 200), (6, None, "y" * 200), (7, "x", "z")]
    warc.write_archives(spark.createDataFrame([(*p, "k", "d") for p in pages], SCHEMA), path)
    content = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect() if "part-" in r.path)
    found = warc.read_archives(spark, path).collect()
    written = {r["origin"]: r["page_id"] for r in found if r["record_type"] == "response"}
    assert [written[r["refers_to_record"]] for r in found if r["record_type"] == "revisit"] == [3, 3]
    assert gzip.decompress(content).count(b"WARC-Refers-To-Target-URI: http://b\r\nWARC-Refers-To-Date: ") == 2
    # Every record is a member of its own.
    members = 0
    while content:
        unpacker = zlib.decompressobj(wbits=31)
        assert unpacker.decompress(content).startswith(b"WARC/1.1\r\n") and unpacker.eof
        content, members = unpacker.unused_data, members + 1
    assert members == 4


def foreign(kind, record_id, block, *headers):
    lines = [b"WARC/1.0", b"warc-type: " + kind, b"Warc-Record-Id: <" + record_id + b">", *headers, b"content-length:%d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    html = b"<html>" + b"w" * 300
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    records = [
        foreign(b"warcinfo", b"urn:uuid:0", b"software: x\r\nformat: WARC 1.0\r\n", b"WARC-Filename: a\r\n  b"),
        foreign(b"request", b"urn:uuid:1", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        foreign(b"response", b"urn:uuid:2", http + b"content-length: 306\r\n\r\n" + html, b"WARC-Payload-Digest: sha1:ABC"),
        foreign(b"response", b"urn:uuid:3", http + b"\r\n" + html[:9]),
        foreign(b"response", b"urn:uuid:4", http + b"Transfer-Encoding: Chunked\r\n\r\n" + b"3;x=1\r\nabc\r\n0\r\n\r\n"),
        foreign(b"revisit", b"urn:uuid:5", http + b"\r\n", b"WARC-Refers-To: <urn:uuid:2>"),
        foreign(b"metadata", b"urn:uuid:6", b"a: b", b"WARC-Segment-Number: 1"),
        foreign(b"continuation", b"urn:uuid:7", b"c", b"WARC-Segment-Origin-ID: <urn:uuid:6>", b"WARC-Segment-Number: 2", b"WARC-Segment-Total-Length: 5"),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    one = [r.replace(b"urn:uuid:", b"urn:uuid:one") for r in records]
    (tmp_path / "one.warc.gz").write_bytes(gzip.compress(b"".join(one)))
    many = [r.replace(b"urn:uuid:", b"urn:uuid:many") for r in records]
    (tmp_path / "many.warc.gz").write_bytes(b"".join(map(gzip.compress, many)))
    (tmp_path / "notes.txt").write_text("no archive")
    expected = []
    for name in ("", "one", "many"):
        payloads = ((2, html), (3, html[:9]), (4, b"abc"))
        expected += [(f"urn:uuid:{name}{k}", "response", p, hashlib.sha256(p).hexdigest(), None, None) for k, p in payloads]
        expected.append((f"urn:uuid:{name}5", "revisit", None, None, None, f"urn:uuid:{name}2"))
    found = warc.read_archives(spark, str(tmp_path)).collect()
    told = [(r["origin"], r["record_type"], r["payload"] and bytes(r["payload"]), r["payload_digest"], r["page_id"], r["refers_to_record"]) for r in found]
    assert sorted(told, key=repr) == sorted(expected, key=repr)
    assert {r["refers_to"] for r in found} == {None}
