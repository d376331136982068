"""WARC archives: segmented, chunk-framed records are written and put together again.

``write_archives`` turns rows into WARC/1.1 records.  A payload travels as an HTTP message with
chunked transfer framing; a message longer than one segment is continued in ``continuation`` records
that name the origin's identifier and their segment number, and the last one states the total length.
Spark's text writer stores the records, each compressed as a gzip member of its own, so the archives lie where Spark's file systems
reach.  ``read_archives`` parses each file, groups segments by origin identifier, orders them by
segment number, verifies numbers and total length, and decodes the chunked framing.

Of rows with equal payloads of at least ``MIN_REVISIT`` bytes the one with the smallest id is the
response; the others become revisit records without a payload that refer to its record.

Archives of other writers are read as well: header names in any case, records of other types (left out), bodies
without framing, one or many gzip members, digests by other functions (not verified).  What only our records tell, the
page id and the page that a revisit refers to, is NULL then.

Defined cases: a NULL payload is empty; rows with a NULL id are written as well, and are the response
of a group only if it holds no other id; rows with one id and one payload (repeats) are written each,
and the smallest id is written as response each time; other columns are ignored; a broken record
(missing segment, wrong length, bad framing) makes the read fail with the record's identifier; a very long payload is many
segments, put together in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import pin, read
from lexmill.operators.ranking import scratch_path

MIN_REVISIT = 100
#: Bytes of a message in one record; longer messages are continued.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: Records of one archive file; a record holds one segment, so a file is bounded by the product.
FILE_RECORDS = 1024
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id long, origin string, kind string, digest string, refers_to string, length long, segment int, total long, block binary"
#: Types that hold a payload or stand for one; OTHER names the rest, and sorts before them and after their continuations.
OTHER, WANTED = "other", ("continuation", "response", "revisit")
_OWN_ID = re.compile(r"urn:page:(-?\d+):\d+")


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%s\r\n" % (len(part), part) for part in parts) + b"0\r\n\r\n"


def dechunked(framed: bytes) -> bytes:
    """The payload of a chunk-framed body; ValueError where the framing is broken."""
    at, out = 0, []
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        part = framed[end + 2 : end + 2 + size]
        if len(part) != size or framed[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        if not size:
            if end + 4 != len(framed):
                raise ValueError("bytes after the last chunk")
            return b"".join(out)
        out.append(part)
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _uri(url: str | None) -> str | None:
    return re.sub(r"[\r\n]", "", url) if url is not None else None


def records(origin: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: dict | None) -> Iterator[bytes]:
    """The records of one page; ``first`` is the response (page_id, number, url) that a revisit refers to."""
    base = [
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", page_id),
    ]
    if first is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        own = [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", f"<{origin}>"),
            ("WARC-Profile", profile),
            ("WARC-Refers-To", f"<urn:page:{first['page_id']}:{first['number']}>"),
            ("WARC-Refers-To-Target-URI", _uri(first["url"])),
            ("WARC-Refers-To-Date", DATE),
        ]
        yield _record(own + base, head)
        return
    message = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [message[at : at + SEGMENT_BYTES] for at in range(0, len(message), SEGMENT_BYTES)]
    for number, piece in enumerate(pieces, 1):
        if number == 1:
            own = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{origin}>"), *base]
        else:
            own = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<{origin}:{number}>"),
                ("WARC-Date", DATE),
                ("WARC-Segment-Origin-ID", f"<{origin}>"),
            ]
        if len(pieces) > 1:
            own.append(("WARC-Segment-Number", number))
        if number == len(pieces) > 1:
            own.append(("WARC-Segment-Total-Length", len(message)))
        yield _record(own, piece)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url") -> None:
    """Write ``pages`` as compressed WARC files under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    # The number is that of the row in its part of the scan, the same each time it is read.
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    known = rows.where(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
    # Only payloads that occur under several ids; small as a rule, so Spark broadcasts it by its file size.
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "number", "url"))).alias("first")
    firsts = pin(known.agg(least, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    told = rows.join(firsts, "digest", "left")
    told = told.withColumn(
        "first", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id")), F.col("first"))
    ).select("page_id", "url", "payload", "digest", "first", "number")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for page_id, url, body, digest, first, number in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    origin = f"urn:record:{number}" if page_id is None else f"urn:page:{page_id}:{number}"
                    # The writer ends each value with a zero byte: the last one of a member of less than 16 MB.
                    out += [gzip.compress(r, mtime=0)[:-1] for r in records(origin, page_id, url, body, digest, first)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    packed = told.mapInArrow(pack, "record binary").select(F.col("record").cast("string").alias("value"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(archive: bytes) -> Iterator[tuple]:
    """Rows of RECORDS for the records of one archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        head = _fields(lines)
        size = int(head["content-length"])
        block = archive[end + 4 : end + 4 + size]
        if archive[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"{head['warc-record-id']} is cut off")
        at = end + 8 + size
        kind, length = head["warc-type"].lower(), None
        if kind not in WANTED:
            if "warc-segment-number" not in head:
                continue
            kind, block = OTHER, None  # its continuations have to be left out as well
        if kind == "revisit":
            told = http_message(block)[0].get("content-length")
            length, block = int(told) if told and told.isdigit() else None, None
        yield (
            int(head["x-page-id"]) if "x-page-id" in head else None,
            head.get("warc-segment-origin-id", head["warc-record-id"]).strip("<>"),
            kind,
            head.get("warc-payload-digest"),
            head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
            length,
            int(head.get("warc-segment-number", 1)),
            int(head["warc-segment-total-length"]) if "warc-segment-total-length" in head else None,
            block,
        )


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with a blank goes on with the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def http_message(message: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields of an HTTP message and its body as sent; a message without header end is all body."""
    end = message.find(b"\r\n\r\n")
    if end < 0 or not message.startswith(b"HTTP/"):
        return {}, message
    return _fields(message[:end].decode("latin-1").split("\r\n")[1:]), message[end + 4 :]


def payload_of(message: bytes) -> bytes:
    """The body of an HTTP message without its transfer framing."""
    fields, body = http_message(message)
    if "chunked" in fields.get("transfer-encoding", "").lower():
        return dechunked(body)
    length = fields.get("content-length", "")
    return body[: int(length)] if length.isdigit() else body


def _checked(condition: Column, message: str, origin: Column) -> Column:
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(message), origin)))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, origin, record_type, payload_digest, refers_to, refers_to_record, payload, payload_bytes) of whole records.

    Files are taken by name: ``part-*`` of our writer, and ``*.warc`` and ``*.warc.gz``.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"/part-[^/]*$|\.warc(\.gz)?$")).select("content")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_py()
                rows = list(parse(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                for at in range(0, len(rows), 64):
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows[at : at + 64]), types)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [part.split()[0] for part in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    found = files.mapInArrow(unpack, RECORDS)
    # A group is one page: the segments of one payload, or one revisit record.
    segments = F.sort_array(F.collect_list(F.struct("segment", "total", "block")))
    whole = found.groupBy("origin").agg(
        *(F.max(name).alias(name) for name in ("page_id", "kind", "digest", "refers_to", "length")),
        segments.alias("segments"),
    ).where(F.col("kind") != OTHER)
    numbers = F.transform("segments", lambda s: s["segment"])
    total = F.element_at("segments", -1)["total"]
    length = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.octet_length(s["block"]))
    alone = (F.size("segments") == 1) & total.isNull()
    complete = (numbers == F.sequence(F.lit(1), F.size("segments"))) & (alone | F.coalesce(total == length, F.lit(False)))
    whole = whole.where(_checked(complete, "segments are missing: ", F.col("origin")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bodies, sizes, digests, referred = [], [], [], []
                for origin, kind, digest, target, size, pieces in zip(
                    *(part.column(n).to_pylist() for n in ("origin", "kind", "digest", "refers_to", "length", "segments"))
                ):
                    body = None
                    told = (digest or "").removeprefix("sha256:") if (digest or "").startswith("sha256:") else None
                    if kind != "revisit":
                        body = payload_of(b"".join(piece["block"] for piece in pieces))
                        size, own = len(body), hashlib.sha256(body).hexdigest()
                        if told not in (None, own):
                            raise ValueError(f"{origin} does not have its digest")
                        told = own
                    bodies.append(body)
                    sizes.append(size)
                    digests.append(told or digest)
                    page = _OWN_ID.fullmatch(target or "")
                    referred.append(int(page[1]) if page else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(n) for n in ("page_id", "origin", "kind")),
                        pa.array(digests, pa.string()),
                        pa.array(referred, pa.int64()),
                        part.column("refers_to"),
                        pa.array(bodies, pa.binary()),
                        pa.array(sizes, pa.int64()),
                    ],
                    names=out,
                )

    out = ["page_id", "origin", "record_type", "payload_digest", "refers_to", "refers_to_record", "payload", "payload_bytes"]
    return whole.mapInArrow(
        decode,
        "page_id long, origin string, record_type string, payload_digest string, refers_to long, refers_to_record string, "
        "payload binary, payload_bytes long",
    )


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, from the archives that hold it."""
    path = scratch_path(spark)
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (
    select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
    from pages
), f as (
    select *, min(page_id) over (partition by payload_digest) as first from p
)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= 100 and page_id is distinct from first then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= 100 and page_id is distinct from first then first end as refers_to
from f
"""
