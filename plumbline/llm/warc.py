"""WARC archives: segmented, chunk-framed records, written and reassembled.

Writing: a page's payload is an HTTP body in chunked transfer framing. A record whose block exceeds the
segment size becomes a first segment and continuation records that name the first one's id. Of pages with
equal payloads one is a ``response`` and the others ``revisit`` it without a payload.

Reading: archives are read as records between the separators of the format, so large files are split and only
single records are held. Whole records are decoded where they are read; only segments are shuffled, grouped by
origin id, ordered by segment number, checked to be complete and of the declared total length, then decoded.
Segments and responses of a revisited payload are joined by keys dealt over sub-keys.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.util import lookup, salt, stored, whole_text, with_group
from plumbline.sources.tables import scratch_path

VERSION = b"WARC/1.1\r\n"
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def frame(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing. Chunks also end inside any ``WARC/``, so no framed body holds a record separator."""
    out = []
    for part in _cut(payload):
        out += [part[i:i + size] for i in range(0, len(part), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in out) + b"0\r\n\r\n"


def _cut(payload: bytes) -> list[bytes]:
    out, at = [], 0
    while (hit := payload.find(b"WARC/", at)) >= 0:
        out.append(payload[at:hit + 4])
        at = hit + 4
    return [*out, payload[at:]]


def unframe(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped. ValueError if it is cut off."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut off")
        out.append(body[at:at + size])
        at += size + 2


def _header(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + lines.encode("utf-8") + b"Content-Length: %d\r\n\r\n" % len(block)


def _value(text: str | None) -> str | None:
    """A header value: control characters are percent-encoded."""
    return None if text is None else "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in text)


def records(page: dict, segment_bytes: int) -> Iterator[bytes]:
    """The records of one page. The last line end of a record is left to the writer of lines."""
    payload = page["payload"]
    fields = [
        ("WARC-Record-ID", f"<urn:uuid:{page['uuid']}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _value(page["url"])),
        ("WARC-Payload-Digest", "sha1:" + digest(payload)), ("X-Page-Id", None if page["page_id"] is None else str(page["page_id"])),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page["revisits"]:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(page["refers_to"]))]
        yield _header([("WARC-Type", "revisit"), *fields], HTTP) + HTTP + b"\r\n\r"
        return
    block = HTTP + frame(payload)
    cuts = range(0, len(block), segment_bytes)
    if len(cuts) == 1:
        yield _header([("WARC-Type", "response"), *fields], block) + block + b"\r\n\r"
        return
    for k, at in enumerate(cuts):
        part = block[at:at + segment_bytes]
        own = [("WARC-Type", "response"), ("WARC-Segment-Number", "1"), *fields] if k == 0 else [
            ("WARC-Type", "continuation"), ("WARC-Segment-Number", str(k + 1)), ("WARC-Record-ID", f"<urn:uuid:{page['uuid']}-{k + 1}>"), ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", fields[0][1]), ("WARC-Target-URI", _value(page["url"])),
            ("WARC-Segment-Total-Length", str(len(block)) if k == len(cuts) - 1 else None)]
        yield _header(own, part) + part + b"\r\n\r"


def _batches(rows: Iterator[tuple], schema: pa.Schema, heavy: int) -> Iterator[pa.RecordBatch]:
    """Record batches that end after about 8 MB of column ``heavy``."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[heavy] or b"")
        if size > 8_000_000 or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = 0) -> str:
    """Write one response or revisit record per row of ``pages`` (page_id, url, html) to gzipped archives below ``path``.

    A null html is an empty payload. Of equal payloads of at least ``revisit_bytes`` bytes the largest page_id
    is the response, the others revisit it; smaller payloads are all responses. Repeated rows of the largest
    page_id are all responses, null ids are below all others (and responses where there is no other).
    """
    html = whole_text("html")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.cast("binary").alias("payload"), F.sha2(html, 256).alias("_key"))
    rows = with_group(rows, ["_key"], salt("page_id", "url"), refers_to=(F.col("page_id"), "max"))
    revisits = ~F.col("page_id").eqNullSafe(F.col("refers_to")) & (F.octet_length("payload") >= revisit_bytes)
    rows = rows.select("page_id", "url", "payload", "refers_to", revisits.alias("revisits"), F.uuid().alias("uuid"))
    schema = pa.schema([("record", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = (dict(zip(b.schema.names, (c[i].as_py() for c in b.columns))) for b in batches for i in range(b.num_rows))
        return _batches(((r,) for p in pages for r in records(p, segment_bytes)), schema, 0)

    made = rows.mapInArrow(make, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("compression", "gzip").text(path)
    return path


READ = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("declared", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
READ_DDL = "record_id string, type string, page_id bigint, url string, declared string, refers_to bigint, origin string, segment bigint, total bigint, block binary"


def parse_record(data: bytes) -> tuple:
    """The fields of ``READ``. ValueError if the block is not as long as declared."""
    end = data.index(b"\r\n\r\n")
    head = {}
    for line in data[:end].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            head[name.strip().lower()] = value.strip()
    size = int(head["content-length"])
    block, rest = data[end + 4:end + 4 + size], data[end + 4 + size:]
    if len(block) < size or rest not in (b"", b"\r\n\r", b"\r\n\r\n"):
        raise ValueError(f"record {head.get('warc-record-id')} is not as long as declared")
    number = lambda k: int(head[k]) if k in head else None
    segment = number("warc-segment-number")
    origin = head.get("warc-segment-origin-id") or (head["warc-record-id"] if segment else None)
    declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (head["warc-record-id"], head["warc-type"], number("x-page-id"), head.get("warc-target-uri"), declared, number("x-refers-to-page-id"),
            origin, segment, number("warc-segment-total-length"), block)


def body(block: bytes) -> bytes:
    """The payload of an HTTP response, its transfer framing undone."""
    head, _, rest = block.partition(b"\r\n\r\n")
    return unframe(rest) if b"transfer-encoding: chunked" in head.lower() else rest


def reassemble(segments: list[dict]) -> tuple[bytes | None, str | None]:
    """(block, None) of the segments of one record, or (None, what is wrong)."""
    by = {s["segment"]: s for s in segments}
    if sorted(by) != list(range(1, len(by) + 1)) or by[max(by)]["total"] is None:
        return None, "segments are missing"
    if any(s["block"] != by[s["segment"]]["block"] for s in segments):
        return None, "two segments have one number"
    block = b"".join(by[k]["block"] for k in sorted(by))
    return (block, None) if len(block) == by[max(by)]["total"] else (None, "total length differs")


PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("declared", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("problem", pa.string())])
PAGE_DDL = "page_id bigint, url string, record_type string, declared string, refers_to bigint, payload binary, problem string"


def _page(r: dict, block: bytes | None, problem: str | None) -> tuple:
    payload = None
    if problem is None and r["type"] == "response":
        try:
            payload = body(block)
            if r["declared"] not in (None, digest(payload)):
                payload, problem = None, "payload digest differs"
        except ValueError as e:
            problem = str(e)
    return r["page_id"], r["url"], r["type"], r["declared"], r["refers_to"], payload, problem


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, declared, refers_to, payload, problem): one row per response or revisit.

    A revisit has no payload of its own. ``problem`` says why a response could not be restored: missing or
    differing segments, a wrong total length, broken framing, a digest that differs.
    """
    # Only the first byte of this separator is \n before its end: a search that fails halfway, at the end of a
    # read buffer, cannot miss another start. Bodies that end in \r\n\r\n make the longer \r\n\r\nWARC/1.1 ambiguous.
    lines = spark.read.option("lineSep", "\nWARC/1.1\r\n").text(path)
    head = F.lower(F.substring_index("value", "\r\n\r\n", 1))
    segmented = F.contains(head, F.lit("\nwarc-segment-number:"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = (v.as_py() for b in batches for v in b.column(0))
        return _batches((parse_record(d.removeprefix(VERSION)) for d in data if d.strip()), READ, -1)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(READ.names, parse_record(v.as_py().removeprefix(VERSION)))) for b in batches for v in b.column(0) if v.as_py().strip())
        return _batches((_page(r, r["block"], None) for r in rows if r["type"] in ("response", "revisit")), PAGE, 5)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def restored():
            for b in batches:
                for v in b.column(0):
                    parts = v.as_py()
                    first = next((p for p in parts if p["segment"] == 1), None)
                    if first is None:  # a record whose first segment is lost is still reported
                        yield None, None, "response", None, None, None, "segments are missing"
                    else:
                        yield _page(first, *reassemble(parts))
        return _batches(restored(), PAGE, 5)

    binary = F.col("value").cast("binary").alias("data")
    alone = lines.where(~segmented).select(binary).mapInArrow(whole, PAGE_DDL)
    parts = lines.where(segmented).select(binary).mapInArrow(parse, READ_DDL)
    grouped = parts.groupBy("origin").agg(F.collect_list(F.struct(*[c for c in READ.names if c != "origin"])).alias("parts"))
    return alone.unionByName(grouped.select("parts").mapInArrow(join, PAGE_DDL))


def archived_pages(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES, revisit_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): pages written to archives and read back.

    Bytes and digest of a revisit are those of the response it refers to, found in the archives by its digest
    (null if there is none). An empty table gives an empty table; see ``write_archives`` for nulls and repeats.
    """
    spark = pages.sparkSession
    path = write_archives(pages, scratch_path(spark, "warc"), segment_bytes, revisit_bytes)
    schema = pa.schema([*[f for f in PAGE if f.name in ("page_id", "record_type", "declared", "refers_to", "problem")], ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [v.as_py() for v in b.column("payload")]
            more = [pa.array([None if p is None else len(p) for p in own], pa.int64()), pa.array([None if p is None else digest(p) for p in own], pa.string())]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in schema.names[:5]], *more], names=schema.names)

    ddl = "page_id bigint, record_type string, declared string, refers_to bigint, problem string, payload_bytes bigint, payload_digest string"
    rows = stored(read_archives(spark, path).mapInArrow(measure, ddl), "warc-pages")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem"]
    responses = rows.where("record_type = 'response'")
    seen = responses.where("payload_digest is not null").groupBy(F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    revisits = lookup(revisits, seen.withColumn("payload_digest", F.col("declared")), ["declared"], salt("page_id"), "left")
    return responses.select(out).unionByName(revisits.select(out))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
g AS (SELECT page_id, list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1) for k in range(32)], lambda a, b: a || b) AS b32 FROM d)
SELECT d.page_id, n AS payload_bytes, b32 AS payload_digest, CASE WHEN d.page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id <> top THEN top END AS refers_to, NULL::VARCHAR AS problem
FROM d JOIN g ON d.page_id = g.page_id
"""
