"""WARC archives written and read by Spark's text source, with segmented records and chunked payloads.

Records open with ``WARC/1.1 CRLF``, so a reader that splits there gets one record a row from splittable files. Chunks
of the transfer framing end inside any ``WARC/1.1`` of the payload, so no block that is written here holds that string,
whatever follows it there (the framing's and the record's own line ends among it). Archives of other writers may
hold it in their blocks: the reader goes by Content-Length and joins what such a string has parted.
Long blocks are written as segments: a first record and continuation records that name it as their origin. Files are
compressed as a whole, by Spark's writer, and each part of the table begins with a warcinfo record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingspark.plans.shared import Workspace

VERSION = b"WARC/1.1\r\n"
#: What separates records for a reader.
BORDER = VERSION.decode()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
CHUNK, SEGMENT = 8192, 32768
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing; chunks also end inside any version string of the payload, so that none holds one."""
    version = VERSION.strip()
    pieces = payload.split(version)
    out = []
    for i, piece in enumerate(pieces):
        data = (version[4:] if i else b"") + piece + (version[:4] if i + 1 < len(pieces) else b"")
        for at in range(0, len(data), size):
            part = data[at : at + size]
            out.append(b"%x\r\n%s\r\n" % (len(part), part))
    return b"".join([*out, b"0\r\n\r\n"])


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        if n == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        if len(out[-1]) != n or body[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("broken chunk")
        at = end + 4 + n


def head(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = [f"{k}: {v}\r\n" for k, v in fields]
    return VERSION + "".join(lines).encode("utf-8", "replace") + b"Content-Length: %d\r\n\r\n" % length


def uri_fields(url: str | None) -> list[tuple[str, str]]:
    """The target URI; besides it, where a header line can't hold the url as it is, the url's own bytes."""
    plain = url is not None and url == url.strip() and not re.search(r"[\x00-\x1f\x7f\u2028\u2029\x85]|WARC/1\.1$", url) and url != ""
    if plain:
        return [("WARC-Target-URI", url)]
    safe = re.sub(r"WARC/1\.1$", "WARC/1%2E1", quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=~-._"))
    return [("WARC-Target-URI", safe), ("X-Target-URI-Base64", "null" if url is None else base64.b64encode(url.encode("utf-8", "surrogatepass")).decode() or "empty")]


def uri_of(fields: dict[str, str]) -> str | None:
    said = fields.get("x-target-uri-base64")
    if said is None:
        return fields.get("warc-target-uri")
    return {"null": None, "empty": ""}[said] if said in ("null", "empty") else base64.b64decode(said).decode("utf-8", "surrogatepass")


def record_id(page: int | None, digest: str, row: str) -> str:
    """Of a response: from its page and payload, so that revisits can name it; a page without an id has its row's."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row if page is None else page}:{digest}')}>"


def segments(block: bytes, size: int) -> list[bytes]:
    return [block[at : at + size] for at in range(0, len(block), size)] or [block]


def page_records(segment: int, chunk: int, date: str):
    """row, page_id, url, html, winner -> record (bytes): a response or a revisit, in segments where it is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        said = b"software: Spark text writer\r\nformat: WARC File Format 1.1\r\n"
        records = [head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], len(said)) + said]
        for batch in batches:
            for row, page, url, html, winner in zip(*(batch[c].to_pylist() for c in ("row", "page_id", "url", "html", "winner")), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = sha1_base32(payload)
                base = [("WARC-Date", date), *uri_fields(url), ("WARC-Payload-Digest", f"sha1:{digest}")]
                base += [("X-Page-Id", str(page))] if page is not None else []
                if winner is not None and page is not None and page != winner:
                    own = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<urn:uuid:{row}>")]
                    records.append(head([*own, *base, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(winner, digest, row))], 0))
                    continue
                block = HTTP + chunked(payload, chunk)
                parts = segments(block, segment)
                own = record_id(page, digest, row)
                # rows that are repeated have records of equal ids; the row keeps their segments apart
                more = [("WARC-Segment-Number", "1"), ("X-Row", row)] if len(parts) > 1 else []
                records.append(head([("WARC-Type", "response"), ("WARC-Record-ID", own), *base, ("Content-Type", "application/http; msgtype=response"), *more], len(parts[0])) + parts[0])
                for k, part in enumerate(parts[1:], 2):
                    fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{own}:{row}:{k}')}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k)), ("X-Row", row)]
                    fields += [("WARC-Segment-Total-Length", str(len(block)))] if k == len(parts) else []
                    records.append(head(fields, len(part)) + part)
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])
            records = []

    return run


def write_pages(pages: DataFrame, path: str, *, segment: int = SEGMENT, chunk: int = CHUNK, compression: str = "gzip", most: int = 20_000, date: str = DATE) -> None:
    """A record for each row of pages(page_id, url, html) in WARC files under ``path``.

    Of the rows with equal payloads, those of the largest page_id are responses and the others revisit that page. Null
    html is an empty payload, a null url is told from an empty one. Null page_id: a response of its own without an id. Repeated
    rows give repeated records. Files hold ``most`` records, as one compressed file is read by one task; with
    ``compression="none"`` they are read in splits. ``date`` stands in all records."""
    ws, html = Workspace(pages.sparkSession, "warc"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    df = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    # written, so that a payload that most pages have is dealt among several tasks
    winners = ws.write(df.groupBy("digest").agg(F.max("page_id").alias("winner"), F.min("page_id").alias("least")).filter("least < winner").drop("least"), "winners")
    rows = df.join(winners, "digest", "left").withColumn("row", F.expr("uuid()")).select("row", "page_id", "url", "html", "winner")
    records = rows.mapInArrow(page_records(segment, chunk, date), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", most).text(path)


def parse_records(border: bytes):
    """value (bytes between borders) -> the record's named fields and its block, cut to its declared length. A block that holds
    the border comes in several values, which are joined until the declared length is reached."""

    def parsed(fields: dict[str, str], block: bytes) -> dict:
        number = lambda k: int(fields[k]) if fields.get(k) else None
        return {
            "record_id": fields.get("warc-record-id"),
            "type": fields.get("warc-type"),
            "page_id": number("x-page-id"),
            "url": uri_of(fields),
            "digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:"),
            "refers_to": fields.get("warc-refers-to"),
            "origin": fields.get("warc-segment-origin-id"),
            "row": fields.get("x-row"),
            "segment": number("warc-segment-number"),
            "total": number("warc-segment-total-length"),
            "block": block,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields, parts, missing = {}, [], 0
        for batch in batches:
            out: list[dict] = []
            for value in batch["value"].to_pylist():
                if missing > 0:
                    parts += [border, value]
                    missing -= len(border) + len(value)
                else:
                    top, _, block = value.partition(b"\r\n\r\n")
                    if not top.strip():
                        continue
                    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in top.decode("utf-8", "replace").split("\r\n"))}
                    parts, missing = [block], int(fields["content-length"]) - len(block)
                if missing <= 0:
                    out.append(parsed(fields, b"".join(parts)[: int(fields["content-length"])]))
            yield pa.RecordBatch.from_pylist(out, RECORD)
        if missing > 0:
            raise ValueError(f"record {fields.get('warc-record-id')} is shorter than declared")

    return run


RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("origin", pa.string()), ("row", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary())])
RECORD_DDL = "record_id string, type string, page_id long, url string, digest string, refers_to string, origin string, row string, segment long, total long, block binary"


def payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """record_id, page_id, url, digest, parts (of the block, by segment number), total -> the decoded payload and its length."""
    for batch in batches:
        out = []
        for parts, total, digest, record in zip(*(batch[c].to_pylist() for c in ("parts", "total", "digest", "record_id")), strict=True):
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise ValueError(f"{record}: a segment is missing or twice")
            block = b"".join(p["block"] for p in parts)
            if len(parts) > 1 and len(block) != total:
                raise ValueError(f"{record}: {len(block)} bytes of {total}")
            top, _, body = block.partition(b"\r\n\r\n")
            payload = dechunk(body) if b"transfer-encoding: chunked" in top.lower() else body
            if digest and sha1_base32(payload) != digest:
                raise ValueError(f"{record}: payload differs from its digest")
            out.append(payload)
        yield pa.RecordBatch.from_arrays([batch["record_id"], batch["page_id"], batch["url"], pa.array(out, pa.binary()), pa.array([len(p) for p in out], pa.int64()), pa.array([sha1_base32(p) for p in out], pa.string())], ["record_id", "page_id", "url", "payload", "payload_bytes", "payload_digest"])


def read_records(spark: SparkSession, path: str, version: str = "WARC/1.1") -> DataFrame:
    """One row per record of the archives, of this writer or another, of one ``version``. Files compressed record by record or as
    a whole are read by one task each; others in splits, unless a block holds the border, which this writer keeps out.
    A record that is shorter than it declares ends the job."""
    border = f"{version}\r\n"
    raw = spark.read.option("lineSep", border).text(path)
    return raw.select(F.col("value").cast("binary").alias("value")).mapInArrow(parse_records(border.encode()), RECORD_DDL)


def read_pages(spark: SparkSession, path: str, version: str = "WARC/1.1") -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of each page in the archives.

    Segments are grouped by origin, ordered by number and checked against the total length; chunked framing is decoded
    and the payload checked against its digest. A record's segments meet in one row, as its payload must. Revisits have
    the payload of the response whose record they name; who doesn't select ``payload`` moves none to them. A revisit of a
    record that the archives lack has null payload and refers_to. Archives without records: empty result."""
    records = read_records(spark, path, version).filter("type in ('response', 'continuation', 'revisit')")
    part = F.struct(F.coalesce("segment", F.lit(1).cast("long")).alias("segment"), "block")
    said = ["page_id", "url", "digest", "total"]
    whole = records.filter("type = 'response' and segment is null").select("record_id", *said, F.array(part).alias("parts"))
    cut = (
        records.filter("segment is not null")
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"), "row")
        .agg(*[F.max(c).alias(c) for c in said], F.array_sort(F.collect_list(part)).alias("parts"))
    )
    one = whole.unionByName(cut.select(*whole.columns)).select("record_id", "page_id", "url", "digest", "total", "parts")
    responses = one.mapInArrow(payloads, "record_id string, page_id long, url string, payload binary, payload_bytes long, payload_digest string")
    first = responses.select(F.col("record_id").alias("named"), F.col("page_id").alias("refers_to"), "payload", "payload_bytes").dropDuplicates(["named"])
    revisits = records.filter("type = 'revisit'").select("page_id", "url", F.col("refers_to").alias("named"), F.col("digest").alias("payload_digest")).join(first, "named", "left").drop("named")
    return responses.drop("record_id").select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.withColumn("record_type", F.lit("revisit")))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back."""
    ws = Workspace(pages.sparkSession, "warc")
    path = f"{ws.path}/archives"
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)
