"""WARC archives of pages, and captures put together from their records.

Archives are written by Spark's text writer: a row is a record, and the line
separator is the blank line that ends a record. Readers go by Content-Length. Reading
joins request, response (or revisit) and metadata records through WARC-Concurrent-To
and gives one nested row for each capture.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, discard, numbered

#: Payloads below this many bytes are never replaced by a reference.
LEAST_REVISIT = 100
#: Records in an archive part by the bytes of their html: a reader holds one part's compressed bytes at a time,
#: so long pages share parts of their own. Beyond the last size each page has a part.
PART_RECORDS = {1 << 16: 6000, 1 << 20: 384, 1 << 24: 24}
PAGE_RECORDS = 3
#: Records and payload bytes that a reader passes on together.
BATCH_RECORDS, BATCH_BYTES = 2000, 32 << 20
#: Groups of equal payloads that every executor may hold (about 120 bytes each).
FEW = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, target string, concurrent_to string, refers_to string, "
    "content_type string, declared_digest string, head string, block binary, payload_bytes bigint, payload_digest string"
)
END = "\r\n\r\n"


def _record(kind: str, record_id: Column, target: Column, content_type: str, block: Column, *fields: tuple[str, Column]) -> Column:
    """The text of one record, but for the blank line after it. Null fields are left out."""
    head = [
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id, F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), target,
        F.lit(f"\r\nContent-Type: {content_type}\r\n"),
    ]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write a request, a response or revisit, and a metadata record for every row of ``pages``.

    The payload is the html (null: empty). Of rows whose payloads are equal and at
    least 100 bytes long, those with the smallest page_id are responses, the others
    revisit the first of them; rows without an id come last. Repeated rows with the
    smallest id are responses each. Line breaks in a url are percent-encoded; a null
    url is an empty target. Very long pages get archive parts of their own. Other columns are not read. An empty table gives an archive
    without records.
    """
    digest = F.sha2(F.coalesce(F.col(html), F.lit("")), 256)
    slim = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"), digest.alias("digest"))
    rows, uid = numbered(slim, "captures")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col(uid).alias("uid"))
    # Copies are summed up before the shuffle; only payloads that recur are joined.
    groups = rows.filter(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = cut_lineage(groups.filter("n > 1").select(F.col("digest").alias("d"), "first"), "firsts")
    if firsts.count() <= FEW:  # else the pages are shuffled to them
        firsts = F.broadcast(firsts)
    led = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.octet_length("html") >= LEAST_REVISIT), "left")
    is_response = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first.page_id"))

    def name(kind: str, number: Column) -> Column:
        hexed = F.sha2(F.concat(F.lit(f"{kind} "), number.cast("string")), 256)
        parts = [F.substring(hexed, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
        return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))

    target = F.coalesce(F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A"), F.lit(""))
    number = F.col(uid)
    main = name("response", number)
    payload_digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    request = _record("request", name("request", number), target, "application/http; msgtype=request", F.lit("GET / HTTP/1.1\r\n\r\n"), ("WARC-Concurrent-To", main))
    response = _record("response", main, target, "application/http; msgtype=response", F.concat(http, "html"), ("WARC-Payload-Digest", payload_digest))
    revisit = _record(
        "revisit", main, target, "application/http; msgtype=response", http,
        ("WARC-Payload-Digest", payload_digest), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", name("response", F.col("first.uid"))),
    )
    about = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", name("metadata", number), target, "application/warc-fields", about, ("WARC-Concurrent-To", main))
    limits = [*PART_RECORDS, None]
    fits = reduce(lambda rest, k: F.when(F.octet_length("html") <= limits[k], k).otherwise(rest), reversed(range(len(limits) - 1)), F.lit(len(limits) - 1))
    there = sorted(r.k for r in rows.select(fits.alias("k")).distinct().collect()) or [0]  # at most four
    for n, k in enumerate(there):
        part = led.filter(fits == k) if len(there) > 1 else led
        records = part.select(F.explode(F.array(request, F.when(is_response, response).otherwise(revisit), metadata)).alias("value"))
        writer = records.write.mode("append" if n else "overwrite").option("lineSep", END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", PART_RECORDS.get(limits[k], PAGE_RECORDS)).text(path)
    discard(rows)


class _Stream:
    """Bytes of a part, unpacked as they are asked for; gzip members may follow each other."""

    def __init__(self, raw: bytes):
        self.zipped = raw[:2] == b"\x1f\x8b"
        self.raw, self.at = memoryview(raw), 0
        self.unzip = zlib.decompressobj(31)
        self.held = bytearray()
        self.used = 0

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        chunk = self.raw[self.at : self.at + (1 << 18)]
        self.at += len(chunk)
        if not self.zipped:
            self.held += chunk
            return True
        self.held += self.unzip.decompress(chunk)
        while self.unzip.eof and self.unzip.unused_data:
            rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
            self.held += self.unzip.decompress(rest)
        if self.unzip.eof:
            self.unzip = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to ``mark``, which is passed over; None at the end."""
        self._drop()
        seen = 0
        while (k := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                return None
        self.used = k + len(mark)
        return bytes(self.held[:k])

    def take(self, n: int) -> bytes:
        self._drop()
        while len(self.held) < n:
            if not self._more():
                raise ValueError("an archive ends inside a record")
        self.used = n
        return bytes(self.held[:n])

    def _drop(self) -> None:
        del self.held[: self.used]
        self.used = 0


def parse_records(raw: bytes) -> Iterator[tuple]:
    """The records of one part, in the order of ``RECORD``; blocks are cut out by Content-Length."""
    stream = _Stream(raw)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").lstrip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not the start of a record: {lines[0][:40]!r}")
        field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = stream.take(int(field["content-length"]))
        stream.until(END.encode())
        http = b""
        if field.get("content-type", "").startswith("application/http"):
            http, _, block = block.partition(b"\r\n\r\n")
        yield (
            field.get("warc-record-id"), field.get("warc-type"), field.get("warc-target-uri"), field.get("warc-concurrent-to"), field.get("warc-refers-to"),
            field.get("content-type"), field.get("warc-payload-digest"), http.decode("latin-1"), block, len(block), hashlib.sha256(block).hexdigest(),
        )


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of parts in batches of bounded size, however much a part unpacks to."""
    kinds = [pa.string()] * 8 + [pa.binary(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RECORD.split(", ")]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    for part in batches:
        for raw in part.column(0):
            held, size = [], 0
            for record in parse_records(raw.as_buffer().to_pybytes()):
                held.append(record)
                size += record[9]
                if len(held) >= BATCH_RECORDS or size >= BATCH_BYTES:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archive parts below ``path``, one part after the other in a task."""
    parts = spark.read.format("binaryFile").load(path).select("content")
    return parts.mapInArrow(_parsed, RECORD)


def without_payloads(records: DataFrame) -> DataFrame:
    """``records`` stored once without the blocks of responses: enough for :func:`captures` ``with_payload=False``, which reads them three times."""
    main = F.col("type").isin("response", "revisit")
    return cut_lineage(records.withColumn("block", F.when(~main, F.col("block"))), "records")


def captures(records: DataFrame, with_payload: bool = True) -> DataFrame:
    """One nested row for each response or revisit: record_id, type, target, refers_to, response, requests, metadata, and the full payload's bytes and digest.

    Requests and metadata find their capture through WARC-Concurrent-To; a capture may
    have none of them. A revisit's payload size and digest are those of the response it
    refers to; where that is not in the archive, its declared digest stands and the
    size is null. Records concurrent to nothing present are left out.
    """
    main = records.filter(F.col("type").isin("response", "revisit"))
    side = records.filter(F.col("concurrent_to").isNotNull() & F.col("type").isin("request", "metadata"))
    part = F.struct("record_id", "content_type", "head", "block")
    around = side.groupBy("concurrent_to").agg(
        F.collect_list(F.when(F.col("type") == "request", part)).alias("requests"),
        F.collect_list(F.when(F.col("type") == "metadata", part)).alias("metadata"),
    )
    body = F.struct("content_type", "head", *(["block"] if with_payload else []))
    own = main.select("record_id", "type", "target", "refers_to", body.alias("response"), "payload_bytes", "payload_digest", "declared_digest")
    whole = own.join(around.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
    # Payloads stay behind: a response referred to by many sends its size and digest only.
    first = main.filter("type = 'response'").select(F.col("record_id").alias("r_id"), F.col("payload_bytes").alias("r_bytes"), F.col("payload_digest").alias("r_digest"))
    linked = whole.join(first, F.col("refers_to") == F.col("r_id"), "left")
    revisit = F.col("type") == "revisit"
    return linked.select(
        "record_id", "type", "target", "refers_to", "response", "requests", "metadata",
        F.when(revisit, F.col("r_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("r_digest", F.expr("substr(declared_digest, 8)"))).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def page_of(metadata: Column) -> Column:
    """The page id in a capture's metadata records, null where it is empty."""
    told = F.decode(F.get(metadata, F.lit(0))["block"], "utf-8")
    number = F.regexp_extract(told, r"pageId: (-?\d+)", 1)
    return F.when(number != "", number.cast("long"))
