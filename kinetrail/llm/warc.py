"""WARC archives: write one capture per page, read them back, assemble captures.

A capture is three records: a response (or a revisit of an equal payload), the
request and a metadata record, tied by ``WARC-Concurrent-To``.  Archives are
written by Spark's text sink, whose line end is the record end (two CRLF), so
they go wherever Spark can write; a file holds ``records_per_file`` records at
most.  They are read as binary files and cut by Content-Length, one record
after the other as they are inflated, and captures are assembled by equi-joins on record ids.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrail.llm.common import bounded_batches
from kinetrail.plans.stage import fresh_path, written

CRLF = "\r\n"
# fixed value: the base 32 alphabet of RFC 4648
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = ("record_id string, type string, concurrent_to string, refers_to string, target_uri string, header_digest string, "
          "payload_bytes long, payload_digest string, payload binary")


def base32_sha1(payload: Column) -> Column:
    """Upper-case base 32 SHA-1: five hex digits are four base-32 digits."""
    hexed = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(hexed, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str | Column, record_id: Column, block: Column, content_type: Column, *headers: Column) -> Column:
    """A record without its closing line ends; a null header is left out."""
    named = [F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
             *headers, F.concat(F.lit("Content-Type: "), content_type),
             F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.lit("WARC/1.1" + CRLF), F.concat_ws(CRLF, *named), F.lit(CRLF * 2), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z",
                   records_per_file: int = 6000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a capture per row.  Of equal payloads of at least ``min_bytes`` bytes the
    least id is the response and the others revisit it; smaller payloads are all
    responses.

    A null payload is empty; a null url leaves its header out; a row with a null
    id is the response of its payload only if no other has it; repeated rows are
    captures of their own, of which those with the least id are all responses.
    """
    rows = written(pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.regexp_replace(F.col(url_col), "[\\r\\n]", "%0A").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"), F.monotonically_increasing_id().alias("rid"),
    ).withColumns({"digest": base32_sha1(F.col("body").cast("binary")), "same": F.sha2(F.col("body").cast("binary"), 256)}), "pages")
    first = rows.filter(F.octet_length("body") >= min_bytes).groupBy("same").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rid")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    urn = lambda kind, rid: F.concat(F.lit(f"<urn:capture:{kind}:"), rid.cast("string"), F.lit(">"))
    joined = rows.join(first, "same", "left").withColumn(
        "revisits", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    own = urn("response", F.col("rid"))
    uri = F.concat(F.lit("WARC-Target-URI: "), F.col("url"))
    when = F.lit(f"WARC-Date: {date}")
    tied = F.concat(F.lit("WARC-Concurrent-To: "), own)
    status = F.concat(F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])),
                      F.octet_length("body").cast("string"), F.lit(CRLF * 2))
    answer = _record(
        F.when(F.col("revisits"), "revisit").otherwise("response"), own, F.when(F.col("revisits"), status).otherwise(F.concat(status, "body")),
        F.lit("application/http; msgtype=response"), uri, when, F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("revisits"), F.concat(F.lit("WARC-Refers-To: "), urn("response", F.col("first.rid")))),
        F.when(F.col("revisits"), F.lit(f"WARC-Profile: {PROFILE}")))
    request = _record("request", urn("request", F.col("rid")), F.lit(CRLF.join(["GET / HTTP/1.1", "User-Agent: archive", "", ""])),
                      F.lit("application/http; msgtype=request"), uri, when, tied)
    metadata = _record("metadata", urn("metadata", F.col("rid")), F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF)), F.lit("application/warc-fields"), uri, when, tied)
    (joined.select(F.explode(F.array(request, answer, metadata)).alias("value")).write.option("compression", "gzip")
     .option("lineSep", CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path))


# ---------------------------------------------------------------- reading ---


def inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one or many members, ``step`` at most at once; other files as they are."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[k:k + step]) for k in range(0, len(view), step))
        return
    at, z = 0, zlib.decompressobj(31)
    while at < len(view) or z.unconsumed_tail or z.unused_data:
        if z.eof:  # the next member, behind padding
            at -= len(z.unused_data)
            while at < len(view) and view[at] == 0:
                at += 1
            if at == len(view):
                return
            z = zlib.decompressobj(31)
        more = z.unconsumed_tail
        if not more:
            more = view[at:at + step]
            at += len(more)
        yield z.decompress(more, step)
    yield z.flush()


def records_in(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an archive that comes in
    parts; no more than a record and a part are held."""
    parts, held, at, gone = iter(parts), bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, gone
        part = next(parts, None)
        if part is None:
            return False
        gone += at
        del held[:at]
        at = 0
        held.extend(part)
        return True

    while True:
        while held[at:at + 2] == CRLF.encode() or (len(held) - at < 2 and more()):
            at += 2 if held[at:at + 2] == CRLF.encode() else 0
        if at >= len(held):
            return
        seen = 0
        while (end := held.find(b"\r\n\r\n", at + seen)) < 0:
            seen = max(len(held) - at - 3, 0)
            if not more():
                break
        head = held[at:max(end, at)].decode("utf-8", "replace").split(CRLF)
        if end < 0 or not head[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {gone + at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size, start = int(fields["content-length"]), end + 4 - at
        while len(held) - at < start + size and more():
            pass
        yield fields, bytes(held[at + start:at + start + size])
        at += start + size


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record.  The payload is the block after its HTTP head, if it has one."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("record_id", "type", "concurrent_to", "refers_to", "target_uri", "header_digest", "payload_bytes", "payload_digest", "payload")
        types = (pa.string(),) * 6 + (pa.int64(), pa.string(), pa.binary())

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))

        import base64

        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for f, block in records_in(inflated(content.as_buffer())):
                    payload = block.partition(b"\r\n\r\n")[2] if f.get("content-type", "").startswith("application/http") else block
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    rows.append((f.get("warc-record-id"), f.get("warc-type"), f.get("warc-concurrent-to"), f.get("warc-refers-to"),
                                 f.get("warc-target-uri"), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                                 len(payload), digest, payload))
                    held += len(payload)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit, request and metadata.

    Request and metadata name the response they are concurrent to; a missing one
    is null.  ``original`` is the response that a revisit refers to, without its
    payload.
    """
    part = F.struct("record_id", "target_uri", "payload_bytes", "payload_digest", "payload")
    answers = records.filter("type in ('response', 'revisit')").select(
        F.col("record_id").alias("capture_id"), "type", "refers_to", "header_digest", part.alias("response"))
    tied = {kind: records.filter(F.col("type") == kind).select(F.col("concurrent_to").alias("capture_id"), part.alias(kind))
            for kind in ("request", "metadata")}
    original = records.filter("type = 'response'").select(F.col("record_id").alias("refers_to"), F.struct(
        "record_id", "payload_bytes", "payload_digest").alias("original"))
    return (answers.join(tied["request"], "capture_id", "left").join(tied["metadata"], "capture_id", "left")
            .join(original, "refers_to", "left"))


def round_trip(pages: DataFrame, **names: str) -> DataFrame:
    """Write archives, read them back and describe each page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (a
    page id).  An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path, **names)
    # digests are taken where records are read; of the payloads, only the small metadata travels on
    records = read_records(spark, path).withColumn("payload", F.when(F.col("type") == "metadata", F.col("payload")))
    captures = assemble(written(records, "records"))
    page = F.expr("nullif(trim(both '\\r\\n ' from substring_index(cast(metadata.payload as string), ':', -1)), '')").cast("long")
    described = written(captures.select(
        "capture_id", "refers_to", page.alias("page_id"), F.col("type").alias("record_type"),
        F.when(F.col("type") == "response", F.col("response.payload_bytes")).otherwise(F.col("original.payload_bytes")).alias("payload_bytes"),
        F.when(F.col("type") == "response", F.col("response.payload_digest")).otherwise(F.col("header_digest")).alias("payload_digest")), "captures")
    named = described.filter("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("of_page"))
    return described.join(named, "refers_to", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.col("of_page").alias("refers_to"))


SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  g AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS f, sha1(h) AS s FROM p)
  SELECT page_id, strlen(h)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i:
      substr('{BASE32}', ((('0x' || substr(s, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM g"""
