"""WARC archives: write captures as records, read records, assemble captures.

Writing: a page becomes three records: a response (or a revisit, if an earlier page has the same payload), a
request and a metadata record; the last two name the first in WARC-Concurrent-To. A record is a string
column that Spark's text writer ends with the two line breaks that the format asks for, so archives are
written by Spark's own committer: a lost task leaves nothing behind.

Reading: each archive file is unpacked and parsed record by record by Content-Length. Assembling: records are joined
through WARC-Concurrent-To into one nested row per capture, and a revisit with its response through WARC-Refers-To.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, fresh_path, written

END = "\r\n\r\n"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
RECORDS = "file string, offset long, record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, fields map<string,string>, payload_bytes long, payload_sha1 string, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1."""
    digits = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8))), *BASE32)


def _record_id(kind: str, *of: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), *(F.coalesce(c.cast("string"), F.lit("\x1e")) for c in of)).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column, record_id: Column, block: Column, content_type: str, **headers: Column) -> Column:
    """One record without its end: headers that are null are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{k.replace('_', '-')}: "), v) for k, v in headers.items()]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z", least_revisit_bytes: int = 0, file_bytes: int = 1 << 26) -> None:
    """Write three records for each row of pages under path.

    Of rows with equal payloads of at least least_revisit_bytes bytes, those with the smallest id are
    responses, the others revisits without a payload; a smaller payload is always a response. A null payload
    is the empty one. Rows with a null id are responses, as no order says which came first. Line breaks and
    surrounding blanks of an address become %0A, %0D or nothing, as a header holds one line. Repeated rows give
    records each, with one id; an empty table gives no records; other columns are ignored, whatever their names.

    Captures are written by classes of payload size, so many to a file that their payloads are file_bytes at most; a
    capture of more than a sixteenth of that has a file of its own. A class is chosen before anything is shuffled, so
    that each payload is still shuffled once.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("n", F.octet_length("payload"))
    again = p.where((F.col("n") >= least_revisit_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).where("first.page_id <> last").select("digest", "first")
    again = written(again, "repeated-payloads")
    most, above = file_bytes >> 12, -1
    while above < (file_bytes >> 4):
        _write_class(p.where((F.col("n") > above) & (F.col("n") <= most)), again, path, date, least_revisit_bytes, file_bytes // most)
        most, above = most << 4, most
    _write_class(p.where(F.col("n") > above), again, path, date, least_revisit_bytes, 1)


def _write_class(p: DataFrame, again: DataFrame, path: str, date: str, least_revisit_bytes: int, captures_per_file: int) -> None:
    """Add archives of the pages p (page_id, url, payload, digest, n), captures_per_file to a file at most."""
    p = p.join(again, "digest", "left")
    revisit = (F.col("n") >= least_revisit_bytes) & (F.col("page_id") > F.col("first.page_id"))
    p = p.withColumn("original", F.when(revisit, F.col("first"))).drop("first")
    p = p.withColumn("payload", F.when(F.col("original").isNull(), F.col("payload")).otherwise(F.lit("")))
    url = F.replace(F.replace(F.trim("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    capture = _record_id("capture", F.col("page_id"), F.col("url"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    kind = F.when(F.col("original").isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    profile = F.when(F.col("original").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers_to = F.when(F.col("original").isNotNull(), _record_id("capture", F.col("original.page_id"), F.col("original.url"), F.col("digest")))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    day = F.lit(date)
    records = F.array(
        _record(F.lit("request"), _record_id("request", capture), F.concat(F.lit("GET "), F.coalesce("url_line", F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), "application/http; msgtype=request", WARC_Date=day, WARC_Target_URI=F.col("url_line"), WARC_Concurrent_To=capture),
        _record(kind, capture, F.concat(http, F.col("payload")), "application/http; msgtype=response", WARC_Date=day, WARC_Target_URI=F.col("url_line"), WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")), WARC_Profile=profile, WARC_Refers_To=refers_to),
        _record(F.lit("metadata"), _record_id("metadata", capture), fields, "application/warc-fields", WARC_Date=day, WARC_Target_URI=F.col("url_line"), WARC_Concurrent_To=capture),
    )
    p.withColumn("url_line", url).select(F.explode(records).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 3 * captures_per_file).option("compression", "gzip").mode("append").text(path)


def _header(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        out[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    return out


def _unpacked(data: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a plain or gzip file of one or more members, bit by bit."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield from (bytes(data[at : at + step]) for at in range(0, len(data), step))
        return
    at = 0
    while at < len(data):
        member = zlib.decompressobj(wbits=31)
        while at < len(data) and not member.eof:
            piece = bytes(data[at : at + step])
            at += len(piece)
            yield member.decompress(piece)
        at -= len(member.unused_data)


def _parse(pieces: Iterator[bytes]) -> Iterator[tuple]:
    """Records of an archive: by Content-Length, whatever the payloads hold. Memory holds one record. Stops at a cut-off record."""
    held, before, ended = bytearray(), 0, False

    def more() -> bool:
        nonlocal ended
        piece = next(pieces, None)
        ended = piece is None
        held.extend(piece or b"")
        return not ended

    seen = 0
    while True:
        while (to := held.find(END.encode(), max(0, seen - 3))) < 0:
            seen = len(held)
            if not more():
                return
        if not held.startswith(b"WARC/"):
            return
        head = _header(bytes(held[:to]))
        size = head.get("content-length", "")
        if not size.isdigit():
            return
        end = to + 4 + int(size)
        while len(held) < end:
            if not more():
                return
        block = bytes(held[to + 4 : end])
        kind, fields, payload = head.get("warc-type"), None, None
        if kind in ("response", "revisit"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif head.get("content-type") == "application/warc-fields":
            fields = list(_header(b"\r\n" + block).items())
        yield before, kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-date"), (head.get("warc-payload-digest") or "").removeprefix("sha1:") or None, fields, payload
        while len(held) < end + 4 and more():
            pass
        del held[: end + 4]
        before, seen = before + end + 4, 0


def _records(with_payload: bool):
    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 7, pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for *head, payload in _parse(_unpacked(memoryview(content.as_buffer()))):
                    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode() if payload is not None else None
                    rows.append((path, *head, None if payload is None else len(payload), sha, payload if with_payload else None))
                    held += len(payload or b"") + 500
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return batches


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records of the archives (plain or gzip) under path: columns RECORDS. A file is one task's work at least; the writer bounds its size."""
    bounded_batches(spark, 1)  # a row is a whole archive file
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_records(with_payload), RECORDS)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response (the response or revisit record), requests, metadata (arrays of records).

    Requests and metadata are joined to the record that they name in concurrent_to. Records that name
    none that is there form a capture without response, under the id that they name; those that name none
    at all stand alone under their own id. Repeated records with one id give one row each.
    """
    r = records.select("record_type", F.struct(*records.columns).alias("r"), "record_id", F.coalesce("concurrent_to", "record_id").alias("at"))
    main = r.where("record_type in ('response', 'revisit')").select(F.col("record_id").alias("capture_id"), F.col("r").alias("response"))

    def side(kind: str, name: str) -> DataFrame:
        return r.where(F.col("record_type") == kind).groupBy(F.col("at").alias("capture_id")).agg(F.collect_list("r").alias(name))

    return main.join(side("request", "requests"), "capture_id", "full_outer").join(side("metadata", "metadata"), "capture_id", "full_outer")


def archived(pages: DataFrame, *, least_revisit_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder, read them back: one row per page.

    page_id, payload_bytes, payload_digest (of the full payload, as read; of a revisit, its response's bytes and the digest
    that its headers say), record_type, refers_to (the response's page_id for revisits, else null), url. Null payloads are
    empty, repeated rows give repeated rows, an empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, least_revisit_bytes=least_revisit_bytes)
    # parsed once: a lazy plan would parse the archives for each side of the joins
    c = captures(written(read_archives(spark, path, with_payload=False), "records"))
    bounded_batches(spark)  # what follows has small rows again
    c = c.where("response is not null").select("response", F.expr("try_cast(metadata[0].fields['page-id'] as long)").alias("page_id"))
    # repeated rows are repeated records of one id
    first = c.where("response.record_type = 'response'").groupBy(F.col("response.record_id").alias("refers")).agg(F.min("page_id").alias("original"), F.min("response.payload_bytes").alias("bytes"))
    whole = F.col("response.record_type") == "response"
    out = c.withColumn("refers", F.when(~whole, F.col("response.refers_to"))).join(first, "refers", "left")
    return out.select(
        "page_id",
        F.when(whole, F.col("response.payload_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(whole, F.col("response.payload_sha1")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("original").alias("refers_to"),
        F.col("response.target_uri").alias("url"),
    )
