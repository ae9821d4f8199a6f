"""WARC writing, reading and transaction assembly.

``write_archive`` turns pages into request, response (or revisit) and metadata records. They are written by Spark's
text sink, compressed: a capture is one value, and the line end that the sink adds is the last half of the blank lines that end
a record. ``read_records`` parses the files by their content lengths, so payloads may hold anything, record
separators included. ``assemble`` joins the records that name a capture in ``WARC-Concurrent-To`` with it and gives
one nested row per capture.

Defined cases: a null html is an empty payload, a null url leaves the target out, characters that a header can't
hold are percent-encoded, a null page id leaves the id out of the metadata record, repeated rows are separate captures. A
request or metadata record whose capture isn't in the archive gives no row. Empty tables give empty archives.
"""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import fits, python_ready, staged

#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: Aim for the bytes of one archive file; a reader holds one file at a time.
FILE_BYTES = 24 << 20
DATE = "2026-01-01T00:00:00Z"
#: Fixed values of the WARC 1.1 standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, "
                 "date string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>")


def _record_id(rid: Column, kind: str) -> Column:
    h = F.md5(F.concat(F.lit(kind), F.lit("/"), rid.cast("string")).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column | str]], body: Column) -> Column:
    """Header lines, those with a null value left out, then the content; without the blank lines at the end."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, length), F.lit("\r\n\r\n"), body)


def mark_revisits(pages: DataFrame, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Adds ``rid, payload, payload_bytes, payload_digest, first_rid`` (of the capture that holds the payload).

    Rows are numbered and written, so that each later pass sees the same numbers. Digests are grouped before the join,
    so a payload that a third of all pages share costs one row a task; payloads themselves move only where there are
    too many revisits to broadcast.
    """
    payload = F.coalesce(pages["html"].cast("string"), F.lit(""))
    rows = staged(pages.select("page_id", "url", F.monotonically_increasing_id().alias("rid"), payload.alias("payload"),
                               F.octet_length(payload).cast("long").alias("payload_bytes"),
                               F.sha1(payload.cast("binary")).alias("payload_digest")), "pages")
    heads = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes")
             .agg(F.max(F.struct("page_id", "rid")).alias("head"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("payload_digest", "payload_bytes", F.col("head.rid").alias("first_rid")))
    narrow = (rows.where(F.col("payload_bytes") >= min_bytes).select("rid", "payload_digest", "payload_bytes")
              .join(heads, ["payload_digest", "payload_bytes"]).where("rid <> first_rid").select("rid", "first_rid"))
    return rows.join(fits(staged(narrow, "revisits")), "rid", "left")


def write_archive(pages: DataFrame, path: str, min_bytes: int = REVISIT_BYTES) -> None:
    marked = mark_revisits(pages, min_bytes)
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    is_revisit = F.col("first_rid").isNotNull()
    uri = F.regexp_replace(F.col("url").cast("string"), r"[\x00-\x20\x7F]", "%20")
    me = _record_id(F.col("rid"), "capture")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    target = [("WARC-Target-URI", uri), ("WARC-Date", DATE)]
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", _record_id(F.col("rid"), "request")), *target,
                       ("WARC-Concurrent-To", me), ("Content-Type", "application/http; msgtype=request")],
                      F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", me), *target, ("WARC-Payload-Digest", digest),
                        ("Content-Type", "application/http; msgtype=response")], F.concat(http, F.col("payload")))
    revisit = _record([("WARC-Type", "revisit"), ("WARC-Record-ID", me), *target, ("WARC-Payload-Digest", digest),
                       ("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(F.col("first_rid"), "capture")),
                       ("Content-Type", "application/http; msgtype=response")], http)
    page_line = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", _record_id(F.col("rid"), "metadata")), *target,
                        ("WARC-Concurrent-To", me), ("Content-Type", "application/warc-fields")], page_line)
    capture = F.concat(request, F.lit("\r\n\r\n"), F.when(is_revisit, revisit).otherwise(response),
                       F.lit("\r\n\r\n"), metadata, F.lit("\r\n"))
    (marked.select(capture.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", max(1, int(FILE_BYTES // (mean + 1500)))).text(path))


def parse_archive(data: bytes):
    """The records of one file as ``(headers, content)``; raises on a file that breaks off or has no record where one is due."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at:at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            headers[k.strip().lower()] = v.strip()
        start = end + 4
        at = start + int(headers["content-length"])
        if data[at:at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record that ends at byte {at} isn't closed")
        yield headers, bytes(view[start:at])
        at += 4


def _row(headers: dict, content: bytes, with_payload: bool) -> tuple:
    kind, size, payload, fields = headers.get("warc-type"), None, None, None
    digest = headers.get("warc-payload-digest")
    digest = digest and digest.rpartition(":")[2]
    if kind in ("response", "revisit"):
        head, _, payload = content.partition(b"\r\n\r\n")
        http = dict(x.lower().split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
        size = int(http.get("content-length", len(payload)))
        if kind == "response":  # a revisit's payload is elsewhere
            found = hashlib.sha1(payload).hexdigest()
            if size != len(payload) or digest not in (None, found):
                raise ValueError(f"the payload of {headers.get('warc-record-id')} isn't the one recorded")
            digest = found
        if not with_payload or kind == "revisit":
            payload = None
    elif kind == "metadata":
        fields = [tuple(x.split(": ", 1)) for x in content.decode("utf-8").split("\r\n") if ": " in x]
    return (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"),
            headers.get("warc-target-uri"), headers.get("warc-date"), digest, size, payload, fields)


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record. Files are read whole, one at a time, and given on in batches."""
    python_ready(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORD_SCHEMA))

    def parse(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for headers, body in parse_archive(gzip.decompress(content.as_py())):
                    rows.append(_row(headers, body, with_payload))
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its own record, and lists of the request and metadata records concurrent to it."""
    capture = records.where(F.col("record_type").isin("response", "revisit"))

    def beside(kind: str, name: str, *cols: str) -> DataFrame:
        """A capture has few such records, by the standard; those that name none are left out."""
        return (records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
                .groupBy(F.col("concurrent_to").alias("record_id"))
                .agg(F.sort_array(F.collect_list(F.struct("record_id", *cols))).alias(name)))

    meta = (records.where((F.col("record_type") == "metadata") & F.col("concurrent_to").isNotNull())
            .groupBy(F.col("concurrent_to").alias("record_id"))
            .agg(F.collect_list(F.struct("record_id", "date", "fields")).alias("metadata")))
    return (capture.join(beside("request", "requests", "target_uri", "date"), "record_id", "left")
            .join(meta, "record_id", "left")
            .select("record_id", "record_type", "refers_to", "target_uri", "date", "payload_digest", "payload_bytes",
                    "payload", "requests", "metadata"))


def page_of(captures: DataFrame) -> Column:
    return captures["metadata"][0]["fields"]["page-id"].cast("long")


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """Adds ``page_id`` and, for revisits, ``refers_to_page``. Responses get keys of their own in the join, so that no
    task gathers the rows that refer to nothing."""
    mine = captures.withColumn("page_id", page_of(captures)).withColumn(
        "key", F.coalesce("refers_to", F.concat(F.lit("-"), "record_id")))
    heads = captures.where("record_type = 'response'").select(F.col("record_id").alias("key"), page_of(captures).alias("refers_to_page"))
    return mine.join(heads, "key", "left").drop("key")


def archive_and_read(pages: DataFrame, with_payload: bool = True) -> DataFrame:
    """Write the pages as an archive in the shared folder, read it back and assemble its captures."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archive(pages, path)
    return resolve_revisits(assemble(read_records(spark, path, with_payload)))
