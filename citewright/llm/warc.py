"""WARC archives: writing captures and assembling transactions from their records.

A capture is a response (or, for a payload already held, a revisit) record, a request and a
metadata record; the latter two name the former in WARC-Concurrent-To. Archives are written
by Spark's text writer, one record per row with the record terminator as line separator,
gzip-compressed in files of about FILE_BYTES bytes at most (or of one page, where that is longer), and read back as binary files, which are cut
into records by Content-Length alone, so payloads may hold any bytes, from one gzip member or many.
Digest and size of a capture are those of the payload read back, of a revisit those of the response
it refers to (null where that isn't in the archive). The records of a transaction are then brought together by the identifier they are concurrent to and nested
into one row per capture.

Defined cases: a null payload is empty; a null url becomes ``about:blank``; line ends in urls
become blanks; rows without page_id are
left out unless ``unnamed``; every row is a capture: the further rows of a page id, and rows without one, are named
by their number too; an empty table gives an empty archive and no rows; other columns are
ignored.
"""

from __future__ import annotations

import gzip
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stage

LEAST_BYTES = 100
FILE_BYTES = 1 << 26  # of a file before compression
SIZES = (1 << 14, 1 << 18, 1 << 22)  # pages up to each of these sizes share files, longer ones have their own
BATCH_BYTES = 1 << 22  # of the records that leave a worker at once
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, fields string"


def _id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), name, F.lit(">"))


def plan_captures(pages: DataFrame, payload: str = "html", unnamed: bool = False) -> DataFrame:
    """page_id, name, url, body, digest, n_bytes, refers_to (a name): of equal payloads of at least
    LEAST_BYTES bytes the rows of the smallest page_id are responses, the others revisit the first of them.
    Names are found without the payloads, which move once, by row."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]+", " ").alias("url"),
        body.alias("body"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"),
    )
    rows = stage(rows if unnamed else rows.where("page_id is not null"), "pages")
    plan = rows.select("row_id", "page_id", "digest", "n_bytes")
    plan = plan.join(plan.groupBy("page_id").agg(F.min("row_id").alias("own")), "page_id", "left")
    page, row = F.col("page_id").cast("string"), F.col("row_id").cast("string")
    plan = plan.withColumn("name", F.when(F.col("page_id").isNull(), F.concat(F.lit("row."), row)).when(F.col("row_id") == F.col("own"), page).otherwise(F.concat(page, F.lit("."), row)))
    large = plan.where((F.col("n_bytes") >= LEAST_BYTES) & F.col("page_id").isNotNull())
    first = large.groupBy("digest").agg(F.min(F.struct("page_id", "row_id", "name")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stage(first, "first")  # of two tables, so that a payload of many rows can be split
    plan = plan.join(first, "digest", "left")
    refers = F.when((F.col("n_bytes") >= LEAST_BYTES) & (F.col("first.page_id") < F.col("page_id")), F.col("first.name"))
    return rows.join(stage(plan.select("row_id", "name", refers.alias("refers_to")), "plan"), "row_id")


def _record(fields: list[tuple[str, Column]], block: Column) -> Column:
    head = [F.lit("WARC/1.1\r\n")]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        head.append(F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit("")))
    return F.concat(*head, F.lit("\r\n"), block)


def write_archive(pages: DataFrame, path: str, payload: str = "html", date: str = "2024-01-01T00:00:00Z", unnamed: bool = False) -> None:
    """Write the captures of ``pages`` (page_id, url, payload) as gzip-compressed archives."""
    plan = plan_captures(pages, payload, unnamed)
    page, revisit = F.col("name"), F.col("refers_to").isNotNull()
    main = F.when(revisit, _id("revisit", page)).otherwise(_id("response", page))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    capture = _record(
        [("WARC-Type", F.when(revisit, "revisit").otherwise("response")), ("WARC-Record-ID", main), *common,
         ("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
         ("WARC-Refers-To", F.when(revisit, _id("response", F.col("refers_to")))), ("WARC-Profile", F.when(revisit, _PROFILE))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", _id("request", page)), *common,
         ("Content-Type", F.lit("application/http;msgtype=request")), ("WARC-Concurrent-To", main)],
        F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n")),
    )
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _id("metadata", page)), *common,
         ("Content-Type", F.lit("application/warc-fields")), ("WARC-Concurrent-To", main)],
        F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")),
    )
    records = F.explode(F.array(request, capture, metadata)).alias("value")
    longest = plan.agg(F.max("n_bytes")).first()[0] or 0
    low = -1
    for high in (*SIZES, None):
        own = plan.where(F.col("n_bytes") > low)
        own = own if high is None else own.where(F.col("n_bytes") <= high)
        pages_a_file = 1 if high is None else FILE_BYTES // high
        if low < longest or low < 0:
            own.select(records).write.mode("append").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", 3 * pages_a_file).text(path)
        low = high


def parse_records(data: bytes):
    """Header fields and block of every record of an uncompressed archive; it fails on bytes outside of records and
    on records that are shorter than their header says or lack their end."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the WARC record at byte {at} doesn't end where its Content-Length says")
        yield head, data[end + 4 : stop]
        at = stop + 4


def unpack(raw: bytes) -> bytes:
    """A file without compression: all its gzip members, one a record or one for all."""
    return gzip.GzipFile(fileobj=io.BytesIO(raw)).read() if raw[:2] == b"\x1f\x8b" else raw


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. A task holds one file at a time, of bounded bytes; every record is checked against the length its header gives. Digest and size of the payload are as the
    header has them, for ``assemble`` to replace."""

    def run(batches):
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for head, block in parse_records(unpack(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind = head["WARC-Type"]
                    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None) if kind in ("response", "revisit") else None
                    out.append((head["WARC-Record-ID"], kind, head.get("WARC-Concurrent-To"), head.get("WARC-Refers-To"), head.get("WARC-Target-URI"),
                                head.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, length, payload if kind == "response" else None,
                                block.decode("utf-8", "replace") if kind in ("request", "metadata") else None))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield rows(out)
                        out, size = [], 0
                if out:
                    yield rows(out)

    def rows(out):
        types = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, page_id and the nested capture, request and metadata
    records, joined through the identifier that request and metadata are concurrent to. Digest and size are taken
    from the payloads of the responses."""
    main = F.col("record_type").isin("response", "revisit")
    size, digest = F.octet_length("payload").cast("long"), F.sha2("payload", 256)  # null where no payload is held
    whole = F.struct("record_id", "record_type", "refers_to", "url", digest.alias("payload_digest"), size.alias("payload_bytes"), size.alias("held_bytes"), digest.alias("held_digest"))
    side = F.struct("record_id", "fields")
    keyed = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    rows = keyed.groupBy("capture_id").agg(
        F.max(F.when(main, whole)).alias("capture"),
        F.max(F.when(F.col("record_type") == "request", side)).alias("request"),
        F.max(F.when(F.col("record_type") == "metadata", side)).alias("metadata"),
    )
    rows = stage(rows, "captures")
    held = rows.where("capture.record_type = 'response'").select(F.col("capture.record_id").alias("id"), F.col("capture.held_digest").alias("digest"), F.col("capture.held_bytes").alias("size"))
    rows = rows.join(held, F.col("capture.refers_to") == F.col("id"), "left")
    capture = F.col("capture").withField("payload_digest", F.coalesce("capture.held_digest", "digest")).withField("payload_bytes", F.coalesce("capture.held_bytes", "size"))
    rows = rows.withColumn("capture", capture).drop("id", "digest", "size")
    return rows.withColumn("page_id", F.expr("try_cast(regexp_extract(metadata.fields, 'page-id: (-?[0-9]+)', 1) as bigint)"))


def archive_pages(pages: DataFrame, path: str | None = None, unnamed: bool = False) -> DataFrame:
    """Write ``pages`` to archives, read them back and assemble the captures."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, unnamed=unnamed)
    return assemble(read_records(spark, path))
