"""WARC archives with repeated payloads written once.

Headers (id, address, payload digest and length) are shuffled by digest without their payloads. Of
equal payloads the smallest page_id keeps the payload as a response; the others become revisit records
that name it. The archives are then written with fresh headers, and read by the lengths these give.

Spark's text writer writes the records: a record ends with two line ends, which is the separator between
rows, so a file of rows is a file of records. That works on any store Spark can write to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.llm.common import settled, shared_folder

#: RFC 4648. Fixed value.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Large groups of equal payloads are joined in this many parts.
SALTS = 16
RECORDS_PER_FILE = 5000


def base32_sha1(data: Column) -> Column:
    """The usual payload digest: 160 bits as 32 characters of 5 bits."""
    digits = F.sha1(data)
    characters = []
    for group in range(8):
        bits = F.conv(F.substring(digits, 5 * group + 1, 5), 16, 10).cast("int")
        characters += [F.substring(F.lit(BASE32), F.shiftright(bits, 15 - 5 * i).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for i in range(4)]
    return F.concat(*characters)


def resolved(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``headers`` (page_id, url, digest, payload_bytes) with refers_to and refers_to_url: of the smallest
    page_id with the same payload, null for that one itself and for payloads under ``least_bytes``."""
    groups = headers.filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(
        F.min("page_id").alias("_first"), F.min_by("url", "page_id").alias("_url"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    salted = groups.drop("_n").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = headers.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    other = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(salted, ["digest", "_salt"], "left").select(
        "page_id", "url", "digest", "payload_bytes", F.when(other, F.col("_first")).alias("refers_to"),
        F.when(other, F.col("_url")).alias("refers_to_url"))


def _line(name: str, value: Column) -> Column:
    """One header line; nothing where the value is null. Control characters and spaces can't stand in one."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _address(url: Column) -> Column:
    return F.nullif(F.regexp_replace(url, r"[\x00-\x20\x7f]", "%20"), F.lit(""))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def records(pages: DataFrame, date: str, least_bytes: int = 0) -> DataFrame:
    """One column ``value``: the whole record of each page, without the two line ends behind it."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", _address(F.col("url")).alias("url"), payload.alias("_payload"),
                        base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    headers = settled(resolved(rows.drop("_payload"), least_bytes).filter("refers_to is not null").select(
        F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", "refers_to_url").distinct(), "warc-revisits")
    rows = rows.join(headers, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    again = F.col("refers_to").isNotNull()
    reply = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
                     F.col("payload_bytes").cast("string"), F.lit(END + END))
    rows = rows.withColumn("_block", F.when(again, reply).otherwise(F.concat(reply, F.col("_payload"))))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("page_id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("_block").cast("binary")))),
        _line("WARC-Profile", F.when(again, PROFILE)), _line("WARC-Refers-To", F.when(again, _name(F.col("refers_to")))),
        _line("WARC-Refers-To-Target-URI", F.when(again, F.col("refers_to_url"))), _line("WARC-Refers-To-Date", F.when(again, date)),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"),
        _line("Content-Length", F.octet_length("_block").cast("string")), F.lit(END))
    return rows.select(F.concat(head, F.col("_block")).alias("value"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0) -> None:
    """Write a record per page to gzip files under ``path``.

    ``pages`` needs page_id, url and html; other columns are ignored. Null html is an empty payload, a
    null or empty url leaves its line out. Rows that repeat a page_id with the same payload are all
    responses if the id is the smallest, else all revisits. A row with a null page_id is never
    referred to. ``least_bytes``: smaller payloads are never revisits.
    """
    records(pages, date, least_bytes).write.option("lineSep", END + END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every record of an archive: its headers, the reply's headers, the payload."""
    def headers() -> dict[str, str]:
        found: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.strip().lower()] = value.strip()
        return found

    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        head = headers()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record {head.get('warc-record-id')} is longer or shorter than it says")
        reply, _, payload = block.partition(b"\r\n\r\n")
        lines = dict(line.decode("utf-8", "replace").split(": ", 1) for line in reply.split(b"\r\n")[1:])
        yield head, {k.lower(): v for k, v in lines.items()}, payload


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Per record page_id, url, record_type, payload_bytes and payload_digest (of the full payload),
    refers_to and payload (null for revisits). A payload that does not fit its digest is an error."""
    number = lambda name: None if name in (None, "<urn:page:null>") else int(name[len("<urn:page:"):-1])
    schema = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
              "payload binary")
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                       ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, reply, payload in parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())))):
                    digest, kind = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"]
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {head['warc-record-id']} does not fit its digest")
                    rows.append((number(head["warc-record-id"]), head.get("warc-target-uri"), kind, int(reply["content-length"]), digest,
                                 number(head.get("warc-refers-to")), payload if kind == "response" else None))
                    held += len(payload)
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, schema)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The pages' records as read back from archives written to the shared folder."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes=least_bytes)
    return read_archives(spark, path)


ARCHIVE_SQL = """with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages)
select page_id, strlen(html)::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::int >> (15 - 5 * (i % 4))::int) & 31) + 1), 1)), '') as payload_digest,
  case when min(page_id) over (partition by h) = page_id then 'response' else 'revisit' end as record_type,
  case when min(page_id) over (partition by h) <> page_id then min(page_id) over (partition by h) end as refers_to
from p"""
