"""WARC archives with revisit records for repeated payloads.

Method: headers (page, URL, size, SHA-1 of the payload) are grouped by digest;
of records with equal payloads of at least ``MIN_REVISIT`` bytes the one with
the largest page_id stays a response and the others become revisits of it.
Payloads themselves are never shuffled while the digests that repeat fit the
broadcast bound.  Records are written with fresh headers as gzip files in
WARC/1.0 form through Spark's text writer, so any file system that Spark
writes serves; reading back parses records by Content-Length and joins
revisits to the responses they name.

Defined cases: a null html is an empty payload; equal payloads under one
page_id that is the largest are responses each; rows with a null page_id are
written, and revisit others, but are never revisited; null URLs are written as
``urn:none``; repeated rows are records each; a payload may be as long as a text
can be and is read back by itself, in parts; of equal payloads the largest
page_id decides, so there are no ties; an empty table gives an archive without
records; other columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.workspace import fresh_path, materialize, sized

MIN_REVISIT = 1000
#: Records a file holds at most; files are read by one task each.
FILE_RECORDS = 4000
_CRLF = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PREFIX = "urn:page:"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def _headed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:none")), r"[\r\n]", " ").alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )


def resolve(headed: DataFrame) -> DataFrame:
    """With refers_to: the page that a record revisits, else null."""
    groups = headed.where((F.col("size") >= MIN_REVISIT)).groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null")
    groups = sized(materialize(groups.select("digest", "original"), "originals"))
    joined = headed.join(groups, "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))


def _record() -> Column:
    """The text of a record, but for the line end that the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(_HTTP), F.col("size").cast("string"), F.lit(2 * _CRLF))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    # what others refer to is named by its page; all else, repeated rows too, by its page and a number of its own
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    named = F.when(F.col("page_id") == F.col("original"), number).otherwise(F.concat(number, F.lit(":"), F.expr("uuid()")))
    head = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit(f"WARC-Record-ID: <{_PREFIX}"), named, F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_PREFIX}"), F.col("refers_to").cast("string"), F.lit(f">{_CRLF}WARC-Profile: {_PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws(_CRLF, *head), F.lit(2 * _CRLF), block, F.lit(_CRLF))


def write_archives(pages: DataFrame, path: str) -> None:
    """pages(page_id, url, html) -> gzip WARC files under path."""
    records = resolve(_headed(pages)).select(_record().alias("value"))
    records.write.option("lineSep", _CRLF).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    held, need = bytearray(), 0
    header: dict[str, str] | None = None
    while True:
        if header is None:
            end = held.find(b"\r\n\r\n")
            if end >= 0:
                lines = bytes(held[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
                header = dict(x.split(": ", 1) for x in lines[1:])
                need = int(header["Content-Length"])
                del held[: end + 4]
                continue
        elif len(held) >= need + 4:
            yield header, bytes(held[:need])
            del held[: need + 4]
            header = None
            continue
        part = next(parts, None)
        if part is None:
            if held.strip() or header is not None:
                raise ValueError("the archive ends inside a record")
            return
        held += part


def _inflated(raw: memoryview, step: int = 1 << 18) -> Iterator[bytes]:
    """A gzip file's contents in parts of bounded size, member after member."""
    data, d = raw, zlib.decompressobj(31)
    at = 0
    while at < len(data) or d.unconsumed_tail:
        chunk = d.unconsumed_tail or bytes(data[at : at + step])
        if not d.unconsumed_tail:
            at += step
        out = d.decompress(chunk, 4 * step)
        if out:
            yield out
        while d.eof and d.unused_data:
            rest = d.unused_data
            d = zlib.decompressobj(31)
            out = d.decompress(rest, 4 * step)
            if out:
                yield out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload_digest, payload_bytes of each record; a response's are taken from its payload, a revisit's are null bytes until resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None or x.startswith(f"<{_PREFIX}null:") else int(x[len(_PREFIX) + 1 : -1].split(":")[0])
        for batch in batches:
            for raw in batch.column(0):
                out: list[list] = [[], [], [], [], []]
                for header, block in parse(_inflated(memoryview(raw.as_buffer()))):
                    kind = header["WARC-Type"]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    response = kind == "response"
                    digest = hashlib.sha1(payload).hexdigest() if response else header["WARC-Payload-Digest"].removeprefix("sha1:")
                    if digest != header["WARC-Payload-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"payload digest differs: {header['WARC-Record-ID']}")
                    for column, value in zip(out, (number(header["WARC-Record-ID"]), kind, number(header.get("WARC-Refers-To")), digest, len(payload) if response else None), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long")


def resolved(records: DataFrame) -> DataFrame:
    """Records with every revisit's payload size and digest taken from the response it names."""
    records = materialize(records, "records")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes")
    named = revisits.select(F.col("refers_to").alias("page_id")).distinct()
    originals = records.where("record_type = 'response'").join(named, "page_id", "left_semi")
    originals = originals.groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes")).withColumnRenamed("page_id", "refers_to")
    found = revisits.join(originals, ["refers_to", "payload_digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(columns).union(found.select(columns))


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, payload_bytes, payload_digest, record_type, refers_to, read back from archives written for them."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return resolved(read_archives(pages.sparkSession, path))


ROUND_TRIP_SQL = f"""with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html))::bigint as payload_bytes, sha1(html) as payload_digest from p),
g as (select payload_digest, max(page_id) as original, count(*) as n from d where payload_bytes >= {MIN_REVISIT} group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when g.n > 1 and original is not null and d.page_id is distinct from g.original then 'revisit' else 'response' end as record_type,
  case when g.n > 1 and d.page_id is distinct from g.original then g.original end as refers_to
from d left join g using (payload_digest)"""
