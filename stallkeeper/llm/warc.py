"""WARC archives without repeated payloads.

Headers (digest, size, page) are shuffled by payload digest, not payloads: the smallest page of a digest keeps the
payload as a response, the others become revisit records that name it. What goes back to the pages is only which page
refers to which; payloads are dealt to archives once, by a hash of the page, so copies of one payload never meet.
Records are written as text by Spark's own writer, with the record separator as line separator, so any shared store will
do. Archives hold about ARCHIVE_BYTES of records; an archive is one compressed stream, and is read by Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm.common import join_groups, new_path, written

ARCHIVE_BYTES = 16 << 20
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 (RFC 4648) of a SHA-1: 20 bits at a time, in Spark's base 32 digits, then in those of the RFC."""
    digest = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """id, digest, bytes and refers_to of the pages whose payload an earlier page has; from headers alone. A digest that
    many pages have is joined by broadcast."""
    payload = F.coalesce(payload_col, F.lit(""))
    headers = pages.select(F.col(id_col).alias("id"), base32_sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    headers = written(headers.where(F.col("id").isNotNull() & (F.col("bytes") >= min_bytes)), "headers")
    first = written(headers.groupBy("digest", "bytes").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "first")
    return join_groups(headers, first, ["digest", "bytes"], how="inner").where("id != refers_to").select("id", "digest", "bytes", "refers_to").distinct()


def resolved(pages: DataFrame, parts: int, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, bytes, digest, refers_to (null for responses), in parts. Payloads of fewer than min_bytes bytes
    are all responses, and so are pages without an id, which nothing could refer to."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.encode("payload", "UTF-8")))
    keys = ["id", "digest", "bytes"]
    again = written(revisits(pages, min_bytes, id_col, payload_col), "revisits")
    nameless = rows.where("id is null").withColumn("refers_to", F.lit(None).cast(again.schema["refers_to"].dataType))
    found = rows.where("id is not null").repartition(parts, *keys).join(again.repartition(parts, *keys), keys, "left")
    return found.unionByName(nameless)


def _record(date: str) -> Column:
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\r\n]", " ")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), urn("id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), clean(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("refers_to"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes one record per row of pages to archives under path, of about archive_bytes of records each.

    Null payloads are empty ones; a null url is an empty one; line ends in urls become spaces. Rows that repeat the
    smallest id of a payload are responses all; a row without an id is a response. Very long payloads make an archive
    longer. Other columns are ignored; an empty table gives no records."""
    size = pages.agg(F.sum(F.coalesce(F.octet_length(payload_col), F.lit(0)).cast("long") + 512)).first()[0] or 0
    records = resolved(pages, max(1, -(-size // archive_bytes)), min_bytes, id_col, url_col, payload_col)
    records.select(_record(date).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip

    names = ["type", "id", "refers_to", "url", "payload_bytes", "payload_digest", "declared"]
    for batch in batches:
        for content in batch.column("content").to_pylist():
            data, at, rows = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content, 0, []
            while at < len(data):
                stop = data.index(b"\r\n\r\n", at)
                version, *lines = data[at:stop].decode().split("\r\n")
                if version != VERSION:
                    raise ValueError(f"no record at byte {at}: {version[:40]!r}")
                head = dict(x.split(": ", 1) for x in lines)
                block = data[stop + 4 : (at := stop + 4 + int(head["Content-Length"]))]
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if data[at : at + 4] != b"\r\n\r\n":
                    raise ValueError(f"a record doesn't end at byte {at}")
                at += 4
                page = lambda x: None if x in (None, "<urn:page:none>") else int(x[len("<urn:page:") : -1])
                whole = head["WARC-Type"] == "response"
                rows.append((head["WARC-Type"], page(head["WARC-Record-ID"]), page(head.get("WARC-Refers-To")), head["WARC-Target-URI"], len(payload) if whole else None, base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None, head["WARC-Payload-Digest"].removeprefix("sha1:")))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """type, id, refers_to, url, payload_bytes, payload_digest of every record under path. A revisit's size and digest
    are computed from the payload of the response that it refers to; a digest that differs from the header's is null."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_parse, "type string, id long, refers_to long, url string, payload_bytes long, payload_digest string, declared string")
    rows = written(rows, "records")  # headers; what many revisits refer to is joined by broadcast
    responses = rows.where("type = 'response' and id is not null").groupBy(F.col("id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(F.max("payload_bytes").alias("of_bytes"))
    asked = rows.where("refers_to is not null").groupBy("refers_to", "declared").agg(F.count("*").alias("n"))
    original = written(asked.join(responses, ["refers_to", "declared"]).withColumn("of_digest", F.col("declared")), "originals")
    found = join_groups(rows, original, ["refers_to", "declared"])
    digest = F.coalesce("payload_digest", "of_digest")
    return found.select("type", "id", "refers_to", "url", F.coalesce("payload_bytes", "of_bytes").alias("payload_bytes"), F.when(digest == F.col("declared"), digest).alias("payload_digest"))


def archive(pages: DataFrame, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes archives of pages to a new place in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes, **columns)
    return read_archives(pages.sparkSession, path)
