"""Content-addressed WARC archive.

Each distinct payload is stored once, in gzip members of WARC ``resource``
records named by its SHA-256; the exact header block of every page's record is
kept apart.  Reading verifies each payload against its digests and length, and
joins headers to payloads to give the original records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import ensure_importable, materialize, shared_dir

#: Payloads of fewer bytes are never replaced by a revisit record; payload bytes to a file.
REVISIT_BYTES, FILE_BYTES = 1000, 8 << 20
CRLF = b"\r\n"


def payload_record(digest: str, sha1: str, payload: bytes) -> bytes:
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:sha256:{digest}>", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/octet-stream", f"Content-Length: {len(payload)}"]
    return CRLF.join(h.encode() for h in head) + CRLF * 2 + payload + CRLF * 2


def members(blob: bytes) -> Iterator[bytes]:
    """The gzip members of ``blob``; bytes that start no member end it."""
    while blob[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out = d.decompress(blob) + d.flush()
        if not d.eof:
            raise ValueError("a gzip member is cut short")
        yield out
        blob = d.unused_data


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(CRLF * 2)
    fields = dict(line.decode().split(": ", 1) for line in head.split(CRLF)[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF * 2:
        raise ValueError("the record's length is wrong")
    return fields, rest[:n]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for b in batches:
        for digest, sha1, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = payload.as_py()
            parts.append(gzip.compress(payload_record(digest, sha1, raw), 3, mtime=0))
            held += len(raw)
            if held >= FILE_BYTES:
                yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(parts)], pa.binary())})
                parts, held = [], 0
    if parts:
        yield pa.RecordBatch.from_pydict({"value": pa.array([b"".join(parts)], pa.binary())})


def _safe(c: Column) -> Column:
    """Line ends in a header value are percent-encoded."""
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> str:
    """Write one record a row of ``pages`` and return the archive's folder.

    Null payloads are empty.  Among records with equal payloads of at least
    ``revisit_bytes`` bytes that with the largest id (then URL) is the response
    and the others revisit it; of repeated rows with that id and URL one is the
    response.  A null id is smaller than any other.
    """
    spark = pages.sparkSession
    ensure_importable(spark)
    folder = shared_dir(spark, "warc")
    body = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "sha1": F.sha1("payload"), "n": F.octet_length("payload")})
    distinct = rows.groupBy("sha256").agg(F.first("sha1").alias("sha1"), F.first("payload").alias("payload"))
    distinct.select("sha256", "sha1", "payload").mapInArrow(_pack, "value binary").select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{folder}/payloads")

    heads = materialize(rows.groupBy("id", "url", "sha256", "sha1", "n").agg(F.count(F.lit(1)).alias("copies")), "warc-heads")
    top = heads.where(F.col("n") >= revisit_bytes).groupBy("sha256").agg(F.max(F.struct("id", "url")).alias("top"))
    top = materialize(top, "warc-top")
    each = heads.join(top, "sha256", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = F.col("top").isNull() | (F.struct("id", "url").eqNullSafe(F.col("top")) & (F.col("copy") == 1))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(first, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name(F.col("id")), F.lit(":"), F.col("copy").cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), _safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.concat(F.lit("WARC-Content-Address: sha256:"), F.col("sha256")),
        F.when(~first, F.concat(F.lit("WARC-Refers-To: <urn:page:"), name(F.col("top.id")), F.lit(":1>"))),
        F.when(~first, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(first, F.col("n")).otherwise(F.lit(0)).cast("string")),
    ]
    blocks = each.select(F.concat_ws("\r\n", *lines).alias("value"))
    blocks.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(f"{folder}/headers")
    return folder


def read_payloads(spark: SparkSession, folder: str, with_bytes: bool = True) -> DataFrame:
    """``(sha256, sha1, n[, payload])`` of each stored payload, verified; a mismatch raises."""
    ensure_importable(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0):
                rows = []
                for fields, payload in map(parse_record, members(blob.as_py())):
                    sha256, sha1 = hashlib.sha256(payload).hexdigest(), hashlib.sha1(payload).hexdigest()
                    if fields["WARC-Record-ID"] != f"<urn:sha256:{sha256}>" or fields["WARC-Payload-Digest"] != f"sha1:{sha1}":
                        raise ValueError(f"payload {fields['WARC-Record-ID']} has changed")
                    rows.append((sha256, sha1, len(payload), *([payload] * with_bytes)))
                kinds = (pa.string(), pa.string(), pa.int64(), *([pa.binary()] * with_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["sha256", "sha1", "n", *(["payload"] * with_bytes)])

    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema(schema).load(f"{folder}/payloads")
    return files.select("content").mapInArrow(run, "sha256 string, sha1 string, n long" + ", payload binary" * with_bytes)


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's exact header block and the fields parsed from it."""
    blocks = spark.read.option("lineSep", "\r\n\r\n").schema("value string").text(f"{folder}/headers")
    field = lambda pattern: F.regexp_extract("value", rf"\r\n{pattern}(?:\r\n|$)", 1)
    page = lambda c: F.when(c.isin("", "none"), None).otherwise(c.try_cast("long"))
    return blocks.select(
        F.col("value").alias("header"),
        page(field("WARC-Record-ID: <urn:page:([^:]*):[0-9]+>")).alias("id"),
        field("WARC-Type: ([a-z]+)").alias("record_type"),
        field("WARC-Content-Address: sha256:([0-9a-f]+)").alias("sha256"),
        page(field("WARC-Refers-To: <urn:page:([^:]*):[0-9]+>")).alias("refers_to"),
    )


def read_archive(spark: SparkSession, folder: str, id_col: str = "page_id", with_bytes: bool = True) -> DataFrame:
    """The original records: id, header block, payload digest, length and type, and the payload itself on demand."""
    found = read_headers(spark, folder).join(read_payloads(spark, folder, with_bytes), "sha256")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to", *(["header", "payload"] if with_bytes else []))
