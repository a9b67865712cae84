"""WARC archives and a content-addressed store behind them.

:func:`plan_records` decides which record carries a payload and which revisits it; :func:`write_archives` writes WARC 1.1
records; :func:`read_archives` reads them back; :func:`store` keeps each payload once under its SHA-256
and each record's exact header block apart; :func:`reconstruct` joins them to the original records again.

Archives go through Spark's own text writer, so they land in any store it can reach: a record's end, two line
breaks, is the writer's separator. Files are compressed as a whole, so each is read from its start by one task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.session import checkpoint_root, materialize

REVISIT_BYTES = 1000
END = "\r\n\r\n"
# Target bytes of payload per archive file.
FILE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, key: str, uri: str, payload: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """record_key, target_uri, payload, payload_bytes, sha1, sha256, record_type, refers_to; one row per row of ``pages``.

    Of the records whose payloads of ``least`` bytes or more are equal (both digests and the length agree), that with the
    largest key is a response and the others revisit it; all else are responses. A null payload is empty. Only digests are
    grouped, payloads are not moved; a key repeated with the same payload revisits nothing but itself, so its rows are
    all responses. A null key never is the referred record unless the group has no other.
    """
    body = F.coalesce(payload, F.lit("").cast("binary"))
    marked = pages.select(F.col(key).alias("record_key"), F.col(uri).alias("target_uri"), body.alias("payload")).select(
        "*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256"))
    digests = marked.filter(F.col("payload_bytes") >= least).select("record_key", "sha1", "sha256", "payload_bytes")
    groups = digests.groupBy("sha256", "sha1", "payload_bytes").agg(F.max("record_key").alias("newest"), F.count(F.lit(1)).alias("n"))
    # Only payloads seen more than once need to be looked up.
    repeated = materialize(groups.filter("n > 1").select("sha256", "sha1", "payload_bytes", "newest"), "repeated")
    joined = marked.join(repeated, ["sha256", "sha1", "payload_bytes"], "left")
    revisit = F.col("newest").isNotNull() & ~F.col("record_key").eqNullSafe(F.col("newest"))
    return joined.select("record_key", "target_uri", "payload", "payload_bytes", "sha1", "sha256",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("newest")).alias("refers_to"))


def _record_id(key: Column) -> Column:
    """A name-based id: reruns give the same archives."""
    digest = F.md5(F.concat(F.lit("record:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def headers(records: DataFrame, date: str = "2024-01-01T00:00:00Z") -> Column:
    """The header block of a planned record, without the blank line that ends it. URIs lose blanks and line breaks."""
    def line(name, value):
        return F.when(value.isNotNull(), F.concat(F.lit(f"\r\n{name}: "), value)).otherwise("")
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col("record_key"))),
        line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("target_uri", r"[\x00-\x20]+", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")), line("X-Payload-SHA256", F.col("sha256")),
        line("X-Record-Key", F.col("record_key").cast("string")), line("X-Refers-To-Key", F.col("refers_to").cast("string")),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to")))), line("WARC-Profile", F.when(revisit, PROFILE)),
        line("Content-Type", F.lit("application/octet-stream")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))))


def write_archives(records: DataFrame, path: str | None = None, files: int | None = None) -> str:
    """Write planned records as ``*.txt.gz`` WARC files below ``path`` (a new shared folder unless given); returns it.

    ``files`` deals the records out evenly first; without it each task writes what it holds.
    """
    spark = records.sparkSession
    path = path or f"{checkpoint_root(spark)}/marginalia/warc-{uuid.uuid4().hex}"
    block = F.concat(headers(records).cast("binary"), F.lit(END).cast("binary"),
                     F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload")))
    rows = records.select(block.cast("string").alias("value"))
    (rows.repartition(files) if files else rows).write.mode("errorifexists").option("lineSep", END).option("compression", "gzip").text(path)
    return path


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)")
RECORD_SCHEMA = "headers binary, payload binary"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the pieces between separators together again and cuts records by their stated length.

    Pieces come in file order. A payload may hold separators, even whole records, or end in a part of one: only the
    header block is found by its separator, the body is counted. Line breaks between records are skipped.
    """
    end, buffer, at, body = END.encode(), bytearray(), 0, None
    heads, bodies, size = [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())], ["headers", "payload"])

    for batch in batches:
        for piece in batch.column(0).to_pylist():
            buffer += piece
            buffer += end
            while True:
                if body is None:
                    while at < len(buffer) and buffer[at] in b"\r\n":
                        at += 1
                    stop = buffer.find(end, at)
                    if stop < 0:
                        break
                    head = bytes(buffer[at:stop])
                    found = _LENGTH.search(head)
                    if not head.startswith(b"WARC/1.") or found is None:
                        raise ValueError(f"not a WARC record: {head[:80]!r}")
                    at, body = stop + len(end), int(found[1])
                if len(buffer) - at < body + len(end):
                    break
                if buffer[at + body:at + body + len(end)] != end:
                    raise ValueError(f"record does not end after its Content-Length of {body}: {head[:200]!r}")
                heads.append(head)
                bodies.append(bytes(buffer[at:at + body]))
                at, size, body = at + body + len(end), size + len(head) + body, None
            if at:
                del buffer[:at]
                at = 0
            if size > 8 << 20:
                yield flush()
                heads, bodies, size = [], [], 0
    if body is not None or buffer.strip(b"\r\n"):
        raise ValueError("archive ends inside a record")
    if heads:
        yield flush()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """headers, payload of every record below ``path``; a torn or mislabelled record raises."""
    text = spark.read.option("lineSep", END).text(path)
    return text.select(F.col("value").cast("binary").alias("value")).mapInArrow(_records, RECORD_SCHEMA)


def _field(name: str) -> Column:
    found = F.regexp_extract(F.col("headers").cast("string"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def parsed(records: DataFrame) -> DataFrame:
    """The header fields of records as columns, next to the exact header block and the payload."""
    return records.select(
        "headers", "payload", _field("X-Record-Key").alias("record_key"), _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Key").alias("refers_to"), F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("sha1"),
        _field("X-Payload-SHA256").alias("sha256"))


def store(records: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed records to (heads, payloads), both written below ``path``.

    ``payloads``: sha256, payload, payload_bytes, payload_sha1, each payload once, under the digest computed from its bytes.
    ``heads``: every record's exact header block and fields. A response whose bytes do not have the stated digests
    raises. Equal small payloads of different records are merged by digest before their bytes are looked up.
    """
    spark = records.sparkSession
    path = path or f"{checkpoint_root(spark)}/marginalia/store-{uuid.uuid4().hex}"
    checked = records.withColumn("own_sha256", F.sha2("payload", 256)).withColumn("own_sha1", F.sha1("payload"))
    response = F.col("record_type") == "response"
    right = ~response | ((F.col("own_sha256") == F.col("sha256")) & (F.col("own_sha1") == F.col("sha1")))
    verified = checked.filter(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), F.coalesce("record_key", F.lit("null")))).cast("boolean")))
    verified.drop("payload", "own_sha256", "own_sha1").write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/heads")
    held = checked.filter(response).select("sha256", "payload", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.col("own_sha1").alias("payload_sha1"))
    held.dropDuplicates(["sha256"]).write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/payloads")
    return spark.read.parquet(f"{path}/heads"), spark.read.parquet(f"{path}/payloads")


def reconstruct(heads: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every original record again: its header block and fields with the payload columns given.

    A revisit gets the payload it refers to. Pass only the columns of ``payloads`` that are wanted: a join that needs
    lengths alone then moves no bytes. Many heads on one payload are a skewed join, which adaptive execution splits.
    """
    return heads.join(payloads, "sha256", "left")
