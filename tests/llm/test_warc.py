import gzip
import glob
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import warc
from marginalia.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string"
TRAPS = ["", "\r\n", "a\r\n", "\r\n\r\n", "x\r\n\r\n", "\r\n\r\ny", "\n\n", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é\r", "\r\r\n\n", "\0"]


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGES).withColumn("sha1", F.lit("mine")).withColumn("payload", F.lit(3))


def round_trip(spark, frame, files=None):
    planned = warc.plan_records(frame, "page_id", "url", F.col("html").cast("binary"))
    path = warc.write_archives(planned, files=files)
    heads, payloads = warc.store(warc.parsed(warc.read_archives(spark, path)))
    return planned, path, heads, payloads


def test_every_payload_comes_back_whatever_it_holds(spark):
    rng = random.Random(1)
    bodies = TRAPS + ["".join(rng.choices(["\r", "\n", "a", "WARC/1.1", "\r\n\r\n"], k=rng.randrange(1, 12))) for _ in range(150)]
    rows = [(i, f"http://h/{i}", b) for i, b in enumerate(bodies)] + [(900, None, None), (901, "u r\nl", "z" * 300_000)]
    for files in (1, 3):
        _, _, heads, payloads = round_trip(spark, pages(spark, rows), files)
        back = {int(r.record_key): bytes(r.payload).decode() for r in warc.reconstruct(heads, payloads).collect()}
        assert back == {i: b or "" for i, _, b in rows}


def test_headers_survive_exactly(spark):
    planned, path, heads, _ = round_trip(spark, pages(spark, [(i, f"http://h/{i}", "p" * (i % 3) * 700) for i in range(30)]))
    want = sorted(r.h.encode() for r in planned.select(warc.headers(planned).alias("h")).collect())
    assert sorted(bytes(r.headers) for r in heads.collect()) == want
    raw = b"".join(gzip.open(f).read() for f in glob.glob(f"{path}/*.gz"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == 30 and raw.endswith(b"\r\n\r\n")


def test_largest_key_is_the_response_of_equal_payloads(spark):
    long, limit = "q" * 5000, "é" * 500
    rows = [(3, "a", long), (8, "b", long), (5, "c", long), (1, "d", limit), (2, "e", limit), (6, "f", "s" * 999), (7, "g", "s" * 999), (9, "h", None), (10, "i", None)]
    _, _, heads, payloads = round_trip(spark, pages(spark, rows))
    kinds = {int(r.record_key): (r.record_type, r.refers_to and int(r.refers_to)) for r in heads.collect()}
    assert kinds == {3: ("revisit", 8), 8: ("response", None), 5: ("revisit", 8), 1: ("revisit", 2), 2: ("response", None),
                     6: ("response", None), 7: ("response", None), 9: ("response", None), 10: ("response", None)}
    stored = {r.sha256: bytes(r.payload) for r in payloads.collect()}
    assert len(stored) == 4 and all(hashlib.sha256(p).hexdigest() == d for d, p in stored.items())


def test_repeated_rows_null_keys_and_empty_table(spark):
    rows = [(4, "a", "r" * 2000), (4, "a", "r" * 2000), (None, "a", "r" * 2000)]
    _, _, heads, payloads = round_trip(spark, pages(spark, rows))
    assert sorted((str(r.record_key), r.record_type) for r in heads.collect()) == [("4", "response"), ("4", "response"), ("None", "revisit")]
    assert payloads.count() == 1
    _, _, heads, payloads = round_trip(spark, pages(spark, [(1, "a", "b")]).limit(0))
    assert heads.count() == payloads.count() == 0


def test_damage_is_reported(spark):
    frame = spark.createDataFrame([(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3", b"abc")], "headers binary, payload binary")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.store(warc.parsed(frame).withColumn("sha256", F.lit("0")).withColumn("sha1", F.lit("0")))
    with pytest.raises(ValueError, match="ends inside"):
        import pyarrow as pa
        list(warc._records([pa.RecordBatch.from_arrays([pa.array([b"WARC/1.1\r\nContent-Length: 9", b"abc"])], ["value"])]))


def test_query_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op1_warc_archive']})").fetchall()
    got = QUERIES["op1_warc_archive"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)
