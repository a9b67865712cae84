import random
from collections import defaultdict

from pyspark.sql import functions as F

from marginalia.llm import sharding


def brute_force(rows, limit):
    """(hash bits, bytes) split on one more bit until a bucket fits."""
    out = {}

    def split(prefix, held):
        if sum(b for _, b in held) <= limit or len(prefix) == 64:
            out[prefix] = held
            return
        for bit in "01":
            part = [h for h in held if h[0][len(prefix)] == bit]
            if part:
                split(prefix + bit, part)
    if rows:
        split("", rows)
    return out


def check(docs, limit):
    hashes = docs.select("doc_id", sharding.shard_hash().alias("h"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("b")).collect()
    want = brute_force([(format(r.h & (1 << 64) - 1, "064b"), r.b) for r in hashes], limit)
    got = sharding.assign(docs, limit).collect()
    assert len(got) == len(hashes)
    held = defaultdict(list)
    for r in got:
        held[r.shard, r.part].append(r)
    assert {s for s, _ in held} == set(want)
    for (shard, part), rows in held.items():
        assert sum(r.bytes for r in rows) == rows[0].shard_bytes and len(rows) == rows[0].shard_docs and rows[0].depth == len(shard)
        assert rows[0].shard_bytes <= limit or len(rows) == 1
    return held


def test_only_oversized_buckets_split(documents):
    rng = random.Random(2)
    docs = documents([(i, "x" * rng.choice([0, 3, 50, 400])) for i in range(700)] + [(None, "no id"), (9000, None), (9001, "")])
    held = check(docs, 2000)
    assert len({len(s) for s, _ in held}) > 1


def test_one_shard_when_all_fits_and_deep_splits_when_little_does(documents):
    docs = documents([(i, "word") for i in range(300)])
    assert set(check(docs, 10_000)) == {("", 0)}
    assert max(len(s) for s, _ in check(docs, 4)) > 8


def test_rows_alike_and_a_document_beyond_the_limit(documents):
    docs = documents([(1, "abcd")] * 25 + [(2, "y" * 999), (3, "z")])
    held = check(docs, 12)
    copies = [k for k, rows in held.items() if rows[0].doc_id == 1]
    assert len(copies) == 9 and sorted(p for _, p in copies) == list(range(9))
    assert any(len(rows) == 1 and rows[0].bytes == 999 for rows in held.values())


def test_empty_table_and_clashing_columns(documents):
    assert sharding.assign(documents([(1, "x")]).limit(0), 10).count() == 0
    docs = documents([(i, "ab") for i in range(20)]).withColumn("shard", F.lit(1)).withColumn("bytes", F.lit("x")).withColumn("hash", F.lit(0))
    assert sharding.assign(docs, 7).count() == 20
