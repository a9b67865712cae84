import random

import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing
from marginalia.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """Targets by resharing the excess again and again, as stated."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        left = share * sum(sizes.values()) - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_reshare_until_none_is_above(spark):
    rng = random.Random(4)
    for _ in range(6):
        sizes = {s: rng.choice([0, 1, 5, 40, 900]) + rng.randrange(50) for s in ["a", "b", "ñ", "z", "zz", None][: rng.randrange(1, 7)]}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = water_fill(sizes)
        assert {r.source: round(r.target, 6) for r in got} == {s: round(t, 6) for s, t in want.items()}


def test_mix_takes_whole_prefixes_of_the_hash_order(documents):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(60), "en", rng.choice(["a", "b", "b", "b", None])) for i in range(800)]
    rows += [(900, None, "en", "a"), (901, "", "en", None), (902, "x " * 3000, "en", "big"), (None, "no id", "en", "a")]
    docs = documents(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water_fill(sizes)
    by_id = {r[0]: r for r in rows}
    taken = {s: 0 for s in sizes}
    for r in got:
        source = by_id[r.doc_id][3]
        assert r.size == len((by_id[r.doc_id][1] or "").split()) and r.source_size == sizes[source]
        assert r.target == pytest.approx(want[source]) and r.taken in (0, r.size, 2 * r.size)
        taken[source] += r.taken
    for source in ("a", "b", None):
        assert abs(taken[source] - want[source]) <= 30  # half of the longest document
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_larger_budget_keeps_what_a_smaller_one_took(documents):
    docs = documents([(i, "w " * (i % 40), "en", "a" if i % 3 else "b") for i in range(500)])
    small = {r.doc_id: r.taken for r in mixing.mix(docs, share=0.5).collect()}
    large = {r.doc_id: r.taken for r in mixing.mix(docs, share=0.9).collect()}
    assert all(large[i] >= t for i, t in small.items())


def test_mixed_rows_repeat_and_keep_all_columns(documents):
    docs = documents([(i, "w " * 5, "en", "a" if i < 10 else "b") for i in range(100)]).withColumn("size", F.lit("mine")).withColumn("cut", F.lit(1))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    taken = {r.doc_id: r.taken // 5 for r in mixing.mix(docs).collect()}
    assert counts == {i: t for i, t in taken.items() if t}


def test_empty_table_and_one_document(documents):
    assert mixing.mix(documents([(1, "x", "en", "a")]).limit(0)).count() == 0
    only = mixing.mix(documents([(1, "a b c", "en", None)])).first()
    assert only.target == 4.5 and only.taken in (3, 6)


def test_rows_alike_are_taken_together(documents):
    got = mixing.mix(documents([(1, "a b", "en", "s")] * 5 + [(2, "c d", "en", "s")])).collect()
    assert len({r.taken for r in got if r.doc_id == 1}) == 1 and len(got) == 6


def test_query_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op9_source_mix"]).fetchall()
    got = QUERIES["op9_source_mix"](spark, SF).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 4), r.taken) for r in got) == sorted((a, b, c, round(d, 4), e) for a, b, c, d, e in want)
