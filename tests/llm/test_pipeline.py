"""The pipeline against plain Python that follows the stages' rules on its own."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from marginalia.llm.queries import SHARD_BYTES

from tests.llm.test_decontaminate import brute_force as contaminated
from tests.llm.test_mixing import water_fill
from tests.llm.test_simhash import brute_force as components

BAD = ["nasty", "vile", "awful"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory, spark):
    rng = random.Random(11)
    vocabulary = [chr(97 + i % 26) + chr(97 + i // 26) + "x" for i in range(500)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(4)]
    rows, labels = [], []
    for i in range(240):
        words = rng.choices(vocabulary, k=rng.randrange(20, 90))
        if i % 6 == 0:
            words += rng.choices(BAD, k=3)
        if i % 20 == 3:
            words += items[i % 4][1].split()
        rows.append((i, " ".join(words), rng.choice(["en", None]), rng.choice(["a", "b", "b", "c", None])))
        labels.append((i, int(i % 6 == 0), 1))
    rows += [(300 + i, rows[i][1] + rng.choice(["", " "]), "en", "a") for i in range(0, 60, 3)]
    rows += [(400, None, "en", "a"), (401, "", None, "b"), (402, "long " * 30_000, "en", "c")]
    place = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{place}/benchmark.parquet")
    return place, rows, items


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """The rows after each stage."""
    place, _, _ = tables
    docs, out = spark.read.parquet(f"{place}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{number}"
        stage(spark, docs, place).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mix", "sharding"]


def test_toxic_documents_go_and_clean_ones_stay(stages, tables):
    _, rows, _ = tables
    kept = {r.doc_id for r in stages[0].collect()}
    assert kept == {r[0] for r in rows if not any(w in (r[1] or "").split() for w in BAD)}


def test_one_document_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[0].collect()]
    want = {i for i, (_, root) in components(before).items() if i == root}
    assert {r.doc_id for r in stages[1].collect()} == want and len(want) < len(before)


def test_near_copies_are_those_of_op6(spark, tmp_path):
    """Repeated words vote once each occurrence, so two texts with few common shingles may have like fingerprints."""
    base, rng = "a b c d e f g " * 400, random.Random(4)
    rows = [(1, base), (2, base + " ".join(f"w{i}" for i in range(30)))] + [(i, " ".join(f"{rng.random()}" for _ in range(30))) for i in range(3, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i for i, (_, root) in components(rows).items() if i == root}
    assert want == {1, *range(3, 9)}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()} == want


def test_contaminated_documents_go(stages, tables):
    before = [(r.doc_id, r.text) for r in stages[1].collect() if r.doc_id != 402]
    bad = {d for d, _ in contaminated(before, tables[2])}
    assert len(bad) >= 3 and {r.doc_id for r in stages[2].collect()} - {402} == {d for d, _ in before} - bad


def test_mix_comes_near_its_targets(stages):
    before = stages[2].collect()
    sizes = defaultdict(int)
    for r in before:
        sizes[r.source] += len((r.text or "").split())
    want, taken, copies = water_fill(sizes), defaultdict(int), Counter()
    for r in stages[3].collect():
        taken[r.source] += len((r.text or "").split())
        copies[r.doc_id] += 1
    longest = {s: max(len((r.text or "").split()) for r in before if r.source == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes) and max(copies.values()) == 2


def test_columns_and_shards(stages, tables):
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:4])
    rows, shards = stages[3].collect(), stages[4].collect()
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in rows)
    held = defaultdict(int)
    for r in shards:
        held[r.shard, r.part] += r.bytes
    assert all(b <= SHARD_BYTES for b in held.values())


def test_run_gives_the_last_stage(spark, tables, stages):
    got = corpus_pipeline.run(spark, tables[0])
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "bytes", "shard", "part").collect())
    assert key(got) == key(stages[4])


def test_odd_tables(spark, tables, tmp_path):
    place, _, _ = tables
    docs = spark.read.parquet(f"{place}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None, 1), (5, "a b", "en", None, 3, 2), (5, "a b", "en", None, 3, 2)],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint, size int")
    for name, frame in (("empty", docs.limit(0)), ("nulls", nulls)):
        held = frame
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = f"{tmp_path}/{name}-{number}"
            stage(spark, held, place).write.parquet(path)
            held = spark.read.parquet(path)
            if number < 4:
                assert held.columns == frame.columns
        assert (held.count() > 0) == (name == "nulls")
