import random

from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import copies

from tests.llm.test_simhash import roots


def plain_shingles(text):
    words = (text or "").lower().split()
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute_force(rows):
    held = {i: plain_shingles(t) for i, t in rows}
    return roots(held, [(a, b) for a in held for b in held if a < b and similar(held[a], held[b])])


def planted(seed=4, passage=""):
    """Texts of 60 to 200 words, copies with one to six words changed, and chains of copies."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(40):
        words = rng.choices(vocabulary, k=rng.randrange(60, 200)) + passage.split()
        rows.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            copy = list(words)
            for _ in range(rng.randrange(1, 7)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
            words = copy if rng.random() < 0.5 else words
    rows += [rows[0], rows[1].upper(), "a b", "a  B", "a b c", "", None, " \n", "x " * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_copies_equal_brute_force(documents):
    for passage in ("", "this passage is in all of the texts and in none of them alone"):
        rows = planted(passage=passage)
        want = brute_force(rows)
        assert len(set(want.values())) < len(rows) - 15
        assert {r.doc_id: r.component_id for r in copies.near_copies(documents(rows).withColumn("node", F.lit("x"))).collect()} == want


def test_stage_drops_planted_near_copies(spark, documents):
    rows = planted(seed=9)
    held = {i: plain_shingles(t) for i, t in rows}
    near = [(a, b) for a in held for b in held if a < b and similar(held[a], held[b]) and held[a] != held[b]]
    assert len(near) > 15
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()}
    assert not [p for p in near if kept >= set(p)]
    assert kept == {i for i, root in brute_force(rows).items() if i == root}


def test_nulls_repeats_and_empty_table(documents):
    got = copies.near_copies(documents([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, 0, 4)]
    assert copies.near_copies(documents([(1, "x")]).limit(0)).count() == 0
