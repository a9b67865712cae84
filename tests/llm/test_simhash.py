import random

import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.llm import components, simhash


def plain_fingerprint(text):
    """The definition, one bit at a time."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        low = low.replace(blank, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbÄß \t\n\x0b\x0c\r\x1f\x85\xa0", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_follows_the_definition(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_uses_sparks_hash(spark):
    assert simhash.fingerprint("One two\nTHREE four") == spark.sql("select xxhash64('one two three four') h").first().h & (1 << 64) - 1
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = "wort " * 200_000 + "ende"
    assert simhash.fingerprint(long) == plain_fingerprint(long)


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 1, (1 << 64) - 1, 1 << 63}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    want = {tuple(sorted((a, b))) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    for segments in (2, 3, 5):
        assert {(r.a, r.b) for r in simhash.links(table, segments=segments).collect()} == want


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, i) for i in range(1001, 1200)] + [(7, 7)]
    pairs += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)] + [(-5, 3), (3, -9)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    want = roots({n for p in pairs for n in p}, pairs)
    touched = {n for a, b in pairs if a != b for n in (a, b)}
    assert got == {n: r for n, r in want.items() if n in touched}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_force(rows):
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    pairs = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    component = roots(ids, pairs)
    return {i: (format(fps[i], "016x"), component[i]) for i in ids}


def test_near_duplicates_equal_brute_force(documents):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(300)], k=rng.choice([2, 60, 200]))) for _ in range(60)]
    rows = list(enumerate(texts + [t + " tail" for t in texts[:30]] + [t.upper() for t in texts[:10]] + ["", None, "  "] + texts[:20]))
    docs = documents(rows).withColumn("fp", F.lit("mine")).withColumn("root", F.lit(1))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute_force(rows)


def test_nulls_repeats_and_empty_table(documents):
    got = simhash.near_duplicates(documents([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in got) == [(False, 4, 4), (False, 4, 4), (False, 9, 9), (True, 0, 4)]
    assert simhash.near_duplicates(documents([(1, "x")]).limit(0)).count() == 0
