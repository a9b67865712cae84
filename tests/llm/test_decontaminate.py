import random
import re
from itertools import combinations
from math import ceil

from pyspark.sql import functions as F

from marginalia.llm import decontaminate


def tokens(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def brute_force(docs, items, window=13, similarity=0.8):
    """(doc_id, item_id) with some diagonal window of enough equal tokens that holds a spaced-seed match."""
    out = {}
    for d, text in docs:
        a = tokens(text)
        for i, item in items:
            b = tokens(item)
            width, best = min(window, len(b)), 0
            for diagonal in range(-len(b), len(a)):
                equal = [int(0 <= diagonal + j < len(a) and a[diagonal + j] == b[j]) for j in range(len(b))]
                for s in range(len(b) - width + 1):
                    inside = equal[s:s + width]
                    seeded = any(all(bit == "0" or inside[p + k] for k, bit in enumerate(m)) for m in decontaminate.MASKS for p in range(width - len(m) + 1))
                    if seeded:
                        best = max(best, sum(inside))
            if width and best >= similarity * width:
                out[d, i] = best
    return out


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([9, 13, 20, 40])))) for i in range(12)]
    docs = []
    for d in range(n):
        body = rng.choices(vocabulary, k=rng.randrange(30, 120))
        if d % 2:
            part = items[rng.randrange(12)][1].split()
            for _ in range(rng.randrange(4)):
                part[rng.randrange(len(part))] = "other"
            part = part[: rng.choice([8, 13, len(part)])]
            at = rng.randrange(len(body))
            body = body[:at] + [w.upper() + rng.choice(["", ",", "."]) for w in part] + body[at:]
        docs.append((d, " ".join(body)))
    return docs, items


def test_overlaps_equal_brute_force_in_any_number_of_blocks(spark, documents):
    docs, items = corpus()
    table = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1)).withColumn("key", F.lit("x"))
    want = brute_force(docs, items)
    assert len(want) > 10
    frame = documents(docs).withColumn("item_id", F.lit(0)).withColumn("key", F.lit(None).cast("string"))
    for rows in (200_000, 150):
        got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.overlaps(frame, table, block_rows=rows).collect()}
        assert got == want


def test_substitutions_at_every_fifth_token_are_found(spark, documents):
    words = [f"t{i}" for i in range(30)]
    changed = [w if i % 5 else "x" for i, w in enumerate(words)]
    got = decontaminate.overlaps(documents([(1, " ".join(changed))]), spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.width) for r in got] == [(1, 5, 13)] and got[0].matched >= 11


def test_position_of_the_overlap(spark, documents):
    item = " ".join(f"t{i}" for i in range(20))
    row = decontaminate.overlaps(documents([(1, "a b c " + item + " d")]), spark.createDataFrame([(5, item)], "item_id bigint, text string")).first()
    assert (row.matched, row.doc_start, row.item_start) == (13, 3, 0)


def test_nulls_short_texts_repeats_and_empty_tables(spark, documents):
    item = " ".join(f"t{i}" for i in range(14))
    items = spark.createDataFrame([(5, item), (5, item), (6, None), (7, ""), (8, "t1 t2 t3"), (None, "q " * 14)], "item_id bigint, text string")
    long = "filler " * 50_000 + item
    docs = documents([(1, None), (2, ""), (3, "t1 t2 t3"), (4, item), (4, item), (None, item), (9, long)])
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(4, 5), (None, 5), (9, 5), (3, 8), (4, 8), (None, 8), (9, 8)}
    assert decontaminate.overlaps(docs.limit(0), items).count() == 0
    assert decontaminate.overlaps(docs, items.limit(0)).count() == 0


def test_masks_fit_beside_every_admissible_substitution():
    for width in range(decontaminate.SHORTEST, decontaminate.WINDOW + 1):
        for changed in combinations(range(width), width - ceil(0.8 * width)):
            assert any(all(bit == "0" or p + k not in changed for k, bit in enumerate(m)) for m in decontaminate.MASKS_OF[width]
                       for p in range(width - len(m) + 1)), (width, changed)


def test_every_admissible_substitution_is_found(spark, documents):
    """Each item alone is a document too, and so is each way to change as many of its tokens as the similarity admits."""
    items, docs, want = [], [], set()
    for width in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13):
        words = [f"w{width}n{i}" for i in range(width)]
        items.append((width, " ".join(words)))
        docs.append((1000 * width, " ".join(words)))
        want.add((1000 * width, width))
        few = width - ceil(0.8 * width)
        for n, changed in enumerate(combinations(range(width), few)):
            docs.append((1000 * width + n + 1, "before " + " ".join("x" if i in changed else w for i, w in enumerate(words)) + " after"))
            want.add((1000 * width + n + 1, width))
        if few:
            docs.append((1000 * width + 900, " ".join("x" if i <= few else w for i, w in enumerate(words))))
    got = decontaminate.overlaps(documents(docs), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_a_hit_holds_no_more_of_a_long_text_than_its_windows(spark, documents):
    passage = " ".join(f"p{i}" for i in range(40))
    filler = " ".join(f"f{i}" for i in range(3000))
    docs = documents([(1, f"{passage} {filler} {passage}"), (2, passage), (3, " ".join(passage.split()[:13]))])
    items = spark.createDataFrame([(i, passage) for i in range(8)], "item_id bigint, text string")
    keyed = docs.select("doc_id", decontaminate.tokens(F.col("text")).alias("doc_tokens"))
    keyed = keyed.select("*", F.explode(F.sequence(F.lit(0), F.size("doc_tokens") - 7)).alias("doc_at"))
    number = decontaminate.MASKS.index("1110111")
    keyed = keyed.withColumn("key", decontaminate._seed("doc_tokens", F.col("doc_at"), number, "1110111"))
    found = decontaminate._hits(keyed, decontaminate.seeds(items.select("item_id", decontaminate.tokens(F.col("text")).alias("item_tokens"))))
    rows = found.select("doc_id", F.size("near").alias("n")).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3} and max(r.n for r in rows) < 2 * decontaminate.WINDOW
    assert not set(found.columns) & {"doc_tokens", "text"}
    got = {(r.doc_id, r.item_id): (r.matched, r.doc_start, r.item_start) for r in decontaminate.overlaps(docs, items).collect()}
    assert got == {(d, i): (13, 0, 0) for d in (1, 2, 3) for i in range(8)}
