import random

import pytest

from marginalia.operators import evaluate as E, quotes as Q


def brute_force(quotes, chunks):
    out = set()
    for q, p, text in quotes:
        for paper, index, content in chunks:
            if text and paper == p and text in (content or ""):
                out.add((q, p, index, content.count(text)))
    return out


def frames(spark, quotes, chunks):
    return (spark.createDataFrame(quotes, "quote_id BIGINT, paper_id BIGINT, quote STRING"),
            spark.createDataFrame(chunks, "paper_id BIGINT, chunk_index INT, content STRING"))


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, hot):
    """``hot``: one paper has most chunks, one run of words is in all of them, and most quotes ask for that paper."""
    rng = random.Random(3)
    vocabulary = ["alpha", "beta", "b", "长文", "x1,", "the", "é"]
    passage = "the same run of words in all chunks"
    text = lambda n: rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, k=n)) + (" " + passage if hot else "")
    chunks = [(1 if hot and i % 4 else i % 5, i, text(rng.randrange(25))) for i in range(120)] + [(2, 900, None), (2, 901, "")]
    quotes = []
    for i in range(120):
        paper, _, content = rng.choice(chunks[:120])
        start = rng.randrange(len(content) + 1)
        quotes.append((i, paper, content[start:start + rng.randrange(60)]))
    quotes += [(200, 1, "not there at all, not one word"), (201, 1, ""), (202, 1, None), (203, 77, "alpha"), (204, 1, "alpha beta alpha beta gamma alpha")]
    quotes += [(300 + i, 1, passage) for i in range(20 * hot)]
    assert {tuple(r) for r in Q.quote_hits(*frames(spark, quotes, chunks)).collect()} == brute_force(quotes, chunks)


def test_repeated_ids_and_empty_tables(spark):
    chunks = [(1, 0, "one two three four five six"), (2, 0, "one two")]
    q, c = frames(spark, [(1, 1, "two"), (1, 2, "two"), (1, 1, "two")], chunks)
    assert {tuple(r) for r in Q.quote_hits(q.distinct(), c).collect()} == {(1, 1, 0, 1), (1, 2, 0, 1)}
    assert Q.quote_hits(q.limit(0), c).collect() == [] and Q.quote_hits(q, c.limit(0)).collect() == []


def test_locators_against_a_loop(spark):
    rng = random.Random(9)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "the"]
    chunks = [(i % 3, i, " ".join(rng.choices(vocabulary, k=6)), rng.choice([None, "", "The Beta part", "gamma"])) for i in range(40)]
    locators = [(f"q{i % 12}", i % 3, rng.choice([None, "", " beta ", "beta part", "zeta"]), rng.choice([None, [], ["alpha", "ALPHA", " "], ["the", "no"]])) for i in range(30)]
    want = {}
    for qa, paper, section, keywords in locators:
        section = (section or "").strip().lower()
        words = [k.strip().lower() for k in keywords or [] if k.strip()]
        for p, index, content, title in chunks:
            if p == paper:
                score = (2 * (section in (title or "").lower()) + (section in content.lower()) if section else 0) + sum(k in content.lower() for k in words)
                if score:
                    want[qa, p, index] = max(want.get((qa, p, index), 0), score)
    found = E.locator_scores(spark.createDataFrame(locators, "qa_id STRING, paper_id BIGINT, section STRING, keywords ARRAY<STRING>"),
                             spark.createDataFrame(chunks, "paper_id BIGINT, chunk_index INT, content STRING, section_title STRING"))
    assert {(r.qa_id, r.paper_id, r.chunk_index): r.score for r in found.collect()} == want and found.count() == len(want)
