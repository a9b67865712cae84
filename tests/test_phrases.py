import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import lexical as L, phrases as P

PAPER = "id BIGINT, title STRING, authors STRING, year INT, abstract STRING"


def papers_of(spark, rows):
    return spark.createDataFrame([(i, t, a, 2000, x) for i, t, a, x in rows], PAPER)


def words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def places(fields, phrase):
    return sum(f[i:i + len(phrase)] == phrase for f in fields for i in range(len(f) - len(phrase) + 1))


def brute_force(rows, queries, k=20):
    fields = {i: [words(t), words(a), words(x)] for i, t, a, x in rows}
    n, avg = len(rows), sum(len(f) for fs in fields.values() for f in fs) / len(rows)
    out = set()
    for q, text in queries:
        phrases = {tuple(words(t)) for t in text.split()} - {()}
        scores = {}
        for i, fs in fields.items():
            held = {p: places(fs, list(p)) for p in phrases}
            if phrases and all(held.values()):
                size = sum(map(len, fs))
                scores[i] = 0.0
                for p, tf in held.items():
                    df = sum(places(g, list(p)) > 0 for g in fields.values())
                    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
                    scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / avg))
        ranked = sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
        out |= {(q, r, i) for r, i in enumerate(ranked, 1)}
    return out


def test_phrases_of_a_query(spark):
    q = spark.createDataFrame([("foo_bar baz, l'École  __ foo_bar",), ("",), (None,), ("-- ()",)], "t STRING")
    assert [r[0] for r in q.select(X.keyword_phrases(F.col("t"))).collect()] == [[["foo", "bar"], ["baz"], ["l", "ecole"]], [], [], []]


def test_adjacent_words_in_one_field_only(spark):
    rows = [(1, "foo bar", None, "x"), (2, "bar foo", "a", "foo x bar"), (3, "foo", "bar", ""), (4, "x", "", "a foo, BAR foo_bar!"), (5, None, None, None)]
    found = L.keyword_search(papers_of(spark, rows), spark.createDataFrame([(1, "foo_bar"), (2, "foo bar"), (3, "foo_bar x"), (4, "no_word")], "query_id BIGINT, text STRING"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["paper_id"])
    assert got == {1: {1, 4}, 2: {1, 2, 3, 4}, 3: {1, 4}}
    counts = P.phrase_counts(papers_of(spark, rows), spark.createDataFrame([("foo bar", ["foo", "bar"]), ("foo", ["foo"])], "phrase STRING, words ARRAY<STRING>"))
    assert {(r.phrase, r.paper_id, r.tf) for r in counts.collect()} == {("foo bar", 1, 1), ("foo bar", 4, 2), ("foo", 1, 1), ("foo", 2, 2), ("foo", 3, 1), ("foo", 4, 2)}


@pytest.mark.parametrize("hot", [False, True])
def test_equals_brute_force(spark, hot):
    """``hot``: one word is in every field of every paper, and one paper holds a third of all words."""
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "d", "e1", "f"]
    make = lambda n: " ".join((["the"] if hot else []) + [rng.choice(vocabulary) + rng.choice(["", ",", "-x"]) for _ in range(n)])
    rows = [(i, make(rng.randrange(5)), rng.choice([None, make(2)]), make(rng.randrange(12))) for i in range(60)]
    if hot:
        rows.append((60, "the the", None, " ".join(["the a b"] * 150)))
    queries = [(i, " ".join("_".join(rng.choice(vocabulary + ["the"] * hot) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3)))) for i in range(30)]
    queries += [(90, "a_a a_a a"), (91, "")]
    found = L.keyword_search(papers_of(spark, rows), spark.createDataFrame(queries, "query_id BIGINT, text STRING"))
    assert {(r["query_id"], r["rank"], r["paper_id"]) for r in found.collect()} == brute_force(rows, queries)


@pytest.mark.parametrize("most", [P.PIECES, 5])
def test_phrases_of_any_length_in_parts(spark, most):
    """Phrases longer than a piece, of repeated words, and more pieces than go out at once."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randrange(12))), rng.choice([None, "a b a b"]), " ".join(rng.choices("abc", k=rng.randrange(40)))) for i in range(40)]
    wanted = {tuple(rng.choices("ab", k=n)) for n in (1, 2, 3, 4, 5, 6, 7, 8) for _ in range(4)}
    phrases = spark.createDataFrame([(" ".join(p), list(p)) for p in wanted], "phrase STRING, words ARRAY<STRING>")
    found = P.phrase_counts(papers_of(spark, rows + [(None, "a b", None, "a a")]), phrases, most=most)
    fields = {i: [words(t), words(a), words(x)] for i, t, a, x in rows}
    want = {(" ".join(p), i): places(f, list(p)) for p in wanted for i, f in fields.items()}
    assert {(r.phrase, r.paper_id): r.tf for r in found.collect()} == {k: n for k, n in want.items() if n}


def test_words_of_no_whole_phrase_are_not_moved(spark, monkeypatch):
    """What is written and shuffled is what was found, not the places of every word that some phrase has."""
    rows = [(i, "a b", None, "x a y b z " * 50) for i in range(20)]
    phrases = spark.createDataFrame([("a b", ["a", "b"]), ("z x", ["z", "x"]), ("b a", ["b", "a"])], "phrase STRING, words ARRAY<STRING>")
    written, whole = [], P.materialize

    def counted(df, label="table"):
        out = whole(df, label)
        written.append(out.count())
        return out
    monkeypatch.setattr(P, "materialize", counted)
    found = P.phrase_counts(papers_of(spark, rows), phrases)
    assert {(r.phrase, r.paper_id, r.tf) for r in found.collect()} == {("a b", i, 1) for i in range(20)} | {("z x", i, 49) for i in range(20)}
    assert sum(written) <= 10


def test_empty_tables(spark):
    none = papers_of(spark, [(1, "a", None, None)]).limit(0)
    q = spark.createDataFrame([(1, "a_b")], "query_id BIGINT, text STRING")
    assert L.keyword_search(none, q).collect() == []
    assert L.keyword_search(papers_of(spark, [(1, "a b", None, None)]), q.limit(0)).collect() == []
