import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.llm import resample


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c > "\x7f" or "0" <= c <= "9" or "a" <= c <= "z":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def features_of(text, width=1):
    words = words_of(text)
    return [" ".join(words[i:i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute_force(rows, target, width=1, buckets=10_000, min_words=20, percent=10):
    """(doc_id, n_features, weight, score, rank) of every row."""
    raw = Counter(bucket(f, buckets) for _, text in rows for f in features_of(text, width))
    wanted = Counter(bucket(f, buckets) for text in target for f in features_of(text, width))
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    out, able = [], []
    for i, text in rows:
        held = features_of(text, width)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (t_s + 0.0) / ((raw[b] + 1) * (t_all + buckets))))
                     for b in (bucket(f, buckets) for f in held) for t_s in [s_all + buckets])
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32)))
        out.append([i, len(held), weight, score, None])
        if len(words_of(text)) >= min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(able[:len(able) * percent // 100], 1):
        row[4] = place
    return Counter(map(tuple, out))


def texts(seed, n, words=40):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Größe", "NAÏVE", "日本語", "x1"]
    joints = [" ", ", ", "\n", " - ", "...", "\t", "'"]
    return ["".join(rng.choice(vocabulary) + rng.choice(joints) for _ in range(rng.randrange(words))) for _ in range(n)]


@pytest.mark.parametrize("width, buckets, percent", [(1, 10_000, 10), (3, 50, 35)])
def test_equals_brute_force(spark, documents, width, buckets, percent):
    rows = list(enumerate(texts(1, 150))) + [(900, None), (901, ""), (902, " .,- "), (None, "word " * 30), (5, "again " * 25), (5, "again " * 25)]
    target = texts(2, 12) + [None]
    found = resample.ranked(documents(rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=buckets, percent=percent)
    assert [t for _, t in found.dtypes] == ["bigint"] * 5
    assert Counter(tuple(r) for r in found.collect()) == brute_force(rows, target, width, buckets, percent=percent)


def test_one_text_makes_a_third_of_all_rows(spark, documents):
    rows = [(i, "the same long text of many words " * 4) for i in range(300)] + list(enumerate(texts(3, 600), 300))
    found = resample.ranked(documents(rows), spark.createDataFrame([(t,) for t in texts(4, 5)], "text string"))
    assert Counter(tuple(r) for r in found.collect()) == brute_force(rows, texts(4, 5))


def test_offsets_of_long_texts_and_of_all_plain_characters(monkeypatch):
    split = resample.word_split()
    text = resample.lowered("".join(map(chr, range(128))) + "Ünïcode ABC▁ x")
    assert [text[a:b] for a, b in resample.word_spans(split, text)] == words_of(text)
    long = resample.lowered(" ".join(texts(5, 30)))
    whole = resample.word_spans(split, long)
    monkeypatch.setattr(resample, "PART_CHARS", 7)
    assert resample.word_spans(split, long) == whole and [long[a:b] for a, b in whole] == words_of(long)


def test_empty_tables(spark, documents):
    none = documents([(1, "x")]).limit(0)
    target = spark.createDataFrame([], "text string")
    assert resample.ranked(none, target).collect() == []
    rows = [(1, "a b " * 20), (2, "c d " * 20)]
    assert Counter(tuple(r) for r in resample.ranked(documents(rows), target, percent=50).collect()) == brute_force(rows, [], percent=50)


def test_extra_columns_with_clashing_names_and_drawn_rows(spark, documents):
    rows = list(enumerate(texts(6, 60, 80)))
    docs = documents(rows).withColumn("rank", F.lit("mine")).withColumn("buckets", F.lit(1)).withColumn("score", F.lit(None).cast("int")).withColumn("n_words", F.lit(0))
    target = spark.createDataFrame([("w1 w2 w3 w4",)], "text string")
    want = {r[0] for r in brute_force(rows, ["w1 w2 w3 w4"], percent=30) if r[4] is not None}
    kept = resample.resample(docs, target, percent=30)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert {r.doc_id for r in kept.collect()} == want and {r["rank"] for r in kept.collect()} == {"mine"}
    shown = resample.hashed(docs).select("doc_id", "rank", "n_words", "n_features").first()
    assert shown["rank"] == "mine" and shown["n_words"] == len(words_of(rows[0][1])) == shown["n_features"]


def test_draws_resemble_the_target(spark, documents):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdef" if i % 5 else "uvwxyz") for _ in range(50))) for i in range(400)]
    found = resample.ranked(documents(rows), spark.createDataFrame([("u v w x y z " * 20,)], "text string"))
    assert all(r.doc_id % 5 == 0 for r in found.collect() if r["rank"] is not None)
