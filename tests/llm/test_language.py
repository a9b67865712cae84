import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import language
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SYLLABLES = {"aa": "ba be bi lo lu na".split(), "bb": "zi zo ku ké ra ün".split(), "cc": "sha tho wre ing ed".split()}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def training(documents, rng, n=200):
    return documents([(i, text(rng, lang), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))])


def test_grams_are_those_of_each_text_alone():
    texts = ["Ab, cd!", "", "x", "éÉ  é", "123"]
    hashes, (letters, counts) = language.grams(texts)
    assert letters.tolist() == [4, 0, 1, 3, 0]
    ends = np.cumsum(counts)
    for t, a, b in zip(texts, ends - counts, ends):
        assert hashes[a:b].tolist() == language.grams([t])[0].tolist()
    # " ab cd " has four windows of four characters.
    assert counts[0] == 4


def test_pieces_lose_and_repeat_no_gram(monkeypatch):
    rng = random.Random(2)
    whole = text(rng, "cc", 500).replace(" ", "")
    monkeypatch.setattr(language, "PIECE", 97)
    parts = sum(len(p) - language.N + 1 for p in language._pieces(whole))
    assert parts == len(whole) - language.N + 1


def test_filters_have_no_false_negatives_and_name_every_language():
    first, second = language.grams(["shared words and some"])[0], language.grams(["shared other things"])[0]
    masks = np.zeros(1 << language.BITS, dtype=np.uint64)
    for bit, hashes in ((1, first), (2, second)):
        for place in language._positions(hashes):
            np.bitwise_or.at(masks, place, np.uint64(bit))
    filters = language.Filters(["aa", "bb"], masks)
    letters, total, hits = filters.popcounts(["shared", "some", "things"])
    assert hits[0].tolist() == [total[0], total[0]] or hits[0].min() >= total[0] - 1
    assert hits[1][0] == total[1] and hits[2][1] == total[2]


def test_false_positives_are_taken_off():
    rng = np.random.default_rng(0)
    masks = (rng.random(1 << language.BITS) < 0.6).astype(np.uint64)  # a filter so full that a fifth of all n-grams hit
    filters = language.Filters(["aa"], masks)
    text_ = "".join(random.Random(1).choices("abcdefghij", k=20_000))
    _, total, hits = filters.popcounts([text_])
    assert 0.15 < hits[0, 0] / total[0] < 0.28
    corrected = max(0, hits[0, 0] - total[0] * filters.by_chance[0])
    assert corrected < 0.03 * total[0]


def test_training_reads_only_its_fold(documents):
    rng = random.Random(4)
    docs = training(documents, rng)
    wrong = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "zz").otherwise(F.col("lang")))
    a, b = language.train(docs), language.train(wrong)
    assert a.langs == b.langs == ["aa", "bb", "cc"] and (a.masks == b.masks).all()


def test_predictions_and_edge_cases(documents):
    rng = random.Random(5)
    filters = language.train(training(documents, rng))
    rows = [(1000 + i, text(rng, lang, 40), lang) for i, lang in enumerate(list(SYLLABLES) * 10)]
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "漢字かな"), (5, text(rng, "bb", 120_000)), (5, text(rng, "bb", 12)), (None, text(rng, "aa"))]
    docs = documents(rows + odd).withColumn("score", F.lit("mine")).withColumn("lang", F.lit(None).cast("string"))
    got = {}
    for r in language.identify(docs, filters).collect():
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score))
    assert all(got[i][0][0] == lang for i, _, lang in rows)
    assert got[1] == got[2] == got[3] == [("und", 0.0)] and got[4][0][1] == 0.0 and got[4][0][0] in SYLLABLES
    assert [p[0] for p in got[5]] == ["bb", "bb"] and got[None][0][0] == "aa"
    assert all(0 <= s <= 1 for rs in got.values() for _, s in rs)
    assert language.identify(docs.limit(0), filters).count() == 0


def test_without_labels_nothing_is_named(documents):
    filters = language.train(documents([(1, "some words", None), (2, None, "aa")]))
    assert filters.langs == [] and language.identify(documents([(3, "words")]), filters).first().lang_pred == "und"


def test_sample_is_bounded_though_an_id_repeats(documents):
    docs = documents([(2, f"text {i}", "aa") for i in range(50)] + [(i, "x y", "aa") for i in range(100, 160)])
    assert language.sample(docs, rows=10).count() <= 10


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = QUERIES["op2_language_filters"](spark, SF).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)
