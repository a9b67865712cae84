import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import toxicity
from marginalia.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"
BAD = ["nasty", "vile", "awful"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = rng.choices([f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)], k=rng.randrange(5, 80))
        toxic = rng.random() < 0.2
        if toxic:
            words += rng.choices(BAD, k=rng.randrange(1, 5))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def table(spark, labels):
    return spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.lit(1)).withColumn("text", F.lit("mine"))


def test_nearest_is_exact():
    rng = random.Random(3)
    terms = [f"t{i}" for i in range(40)]
    idf = np.array([rng.random() * 3 for _ in terms])
    examples = [(i, rng.randrange(2), sorted(rng.sample(range(40), rng.randrange(0, 8)))) for i in range(300)]
    examples = [(i, y, t, [rng.randrange(1, 5) for _ in t]) for i, y, t in examples]
    index = toxicity.Index(terms, idf, examples, 0.5)
    dense = np.zeros((300, 40))
    for i, _, t, c in examples:
        dense[i, t] = (1 + np.log(c)) * idf[t]
    length = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, length, out=np.zeros_like(dense), where=length > 0)
    for _ in range(60):
        words = rng.choices(terms + ["unknown"], k=rng.randrange(1, 12))
        q = np.zeros(40)
        for t, n in Counter(w for w in words if w != "unknown").items():
            q[terms.index(t)] = (1 + math.log(n)) * idf[terms.index(t)]
        q = q / (np.linalg.norm(q) or 1)
        cosine = dense @ q
        want = [i for i in np.lexsort((np.arange(300), -np.round(cosine, 12))) if cosine[i] > 1e-12][:16]
        vector = (np.array(sorted({terms.index(w) for w in words if w in terms}), dtype=np.int64),)
        counts = np.array([words.count(terms[t]) for t in vector[0]], dtype=float)
        got = index.nearest(*index.vector(vector[0], counts))
        assert [round(c, 9) for c, _ in got] == [round(cosine[i], 9) for i in want]


def test_terms_of_a_text():
    assert toxicity.terms_of("Abcdef abc") == {"abcdef": 1, "abcd-": 1, "abcde-": 1, "abc": 1}
    assert toxicity.terms_of("abcde " * 3, {"abcd-"}) == {"abcd-": 3, "abcd-2": 1, "abcd-3": 1}
    assert toxicity.terms_of(None) == toxicity.terms_of(" 12 ") == {}


@pytest.fixture(scope="module")
def trained(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    return docs, labels, toxicity.train(docs, table(spark, labels))


def test_terms_frequencies_and_examples(trained):
    docs, labels, index = trained
    assert set(BAD) <= set(index.number) and all(any(b.startswith(t.rstrip("0123456789").rstrip("-")) for b in BAD) for t in index.number)
    texts = [toxicity.terms_of(r.text) for r in docs.collect()]
    for term, i in index.number.items():
        assert index.idf[i] == pytest.approx(math.log(401 / (1 + sum(term in t for t in texts))))
    fold = {i for i, _ in labels if __import__("zlib").crc32(str(i).encode()) % 3 != 1}
    assert set(index.ids.tolist()) == fold


def test_labels_of_the_other_fold_do_not_matter(spark, trained):
    docs, labels, index = trained
    flipped = [(i, 1 - y if __import__("zlib").crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    again = toxicity.train(docs, table(spark, flipped))
    assert (again.slope, again.offset, again.ids.tolist()) == (index.slope, index.offset, index.ids.tolist())


def test_scores_evidence_and_edge_cases(documents, trained):
    _, _, index = trained
    rows = [(1, None), (2, ""), (3, "plain words"), (4, "NASTY, vile!"), (5, "w " * 200_000 + "awful"), (4, "plain"), (None, "nasty")]
    docs = documents(rows).withColumn("score", F.lit("mine")).withColumn("toxic", F.lit(1))
    got = toxicity.scored(docs, index).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got if r.doc_id != 4}
    assert by_id[1].score == by_id[2].score == by_id[3].score < 0.3 and by_id[3].evidence == []
    assert by_id[5].predicted == by_id[None].predicted == 1
    assert sorted(r.predicted for r in got if r.doc_id == 4) == [0, 1]
    cosines = [e.cosine for e in by_id[5].evidence]
    assert len(cosines) == 16 and cosines == sorted(cosines, reverse=True) and cosines[0] <= 1 + 1e-9


def test_odd_label_tables(spark, documents):
    docs = documents([(2, "nasty words"), (3, None)])
    for rows in ([], [(2, None), (None, 1)], [(2, 1), (2, 1)], [(2, 0), (77, 1)]):
        index = toxicity.train(docs, table(spark, rows) if rows else table(spark, [(1, 1)]).limit(0))
        scores = [r.score for r in toxicity.scored(docs, index).collect()]
        assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)
    index = toxicity.train(docs.limit(0), table(spark, [(1, 1)]))
    assert toxicity.scored(docs.limit(0), index).count() == 0


def test_examples_are_bounded(spark, documents):
    rows = [(i, "a b") for i in range(60)] + [(5, "again")] * 20
    held, _ = toxicity.examples(documents(rows), table(spark, [(i, i % 2) for i in range(60)]), per_label=4)
    assert held.groupBy("toxic").count().agg(F.max("count")).first()[0] <= 4


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    marked = docs.withColumn("loud", F.size(F.array_intersect(F.split(F.lower("text"), r"[^\p{L}]+"), F.array(*map(F.lit, (
        "idiot", "scum", "moron", "trash", "loser"))))) > 0)
    got = QUERIES["op5_toxicity_neighbours"](spark, SF).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").join(marked.select("doc_id", "loud"), "doc_id").collect()
    plain = [r for r in got if r.toxic == 0]
    loud = [r for r in got if r.loud]
    assert len(loud) > 30 and sum(r.predicted for r in loud) >= 0.95 * len(loud)
    assert sum(r.predicted for r in plain) <= 0.01 * len(plain)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_planted_toxic_texts_in_small_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    index = toxicity.train(docs, labels)
    clean = docs.join(labels.filter("toxic = 0 and crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), "doc_id", "left_semi").select("doc_id", "text")
    told = {}
    for name, rows in (("clean", clean), ("planted", clean.withColumn("text", F.concat("text", F.lit(" You scum, moron and loser!"))))):
        scores = [r.predicted for r in toxicity.scored(rows, index).collect()]
        told[name] = sum(scores) / len(scores)
    assert told["planted"] >= 0.95 and told["clean"] <= 0.02


def test_terms_do_not_depend_on_the_number_of_examples(spark, documents):
    kept = []
    for n in (200, 2000):
        rows = [(i, f"plain words {chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)} {'cruel' if i % 5 == 0 and i % 25 < 5 else 'calm'}") for i in range(n)]
        kept.append(set(toxicity.train(documents(rows), table(spark, [(i, int(i % 5 == 0)) for i in range(n)])).number))
    assert kept[0] == kept[1] and "cruel" in kept[0]
