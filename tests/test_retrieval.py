import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marginalia.functions import vectors as VX
from marginalia.operators import fusion, lexical as L, retrieve as R, vector as V

TOKEN = re.compile(r"[A-Za-z0-9]+(?:[.\-][A-Za-z0-9]+)*%?")


def corpus(seed=3, papers=6, longest=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "a-b", "1e-4"]
    weights = [1 / (i + 1) for i in range(len(words))]
    # One paper holds a large share of the chunks.
    return [(p, i, " ".join(rng.choices(words, weights, k=rng.randint(0, 25))))
            for p in range(papers) for i in range(700 if p == 0 else rng.randint(1, longest))], words, rng


def bm25_model(chunks, query, neighbour=None):
    docs = {(p, i): [t.lower() for t in TOKEN.findall(c)] for p, i, c in chunks}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    terms = list(dict.fromkeys(t.lower() for t in TOKEN.findall(query)))
    df = {t: sum(t in set(d) for d in docs.values()) for t in terms}
    scores = {}
    for key, tokens in docs.items():
        count, s = Counter(tokens), 0.0
        for t in terms:
            if count[t]:
                s += math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * count[t] * 2.2 / (count[t] + 1.2 * (.1 + .9 * len(tokens) / avg))
        if s > 0:
            scores[key] = s
    if neighbour:
        scores = {(p, i): s + neighbour * (scores.get((p, i - 1), 0) + scores.get((p, i + 1), 0)) for (p, i), s in scores.items()}
    return sorted(((round(s, 9), f"p{p}_c{i}") for (p, i), s in scores.items()), key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("neighbour", [None, 0.5])
@pytest.mark.parametrize("max_terms", [1000, 0])
def test_bm25_against_brute_force(spark, neighbour, max_terms):
    chunks, words, rng = corpus()
    queries = [(q, " ".join(rng.choices(words, k=6))) for q in range(5)] + [(9, "中文")]
    got = L.bm25_search(spark.createDataFrame(chunks, "paper_id BIGINT, chunk_index INT, content STRING").repartition(5),
                        spark.createDataFrame(queries, "query_id BIGINT, text STRING"), 7,
                        neighbor_weight=neighbour, max_terms=max_terms).collect()
    for q, text in queries:
        mine = [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert mine == [c for _, c in bm25_model(chunks, text, neighbour)[:7]]


def test_bm25_rare_term_first(spark):
    chunks = spark.createDataFrame([(1, 0, "MIL MIL MIL common baseline"), (1, 1, "rareanchor precise evidence"),
                                    (1, 2, "common background material")], "paper_id BIGINT, chunk_index INT, content STRING")
    q = spark.createDataFrame([(1, "common rareanchor")], "query_id BIGINT, text STRING")
    assert L.bm25_search(chunks, q, 3).orderBy("rank").first()["chunk_id"] == "p1_c1"


@pytest.mark.parametrize("max_terms", [1000, 0])
def test_count_scores_against_brute_force(spark, max_terms):
    chunks, words, rng = corpus(5)
    chunks += [(7, 0, "aaaa aaa theTHE"), (7, 1, "ß the\x1fof")]
    queries = [(1, "the aa w1 w1"), (2, "W2 of, e"), (3, "zzz"), (4, " ")]
    got = L.count_search(spark.createDataFrame(chunks, "paper_id BIGINT, chunk_index INT, content STRING"),
                         spark.createDataFrame(queries, "query_id BIGINT, text STRING"), 9, max_terms=max_terms).collect()
    for q, text in queries:
        model = [(-sum(c.lower().count(t.lower()) for t in text.split()), f"p{p}_c{i}") for p, i, c in chunks]
        model = sorted(m for m in model if m[0] < 0)[:9]
        mine = sorted((r["rank"], -r["score"], r["chunk_id"]) for r in got if r["query_id"] == q)
        assert [(s, c) for _, s, c in mine] == model


@pytest.mark.parametrize("max_terms", [1000, 0])
def test_keyword_needs_every_word(spark, max_terms):
    papers = spark.createDataFrame([(1, "Colorectal cancer study", "A", 2020, None), (2, "Colorectal imaging", "B", 2021, "text"),
                                    (3, "Other", "Cancer, C", 2020, "colorectal")], "id BIGINT, title STRING, authors STRING, year INT, abstract STRING")
    q = spark.createDataFrame([(1, "colorectal cancer"), (2, "colorectal nonexistentterm"), (3, '"*'), (4, "imaging")], "query_id BIGINT, text STRING")
    got = {(r["query_id"], r["paper_id"]): r for r in L.keyword_search(papers, q, max_terms=max_terms).collect()}
    assert set(got) == {(1, 1), (1, 3), (4, 2)}
    assert got[(1, 1)]["content"] == "Colorectal cancer study" and got[(4, 2)]["content"] == "text"


def hits(spark, rows):
    return spark.createDataFrame([(q, r, c, p, None, None, None, c, None, None, 0.0, "s") for q, r, c, p in rows],
                                 "query_id BIGINT, rank INT, chunk_id STRING, paper_id BIGINT, title STRING, authors STRING, year INT,"
                                 " content STRING, page_number INT, chunk_type STRING, score DOUBLE, source STRING")


def test_fusion_order(spark):
    vec = hits(spark, [(1, i + 1, c, i) for i, c in enumerate("ABCDE")])
    graph = hits(spark, [(1, i + 1, c, 10 + i) for i, c in enumerate(["G1", "G2", "G3"])])
    out = fusion.rrf_chunks(vec, graph, 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in out] == ["A", "G1", "B", "G2", "C"]


def test_fusion_repeated_papers_add(spark):
    sem = hits(spark, [(1, 1, "x", 7), (1, 2, "y", 8), (1, 3, "z", 8), (1, 4, "n", None)])
    kw = hits(spark, [(1, 1, None, 9)])
    out = fusion.rrf_papers(sem, kw, 3).orderBy("rank").collect()
    assert [r["paper_id"] for r in out] == [8, 7, 9]
    assert out[0]["content"] == "y" and abs(out[0]["rrf_score"] - (1 / 62 + 1 / 63)) < 1e-12


def test_rerank_contract(spark):
    q = spark.createDataFrame([(1, "q"), (2, "bad")], "query_id BIGINT, text STRING")
    h = hits(spark, [(k, i + 1, f"c{i:02d}", i) for k in (1, 2) for i in range(23)])

    def scorer(pairs):
        if pairs[0][0] == "bad":
            return [1.0]
        return [float(c[1:]) // 2 for _, c in pairs]
    out = fusion.rerank(h, q, scorer).orderBy("query_id", "rank").collect()
    first = [r["chunk_id"] for r in out if r["query_id"] == 1]
    assert first[:4] == ["c18", "c19", "c16", "c17"] and first[20:] == ["c20", "c21", "c22"]
    second = [r for r in out if r["query_id"] == 2]
    assert [r["chunk_id"] for r in second] == [f"c{i:02d}" for i in range(23)]
    assert {r["rerank_error"] for r in second} == {"score_count_mismatch"}
    assert fusion.rerank(h, q, None).first()["rerank_error"] == "model_unavailable"


def test_vector_layouts_agree(spark):
    rng = np.random.default_rng(1)
    vecs, qs = rng.normal(size=(120, 8)), rng.normal(size=(9, 8))
    vecs[7] = vecs[3]
    v = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(vecs)], "vector_id STRING, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(qs)], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit(qs) @ unit(vecs).T, 9)
    want = {(i, r + 1): f"v{j:03d}" for i in range(9) for r, j in enumerate(np.lexsort((np.arange(120), -scores[i]))[:5])}
    for layout in ({}, {"broadcast_values": 0, "query_block": 4, "vector_block": 50}):
        got = {(r["query_id"], r["rank"]): r["vector_id"] for r in V.vector_top_k(q, v, 5, **layout).collect()}
        assert got == want
    near = V.lsh_top_k(q, v, 5).collect()
    assert all(0 <= r["rank"] <= 5 for r in near)


def test_products_are_bounded_and_the_grid_copies_little(spark, monkeypatch):
    """However many queries meet a block of vectors, a slice of the scores is held; small blocks do not multiply the rows moved."""
    rng = np.random.default_rng(2)
    qs, vecs = rng.normal(size=(300, 4)), rng.normal(size=(500, 4))
    monkeypatch.setattr(V, "HELD_SCORES", 5000)
    ids = np.array([f"v{i:03d}" for i in range(500)], dtype=object)
    parts = list(V._best(list(range(300)), V._unit(qs), ids, V._unit(vecs), 3))
    assert len(parts) == 30 and all(len(p) == 30 for p in parts)
    blocks = list(V._blocks(iter([pd.DataFrame({"vector_id": ids[at:at + 70], "embedding": list(vecs[at:at + 70])}) for at in range(0, 500, 70)]), 200))
    assert [len(i) for i, _ in blocks] == [140, 140, 140, 80] and sorted(np.concatenate([i for i, _ in blocks])) == sorted(ids)
    monkeypatch.undo()
    v = spark.createDataFrame(list(zip(ids.tolist(), vecs.tolist())), "vector_id STRING, embedding ARRAY<DOUBLE>")
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(qs)], "query_id BIGINT, embedding ARRAY<DOUBLE>")
    found = V.vector_top_k(q, v, 3, broadcast_values=0, query_block=4, vector_block=5)
    assert {(r.query_id, r["rank"]): r.vector_id for r in found.collect()} == {
        (i, r + 1): ids[j] for i, row in enumerate(np.round(V._unit(qs) @ V._unit(vecs).T, 9)) for r, j in enumerate(np.lexsort((np.arange(500), -row))[:3])}
    # Blocks of 512 of 100 000 rows would be 38 416 cells and 196 copies of every row.
    assert V._cells((100_000, 100_000), (512, 512), 64, 12) == (5, 5)
    assert V._cells((600_000, 600_000), (512, 512), 64, 12) == (10, 10) and V._cells((300, 500), (512, 512), 4, 8) == (1, 1)


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, 2000), (2, 2010), (3, None)], "paper_id BIGINT, year INT")
    ids = lambda f: sorted(r["paper_id"] for r in df.filter(V.metadata_filter(f)).collect())
    assert ids({}) == [1, 2, 3] and ids({"other": 1}) == [1, 2, 3]
    assert ids({"year_gte": 2005}) == [2] and ids({"year_lte": 2005, "paper_id": 1}) == [1]


def test_embedder_and_profiles(spark):
    chunks = spark.createDataFrame([(1, 0, "deep learning for images"), (1, 1, "statistics of cohorts"), (2, 0, "image learning")],
                                   "paper_id BIGINT, chunk_index INT, content STRING")
    embed = VX.embedder(VX.hashing_embedder(32))
    vectors = VX.with_embeddings(chunks, "content", embed).select(
        F.concat(F.lit("p"), "paper_id", F.lit("_c"), "chunk_index").alias("chunk_id"), "paper_id", F.lit("t").alias("title"),
        F.lit("a").alias("authors"), F.lit(2020).alias("year"), F.col("content").alias("document"), F.lit(1).alias("page_number"),
        F.lit("paragraph").alias("chunk_type"), "embedding")
    q = VX.with_embeddings(spark.createDataFrame([(1, "image learning")], "query_id BIGINT, text STRING"), "text", embed)
    hybrid = R.retrieve(q, chunks, vectors, 2, "bm25").orderBy("rank").collect()
    assert hybrid[0]["chunk_id"] == "p2_c0" and hybrid[0]["mode_used"] == "hybrid" and not hybrid[0]["degraded"]
    assert R.retrieve(q, chunks, None, 2, "bm25").first()["mode_used"] == "keyword-only(degraded)"
    semantic = R.retrieve(q, chunks, vectors, 2, retrieval_profile="semantic-production", scorer=None, semantic_rerank=True)
    assert {r["retrieval_error"] for r in semantic.collect()} == {"model_unavailable"}
    assert R.retrieve(q, chunks, None, 2, retrieval_profile="semantic-production").count() == 0
    def wrong(texts):
        return [[1.0]] * (len(texts) + 1)
    with pytest.raises(Exception, match="different number"):
        VX.with_embeddings(chunks, "content", VX.embedder(lambda: wrong)).collect()


@pytest.mark.parametrize("neighbour", [None, 0.5])
def test_a_task_sends_only_rows_that_can_still_win(neighbour):
    import pyarrow as pa
    from marginalia.functions import scoring as S

    rng, words = np.random.default_rng(4), [f"w{i}" for i in range(60)]
    matrix = S.query_matrix([(q, words[t], 1 + t / 7) for q in range(9) for t in rng.choice(60, 12, replace=False)])
    saturate = lambda count, length: count * 2.2 / (count + 1.2 * (0.1 + 0.9 * length / 8))
    k, sent, best, want = 4, 0, S.Best(9, 4), {q: [] for q in range(9)}
    got = {q: [] for q in range(9)}
    for paper in range(40):
        texts = [list(rng.choice(words, rng.integers(0, 16))) for _ in range(200)]
        texts[7], texts[150] = texts[3], texts[3]  # equal rows tie
        table = pa.table({"paper_id": pa.array([paper] * 200), "chunk_index": pa.array(range(200), pa.int32()), "doc_len": pa.array([len(t) for t in texts], pa.int32()),
                          "tokens": pa.array(texts, pa.list_(pa.string())), "block": pa.array([0] * 200), "home": pa.array([True] * 200)})
        for hits in S.score_batch(table, matrix, pa.array(matrix.terms), saturate, k, neighbour, best=best):
            sent += hits.num_rows
            for q, p, i, s in zip(*(hits.column(c).to_pylist() for c in ("query_id", "paper_id", "chunk_index", "score"))):
                got[q].append((-round(s, 9), f"p{p}_c{i}"))
        weight = np.zeros((60, 9))
        for t, term in enumerate(matrix.terms):
            held = slice(matrix.starts[t], matrix.starts[t + 1])
            weight[words.index(term), matrix.query[held]] = matrix.weight[held]
        value = np.array([[saturate(t.count(w), len(t)) if w in t else 0.0 for w in words] for t in texts])
        score = value @ weight
        if neighbour:
            beside = np.zeros_like(score)
            beside[1:] += score[:-1]
            beside[:-1] += score[1:]
            score = np.where(score > 0, score + neighbour * beside, 0)
        for i, q in np.argwhere(score > 0):
            want[q].append((-round(score[i, q], 9), f"p{paper}_c{i}"))
    for q in range(9):
        best_of = lambda rows: [(name, pytest.approx(s)) for s, name in sorted(rows)[:k]]
        assert [(name, s) for s, name in sorted(got[q])[:k]] == best_of(want[q])
    assert sent < 40 * 9 * k / 3  # every batch sent k rows a query


def test_tokens_that_overlap_themselves_count_apart():
    import ahocorasick
    import pyarrow as pa
    from marginalia.functions import scoring as S

    texts = ["a", "aa", "aba", "xyz", "é\U0001f600é", "abab"]
    automaton = ahocorasick.Automaton()
    for i, text in enumerate(texts):
        automaton.add_word(text, i)
    automaton.make_automaton()
    rows = [["aaaa", "ababa", "aaaa"], [], ["é\U0001f600é\U0001f600é", "xyzxyz"], ["abababab", "\U0001f600a"]]
    looped = np.array([S.overlaps_itself(t) for t in texts])
    assert looped.tolist() == [False, True, True, False, True, True]
    for size in (200_000, 2):
        S.WORDS, whole = size, S.WORDS
        try:
            row, token, n = S.count_tokens_in_words(pa.array(rows, pa.list_(pa.string())), automaton, texts, looped)
        finally:
            S.WORDS = whole
        got = Counter()
        for r, t, c in zip(row.tolist(), token.tolist(), n.tolist()):
            got[r, texts[t]] += c
        assert got == Counter({(i, t): float(sum(w.count(t) for w in ws)) for i, ws in enumerate(rows) for t in texts if any(t in w for w in ws)})


def test_hits_type_only_chunks_of_ranked_papers(spark):
    from marginalia.session import of_few

    chunks = spark.range(40).selectExpr("id AS paper_id", "'abstract\nb\nc' AS text").repartition(3).selectExpr(
        "paper_id", "posexplode(split(text, '\n')) AS (chunk_index, content)").withColumn(
        "chunk_type", F.expr("CASE WHEN paper_id IN (5, 9) THEN 'paragraph' ELSE raise_error('typed') END"))
    ranked = spark.createDataFrame([(1, 1, "p5_c1", 5, 1, 2.0, "s"), (1, 2, "p9_c0", 9, 0, 1.0, "s"), (1, 3, None, None, 0, 1.0, "s")],
                                   "query_id BIGINT, rank INT, chunk_id STRING, paper_id BIGINT, chunk_index INT, score DOUBLE, source STRING")
    got = R.as_hits(ranked, chunks).orderBy("rank").collect()  # all chunks were typed, so this raised
    assert [(r.chunk_id, r.paper_id, r.content, r.chunk_type) for r in got] == [("p5_c1", 5, "b", "paragraph"), ("p9_c0", 9, "abstract", "paragraph")]
    ids = spark.createDataFrame([(3,), (4,), (3,), (None,)], "x BIGINT")
    for limit in (1, 2):
        assert sorted(r.id for r in of_few(spark.range(9), "id", ids, limit).collect()) == [3, 4]
