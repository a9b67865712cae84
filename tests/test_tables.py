import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.functions import metrics as M
from marginalia.functions.chunking import fold_paragraphs
from marginalia.operators import (audit, blocks, context as C, evaluate as E, ingest, library as L, memory, qagen as Q,
                                  thesis as TH, trend)


# Blocks --------------------------------------------------------------------------------------

def test_block_helpers_match_plain_windows(spark):
    rng = random.Random(2)
    rows = [(k, i, rng.randint(0, 5)) for k, n in ((0, 3000), (1, 5), (2, 1)) for i in sorted(rng.sample(range(5000), n))]
    df = spark.createDataFrame(rows, "k INT, i INT, v INT").repartition(7).withColumn("block", blocks.block_of(F.col("i"), 16))
    total = {(r["k"], r["i"]): r["t"] for r in blocks.running_total(df, ["k"], ["i"], "block", F.col("v"), "t").collect()}
    nxt = {(r["k"], r["i"]): r["x"] for r in blocks.next_value(df, ["k"], "i", "block", "i", "x").collect()}
    for key in (0, 1, 2):
        mine = [r for r in rows if r[0] == key]
        seen = 0
        for pos, (_, i, v) in enumerate(mine):
            assert total[(key, i)] == seen
            assert nxt[(key, i)] == (mine[pos + 1][1] if pos + 1 < len(mine) else None)
            seen += v


def test_global_numbers(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("g")).repartition(9)
    got = blocks.global_row_number(df, [F.col("g").desc(), F.col("id").asc()]).orderBy("row_number").collect()
    assert [r["row_number"] for r in got] == list(range(1, 1001))
    assert [(r["g"], r["id"]) for r in got] == sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1]))


def test_salted_join(spark):
    many = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    one = spark.createDataFrame([(0, "a"), (1, "b")], "k BIGINT, n STRING")
    assert blocks.salted_join(many, one, ["k"]).count() == 334
    assert blocks.salted_join(many, one, ["k"], "left").filter("n IS NULL").count() == 166


# Chunks --------------------------------------------------------------------------------------

def model_chunks(text, size, overlap):
    paras = [p.strip() for p in re.split(r"\n\s*\n", text) if p.strip()]
    out, cur, n = [], [], 0
    for p in paras:
        if n + len(p) > size and cur:
            out.append("\n\n".join(cur))
            keep, m = [], 0
            for q in reversed(cur):
                if m + len(q) > overlap:
                    break
                keep.insert(0, q)
                m += len(q)
            cur, n = keep, m
        cur.append(p)
        n += len(p)
    return out + (["\n\n".join(cur)] if cur else [])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), max_size=25), st.integers(1, 60), st.integers(1, 30))
def test_chunk_fold(parts, size, overlap):
    text = "\n\n".join(parts)
    assert fold_paragraphs(text, size, overlap, re.compile(r"\n\s*\n")) == model_chunks(text, size, overlap)


def test_chunk_numbers_span_pages(spark):
    pages = [(1, n, "\n\n".join("x" * 200 for _ in range(5))) for n in range(1, 600)] + [(2, 1, " "), (3, 1, "one")]
    got = ingest.chunk_pages(spark.createDataFrame(pages, "paper_id BIGINT, page_number INT, text STRING").repartition(6)).collect()
    rows = sorted((r for r in got if r["paper_id"] == 1), key=lambda r: r["chunk_index"])
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert [r["page_number"] for r in rows] == sorted(r["page_number"] for r in rows)
    assert {r["paper_id"] for r in got} == {1, 3} and rows[0]["token_count"] == len(rows[0]["content"])


def test_abstract_chunks(spark):
    papers = spark.createDataFrame([(1, " abs "), (2, None), (3, ""), (4, None)], "id BIGINT, abstract STRING")
    pages = spark.createDataFrame([(1, 1, "p"), (2, 3, " " + "y" * 2000), (2, 4, "z"), (3, 1, "  ")], "paper_id BIGINT, page_number INT, text STRING")
    got = {r["paper_id"]: r for r in ingest.abstract_chunks(papers, pages).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["content"], got[1]["page_number"], got[1]["chunk_id"]) == ("abs", None, "p1_c-1")
    assert len(got[2]["content"]) == 1500 and got[2]["page_number"] == 3 and got[2]["token_count"] is None


def test_orphan_records_are_an_error(spark):
    chunks = spark.createDataFrame([(1, 0, "c", None, None), (5, 0, "c", "x", 2)], "paper_id BIGINT, chunk_index INT, content STRING, chunk_type STRING, page_number INT")
    papers = spark.createDataFrame([(1, None, "a", None)], "id BIGINT, title STRING, authors STRING, year INT")
    records = ingest.vector_records(chunks, papers)
    with pytest.raises(ValueError, match="5"):
        ingest.require_no_orphans(records)
    row = ingest.require_no_orphans(records.filter("paper_id = 1")).first()
    assert (row["title"], row["chunk_type"], row["chunk_id"]) == ("", "paragraph", "p1_c0")


# Metrics -------------------------------------------------------------------------------------

def metric(spark, expr, r, g):
    df = spark.createDataFrame([(r, g)], "r ARRAY<STRING>, g ARRAY<STRING>")
    return df.select(expr(F.col("r"), F.col("g")).alias("x")).first()["x"]


def test_metrics(spark):
    abcd, bd = list("abcd"), list("bd")
    l2 = np.log2
    assert metric(spark, lambda r, g: M.ndcg_at_k(r, g, 4), abcd, bd) == pytest.approx((1 / l2(3) + 1 / l2(5)) / (1 + 1 / l2(3)))
    assert metric(spark, lambda r, g: M.ndcg_at_k(r, g, 2), abcd, bd) == pytest.approx((1 / l2(3)) / (1 + 1 / l2(3)))
    assert metric(spark, lambda r, g: M.ndcg_at_k(r, g, 2), ["a", "a"], ["a"]) == 1.0
    assert metric(spark, lambda r, g: M.recall_at_k(r, g, 2), ["a", "a", "b"], ["a", "b"]) == 0.5
    assert metric(spark, lambda r, g: M.recall_at_k(r, g, 2), ["a"], []) == 0.0
    assert metric(spark, lambda r, g: M.reciprocal_rank(r, g), list("xyzb"), bd) == 0.25
    assert metric(spark, lambda r, g: M.ndcg_at_k(r, g, 0), abcd, bd) == 0.0
    s = metric(spark, M.citation_scores, ["p1_c1", "p1_c2", "p9_c9"], ["p1_c2", "p1_c3"])
    assert (s["recall"], s["coverage"]) == (0.5, 0.5) and s["precision"] == pytest.approx(1 / 3)
    df = spark.createDataFrame([("该方法用 BiGRU 抑制背景", "肿瘤、背景抑制；BiGRU")], "a STRING, g STRING")
    assert df.select(M.keyword_hit_rate(F.col("a"), F.col("g"))).first()[0] == pytest.approx(1 / 3)


def test_latency(spark):
    get = lambda xs, **k: E.latency_stats(spark.createDataFrame([(x,) for x in xs], "latency_ms DOUBLE"), **k).first()
    assert tuple(get([100.0])) == (100.0, 100.0, 100.0, 1)
    assert tuple(get([])) == (0.0, 0.0, 0.0, 0)
    assert get([1.0, 2.0, 4.0, 10.0])["p95"] == pytest.approx(9.1)
    rng = np.random.default_rng(0)
    xs = rng.normal(size=400).round(2).tolist()
    both = get(xs), get(xs, max_values=0)
    for row in both:
        assert row["p50"] == pytest.approx(np.percentile(xs, 50)) and row["p95"] == pytest.approx(np.percentile(xs, 95))


def test_quotes_and_passages(spark):
    chunks = spark.createDataFrame([(1, 0, "alpha beta gamma delta epsilon"), (1, 1, "alpha beta gamma delta"), (2, 0, "abab\nalpha  beta")],
                                   "paper_id BIGINT, chunk_index INT, content STRING")
    ev = spark.createDataFrame([(1, 1, " epsilon"), (2, 1, "beta"), (3, 2, "none"), (4, 2, "ab")], "evidence_id BIGINT, paper_id BIGINT, quote STRING")
    got = {r["evidence_id"]: (r["status"], r["n"], r["chunk_id"]) for r in E.resolve_quotes(ev, chunks).collect()}
    assert got == {1: ("ok", 1, "p1_c0"), 2: ("multiple", 2, None), 3: ("missing", 0, None), 4: ("multiple", 2, None)}
    texts = [(i, t) for i, t in enumerate(["x alpha beta gamma delta epsilon y", "ha beta gamma delta ep", "ab ab ab", "", "长文本没有空格"])]
    passages = [(1, "ha beta gamma delta ep"), (2, "ab"), (3, "b a"), (4, "文本没"), (5, "alpha beta gamma delta epsilon")]
    want = {(p, i, t.count(s)) for p, s in passages for i, t in texts if s in t}
    found = E.find_passages(spark.createDataFrame(passages, "passage_id BIGINT, passage STRING"), spark.createDataFrame(texts, "text_id BIGINT, text STRING"))
    assert {tuple(r) for r in found.collect()} == want


def qa(**over):
    row = dict(qa_id="q", question="q?", ground_truth="g", question_type="factoid", source="synthetic", has_answer=True, split="dev",
               reviewed=True, relevant_chunks=None, relevant_evidence=[("doi:10.1/a", "x" * 20)])
    row.update(over)
    return tuple(row.values())


def test_dataset_rules(spark):
    from marginalia.schemas import QA
    rows = [qa(qa_id="ok"), qa(qa_id="blank", question=" "), qa(qa_id="type", question_type="essay"), qa(qa_id="none", relevant_evidence=None),
            qa(qa_id="neg", has_answer=False), qa(qa_id="pos", relevant_evidence=[]), qa(qa_id="uid", relevant_evidence=[("x", "y" * 20)]),
            qa(qa_id="short", relevant_evidence=[("sha256:" + "a" * 64, "y")]), qa(qa_id="miss", source=None),
            qa(qa_id="loc", relevant_evidence=None, relevant_chunks=[(1, None, [])]), qa(qa_id="twice"), qa(qa_id="twice")]
    got = {(r["qa_id"], r["problem"]) for r in E.dataset_violations(spark.createDataFrame(rows, QA)).collect()}
    assert {q for q, _ in got} == {"blank", "type", "none", "neg", "pos", "uid", "short", "miss", "loc", "twice"}
    with pytest.raises(ValueError, match="illegal question_type"):
        E.raise_if_any(E.dataset_violations(spark.createDataFrame(rows, QA)), "dataset")
    leak = [qa(qa_id="a"), qa(qa_id="b", split="train"), qa(qa_id="c", reviewed=False, split="x", relevant_evidence=[])]
    problems = {r["problem"] for r in E.benchmark_violations(spark.createDataFrame(leak, QA)).collect()}
    assert problems == {"paper in several splits", "not reviewed", "illegal split", "too few items", "too few papers"}
    with pytest.raises(ValueError):
        E.select_split(spark.createDataFrame(leak, QA), "holdout")
    with pytest.raises(ValueError, match="zz"):
        E.select_qa(spark.createDataFrame(leak, QA), ["a", "zz"])
    with pytest.raises(ValueError, match="3 problems"):
        E.require_resolved(spark.createDataFrame(leak, QA), spark.createDataFrame([], "qa_id STRING"))
    with pytest.raises(E.InvalidData, match="250 problems") as found:
        E.raise_if_any(E.dataset_violations(spark.createDataFrame([qa(qa_id=f"q{i}", question=" ") for i in range(250)], QA)), "dataset")
    assert {r["qa_id"] for r in found.value.violations.collect()} == {f"q{i}" for i in range(250)}


def test_trend(spark):
    runs = spark.createDataFrame([("1", .4, .1, None, 5), ("2", .5, None, .2, None), ("3", .48, .3, .1, None)], "run_id STRING, recall DOUBLE, mrr DOUBLE, ndcg DOUBLE, k INT")
    rows = trend.with_deltas(runs).orderBy("run_id").collect()
    assert rows[0]["delta_recall"] is None and rows[1]["delta_recall"] == pytest.approx(.1) and rows[2]["delta_recall"] == pytest.approx(-.02)
    assert rows[1]["delta_mrr"] is None and rows[2]["delta_ndcg"] == pytest.approx(-.1)
    assert trend.metric_label(runs).first()["k"] == 5


# Memory, context, library --------------------------------------------------------------------

def test_memory_capacity(spark):
    rows = [(i, "short_term" if i % 2 else "fact", f"m{i}", i, i % 3) for i in range(20)]
    df = spark.createDataFrame(rows, "id BIGINT, memory_type STRING, content STRING, at INT, importance INT").withColumn("created_at", F.timestamp_seconds("at"))
    kept = memory.enforce_capacity(df, {"short_term": 3, "fact": 2}).collect()
    assert {r["id"] for r in kept} == {19, 17, 15, 14, 8}
    assert memory.enforce_capacity(df, {"short_term": 0, "fact": -1}).count() == 20


def test_sub_answers(spark):
    q = spark.createDataFrame([(1, i, f"q{i}") for i in (1, 2, 3)], "topic_id BIGINT, index BIGINT, question STRING")
    hits = spark.createDataFrame([(1, 1, 1, "T", 4), (1, 1, 2, None, None), (1, 2, 1, "U", None)], "topic_id BIGINT, index BIGINT, rank INT, title STRING, page_number INT")
    answers = spark.createDataFrame([(1, 1, "a[^2^][^3^]", None), (1, 2, "[调用 LLM 出错: x", None)], "topic_id BIGINT, index BIGINT, answer STRING, error STRING")
    out = C.global_markers(C.sub_answers(q, hits, answers))
    rows = out.orderBy("index").collect()
    assert [(r["ok"], r["n_chunks"], r["global_answer"]) for r in rows] == [(True, 2, "a[^2^]"), (False, 0, "该子问题检索不足。"), (False, 0, "该子问题检索不足。")]
    text = C.synthesis_contexts(out, hits).first()["context"]
    assert text.endswith("### 全局引用清单\n[1] T 第4页\n[2] 未知文献")


def test_material_budget(spark):
    chunks = spark.createDataFrame([(1, i, f"{i:02d}" + "x" * 100) for i in range(30)] + [(1, 30, " ")], "paper_id BIGINT, chunk_index INT, content STRING")
    papers = spark.createDataFrame([(1, "T", " abs "), (2, None, None)], "id BIGINT, title STRING, abstract STRING")
    got = {r["paper_id"]: r["material"] for r in Q.material(papers, chunks, 300).collect()}
    assert got[2] == "论文标题: (无标题)"
    parts = got[1].split("\n\n")
    n, used = 30, len("论文标题: T") + len("摘要: abs")
    wanted = list(dict.fromkeys([0, n // 2, n - 1] + [round(i * (n - 1) / 6) for i in range(1, 6)]))
    share = max(1, max(0, 300 - used - 4 * len(wanted)) // len(wanted))
    want = []
    for p in wanted:
        room = 300 - used - 2
        if room <= 0:
            break
        want.append((f"{p:02d}" + "x" * 100)[:min(share, room)])
        used += len(want[-1]) + 2
    assert parts == ["论文标题: T", "摘要: abs"] + want


def test_paper_context_is_cut(spark):
    chunks = spark.createDataFrame([(1, i, "" if i % 2 else "y" * 7) for i in range(400)], "paper_id BIGINT, chunk_index INT, content STRING")
    papers = spark.createDataFrame([(1, "done")], "id BIGINT, processed STRING")
    want = "\n\n".join("" if i % 2 else "y" * 7 for i in range(400))[:500]
    assert C.paper_contexts(papers, chunks, 500).first()["context"] == want


def test_thesis_title_and_chapters(spark):
    rows = [(1, 0, "学位论文", "Title", 22.0), (1, 1, "基于深度学习的结直肠癌", "Title", 20.0), (1, 2, "T 分期预测研究", "Title", 18.0),
            (1, 3, "目录", "Heading 1", None), (1, 4, "x", "toc 1", None), (1, 5, "第一章 绪论\t1", "Normal", None), (1, 6, "body text", "Normal", None),
            (1, 8, "1.1 背景 3", "Normal", None), (1, 9, "tail", "Normal", None)]
    p = spark.createDataFrame(rows, "thesis_id BIGINT, index INT, text STRING, style STRING, font_size DOUBLE")
    assert TH.thesis_titles(p).first()["title"] == "基于深度学习的结直肠癌T 分期预测研究"
    got = TH.chapters(p).orderBy("start_paragraph").collect()
    assert [(r["title"], r["level"], r["start_paragraph"], r["end_paragraph"]) for r in got] == [("第一章 绪论", 1, 5, 7), ("1.1 背景", 2, 8, 9)]


def test_manifest_has_one_definition(spark):
    import hashlib
    import json
    df = spark.createDataFrame([(1, i, f"t{i}") for i in range(-1, 40)] + [(2, 0, None)], "paper_id BIGINT, chunk_index INT, content STRING")
    long = spark.range(70_000).select(F.lit(3).cast("bigint").alias("paper_id"), F.col("id").cast("int").alias("chunk_index"), F.lit("x").alias("content"))
    got = dict(audit.chunk_manifests(df.union(long).repartition(5)).collect())
    for paper, texts in ((1, {i: f"t{i}" for i in range(-1, 40)}), (2, {0: ""}), (3, dict.fromkeys(range(70_000), "x"))):
        digest = lambda rows: hashlib.sha256(json.dumps(rows, separators=(",", ":")).encode()).hexdigest()
        blocks = {}
        for i, t in sorted(texts.items()):
            blocks.setdefault(i // 512, []).append({"chunk_index": i, "content_sha256": hashlib.sha256(t.encode()).hexdigest()})
        assert got[paper] == digest([{"block": b, "sha256": digest(rows)} for b, rows in sorted(blocks.items())])
    df = df.filter("paper_id = 1")
    uid = spark.createDataFrame([(1, "doi:x"), (9, "doi:x")], "paper_id BIGINT, paper_uid STRING")
    moved = df.withColumn("paper_id", F.lit(9).cast("bigint"))
    assert audit.corpus_fingerprint(df, uid).first() == audit.corpus_fingerprint(moved.repartition(4), uid).first()


def test_repair_keeps_source(spark):
    links = spark.createDataFrame([(1, 1), (2, 1), (2, 2)], "paper_id BIGINT, tag_id BIGINT")
    papers = spark.createDataFrame([(1,)], "id BIGINT")
    kept, report = audit.repair_links(links, papers)
    assert kept.count() == 3 and tuple(report.first()) == (True, 2, 0, 2)
    kept, report = audit.repair_links(links, papers, dry_run=False)
    assert kept.count() == 1 and tuple(report.first()) == (False, 2, 2, 0)


def test_vector_problems(spark):
    chunks = spark.createDataFrame([(1, 0), (1, 1)], "paper_id BIGINT, chunk_index INT")
    v = spark.createDataFrame([("p1_c0", [1.0]), ("p1_c0", [1.0, 2.0]), ("x", [1.0, 2.0])], "chunk_id STRING, embedding ARRAY<DOUBLE>")
    got = {tuple(r) for r in audit.vector_validation(v, chunks, 2).collect()}
    assert got == {("missing vector", 1), ("unknown id", 1), ("repeated id", 1), ("wrong dimension", 1)}


def test_listing_clamps(spark):
    papers = spark.createDataFrame([(i, f"T{i}", None, None, "read") for i in range(300)], "id BIGINT, title STRING, authors STRING, abstract STRING, status STRING").withColumn(
        "created_at", F.timestamp_seconds("id"))
    page, total = L.list_papers(papers, limit=1000, status="read")
    assert page.count() == 200 and total.first()["total"] == 300
    assert L.list_papers(papers, limit=0)[0].first()["id"] == 299
    assert L.search_like(papers, "t1_", 99).count() == 50


def test_generator_errors_stay_in_band(spark):
    from marginalia.operators.generate import generate_answers
    msgs = "ARRAY<STRUCT<role: STRING, content: STRING>>"
    req = spark.createDataFrame([(1, [("user", "hi")]), (2, [("user", "boom")])], f"query_id BIGINT, messages {msgs}")

    def generator(messages):
        if messages[-1]["content"] == "boom":
            raise RuntimeError("x")
        return messages[-1]["content"].upper()
    got = {r["query_id"]: r["answer"] for r in generate_answers(req, generator).collect()}
    assert got == {1: "HI", 2: "[调用 LLM 出错: RuntimeError]"}


def test_metrics_by_ranks_equal_a_loop(spark):
    """One item holds most labels; hits repeat ids and share ranks."""
    import math
    import random
    rng = random.Random(4)
    items = [(f"q{i}", "factoid", i % 5 > 0) for i in range(40)]
    hits = [(f"q{i % 45}", rng.randrange(1, 8), f"c{rng.randrange(9)}") for i in range(300)]
    labels = [(f"q{rng.randrange(40)}", f"c{rng.randrange(9)}") for _ in range(90)] + [("q1", f"x{i}") for i in range(500)] + [("q1", "c3"), (None, "c1"), ("q2", None)]
    for k in (5, 2, 0):
        want = {}
        for q, _, answer in items:
            shown = [c for _, c in sorted((r, c) for x, r, c in hits if x == q)]
            relevant = {c for x, c in labels if x == q and c is not None}
            found = set(shown[:k]) & relevant
            first = next((1 / n for n, c in enumerate(shown, 1) if c in relevant), 0.0)
            once = list(dict.fromkeys(shown))[:k]
            ideal = sum(1 / math.log2(n + 1) for n in range(1, min(len(relevant), k) + 1))
            dcg = sum(1 / math.log2(n + 1) for n, c in enumerate(once, 1) if c in relevant)
            want[q] = (len(found) / len(relevant) if relevant and k else 0.0, first, dcg / ideal if ideal else 0.0) if answer else (None, None, None)
        got = E.score_items(spark.createDataFrame(items, "qa_id STRING, question_type STRING, has_answer BOOLEAN"),
                            spark.createDataFrame(hits, "qa_id STRING, rank INT, chunk_id STRING"), spark.createDataFrame(labels, "qa_id STRING, chunk_id STRING"), k)
        for r in got.collect():
            assert (r.recall, r.mrr, r.ndcg) == (pytest.approx(want[r.qa_id]) if want[r.qa_id][0] is not None else want[r.qa_id]), (k, r)


def test_annotations_in_order(spark):
    rows = [(1, i, i % 7, i % 3) for i in range(50)] + [(2, 100, None, 1), (2, 101, 3, 0)]
    df = spark.createDataFrame(rows, "paper_id BIGINT, id BIGINT, page_number INT, at INT").withColumn("created_at", F.timestamp_seconds("at"))
    got = {(r.paper_id, r.pos): r.id for r in L.ordered_annotations(df, block=2).collect()}
    want = {(1, n): r[1] for n, r in enumerate(sorted(rows[:50], key=lambda r: (r[2], r[3], r[1])), 1)}
    assert got == want | {(2, 1): 100, (2, 2): 101}
