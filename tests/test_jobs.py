import json
import os

import pytest
from pyspark.sql import functions as F

from marginalia.schemas import PAPERS, conform
from marginalia.sources import documents as D, evaluation as EV, sinks as S
from marginalia.functions import vectors as VX
from marginalia.session import checkpoint_root
from marginalia.streaming import conversation_stream as CS, ingest_stream as IS


def test_binary_scan_dedup_and_pages(spark, tmp_path):
    files = {"a.pdf": b"%PDF-one|two", "b.PDF": b"%PDF-one|two", "c.pdf": b"nope", "d.txt": b"%PDF-x", "e.pdf": b"%PDF-\xff"}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    scan = D.scan_documents(spark, str(tmp_path))
    bad = {os.path.basename(r["path"]): r["reject_reason"] for r in D.rejected(scan).collect()}
    assert bad == {"c.pdf": "signature", "d.txt": "extension"}
    known = spark.createDataFrame([], "md5 STRING")
    fresh = D.new_documents(D.accepted(scan), known)
    assert sorted(os.path.basename(r["path"]) for r in fresh.collect()) == ["a.pdf", "e.pdf"]
    pages = D.extract_pages(fresh, lambda b: b[5:].decode().split("|"))
    got = {(os.path.basename(r["path"]), r["page_number"], r["text"], r["error"]) for r in pages.collect()}
    assert got == {("a.pdf", 1, "one", None), ("a.pdf", 2, "two", None), ("e.pdf", None, None, "UnicodeDecodeError")}
    assert {r["reject_reason"] for r in D.rejected(D.gate(spark.read.format("binaryFile").load(str(tmp_path)), 6)).collect()} == {"size", "extension", "signature"}


def qa_line(i, **over):
    row = {"qa_id": f"q{i:03d}", "question": "q?", "ground_truth": "g", "question_type": "factoid", "source": "imported_paper", "has_answer": True,
           "split": "dev", "reviewed": True, "relevant_evidence": [{"paper_uid": f"doi:10.1/{i % 13}", "quote": "x" * 25}]}
    row.update(over)
    return json.dumps(row, ensure_ascii=False)


def test_dataset_files(spark, tmp_path):
    a, b = tmp_path / "a.jsonl", tmp_path / "b.jsonl"
    a.write_text("\n".join(qa_line(i) for i in range(30)) + "\n\n")
    b.write_text("\n".join(qa_line(i) for i in range(30, 52)))
    counts = S.assemble_dataset(spark, [str(a), str(b)], str(tmp_path / "out"))
    assert tuple(counts.first()) == ("dev", 52, 13)
    assert spark.read.json(str(tmp_path / "out")).count() == 52
    b.write_text(qa_line(1) + "\n{broken\n")
    with pytest.raises(ValueError, match="line 2"):
        EV.load_dataset(spark, str(b))
    assert EV.load_dataset(spark, str(b), strict=False).count() == 1
    with pytest.raises(ValueError, match="qa_id repeated"):
        S.assemble_dataset(spark, [str(a), str(a)], str(tmp_path / "never"))
    assert not (tmp_path / "never").exists()


def test_corpus_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"benchmark_id": "b", "license": "L", "papers": [
        {"paper_uid": "doi:10.1/a", "title": "A", "year": 2020, "chunks": [{"chunk_index": 0, "content": "x" * 20}, {"chunk_index": 1, "content": "y" * 20}]},
        {"paper_uid": "doi:10.1/b", "title": "B", "authors": "Z", "chunks": [{"chunk_index": 0, "section_title": "S", "content": "z" * 20}]}]}, indent=1))
    papers, chunks = EV.load_corpus(spark, str(path))
    assert [(r["id"], r["doi"], r["authors"], r["year"]) for r in papers.orderBy("id").collect()] == [
        (1, "10.1/a", "Evaluation Team", 2020), (2, "10.1/b", "Z", 2026)]
    assert sorted(r["chunk_id"] for r in chunks.collect()) == ["p1_c0", "p1_c1", "p2_c0"]


def test_reports(spark, tmp_path):
    (tmp_path / "20240102_000000.json").write_text(json.dumps({"timestamp": "t", "retrieval_mode": "hybrid", "overall": {
        "recall@7": 0.5, "mrr": "bad", "n_positive": 3}, "by_question_type": [{"question_type": "factoid", "n": 3, "recall": 0.5}]}, indent=2))
    (tmp_path / "20240101_000000.json").write_text("{}")
    (tmp_path / "broken.json").write_text('{"overall": ')
    (tmp_path / "list.json").write_text("[1]")
    runs, types = EV.load_reports(spark, str(tmp_path))
    got = {r["run_id"]: r for r in runs.collect()}
    assert set(got) == {"20240101_000000", "20240102_000000"}
    row = got["20240102_000000"]
    assert (row["k"], row["recall"], row["mrr"], row["ndcg"], row["n_positive"], row["n_negative"]) == (7, 0.5, None, None, 3, None)
    assert got["20240101_000000"]["recall"] is None
    assert [tuple(r)[:3] for r in types.collect()] == [("20240102_000000", "factoid", 3)]


def test_staged_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    first = S.stage_table(spark.range(3), root)
    S.publish_table(spark, root, first)
    second = S.stage_table(spark.range(5), root)
    assert S.read_published(spark, root).count() == 3
    S.publish_table(spark, root, second)
    assert S.read_published(spark, root).count() == 5


def test_vectors_are_validated_before_publication(spark, tmp_path):
    from marginalia.operators.evaluate import InvalidData
    chunks = spark.createDataFrame([(1, 0), (1, 1)], "paper_id BIGINT, chunk_index INT")
    table = lambda *rows: spark.createDataFrame(list(rows), "chunk_id STRING, embedding ARRAY<FLOAT>")
    good = table(("p1_c0", [1.0, 0.0]), ("p1_c1", [0.0, 1.0]))
    root = str(tmp_path / "vectors")
    version = S.publish_vectors(good, chunks, root, 2, [1.0, 1.0])
    for bad in (table(("p1_c0", [1.0, 0.0])), table(("p1_c0", [1.0, 0.0]), ("p1_c1", [0.0])), good.unionByName(good),
                table(("p1_c0", [1.0, 0.0]), ("p1_c1", [0.0, 1.0]), ("p9_c0", [0.0, 1.0]))):
        with pytest.raises(InvalidData):
            S.publish_vectors(bad, chunks, root, 2, [1.0, 1.0])
    assert spark.read.parquet(root + "/pointer").collect()[0].version == version and S.read_published(spark, root).count() == 2
    S.publish_vectors(good.limit(0), chunks.limit(0), root, 2, [1.0, 1.0])
    assert S.read_published(spark, root).count() == 0


def test_conform(spark):
    df = conform(spark.createDataFrame([(1, None)], "id INT, status STRING"), PAPERS, {"status": "unread"})
    row = df.first()
    assert row["status"] == "unread" and row["title"] is None and df.schema["id"].dataType.simpleString() == "bigint"


def test_ingest_stream(spark, tmp_path):
    src, root, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "paper_id BIGINT, page_number INT, text STRING"
    papers = spark.createDataFrame([(1, "Cells and slides in depth", None), (2, "Another long title here", "abs")], "id BIGINT, title STRING, abstract STRING")
    page = 'a\n\nb\nReferences\n[1] X. "Another long title here", 2020.'
    spark.createDataFrame([(1, 1, page), (3, 1, " ")], schema).coalesce(1).write.parquet(src)
    run = lambda: IS.ingest_stream(spark, src, papers, root, mark).awaitTermination()
    run()
    ids = lambda: sorted(r["chunk_id"] for r in IS.current_table(spark, root, "chunks").collect())
    assert ids() == ["p1_c-1", "p1_c0"]
    assert {(r["paper_id"], r["processed"]) for r in IS.current_table(spark, root, "status").collect()} == {(1, "done"), (3, "error")}
    assert [tuple(r) for r in IS.current_table(spark, root, "edges").collect()] == [(1, 2)]
    run()
    assert ids() == ["p1_c-1", "p1_c0"]
    spark.createDataFrame([(1, 1, "new"), (2, 1, "two")], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    assert ids() == ["p1_c-1", "p1_c0", "p2_c-1", "p2_c0"]
    text = {r["chunk_id"]: r["content"] for r in IS.current_table(spark, root, "chunks").collect()}
    assert text["p1_c0"] == "new" and text["p2_c-1"] == "abs"


def test_pages_of_a_paper_meet_over_batches(spark, tmp_path):
    src, root, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    papers = spark.createDataFrame([(1, "A long enough title", "abs")], "id BIGINT, title STRING, abstract STRING")

    def push(*rows):
        spark.createDataFrame(list(rows), "paper_id BIGINT, page_number INT, text STRING").coalesce(1).write.mode("append").parquet(src)
        IS.ingest_stream(spark, src, papers, root, mark, embed=VX.embedder(VX.hashing_embedder(8))(F.col("content")), buckets=4).awaitTermination()
        return {(r.chunk_id, r.content) for r in IS.current_table(spark, root, "chunks").collect()}

    assert push((1, 2, "second"), (2, 1, " ")) == {("p1_c0", "second"), ("p1_c-1", "abs")}
    state = lambda: {r.paper_id: (r.processed, r.error, r.batch) for r in IS.current_table(spark, root, "status").collect()}
    assert state() == {1: ("done", None, 0), 2: ("error", "no text", 0)}
    assert push((1, 1, "first"), (1, 3, "third"), (1, 3, "third")) == {("p1_c0", "first"), ("p1_c1", "second"), ("p1_c2", "third"), ("p1_c-1", "abs")}
    before = state()
    assert push((1, 2, "second"), (None, 1, "x"), (3, None, "y")) == {("p1_c0", "first"), ("p1_c1", "second"), ("p1_c2", "third"), ("p1_c-1", "abs")} and state() == before
    assert push((1, 2, "changed"), (2, 1, "now with text")) == {("p1_c0", "first"), ("p1_c1", "changed"), ("p1_c2", "third"), ("p1_c-1", "abs"),
                                                              ("p2_c0", "now with text"), ("p2_c-1", "now with text")}
    vectors = {r.chunk_id for r in IS.current_table(spark, root, "vectors").collect()}
    assert vectors == {r.chunk_id for r in IS.current_table(spark, root, "chunks").collect()} and state()[2][0] == "done"
    assert push((1, 1, ""), (1, 2, " "), (1, 3, None)) == {("p2_c0", "now with text"), ("p2_c-1", "now with text")} and state()[1][:2] == ("error", "no text")


def test_a_failed_batch_is_retried_and_edge_failures_are_recorded(spark, tmp_path, monkeypatch):
    src, root, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    papers = spark.createDataFrame([(1, "A long enough title", None)], "id BIGINT, title STRING, abstract STRING")
    spark.createDataFrame([(1, 1, "text"), (1, 2, "more")], "paper_id BIGINT, page_number INT, text STRING").coalesce(1).write.parquet(src)
    calls, whole = [], IS.ingest.abstract_chunks

    def failing(*args):
        calls.append(1)
        if len(calls) < 4:
            raise OSError("storage is away")
        return whole(*args)

    monkeypatch.setattr(IS.ingest, "abstract_chunks", failing)
    with pytest.raises(Exception):
        IS.ingest_stream(spark, src, papers, root, mark, attempts=3).awaitTermination()
    assert len(calls) == 3
    monkeypatch.setattr(IS.graph, "title_edges", lambda *args: (_ for _ in ()).throw(ValueError("no titles today")))
    IS.ingest_stream(spark, src, papers, root, mark, attempts=3).awaitTermination()
    assert {r.content for r in IS.current_table(spark, root, "chunks").collect()} == {"text", "more"}
    assert [(r.processed, r.edge_error) for r in IS.current_table(spark, root, "status").collect()] == [("done", "ValueError: no titles today")]


def test_a_page_with_an_error_and_a_replayed_batch(spark, tmp_path):
    root = str(tmp_path / "out")
    papers = spark.createDataFrame([], "id BIGINT, title STRING, abstract STRING")
    rows = spark.createDataFrame([(1, 1, "text", None), (1, 2, None, "broken"), (2, 1, "fine", None)], "paper_id BIGINT, page_number INT, text STRING, error STRING")
    for _ in range(2):
        IS.process_batch(papers, rows, 0, root)
        assert {(r.paper_id, r.processed, r.error) for r in IS.current_table(spark, root, "status").collect()} == {(1, "error", "broken"), (2, "done", None)}
        assert sorted(r.chunk_id for r in IS.current_table(spark, root, "chunks").collect()) == ["p2_c-1", "p2_c0"]
    IS.process_batch(papers, rows.limit(0), 1, root)
    assert IS.current_table(spark, root, "pages").count() == 3


def test_digest_stream_across_batches(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "id BIGINT, conversation_id BIGINT, role STRING, content STRING, at INT"

    def push(rows):
        spark.createDataFrame(rows, schema).withColumn("created_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema + ", created_at TIMESTAMP").parquet(src)
        CS.digest_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(
            availableNow=True).start().awaitTermination()
    push([(i, 1, "user", f"m{i}", i) for i in range(4)] + [(100, 2, "user", "x", 0)])
    push([(i, 1, "user", f"m{i}", i) for i in range(4, 16)])
    got = {r["message_count"]: r["digest"] for r in spark.read.parquet(out).collect()}
    assert sorted(got) == [5, 10, 15]
    assert got[5] == "\n".join(f"user: m{i}" for i in range(5)) and got[15] == "\n".join(f"user: m{i}" for i in range(5, 15))


@pytest.mark.parametrize("files", [1, 3])
def test_digests_of_a_table_of_one_or_more_files(spark, tmp_path, files):
    """A table is a file or a folder of files; one without five messages of a conversation has no digest."""
    from marginalia.plans.job_queries import stream_digests
    for name, turns in (("long", 7), ("short", 3)):
        rows = [(c, t, "user", f"c{c} m{t}") for c in range(4) for t in range(turns)]
        table = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
        path = tmp_path / name / "conversations.parquet"
        if files == 1:
            path.parent.mkdir()
            table.toPandas().to_parquet(path)
        else:
            table.repartition(files).write.parquet(str(path))
        got = {(r.conversation_id, r.message_count, r.digest) for r in stream_digests(spark, str(path.parent)).collect()}
        assert got == {(c, 5, "\n".join(f"user: c{c} m{t}" for t in range(5))) for c in range(4) if turns >= 5}


def test_memory_stream_keeps_capacity(spark, tmp_path):
    src, root, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "id BIGINT, memory_type STRING, content STRING, importance INT, created_at TIMESTAMP"

    def push(ids):
        spark.createDataFrame([(i, "short_term", "" if i == 3 else f"m{i}", 5, i) for i in ids], "id BIGINT, memory_type STRING, content STRING, importance INT, at INT").select(
            "id", "memory_type", "content", "importance", F.timestamp_seconds("at").alias("created_at")).coalesce(1).write.mode("append").parquet(src)
        CS.memory_stream(spark.readStream.schema(schema).parquet(src), root, mark, {"short_term": 3}).awaitTermination()
    push(range(5))
    push(range(5, 7))
    assert sorted(r["id"] for r in CS.read_memory(spark, root).collect()) == [4, 5, 6]


def test_memories_are_bounded_without_rewriting(spark, tmp_path):
    """Several batches, rows sent twice, a type that holds most rows, a type without a limit."""
    import random
    rng = random.Random(2)
    src, root, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "id BIGINT, memory_type STRING, content STRING, importance INT, at INT"
    limits = {"short_term": 3, "fact": 2}
    sent, sizes = {}, []
    for part in range(3):
        rows = [(i, "fact" if i % 3 else rng.choice(["short_term", "scratch"]), f"m{i}", rng.choice([None, 1, 5, 5]), rng.randrange(9)) for i in range(part * 20, part * 20 + 40) if i not in sent]
        again = [r for r in sent.values() if rng.random() < 0.5] + rows[:3]
        sent |= {r[0]: r for r in rows}
        spark.createDataFrame(rows + again + [(None, "fact", "x", 9, 9), (999, "fact", " ", 9, 9)], schema).withColumn("created_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema + ", created_at TIMESTAMP").parquet(src)
        CS.memory_stream(stream, root, mark, limits, salts=4).awaitTermination()
        want = {r[0] for r in sent.values() if r[1] == "scratch"}
        for kind, n in limits.items():
            best = sorted((r for r in sent.values() if r[1] == kind), key=lambda r: ((r[3] or 0) if kind != "short_term" else 0, r[4], r[0]), reverse=True)
            want |= {r[0] for r in best[:n]}
        assert {r.id for r in CS.read_memory(spark, root, limits).collect()} == want
        sizes.append({f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names})
    assert all(sizes[-1][f] == t for f, t in sizes[0].items())


def test_short_term_memories_follow_the_digests(spark, tmp_path):
    src, root, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "id BIGINT, conversation_id BIGINT, role STRING, content STRING, at INT"
    sent, store, counts = [], {}, {}

    def push(rows, limit=2):
        spark.createDataFrame(rows, schema).withColumn("created_at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(src)
        CS.short_term_stream(spark.readStream.schema(schema + ", created_at TIMESTAMP").parquet(src), root, mark, limit).awaitTermination()
        for i, conversation, role, content, at in sorted(rows, key=lambda r: (r[4], r[0])):
            counts.setdefault(conversation, []).append(f"{role}: {content}")
            if len(counts[conversation]) % 5 == 0:
                digest = "\n".join(counts[conversation][-10:])
                if conversation in store:
                    store[conversation][0] = digest
                else:
                    store[conversation] = [digest, at]
                    if len(store) > limit:
                        del store[min(store, key=lambda c: store[c][1])]
        got = {r.source_conversation_id: [r.content, int(r.created_at.timestamp())] for r in CS.read_short_term(spark, root).collect()}
        assert got == store

    make = lambda conversation, start, n: [(conversation * 100 + i, conversation, "user", f"m{i}", conversation * 20 + i) for i in range(start, start + n)]
    push(make(1, 0, 5) + make(2, 0, 4))
    push(make(1, 5, 6) + make(2, 4, 2) + make(3, 0, 7))
    push(make(1, 11, 9) + make(4, 0, 3))


def test_a_part_of_many_files_is_one_batch(spark, tmp_path):
    import glob
    from marginalia.plans import job_queries as J

    lines = "one line\nanother line\n \nthe last of them\nand a fifth"
    spark.createDataFrame([(i, lines if i % 9 else " ", "en", "s", 1) for i in range(40)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT").repartition(
        4).write.parquet(f"{tmp_path}/documents.parquet")
    made, folder = [], J._folder
    J._folder = lambda s, name: made.append(folder(s, name)) or made[-1]
    try:
        root = J._ingested(spark, str(tmp_path))
    finally:
        J._folder = folder
    source = next(p for p in made if "-source" in p).removeprefix("file:")
    assert len(glob.glob(f"{source}/*.parquet")) > 4  # each part was the work of one task
    state = {r.paper_id: (r.processed, r.batch) for r in IS.current_table(spark, root, "status").collect()}
    # The last new page of a paper comes with its part; the repeated part changes nothing.
    assert state == {i: ("done", 2) if i % 9 else ("error", 1) for i in range(40)}
    assert IS.current_table(spark, root, "pages").count() == 40 // 9 + 1 + 5 * (40 - 40 // 9 - 1)


@pytest.mark.parametrize("groups", [2, 1000])
def test_state_of_pages_in_groups(spark, tmp_path, groups):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "paper_id BIGINT, page_number INT, text STRING"

    def push(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        found = []
        keep = lambda df, n: found.extend((r.paper_id, r.page_number, r.text, r.error) for r in df.collect())
        IS.changed_pages(spark.readStream.schema(schema).parquet(src), groups).writeStream.foreachBatch(keep).option("checkpointLocation", mark).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(found, key=lambda r: r[:2])

    assert push([(1, p, f"t{p}") for p in range(-1, 600)] + [(2, 3, None)]) == [(1, p, f"t{p}", None) for p in range(-1, 600)] + [(2, 3, None, None)]
    assert push([(1, p, "new" if p in (0, 255, 599) else f"t{p}") for p in range(601) if p < 600 or p == 600] + [(2, 3, None)]) == [
        (1, 0, "new", None), (1, 255, "new", None), (1, 599, "new", None), (1, 600, "t600", None)]
    assert push([(1, 0, "t0"), (1, 255, "new"), (2, 3, "")]) == [(1, 0, "t0", None), (2, 3, "", None)]


def test_a_batch_leaves_nothing_but_its_tables(spark, tmp_path, monkeypatch):
    root, place = tmp_path / "out", os.path.join(checkpoint_root(spark).removeprefix("file://"), "marginalia")
    papers = spark.createDataFrame([(1, "A long enough title", None), (2, "Another title of it", None)], "id BIGINT, title STRING, abstract STRING")
    text = 'Body.\nReferences\n[1] Anon. "Another title of it", 2020.'
    rows = spark.createDataFrame([(1, 1, text, None), (2, 1, "fine", None)], "paper_id BIGINT, page_number INT, text STRING, error STRING")
    before = set(os.listdir(place)) if os.path.isdir(place) else set()
    embed, worked, one = VX.embedder(VX.hashing_embedder(8))(F.col("content")), [], IS._process_buckets
    monkeypatch.setattr(IS, "_process_buckets", lambda *args: (worked.append(args[3]), one(*args)))
    for batch, size in enumerate((1 << 30, 20)):  # all at once, then a bucket at a time
        IS.process_batch(papers, rows, batch, str(root), embed=embed, buckets=4, slice_bytes=size)
        assert {(r.paper_id, r.batch) for r in IS.current_table(spark, str(root), "status").collect()} == {(1, batch), (2, batch)}
        assert IS.current_table(spark, str(root), "chunks").count() == IS.current_table(spark, str(root), "vectors").count() == 4
    together, *single = worked
    assert len(together) == 2 and single == [[n] for n in together]
    assert [tuple(r) for r in IS.current_table(spark, str(root), "edges").collect()] == [(1, 2)]
    assert sorted(os.listdir(root)) == ["chunks", "edges", "pages", "status", "vectors"]
    assert set(os.listdir(place)) <= before
