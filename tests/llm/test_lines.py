import random

from pyspark.sql import functions as F

from marginalia.llm import lines


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_force(rows, min_words=5):
    """(doc_id, line_no) to the earliest line equal to it or one word edit away."""
    found = [((i, n), line.split()) for i, text in rows if text is not None for n, line in enumerate(text.split("\n"))]
    out = {}
    for place, words in found:
        near = [p for p, other in found if words and p < place and (
            other == words or max(len(words), len(other)) >= min_words and abs(len(words) - len(other)) <= 1 and word_edits(words, other) <= 1)]
        out[place] = min(near, default=place)
    return out


def variants(rng, words, vocabulary):
    w = list(words)
    kind, at = rng.randrange(5), rng.randrange(len(words))
    if kind == 0:
        w[at] = rng.choice(vocabulary)
    elif kind == 1:
        del w[at]
    elif kind == 2:
        w.insert(at, rng.choice(vocabulary))
    elif kind == 3:
        w[at], w[-1 - at] = w[-1 - at], w[at]
    return w


def test_links_equal_brute_force(documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    base = [rng.choices(vocabulary, k=rng.randrange(1, 12)) for _ in range(25)]
    rows = []
    for i in range(70):
        held = [" ".join(variants(rng, rng.choice(base), vocabulary)) if rng.random() < 0.8 else " ".join(rng.choice(base)) for _ in range(rng.randrange(1, 4))]
        rows.append((i, "\n".join(held + ([""] if i % 9 == 0 else []))))
    docs = documents(rows).withColumn("line_no", F.lit(1)).withColumn("place", F.lit("x"))
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in lines.linked_lines(docs).collect()}
    assert got == brute_force(rows)


def test_keep_marks_the_earliest_and_blank_lines(documents):
    rows = [(1, "one two three four five\n\nshort line"), (2, "one  two three four FIVE\n\nshort  line"), (3, "one two three four five\tsix"), (4, "short word")]
    keep = {(r.doc_id, r.line_no): r.keep for r in lines.linked_lines(documents(rows)).collect()}
    assert keep == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): False, (2, 1): True, (2, 2): False, (3, 0): False, (4, 0): True}


def test_common_line_and_numbered_lines_make_no_pairs(documents):
    rows = [(i, f"the same line for everyone here\npage number {i} of the report") for i in range(400)]
    got = lines.linked_lines(documents(rows)).collect()
    assert {(r.doc_id, r.line_no) for r in got if r.keep} == {(0, 0), (0, 1)}
    assert {(r.first_doc_id, r.first_line_no) for r in got} == {(0, 0), (0, 1)}


def test_very_long_lines(documents):
    words = [f"w{i}" for i in range(20_000)]
    changed = words[:10_000] + ["x"] + words[10_001:]
    cut = words[:5] + words[6:]
    got = {r.doc_id: r.first_doc_id for r in lines.linked_lines(documents([(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(cut)), (4, " ".join(words[:9000]))])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_nulls_repeats_and_empty_table(documents):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e g"), (None, None)]
    got = lines.linked_lines(documents(rows)).collect()
    assert sorted((str(r.doc_id), r.keep) for r in got) == [("2", True), ("3", True), ("3", True), ("None", False)]
    assert lines.linked_lines(documents([(1, "x")]).limit(0)).count() == 0


def test_texts_of_kept_lines(documents):
    rows = [(1, "a b c d e\nlast  line"), (2, "a b c d x\n\nnew"), (3, "last line"), (4, None)]
    got = {r.doc_id: r.text for r in lines.deduplicated(documents(rows)).collect()}
    assert got == {1: "a b c d e\nlast  line", 2: "\nnew", 3: "", 4: None}


def test_texts_of_repeated_and_null_ids(documents):
    rows = [(1, "a b c d e\nx y"), (1, "a b c d e\nx y"), (1, "another row of one\nx y"), (None, "none has this line"), (None, "x y\n\nnor this one"), (None, None)]
    got = sorted((str(r.doc_id), r.text or "-") for r in lines.deduplicated(documents(rows).withColumn("row", F.lit(7)).withColumn("line_no", F.lit("z"))).collect())
    assert got == sorted([("1", "a b c d e\nx y"), ("1", "a b c d e\nx y"), ("1", "another row of one\nx y"), ("None", "none has this line"), ("None", "\nnor this one"), ("None", "-")])


def test_running_xor(spark):
    values = [[1], list(range(1, 65)), list(range(7, 200)), [5] * 129]
    rows = spark.createDataFrame([(v,) for v in values], "v array<bigint>").select("v", lines._running_xor(F.col("v")).alias("x")).collect()
    for r in rows:
        want = [0]
        for x in r.v:
            want.append(want[-1] ^ x)
        assert r.x == want
