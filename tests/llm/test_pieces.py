import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

from marginalia.llm import pieces
from marginalia.llm.queries import op13_piece_round_trip

ODD = ["<s> </s> <unk> <0x41>", "a  b   c", "  leading", "trailing  ", " ", "   ", "\n", "\n\n", "a\n b\n  c\r\n d", "tab\tand \t\tboth ", "日本語 テキスト", "emoji 👩‍👩‍👧‍👦 x",
       "▁", "▁▁ marker", "a▁ b", "x▁y", "　wide", "nul \x00 byte", "ﬁ ½ Å é", "﻿ bom", "12345 67,890", "word" * 500, "مرحبا नमस्ते", "\n▁", " \n \n", "\x85\x1c", "<unk>▁<s>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        out.append((i, b"".join(x.to_bytes(4, "little") for x in ids), library.decode(ids)))
    return Counter(out)


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "über", "ción", "(2039),", "日本", "###", "\n", "\t", "", "e.g.", "▁"] + ["".join(rng.choice("abcdehinorst") for _ in range(rng.randrange(2, 12))) for _ in range(60)]
    return [" ".join(rng.choices(vocabulary, k=rng.randrange(50))) for _ in range(n)]


@pytest.mark.parametrize("head", [400_000, 20, 0])
def test_equals_the_library(library, documents, head):
    rows = list(enumerate(ODD + prose(1, 150))) + [(900, None), (901, ""), (None, "no id"), (5, "twice twice"), (5, "twice twice"), (6, "twice twice")]
    docs = documents(rows).repartition(5).withColumn("ids", F.lit("mine")).withColumn("key", F.lit(0)).withColumn("n", F.lit(1))
    found = pieces.encoded(docs, head_words=head)
    assert found.columns == ["doc_id", "ids", "decoded"]
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in found.collect()) == expected(library, rows)


def test_each_distinct_word_is_segmented_once(spark, documents):
    docs = documents(list(enumerate(prose(2, 60) * 3)))
    with open(pieces.MODEL, "rb") as file:
        model = pieces.Model(file.read())
    counts = pieces.word_counts(docs, model.pattern)
    shared = spark.sparkContext.broadcast(pieces._Shared(model.library.serialized_model_proto(), model.pattern))
    rows = pieces.word_table(counts, shared).collect()
    words = Counter(w for t in prose(2, 60) * 3 if t for w in __import__("re").findall(model.pattern, "▁" + t.replace(" ", "▁")))
    assert {r.word: r.n for r in rows} == words and len(rows) == len(words)


def test_a_third_of_all_rows_is_one_text_with_rare_words(library, documents):
    rows = [(i, "hot hot hot text") for i in range(200)] + list(enumerate(prose(3, 400), 200)) + [(i, "zyx wvu\ntsr") for i in range(700, 705)]
    found = pieces.encoded(documents(rows), head_words=30)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in found.collect()) == expected(library, rows)


def test_long_texts_and_empty_table(library, documents):
    rows = [(1, " ".join(prose(4, 600))), (2, "y" * 5000), (3, "\n".join(prose(5, 300)))]
    for head in (400_000, 10):
        assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in pieces.encoded(documents(rows), head_words=head).collect()) == expected(library, rows)
    assert pieces.encoded(documents(rows).limit(0)).collect() == []


def test_query_digests(spark, library, tmp_path, documents):
    rows = [(1, "Some text."), (2, None), (3, "Größe\n x")]
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, len(k) // 4, hashlib.sha256(k).hexdigest(), hashlib.sha256(d.encode()).hexdigest()) for i, k, d in expected(library, rows)}
    found = op13_piece_round_trip(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and dict(found.dtypes)["n_tokens"] == "bigint"
    assert {tuple(r) for r in found.collect()} == want


def test_models_that_cannot_be_cut_are_refused():
    with open(pieces.MODEL, "rb") as file:
        held = file.read()
    broken = held.replace("▁the".encode(), "t▁he".encode(), 1)
    assert broken != held
    with pytest.raises(ValueError):
        pieces.Model(broken)
