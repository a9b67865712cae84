import importlib.util
import os
import uuid

import pytest
from pyspark.sql import functions as F

from marginalia.llm import counts
from marginalia.llm.queries import token_batches
from marginalia.session import checkpoint_root

WORDS = {"words-1": counts.white_space_words}


@pytest.fixture
def rollup(spark):
    return counts.Rollup(spark, f"{checkpoint_root(spark)}/rollup-{uuid.uuid4().hex}")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens) for r in rollup.totals().collect()}


def test_inserts_revisions_and_deletes(rollup, documents):
    docs = documents([(1, "a b c", "en", "s"), (2, "d", "en", "s"), (3, "e f", None, None), (4, None, "de", "s")]).withColumn("tokens", F.lit("x"))
    assert rollup.commit("1", inserts=counts.counted(docs, WORDS))
    assert totals(rollup) == {("s", "en", "words-1"): (2, 4), (None, None, "words-1"): (1, 2), ("s", "de", "words-1"): (1, 0)}
    moved = documents([(2, "d d d d", "de", "t"), (9, "new", "en", "s")])
    assert rollup.commit("2", deletes=documents([(3, ""), (77, "")]), revisions=counts.counted(moved, WORDS))
    assert totals(rollup) == {("s", "en", "words-1"): (2, 4), ("s", "de", "words-1"): (1, 0), ("t", "de", "words-1"): (1, 4)}
    assert rollup.commit("3", deletes=documents([(1, ""), (2, ""), (3, ""), (4, ""), (9, "")]))
    assert totals(rollup) == {} and rollup.current().count() == 0


def test_a_batch_counts_once(rollup, documents):
    docs = counts.counted(documents([(1, "a b"), (2, "c")]), WORDS)
    assert rollup.commit("1", inserts=docs) and not rollup.commit("1", inserts=docs)
    assert rollup.commit("2", deletes=documents([(1, "")])) and not rollup.commit("2", deletes=documents([(2, "")]))
    assert totals(rollup) == {("a", "en", "words-1"): (1, 1)}
    with pytest.raises(ValueError):
        rollup.commit("0", inserts=docs)
    with pytest.raises(ValueError):
        rollup.commit("../x", inserts=docs)


def test_an_interrupted_batch_is_invisible_and_repeatable(rollup, documents):
    docs = counts.counted(documents([(1, "a b"), (2, "c")]), WORDS)
    rollup.commit("1", inserts=docs)
    rollup.commit("2", deletes=documents([(1, "")]))
    os.remove(f"{rollup.path}/deltas/2/_SUCCESS")
    assert totals(rollup) == {("a", "en", "words-1"): (2, 3)}
    assert rollup.commit("2", deletes=documents([(1, "")])) and totals(rollup) == {("a", "en", "words-1"): (1, 1)}
    os.remove(f"{rollup.path}/deltas/2/_SUCCESS")
    os.remove(f"{rollup.path}/ledger/2/_SUCCESS")
    assert rollup.commit("2", deletes=documents([(1, "")])) and totals(rollup) == {("a", "en", "words-1"): (1, 1)}


def test_repeated_rows_nulls_and_empty_tables(rollup, documents):
    docs = documents([(1, "a b"), (1, "a b"), (1, "c"), (None, "d")])
    rollup.commit("1", inserts=counts.counted(docs, WORDS))
    assert totals(rollup) == {("a", "en", "words-1"): (4, 6)}
    rollup.commit("2", deletes=documents([(1, ""), (1, ""), (None, "")]))
    assert totals(rollup) == {("a", "en", "words-1"): (1, 1)}
    rollup.commit("3", inserts=counts.counted(docs.limit(0), WORDS), deletes=docs.limit(0), revisions=counts.counted(docs.limit(0), WORDS))
    rollup.commit("4")
    assert totals(rollup) == {("a", "en", "words-1"): (1, 1)}


def reference_totals(rows, count):
    """The state after each batch of ``token_batches``, from plain dictionaries."""
    held = {i: (t, lang, s) for i, t, lang, s in rows}
    first = {}
    for i in sorted(held):
        if held[i][0] is not None:
            first.setdefault(held[i][0], i)
    out = {}
    for i, (text, lang, source) in held.items():
        if text is not None and first[text] != i:
            continue
        kept = None if text is None else "\n".join(dict.fromkeys(text.split("\n")))
        for name, of in count.items():
            docs, tokens = out.get((source, lang, name), (0, 0))
            out[source, lang, name] = docs + 1, tokens + of(kept or "")
    return out


def test_batches_equal_a_plain_recount(rollup, documents):
    spec = importlib.util.spec_from_file_location("public_tokenizers", "/opt/tokenizers/__init__.py")
    public = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(public)
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    rows = [(i, text, lang, source) for i, (text, lang, source) in enumerate([
        ("Some words, it's 3 of them.\nSome words, it's 3 of them.\nend", "en", "a"), ("x", "en", "a"), ("x", "de", "b"), (None, None, "b"), ("", "en", None),
        ("über <|endoftext|> ñandú  \n\n t", "es", "b"), ("long " * 30_000, "en", "a"), ("a\nb\na", "en", "a"), ("a\nb\na", "fr", "c")])]
    token_batches(rollup, documents(rows), {**WORDS, "bpe": counts.byte_pairs(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)})
    want = reference_totals(rows, {"words-1": lambda t: len(t.split()), "bpe": lambda t: len(whole.encode(t, add_special_tokens=False).ids)})
    assert totals(rollup) == want
    assert rollup.batches() == ["1-load", "2-tokenizers", "3-copies", "4-lines"]
