"""SentencePiece encoding and decoding through a table of distinct marked words.

The library writes a text as its spaces turned into markers, one put before it. A model none of whose pieces has a marker
after another character cannot join across the start of a marked word, nor across a character that no longer piece holds; so a
text's ids are those of its words in order. Spark counts the distinct words of the corpus, each is segmented (and decoded
back) once, and the ids return to the texts by position. The table of the words that occur most is of bounded size and goes to
every executor; each slice of documents makes a table of its own for its other words. Joining those corpus-wide as well
was built and measured: it moves every text once and every rare word twice, above the disk this may take.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.llm.counts import TOKENIZERS
from marginalia.llm.shared import heavy_threshold
from marginalia.session import Scratch

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "▁"
# Words that are sent to every executor, and the longest of them.
HEAD_WORDS = 400_000
HEAD_BYTES = 256
# Words the library segments in one call, and characters of the documents that share a table of their other words.
SEGMENT = 20_000
SLICE_CHARS = 4 << 20


class Model:
    """The library with what the table needs to know of it. Raises if words cannot be segmented apart."""

    def __init__(self, file: bytes):
        from sentencepiece import SentencePieceProcessor
        self.library = SentencePieceProcessor(model_proto=file)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())
                  if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i))]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a marker")
        if self.library.normalize(" ﬁＡ  b\t ") != f"{MARK}{MARK}ﬁＡ{MARK}{MARK}b\t{MARK}":
            raise ValueError("the model changes more than spaces, or sets no marker before a text")
        joined = {c for p in pieces if len(p) > 1 for c in p}
        # Line ends and tabs, unless a longer piece holds them, part words too.
        self.lone = "".join(c for c in "\n\t" if c not in joined)
        self.mark = [self.library.piece_to_id(MARK)]

    @property
    def pattern(self) -> str:
        """A word: one lone character, or markers and what follows them. For Java and Python alike."""
        return (f"[{self.lone}]|" if self.lone else "") + f"{MARK}*[^{MARK}{self.lone}]+|{MARK}+"

    def segment(self, words: list[str]) -> list[list[int]]:
        # The library sets a marker before every text; words without one of their own go behind a lone character, whose ids are cut off.
        before = len(self.library.encode(self.lone[0])) if self.lone else 0
        marked = [w.startswith(MARK) for w in words]
        found = self.library.encode([w[1:] if m else self.lone[0] + w for w, m in zip(words, marked)], num_threads=1)
        return [(ids or self.mark) if m else ids[before:] for ids, m in zip(found, marked)]

    def restored(self, words: list[str], ids: list[list[int]]) -> list[str]:
        """The words' own part of a decoded text. Decoding drops one marker in front."""
        return [(" " if w.startswith(MARK) else "") + d for w, d in zip(words, self.library.decode(ids))]


class _Shared(NamedTuple):
    file: bytes
    pattern: str


def marked(text: str) -> Column:
    """The text as the library sees it; null is empty, and an empty text has no marker."""
    return F.when(F.col(text) != "", F.concat(F.lit(MARK), F.translate(text, " ", MARK))).otherwise(F.lit(""))


def packed_ids(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def word_counts(docs: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """word, n: how often the corpus has each distinct marked word."""
    return docs.select(F.explode(F.regexp_extract_all(marked(text), F.lit(pattern), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_table(counts: DataFrame, shared) -> DataFrame:
    """word, n, ids, restored: every word of the table segmented once. ``restored`` is null where decoding gives the word with spaces for markers."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value.file)
        for batch in batches:
            for at in range(0, batch.num_rows, SEGMENT):
                part = batch.slice(at, SEGMENT)
                words = part.column(0).to_pylist()
                ids = model.segment(words)
                back = [r if r != w.replace(MARK, " ") else None for w, r in zip(words, model.restored(words, ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([packed_ids(i) for i in ids], pa.binary()), pa.array(back, pa.string())],
                                                 names=["word", "n", "ids", "restored"])
    return counts.select("word", "n").mapInArrow(each, "word string, n bigint, ids binary, restored string")


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS characters; a longer text is one of its own."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= SLICE_CHARS:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS, path: str = MODEL) -> DataFrame:
    """Per row of ``docs``: key, ids (begin and end included, 32-bit little-endian), decoded: what decoding the ids gives.

    A null text is an empty one: begin and end only. Rows that repeat count each. Other columns of ``docs`` are not looked at. The
    model file is read on the driver and sent to the executors.
    """
    spark = docs.sparkSession
    with open(path, "rb") as file:
        held = file.read()
    model = Model(held)
    shared = spark.sparkContext.broadcast(_Shared(held, model.pattern))
    with Scratch(spark) as scratch:
        counts = scratch.write(word_counts(docs, model.pattern, text), "words")
        least = heavy_threshold(counts, "n", head_words)
        table = word_table(counts.filter((F.col("n") >= least) & (F.octet_length("word") <= HEAD_BYTES)), shared)
        head = table.select("word", "ids", "restored").toPandas()  # at most head_words rows of HEAD_BYTES and their ids
    common = spark.sparkContext.broadcast((dict(zip(head["word"], map(bytes, head["ids"]))), {w: r for w, r in zip(head["word"], head["restored"]) if r is not None}))
    kind = dict((f.name, f.dataType.simpleString()) for f in docs.schema.fields)[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shared.value.file)
        find = re.compile(model.pattern).findall
        begin, end = packed_ids([model.library.bos_id()]), packed_ids([model.library.eos_id()])
        common_ids, common_restored = common.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in slices(texts):
                # Words are found twice, here and below: those of one text are held, never those of the slice.
                rest = set()
                for t in texts[i:j]:
                    rest.update(w for w in find(t) if w not in common_ids)
                rest = list(rest)
                ids_of, restored = {}, {}
                for at in range(0, len(rest), SEGMENT):
                    part = rest[at:at + SEGMENT]
                    ids = model.segment(part)
                    ids_of.update(zip(part, map(packed_ids, ids)))
                    restored.update((w, r) for w, r in zip(part, model.restored(part, ids)) if r != w.replace(MARK, " "))
                out = []
                for t in texts[i:j]:
                    found = find(t)
                    ids = b"".join([begin, *[common_ids.get(w) or ids_of[w] for w in found], end])
                    if common_restored or restored:
                        decoded = "".join([common_restored.get(w) or restored.get(w) or w.replace(MARK, " ") for w in found])
                    else:
                        decoded = t.replace(MARK, " ")
                    out.append((ids, decoded[1:]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x for x, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())],
                                                 names=["key", "ids", "decoded"])

    return docs.select(F.col(key).alias("key"), marked(text)).mapInArrow(each, f"key {kind}, ids binary, decoded string").withColumnRenamed("key", key)
