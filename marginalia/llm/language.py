"""Language identification by bit-sliced Bloom filters of character n-grams.

One table of bit masks stands for a Bloom filter per language: bit ``l`` of position ``p`` says that some n-gram of
language ``l`` hashes to ``p``. The AND of the masks at an n-gram's positions is the set of all languages that hold it. Over a
text, the popcount per language, less the hits expected by chance from that language's fill, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from marginalia.llm.shared import bounded_sample, training_fold

N = 4
BITS = 20
PROBES = 3
# The training sample: so many rows of each language, those with the smallest hash of their id.
SAMPLE_ROWS = 1500
# An n-gram enters a filter if this share of the language's sampled texts, and two of them, hold it.
MIN_SHARE = 0.004
PIECE = 1 << 19
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of ``texts`` and the number of letters and n-grams of each text, as (hashes, counts[2, n]).

    Lower case; runs of other characters are one blank, and a blank stands before and after the text, so beginnings
    and ends of words count.
    """
    codes = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    letter = _letters()[flat]
    owner = np.repeat(np.arange(len(texts)), lengths)
    letters = np.bincount(owner[letter], minlength=len(texts))
    same = owner[1:] == owner[:-1]
    keep = np.concatenate(([True], letter[1:] | letter[:-1] | ~same))
    flat, owner = np.where(letter, flat, 32)[keep].astype(np.uint64), owner[keep]
    if len(flat) < N:
        return np.empty(0, np.uint64), np.stack([letters, np.zeros(len(texts), np.int64)])
    value = np.zeros(len(flat) - N + 1, dtype=np.uint64)
    for i in range(N):
        value = (value ^ flat[i:len(flat) - N + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
    inside = owner[N - 1:] == owner[: len(owner) - N + 1]
    counts = np.bincount(owner[: len(owner) - N + 1][inside], minlength=len(texts))
    return value[inside], np.stack([letters, counts])


def _positions(hashes: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """PROBES places per hash: two independent halves, combined."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(i) * high) & np.uint64((1 << bits) - 1)).astype(np.int64) for i in range(PROBES)]


def _pieces(text: str) -> list[str]:
    """Long texts in pieces that overlap by N - 1 characters."""
    return [text[i:i + PIECE + N - 1] for i in range(0, max(1, len(text) - N + 1), PIECE)]


def _distinct_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, text) to (lang, gram, texts): how many texts of the batch hold each n-gram."""
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found = [np.unique(np.concatenate([grams([p])[0] for p in _pieces(t)])) for t in texts]
            if sum(map(len, found)):
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "texts": n})


class Filters:
    """The bit-sliced table: ``langs`` in code point order, ``masks`` of 2 ** BITS positions, false positive rate each."""

    def __init__(self, langs: list[str], masks: np.ndarray):
        self.langs, self.masks = langs, masks
        fill = np.array([np.count_nonzero(masks >> np.uint64(i) & np.uint64(1)) for i in range(len(langs))]) / len(masks)
        self.by_chance = fill ** PROBES

    def popcounts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(letters, n-grams, hits per language) of each text."""
        hits = np.zeros((len(texts), len(self.langs)))
        letters, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        todo: list[tuple[int, str]] = []
        held = 0

        def count():
            hashes, (own, n) = grams([p for _, p in todo])
            at = np.array([i for i, _ in todo])
            np.add.at(letters, at, own)
            np.add.at(total, at, n)
            if len(hashes):
                places = _positions(hashes)
                mask = self.masks[places[0]]
                for more in places[1:]:
                    mask &= self.masks[more]
                owner = np.repeat(at, n)
                for i in range(len(self.langs)):
                    hits[:, i] += np.bincount(owner[(mask >> np.uint64(i) & np.uint64(1)).astype(bool)], minlength=len(texts))

        for i, text in enumerate(texts):
            for piece in _pieces(text):
                todo.append((i, piece))
                held += len(piece)
                if held >= PIECE:
                    count()
                    todo, held = [], 0
        if todo:
            count()
        return letters, total, hits

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text. The score is the language's share of the corrected hits of all.

        No letter or no text: und and 0. Equal counts: the first language. No hit at all: the first language, score 0.
        """
        letters, total, hits = self.popcounts([t or "" for t in texts])
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        chance = np.minimum(self.by_chance, 1 - 1e-9)
        corrected = np.maximum(0, (hits - total[:, None] * chance) / (1 - chance))
        best, sums = corrected.argmax(axis=1), corrected.sum(axis=1)
        score = np.where(sums > 0, corrected.max(axis=1) / np.maximum(sums, 1e-12), 0)
        known = letters > 0
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known)], np.where(known, score, 0)


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """lang, text of at most ``rows`` labelled training rows of each language, by hash of the id."""
    # Ids first; the texts of the chosen ones are then looked up, at most ``rows`` for each language.
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & training_fold()).select("doc_id", "lang")
    chosen = bounded_sample(known, "lang", "doc_id", rows).distinct()
    return docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi").filter("text is not null").dropDuplicates(["lang", "doc_id"]).select("lang", "text")


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, min_share: float = MIN_SHARE) -> Filters:
    """Filters from (doc_id, text, lang). At most 64 languages fit one mask; more raise.

    The driver receives the filter only: 2 ** BITS positions at most, whatever the corpus holds.
    """
    held = sample(docs, rows)
    langs = sorted(r[0] for r in docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & training_fold()).select("lang").distinct().limit(65).collect())
    if len(langs) > 64:
        raise ValueError("more than 64 languages")
    spark = docs.sparkSession
    counted = held.mapInPandas(_distinct_grams, "lang string, gram bigint, texts bigint").groupBy("lang", "gram").agg(F.sum("texts").alias("texts"))
    sizes = held.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.join(sizes, "lang").filter((F.col("texts") >= F.least(F.lit(2), F.col("n"))) & (F.col("texts") >= F.col("n") * min_share))
    bit = spark.createDataFrame([(lang, i) for i, lang in enumerate(langs)], "lang string, bit int")

    @pandas_udf("array<int>")
    def positions(gram: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(_positions(gram.to_numpy().view(np.uint64)), axis=1).astype(np.int32)))

    spots = (frequent.join(F.broadcast(bit), "lang").select(F.explode(positions("gram")).alias("place"), F.expr("shiftleft(1L, bit)").alias("mask"))
             .groupBy("place").agg(F.bit_or("mask").alias("mask")).toPandas())
    masks = np.zeros(1 << BITS, dtype=np.uint64)
    masks[spots["place"].to_numpy(dtype=np.int64)] = spots["mask"].to_numpy(dtype=np.int64).view(np.uint64)
    return Filters(langs, masks)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score for every row; only the text is read. See :meth:`Filters.decide` for the rules."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 8 bytes a position

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = shared.value.decide(texts.tolist())
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return docs.select("doc_id", predict(F.col("text")).alias("found")).select("doc_id", "found.lang_pred", "found.score")
