"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded, documented sample of labelled rows is the example set. Its index keeps, per term, postings sorted by example and
the greatest weight within each block of examples. A text's bound for a block is the sum of its weights
times these maxima; blocks are read from the greatest bound down until no block can beat the k-th nearest found, so the
neighbours are exact. Their distance-weighted votes, calibrated on the examples left out one by one, are
the score; the neighbours are its evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from marginalia.session import materialize
from marginalia.llm.shared import bounded_sample, training_fold

# Bounds of the model: examples per label, terms.
EXAMPLES = 2000
TERMS = 4096
# A term is kept if the odds to hold it differ between the labels by this factor (half an example added to each count)
# and so many examples of one label hold it, however many examples there are.
MIN_ODDS = 20.0
SUPPORT = 3
# Besides words, their beginnings of these lengths are terms, so that inflected and compounded forms share one.
BEGINNINGS = (4, 5)
REPEATS = (2, 3, 5)
NEIGHBOURS = 16
BLOCK = 64
# Similarity of the imagined neighbour that votes with the share of toxic rows.
PRIOR_WEIGHT = 0.05
THRESHOLD = 0.7

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters of the whole text."""
    return _WORD.findall(text.lower()) if text else []


def terms_of(text: str | None, bases: set[str] | dict | None = None) -> dict[str, int]:
    """The terms of a text with their counts, of the given bases or of all.

    Bases are words and their beginnings, marked by a hyphen. A base that occurs as often as one of REPEATS is a
    further term: what is harmless once may tell when it is repeated.
    """
    found: Counter = Counter()
    held = words(text)
    if bases is not None:
        # A base and the words it stands for begin alike, so most words are out at once.
        heads = bases if isinstance(bases, Heads) else Heads(bases)
        held = [w for w in held if w[:heads.length] in heads.known]
    for word, n in Counter(held).items():
        for base in (word, *(word[:k] + "-" for k in BEGINNINGS if len(word) > k)):
            if bases is None or base in bases:
                found[base] += n
    return dict(found) | {f"{base}{least}": 1 for base, n in found.items() for least in REPEATS if n >= least}


class Heads(set):
    """A set of bases with their first letters."""

    def __init__(self, bases):
        super().__init__(bases)
        self.length = min(BEGINNINGS)
        self.known = {b.rstrip("-")[:self.length] for b in self}

    def __reduce__(self):
        return Heads, (list(self),)


def bases_of(terms: list[str]) -> Heads:
    return Heads(t.rstrip("0123456789") for t in terms)


def numbered(text: str | None, number: dict[str, int], bases: set[str]) -> dict[int, int]:
    """How often each known term of ``number`` occurs in the text."""
    return {number[t]: n for t, n in terms_of(text, bases).items() if t in number}


def _term_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(toxic, text) to (term, toxic, texts) of the batch."""
    for batch in batches:
        for toxic, texts in batch.groupby("toxic")["text"]:
            found = Counter()
            for text in texts:
                found.update(terms_of(text).keys())
            if found:
                yield pd.DataFrame({"term": list(found), "toxic": int(toxic), "texts": list(found.values())})


class Index:
    """Examples as TF-IDF vectors of length one, inverted, with block maxima."""

    def __init__(self, terms: list[str], idf: np.ndarray, examples: list[tuple[int, int, list[int], list[int]]], prior: float):
        """``examples``: (doc_id, toxic, term numbers, counts), in order of doc_id; ``prior``: share of toxic rows."""
        self.number = {t: i for i, t in enumerate(terms)}
        self.bases = bases_of(terms)
        self.idf, self.prior = idf, prior
        self.ids = np.array([e[0] for e in examples], dtype=np.int64)
        self.toxic = np.array([e[1] for e in examples], dtype=np.float64)
        blocks = -(-len(examples) // BLOCK)
        vectors = [self.vector(np.array(e[2], dtype=np.int64), np.array(e[3], dtype=np.float64)) for e in examples]
        rows = np.concatenate([np.full(len(v[0]), i) for i, v in enumerate(vectors)] or [[]]).astype(np.int64)
        cols = np.concatenate([v[0] for v in vectors] or [[]]).astype(np.int64)
        values = np.concatenate([v[1] for v in vectors] or [[]]).astype(np.float64)
        order = np.lexsort((rows, cols))
        self.example, self.weight, cols = rows[order], values[order], cols[order]
        # Where the postings of (term, block) begin.
        cell = cols * max(blocks, 1) + self.example // BLOCK
        self.begin = np.searchsorted(cell, np.arange(len(terms) * max(blocks, 1) + 1))
        self.maxima = np.zeros((len(terms), blocks))
        np.maximum.at(self.maxima, (cols, self.example // BLOCK), self.weight)
        self.blocks = blocks
        self.slope, self.offset = 1.0, 0.0
        self._calibrate(vectors)

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights = (1 + np.log(counts)) * self.idf[terms]
        length = np.sqrt((weights ** 2).sum())
        return (terms, weights / length) if length > 0 else (terms[:0], weights[:0])

    def of_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = numbered(text, self.number, self.bases)
        terms = np.array(sorted(found), dtype=np.int64)
        return self.vector(terms, np.array([found[t] for t in terms], dtype=np.float64))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> list[tuple[float, int]]:
        """The ``k`` examples of greatest cosine above 0 as (cosine, example), exact; equal cosines by lower example number.

        The two blocks of greatest bound give a first k-th cosine; of the rest only blocks whose bound reaches it are read.
        """
        if not len(terms) or not self.blocks:
            return []
        bounds = weights @ self.maxima[terms]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        found = self._best([], terms, weights, order[:2], k, skip)
        # A margin for rounding: bounds and cosines are sums in different order.
        least = found[-1][0] - 1e-9 if len(found) == k else 0.0
        rest = order[2:]
        rest = rest[bounds[rest] >= least]
        return self._best(found, terms, weights, rest, k, skip) if len(rest) else found

    def _best(self, found: list, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray, k: int, skip: int) -> list[tuple[float, int]]:
        """The ``k`` best of ``found`` and the examples in ``blocks``."""
        scores = np.zeros(self.blocks * BLOCK)
        for t, w in zip(terms * self.blocks, weights):
            # Many blocks: the term's postings in one piece, those of other blocks are left out below.
            for a, b in ((t + i, t + i + 1) for i in blocks) if len(blocks) <= 4 else ((t, t + self.blocks),):
                a, b = self.begin[a], self.begin[b]
                if a < b:
                    scores[self.example[a:b]] += w * self.weight[a:b]
        if skip >= 0:
            scores[skip] = 0
        wanted = np.zeros(self.blocks, dtype=bool)
        wanted[blocks] = True
        rows = np.flatnonzero(scores > 0)
        rows = rows[wanted[rows // BLOCK]]
        if len(rows) > k:
            rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]
        merged = found + [(float(scores[i]), int(i)) for i in rows]
        return sorted(merged, key=lambda x: (-x[0], x[1]))[:k]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of toxic neighbours weighted by squared cosine, with the prior as one weak neighbour."""
        weight = np.array([c * c for c, _ in near])
        toxic = self.toxic[[e for _, e in near]] if near else np.zeros(0)
        return float((weight @ toxic + PRIOR_WEIGHT * self.prior) / (weight.sum() + PRIOR_WEIGHT))

    def _calibrate(self, vectors: list) -> None:
        """Logistic map of the votes' log odds, fitted to the examples left out, weighted to the true share of labels."""
        if not len(self.toxic) or self.toxic.min() == self.toxic.max():
            return
        votes = np.array([self.vote(self.nearest(*v, skip=i)) for i, v in enumerate(vectors)])
        n1, n0 = self.toxic.sum(), (1 - self.toxic).sum()
        weight = np.where(self.toxic > 0, self.prior / n1, (1 - self.prior) / n0) * len(votes)
        goal = np.where(self.toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # smoothed, so that separable votes stay finite
        x = _odds(votes)
        slope, offset = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
            g = np.array([((p - goal) * weight * x).sum() + 1e-3 * (slope - 1), ((p - goal) * weight).sum()])
            h = p * (1 - p) * weight
            hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
            step = np.clip(np.linalg.solve(hessian, g), -2, 2)
            slope, offset = slope - step[0], offset - step[1]
            if np.abs(step).max() < 1e-9:
                break
        if slope > 0:
            self.slope, self.offset = float(slope), float(offset)

    def score(self, near: list[tuple[float, int]]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * _odds(self.vote(near)) + self.offset, -30, 30))))


def _odds(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def examples(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES) -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) of at most ``per_label`` rows of each label, by hash of the id, and the share of toxic rows.

    Only rows of the training fold with a label count. A document labelled twice is toxic if one label says so;
    a repeated doc_id gives one example, and so do equal texts, lest copies make their words look telling.
    """
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training_fold())
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    present = materialize(known.join(docs.filter("text is not null").select("doc_id"), "doc_id", "left_semi"), "labelled")
    share = present.agg(F.avg("toxic")).first()[0]
    chosen = materialize(bounded_sample(present, "toxic", "doc_id", per_label), "chosen")
    # At most 2 * per_label ids, so the broadcast is bounded.
    texts = docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    once = texts.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return materialize(once.select("doc_id", "toxic", "text"), "examples"), float(share or 0.0)


def train(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES, most_terms: int = TERMS, min_odds: float = MIN_ODDS, support: int = SUPPORT) -> Index:
    """The index. Terms and examples are bounded by parameters; document frequencies count every document."""
    held, share = examples(docs, labels, per_label)
    sizes = {r[0]: r[1] for r in held.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    terms: list[str] = []
    if n1 and n0:
        counted = held.select("toxic", "text").mapInPandas(_term_sets, "term string, toxic int, texts bigint")
        a = F.sum(F.when(F.col("toxic") == 1, F.col("texts")).otherwise(0))
        b = F.sum(F.when(F.col("toxic") == 0, F.col("texts")).otherwise(0))
        by_term = counted.groupBy("term").agg(a.alias("a"), b.alias("b"))
        rest = (F.col("a") * (n0 - F.col("b")) - F.col("b") * (n1 - F.col("a"))).cast("double")
        seen = (F.col("a") + F.col("b")).cast("double")
        chi2 = rest * rest * (n1 + n0) / (seen * F.greatest(n1 + n0 - seen, F.lit(0.5)) * float(n1) * float(n0))
        odds = F.log((F.col("a") + 0.5) * (n0 - F.col("b") + 0.5) / ((F.col("b") + 0.5) * (n1 - F.col("a") + 0.5)))
        telling = by_term.filter((F.greatest("a", "b") >= support) & (F.abs(odds) >= float(np.log(min_odds))))
        # Should more than ``most_terms`` pass, those with most evidence (chi-square) stay.
        terms = [r[0] for r in telling.withColumn("chi2", chi2)
                 .orderBy(F.desc("chi2"), "term").limit(most_terms).select("term").collect()]
    number, bases = {t: i for i, t in enumerate(terms)}, bases_of(terms)

    def frequencies(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, texts = Counter(), 0
            for text in batch["text"]:
                texts += 1
                found.update(numbered(text, number, bases).keys())
            yield pd.DataFrame({"term": [-1, *found], "texts": [texts, *found.values()]})

    idf = np.zeros(len(terms))
    if terms:
        df = {r[0]: r[1] for r in docs.select("text").mapInPandas(frequencies, "term int, texts bigint").groupBy("term").agg(F.sum("texts")).collect()}
        idf = np.array([np.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) for i in range(len(terms))])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [numbered(t, number, bases) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [sorted(c) for c in found],
                                "counts": [[c[t] for t in sorted(c)] for c in found]})

    rows = held.mapInPandas(vectors, "doc_id bigint, toxic int, terms array<int>, counts array<int>").orderBy("doc_id").collect() if terms else []
    return Index(terms, idf, [tuple(r) for r in rows], share)


def scorer(docs: DataFrame, index: Index):
    """A function of a text column: score double, evidence array of (doc_id, cosine) of the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the parameters of the training

    @pandas_udf("score double, evidence array<struct<doc_id: bigint, cosine: double>>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for texts in batches:
            near = [known.nearest(*known.of_text(t)) for t in texts]
            yield pd.DataFrame({"score": [known.score(n) for n in near],
                                "evidence": [[{"doc_id": int(known.ids[e]), "cosine": c} for c, e in n] for n in near]})
    return score


def scored(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= threshold), evidence; every row, from its text alone.

    Texts without a known term, null and empty ones included, have no neighbour and get the calibrated prior.
    Without any label the prior is 0.
    """
    found = docs.select("doc_id", scorer(docs, index)(F.col("text")).alias("found"))
    return found.select("doc_id", "found.score", (F.col("found.score") >= threshold).cast("int").alias("predicted"), "found.evidence")


def accepted(score: Column, threshold: float = THRESHOLD) -> Column:
    return score["score"] < threshold
