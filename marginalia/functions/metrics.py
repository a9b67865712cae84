"""Retrieval and citation metrics as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from marginalia.functions import text as X, vocabulary as V


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(0.0)


def recall_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Share of distinct relevant ids in the first ``k`` positions (cut first, then distinct)."""
    if k <= 0:
        return F.lit(0.0)
    relevant = F.array_distinct(relevant)
    return _ratio(F.size(F.array_intersect(F.slice(retrieved, 1, k), relevant)), F.size(relevant))


def reciprocal_rank(retrieved: Column, relevant: Column) -> Column:
    """1 / rank of the first relevant id, without a cut-off."""
    ranks = F.filter(F.transform(retrieved, lambda r, i: F.when(F.array_contains(relevant, r), i + 1)),
                     lambda i: i.isNotNull())
    return F.coalesce(F.lit(1.0) / F.array_min(ranks), F.lit(0.0))


def ndcg_at_k(retrieved: Column, relevant: Column, k: int) -> Column:
    """Binary NDCG; repeated ids are removed before the cut."""
    if k <= 0:
        return F.lit(0.0)
    gain = lambda position: F.lit(1.0) / F.log2(position.cast("double") + 2.0)
    total = lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    shown = F.slice(F.array_distinct(retrieved), 1, k)
    dcg = total(F.transform(shown, lambda r, i: F.when(F.array_contains(relevant, r), gain(i)).otherwise(0.0)))
    ideal_length = F.least(F.size(F.array_distinct(relevant)), F.lit(k))
    ideal = total(F.transform(F.sequence(F.lit(0), F.greatest(ideal_length - 1, F.lit(0))), gain))
    return F.when(ideal_length > 0, dcg / ideal).otherwise(0.0)


def share_found(found: Column, relevant: Column, k: int) -> Column:
    """Recall from the number of relevant ids found in the first ``k`` places and the number of all; 0 without any."""
    return F.when((relevant > 0) & F.lit(k > 0), F.coalesce(found, F.lit(0)).cast("double") / relevant).otherwise(0.0)


def gain_share(dcg: Column, relevant: Column, k: int) -> Column:
    """NDCG from the discounted gain of the first ``k`` places and the number of relevant ids; 0 without any."""
    if k <= 0:
        return F.lit(0.0)
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(relevant.cast("int"), F.lit(k)), F.lit(1))), F.lit(0.0),
                        lambda total, place: total + F.lit(1.0) / F.log2(place + 1.0))
    return F.when(relevant > 0, F.coalesce(dcg, F.lit(0.0)) / ideal).otherwise(0.0)


def citation_scores(cited: Column, relevant: Column) -> Column:
    """``struct(precision, recall, f1, coverage)`` on sets; coverage equals recall."""
    c, r = F.array_distinct(cited), F.array_distinct(relevant)
    hits = F.size(F.array_intersect(c, r))
    p, q = _ratio(hits, F.size(c)), _ratio(hits, F.size(r))
    return F.struct(p.alias("precision"), q.alias("recall"),
                    F.when(p + q > 0, F.lit(2.0) * p * q / (p + q)).otherwise(0.0).alias("f1"), q.alias("coverage"))


def key_points(reference: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(reference, F.lit("")), V.KEYPOINT_SEPARATORS), lambda p: X.strip(p))
    return F.filter(parts, lambda p: F.length(p) > 0)


def keyword_hit_rate(answer: Column, reference: Column) -> Column:
    """Share of the key points of the reference answer that occur in the answer."""
    points, lowered = key_points(reference), F.lower(F.coalesce(answer, F.lit("")))
    hits = F.size(F.filter(points, lambda p: F.contains(lowered, F.lower(p))))
    return F.when(F.length(lowered) > 0, _ratio(hits, F.size(points))).otherwise(0.0)
