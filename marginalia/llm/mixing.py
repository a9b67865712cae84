"""Mixing sources to target weights by hash thresholds.

Every document has a fixed 60-bit hash. A source's mix is all its documents once, if the target allows, plus
those whose hash lies at or below the source's cut, once more. The cut comes from histograms: tokens are summed
by source and the top 12 hash bits, the running sum finds the one bucket in which the budget ends, only that
bucket is split on the next 12 bits, and only what then remains is summed by single hash. Documents
are never sorted, and a larger budget always keeps what a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.session import materialize
from marginalia.llm.shared import word_count

BITS = 12
HASH_BITS = 60
WEIGHTS = (3, 1, 2)


def document_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The first 60 bits of an MD5 over id and text. Rows equal in both share it and are taken together."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(totals: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): ``share`` of all tokens, split by weight.

    Weights repeat over the sources in code point order, null last. A target above ``most`` times its source's size is
    cut to it and the excess reshared by weight until none is above. With sources ordered by the ratio of
    cap to weight, those before the first that stays below its cap are full. One row per source: the windows run over
    the list of sources, never over documents. Empty sources get 0.
    """
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    capped = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    leveled = (capped
               .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
               .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
               .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.col("full")) / F.col("open"))
               .withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)["level"]))
    return leveled.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def _ends_in(sums: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The bucket of each source in which its rest ends, with the rest still to take inside it."""
    before = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return placed.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("tokens")))


def cuts(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source: target, whole copies of everything (``base``) and the ``cut`` hash up to which one more is taken.

    ``sized``: source, hash, size. ``wanted``: the result of :func:`targets`. A document at the cut is taken if
    at least half of it fits. ``cut`` is -1 if none is taken, and the largest hash if all are.
    """
    base = F.when(F.col("target") >= F.col("source_size"), F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = materialize(wanted.withColumn("base", F.when(F.col("source_size") > 0, base).otherwise(0).cast("int"))
                       .withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "goals")

    def join(left, right):
        named = right.withColumnRenamed("source", "goal_source")
        return left.join(named, left.source.eqNullSafe(named.goal_source)).drop("goal_source")

    first = sized.groupBy("source", F.shiftright("hash", HASH_BITS - BITS).alias("bucket")).agg(F.sum("size").alias("tokens"))
    one = materialize(_ends_in(join(first, goal.select("source", "rest")), ["source"], "bucket")
                      .select("source", F.col("bucket").alias("bucket_1"), (F.col("rest") - F.col("before")).alias("rest")), "boundary")
    inside = join(sized, one).filter(F.shiftright("hash", HASH_BITS - BITS) == F.col("bucket_1"))
    second = inside.groupBy("source", "rest", F.shiftright("hash", HASH_BITS - 2 * BITS).alias("bucket")).agg(F.sum("size").alias("tokens"))
    two = materialize(_ends_in(second, ["source"], "bucket")
                      .select("source", F.col("bucket").alias("bucket_2"), (F.col("rest") - F.col("before")).alias("rest")), "boundary")
    last = (join(sized, two).filter(F.shiftright("hash", HASH_BITS - 2 * BITS) == F.col("bucket_2"))
            .groupBy("source", "rest", "bucket_2", "hash").agg(F.sum("size").alias("tokens")))
    before = F.coalesce(F.sum("tokens").over(W.partitionBy("source").orderBy("hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # The last hash of which half fits; without one the cut lies just below the bucket.
    found = (last.withColumn("before", before)
             .groupBy("source", "bucket_2")
             .agg(F.max(F.when(F.col("before") + F.col("tokens") / 2 <= F.col("rest"), F.col("hash"))).alias("fits"))
             .select("source", F.coalesce("fits", F.shiftleft("bucket_2", HASH_BITS - 2 * BITS) - 1).alias("found")))
    named = found.withColumnRenamed("source", "found_source")
    none = F.when(F.col("rest") > 0, F.lit((1 << HASH_BITS) - 1)).otherwise(F.lit(-1)).cast("bigint")
    return goal.join(named, goal.source.eqNullSafe(named.found_source), "left").select(
        "source", "source_size", "target", "base", F.coalesce("found", none).alias("cut"))


def plan(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(sized documents: doc_id, source, size, hash; the cuts per source), both written.

    A null text has size 0, a null source is a source, an empty table gives empty tables, further columns are not read.
    """
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), document_hash().alias("hash")), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, materialize(cuts(sized, targets(totals, weights, share, most)), "cuts")


def _copies(hash_: Column) -> Column:
    return F.col("base") + (hash_ <= F.col("cut")).cast("int")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (tokens, repeats counted)."""
    sized, cut = plan(docs, weights, share, most)
    c = cut.withColumnRenamed("source", "cut_source")
    return sized.join(c, sized.source.eqNullSafe(c.cut_source)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("hash"))).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it is taken, with all its columns."""
    _, cut = plan(docs, weights, share, most)
    c = cut.select(F.struct("source", "base", "cut").alias("_mixing_cut"))
    joined = docs.join(c, F.col("source").eqNullSafe(F.col("_mixing_cut.source")))
    times = F.col("_mixing_cut.base") + (document_hash() <= F.col("_mixing_cut.cut")).cast("int")
    return joined.filter(times > 0).withColumn("_mixing_copy", F.explode(F.sequence(F.lit(1), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS hash
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
capped AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM totals),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM capped WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
wanted AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, cap / weight) FROM leveled WHERE level <= cap / weight)), cap) AS target
  FROM leveled),
goals AS (
  SELECT *, CASE WHEN source_size > 0 AND target >= source_size THEN floor(target / source_size) ELSE 0 END::INTEGER AS base FROM wanted),
grouped AS (SELECT source, hash, sum(size) AS tokens FROM sized GROUP BY source, hash),
placed AS (
  SELECT source, hash, tokens, coalesce(sum(tokens) OVER (PARTITION BY source ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM grouped)
SELECT s.doc_id, s.size, g.source_size, g.target,
       (s.size * (g.base + (p.before + p.tokens / 2 <= g.target - g.base * g.source_size)::INTEGER))::BIGINT AS taken
FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
JOIN placed p ON p.source IS NOT DISTINCT FROM s.source AND p.hash = s.hash
"""
