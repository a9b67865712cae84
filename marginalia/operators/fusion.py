"""Reciprocal-rank fusion and reranking of hit lists keyed by query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from marginalia.functions import vocabulary as V


def _fuse(first: DataFrame, second: DataFrame, key: Column, k: int, top_k: int) -> DataFrame:
    both = (first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1)))
            .withColumn("_key", key).filter(F.col("_key").isNotNull()))
    payload = [c for c in first.columns if c not in ("query_id", "rank")]
    seen = F.struct("_list", "rank")
    fused = both.groupBy("query_id", "_key").agg(
        F.sum(F.lit(1.0) / (F.lit(float(k)) + F.col("rank"))).alias("rrf_score"),
        F.min(seen).alias("_seen"), F.min_by(F.struct(*payload), seen).alias("_hit"))
    window = W.partitionBy("query_id").orderBy(F.round("rrf_score", 12).desc(), F.col("_seen").asc())
    return (fused.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_k)
            .select("query_id", "rank", "rrf_score", "_hit.*"))


def rrf_papers(semantic: DataFrame, keyword: DataFrame, top_k: int = 10, k: int = V.RRF_K) -> DataFrame:
    """Paper-level fusion. A paper that appears several times in a list adds each time; the
    first-seen hit (semantic before keyword) supplies the columns and decides ties."""
    return _fuse(semantic, keyword, F.col("paper_id"), k, top_k)


def rrf_chunks(first: DataFrame, second: DataFrame, top_k: int = 5, k: int = V.RRF_K,
               need_id: bool = False) -> DataFrame:
    """Chunk-level fusion on ``chunk_id``; hits without one use (paper, page, content),
    or are left out with ``need_id``."""
    fallback = F.to_json(F.struct("paper_id", "page_number", "content"),
                         {"ignoreNullFields": "false"})
    key = F.col("chunk_id") if need_id else F.coalesce("chunk_id", fallback)
    return _fuse(first, second, key, k, top_k)


def concatenate(semantic: DataFrame, keyword: DataFrame, top_k: int) -> DataFrame:
    """Both lists one after the other, cut to ``top_k`` per query."""
    both = semantic.withColumn("_list", F.lit(0)).unionByName(keyword.withColumn("_list", F.lit(1)))
    window = W.partitionBy("query_id").orderBy("_list", "rank")
    return (both.withColumn("_new", F.row_number().over(window)).filter(F.col("_new") <= top_k)
            .drop("rank", "_list").withColumnRenamed("_new", "rank"))


def rerank(hits: DataFrame, queries: DataFrame, scorer, top_k: int | None = None,
           pool: int = V.RERANK_POOL) -> DataFrame:
    """Rescore the first ``pool`` hits of each query; later hits follow in their old order.

    ``scorer(list[(query, passage)]) -> list[float]`` runs inside the workers on one pool at a
    time. If it is missing, raises, or returns a wrong count, that query keeps its order and
    ``rerank_error`` says why. Adds ``rerank_effective`` and ``rerank_error``.
    """
    kept = [c for c in hits.columns]
    if scorer is None:
        out = hits.withColumn("rerank_error", F.lit("model_unavailable"))
    else:
        head = hits.filter(F.col("rank") <= pool).join(
            queries.select("query_id", F.col("text").alias("_query")), "query_id")
        schema = T.StructType([hits.schema["query_id"], T.StructField("rank", T.IntegerType()),
                               T.StructField("_new", T.IntegerType()), T.StructField("rerank_error", T.StringType())])

        def one_pool(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rank")
            error, order = None, list(range(len(pdf)))
            try:
                scores = [float(s) for s in scorer(list(zip(pdf["_query"], pdf["content"])))]
                if len(scores) == len(pdf):
                    order = sorted(order, key=lambda i: -scores[i])
                else:
                    error = "score_count_mismatch"
            except Exception:
                error = "scoring_failed"
            place = {row: new for new, row in enumerate(order, start=1)}
            return pd.DataFrame({"query_id": pdf["query_id"], "rank": pdf["rank"].astype("int32"),
                                 "_new": [place[i] for i in range(len(pdf))], "rerank_error": error})

        moved = (head.select("query_id", "rank", "_query", "content")
                 .groupBy("query_id").applyInPandas(one_pool, schema))
        status = moved.groupBy("query_id").agg(F.max("rerank_error").alias("rerank_error"))
        out = (hits.join(moved.drop("rerank_error"), ["query_id", "rank"], "left")
               .join(status, "query_id", "left")
               .withColumn("rank", F.coalesce("_new", "rank")).drop("_new"))
    out = out.withColumn("rerank_effective", F.col("rerank_error").isNull())
    if top_k is not None:
        out = out.filter(F.col("rank") <= top_k)
    return out.select(*kept, "rerank_effective", "rerank_error")
