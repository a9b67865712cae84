"""Retrieval profiles composed into single plans over a table of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.functions import vocabulary as V
from marginalia.operators import fusion, lexical, vector
from marginalia.schemas import HIT_COLUMNS, chunk_id
from marginalia.session import materialize, of_few

# Lexical profile name -> arguments of the BM25 search; "count" is the occurrence score.
LEXICAL_PROFILES = {
    "bm25": {},
    "bm25-bilingual": {"bilingual": V.BILINGUAL_TERMS},
    "bm25-bilingual-neighbor": {"bilingual": V.BILINGUAL_TERMS, "neighbor_weight": V.NEIGHBOR_WEIGHT},
}


def lexical_search(chunks: DataFrame, queries: DataFrame, profile: str = "count", k: int = 20) -> DataFrame:
    """Top ``k`` chunks by one of the four lexical profiles."""
    if profile == "count":
        return lexical.count_search(chunks, queries, k)
    return lexical.bm25_search(chunks, queries, k, **LEXICAL_PROFILES[profile])


def as_hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Attach the hit columns to ``(query_id, rank, chunk_id, score, source)`` rows.

    The ranked rows are written first: Spark then knows how few they are and sends them to the texts, not the texts around. Only
    chunks of their papers are typed; rows ranked without ``paper_id`` meet all chunks.
    """
    held = ["query_id", "rank", "chunk_id", "score", "source"]
    ranked = materialize(ranked.select(*held, *[c for c in ["paper_id"] if c in ranked.columns]), "winners")
    if "paper_id" in ranked.columns:
        chunks, ranked = of_few(chunks, "paper_id", ranked.select("paper_id")), ranked.select(*held)
    payload = {"title": "string", "authors": "string", "year": "int", "page_number": "int", "chunk_type": "string"}
    table = chunks.select(chunk_id().alias("chunk_id"), "paper_id", "content",
                          *[F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c)
                            for c, t in payload.items()])
    return (ranked.join(table, "chunk_id")
            .select("query_id", "rank", *HIT_COLUMNS))


def hybrid_papers(queries: DataFrame, papers: DataFrame, vectors: DataFrame | None, top_k: int = 10,
                  filters: dict | None = None, use_keyword: bool = True, use_semantic: bool = True) -> DataFrame:
    """Library search. ``queries(query_id, text[, embedding])``; both lists take ``2*top_k`` hits and are
    fused by paper; with one flag the list is cut to ``top_k``; without vectors keyword only."""
    if use_semantic and vectors is not None:
        semantic = vector.vector_search(queries, vectors, 2 * top_k, filters).filter(F.col("rank") <= 2 * top_k)
    else:
        semantic = None
    keyword = lexical.keyword_search(papers, queries, 2 * top_k) if use_keyword else None
    if semantic is None and keyword is None:
        return queries.sparkSession.createDataFrame([], "query_id BIGINT, rank INT, chunk_id STRING")
    template = keyword if semantic is None else semantic
    empty = template.limit(0)
    semantic = empty if semantic is None else semantic.select(*template.columns)
    keyword = empty if keyword is None else keyword.select(*template.columns)
    if use_keyword and use_semantic:
        return fusion.rrf_papers(semantic, keyword, top_k).drop("rrf_score").withColumn("source", F.lit("hybrid"))
    return fusion.concatenate(semantic, keyword, top_k).select(*template.columns)


def retrieve(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, top_k: int = 5,
             lexical_profile: str = "count", retrieval_profile: str = "hybrid", scorer=None,
             semantic_rerank: bool | None = None) -> DataFrame:
    """Evaluation retriever: ``hybrid``, ``keyword-only`` or ``semantic-production``.

    Adds ``mode_used``, ``degraded`` and ``retrieval_error`` per row. Without vectors the hybrid
    profile degrades to keyword only and the semantic profile returns nothing.
    """
    degraded = vectors is None or retrieval_profile == "keyword-only"
    if retrieval_profile == "semantic-production":
        if vectors is None:
            hits = as_hits(lexical.count_search(chunks, queries, top_k), chunks).limit(0)
            return (hits.withColumn("mode_used", F.lit("semantic-production(degraded)"))
                    .withColumn("degraded", F.lit(True)).withColumn("retrieval_error", F.lit(None).cast("string")))
        hits = vector.vector_search(queries, vectors, 5)
        if semantic_rerank:
            hits = fusion.rerank(hits, queries, scorer, 5)
        else:
            hits = hits.filter(F.col("rank") <= 5).withColumn("rerank_error", F.lit(None).cast("string"))
        return (hits.withColumn("mode_used", F.lit("semantic-production"))
                .withColumn("degraded", F.col("rerank_error").isNotNull())
                .withColumnRenamed("rerank_error", "retrieval_error").drop("rerank_effective"))
    keyword = lexical_search(chunks, queries, lexical_profile, 2 * top_k)
    mode = "keyword-only(degraded)" if degraded else "hybrid"
    if degraded:
        hits = as_hits(keyword.filter(F.col("rank") <= top_k), chunks)
    else:
        semantic = vector.vector_search(queries, vectors, 2 * top_k).filter(F.col("rank") <= 2 * top_k)
        hits = fusion.rrf_chunks(semantic.select("query_id", "rank", *HIT_COLUMNS),
                                 as_hits(keyword, chunks), top_k, need_id=True).drop("rrf_score")
    return (hits.withColumn("mode_used", F.lit(mode)).withColumn("degraded", F.lit(degraded))
            .withColumn("retrieval_error", F.lit(None).cast("string")))


def suggest_citations(paragraphs: DataFrame, vectors: DataFrame | None = None, chunks: DataFrame | None = None,
                      top_k: int = 5) -> DataFrame:
    """Chunks to cite for each paragraph: the paragraphs are the query table."""
    if vectors is not None:
        return vector.vector_search(paragraphs, vectors, top_k).filter(F.col("rank") <= top_k)
    return lexical.bm25_search(chunks, paragraphs, top_k)
