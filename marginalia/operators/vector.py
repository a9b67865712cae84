"""Exact cosine top-k of a query table against a vector table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.schemas import all_of
from marginalia.session import bounded_rows, materialize

# Rows per block of the products.
QUERY_BLOCK = 2048
VECTOR_BLOCK = 65536
# Most values (rows x dimension) a task holds of one side, and most scores it holds at once: 32 MB each as doubles.
HELD_VALUES = 4_000_000
HELD_SCORES = 4_000_000
# Most query values (rows x dimension) sent to every executor: 8 M floats, 32 MB.
BROADCAST_VALUES = 8_000_000

_PART = "query_id {q}, vector_id {v}, score DOUBLE"


def metadata_filter(filters: dict | None) -> Column:
    """AND of ``year_gte``, ``year_lte`` and ``paper_id``; other keys are ignored."""
    filters = filters or {}
    tests = []
    if "year_gte" in filters:
        tests.append(F.col("year") >= filters["year_gte"])
    if "year_lte" in filters:
        tests.append(F.col("year") <= filters["year_lte"])
    if "paper_id" in filters:
        tests.append(F.col("paper_id") == filters["paper_id"])
    return all_of(tests)


def _unit(rows) -> np.ndarray:
    matrix = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    length[length == 0] = 1.0
    return matrix / length


def _best(query_ids, queries: np.ndarray, vector_ids: np.ndarray, vectors: np.ndarray, k: int, query_block: int = QUERY_BLOCK) -> Iterator[pd.DataFrame]:
    """Best ``k`` vectors of this block for each query, ties by id; the scores of a slice of the queries are held at a time."""
    order = np.argsort(vector_ids, kind="stable")
    ids, vectors = vector_ids[order], vectors[order]
    keep = min(k, len(ids))
    step = max(1, min(query_block, HELD_SCORES // max(len(ids), 1)))
    for at in range(0, len(queries), step):
        scores = queries[at:at + step] @ vectors.T
        np.round(scores, 9, out=scores)
        if keep < len(ids):
            # Everything at or above the k-th score, so that ties at the cut are resolved by id.
            cut = np.partition(scores, len(ids) - keep, axis=1)[:, len(ids) - keep]
        else:
            cut = np.full(len(scores), -np.inf)
        out_q, out_v, out_s = [], [], []
        for i, row in enumerate(scores):
            cand = np.flatnonzero(row >= cut[i])
            cand = cand[np.argsort(-row[cand], kind="stable")][:keep]
            out_q.extend([query_ids[at + i]] * len(cand))
            out_v.append(ids[cand])
            out_s.append(row[cand])
        yield pd.DataFrame({"query_id": out_q, "vector_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def _blocks(batches: Iterator[pd.DataFrame], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of several batches together, about ``block`` rows or HELD_VALUES values."""
    ids, units, held = [], [], 0
    for pdf in batches:
        dim = max(len(pdf["embedding"].iloc[0]), 1) if len(pdf) else 1
        step = max(1, min(block, HELD_VALUES // dim))
        for at in range(0, len(pdf), step):
            part = pdf.iloc[at:at + step]
            if held and held + len(part) > step:
                yield np.concatenate(ids), np.concatenate(units)
                ids, units, held = [], [], 0
            ids.append(part["vector_id"].to_numpy())
            units.append(_unit(part["embedding"]))
            held += len(part)
    if held:
        yield np.concatenate(ids), np.concatenate(units)


def _cells(rows: tuple[int, int], blocks: tuple[int, int], dim: int, cores: int) -> tuple[int, int]:
    """Parts of either side: enough that two cells meet a core if there are blocks for that, more where a part would exceed
    VECTOR_BLOCK rows or HELD_VALUES."""
    most = max(1, min(VECTOR_BLOCK, HELD_VALUES // dim))
    side = math.ceil(math.sqrt(2 * cores))
    nq, nv = (max(1, math.ceil(n / most), min(math.ceil(n / block), side)) for n, block in zip(rows, blocks))
    return nq, nv


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, broadcast_values: int = BROADCAST_VALUES,
                 query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """``query_id, rank, vector_id, score`` for ``queries(query_id, embedding)`` and
    ``vectors(vector_id, embedding)``; score is the cosine, rounded to 9 digits.

    Each task multiplies blocks and emits at most ``k`` rows per query and block of vectors; a window merges them.
    A query table within ``broadcast_values`` is sent to the executors and the vectors are scanned
    where they lie, without a shuffle. A larger one is laid out as a grid, each cell one task of bounded size. A cell holds many
    blocks of either side, as each side is copied once per cell it meets; products are bounded in queries and scores.
    """
    types = {"q": queries.schema["query_id"].dataType.simpleString(),
             "v": vectors.schema["vector_id"].dataType.simpleString()}
    schema = _PART.format(**types)
    queries = queries.select("query_id", "embedding")
    vectors = vectors.select("vector_id", "embedding")
    first = queries.select(F.size("embedding").alias("d")).take(1)
    dim = max(first[0]["d"], 1) if first else 1
    n_queries = bounded_rows(queries, max(broadcast_values // dim, 1))
    if n_queries is not None:
        local = queries.toPandas()
        shared = queries.sparkSession.sparkContext.broadcast(
            (local["query_id"].tolist(), _unit(local["embedding"]) if len(local) else None))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            if matrix is not None:
                for vector_ids, units in _blocks(batches, vector_block):
                    yield from _best(ids, matrix, vector_ids, units, k, query_block)

        parts = vectors.mapInPandas(scan, schema)
    else:
        nq, nv = _cells((queries.count(), vectors.count()), (query_block, vector_block), dim, queries.sparkSession.sparkContext.defaultParallelism)

        def grid(df, own, other, n_own, n_other):
            key = df.columns[0]
            return (df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int"))
                    .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "vector_id": [], "score": []})
            return pd.concat(_best(left["query_id"].tolist(), _unit(left["embedding"]),
                                   right["vector_id"].to_numpy(), _unit(right["embedding"]), k, query_block))

        tasks = nq * nv  # one cell each
        parts = (grid(queries, "qb", "vb", nq, nv).repartition(tasks, "qb", "vb").groupBy("qb", "vb")
                 .cogroup(grid(vectors, "vb", "qb", nv, nq).repartition(tasks, "qb", "vb").groupBy("qb", "vb"))
                 .applyInPandas(cell, schema))
    window = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_id").asc())
    return (parts.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vector_id", "score"))


def vector_search(queries: DataFrame, vectors: DataFrame, top_k: int = 10, filters: dict | None = None,
                  **layout) -> DataFrame:
    """Semantic hits for ``queries(query_id, embedding)`` over a chunk-vector table.

    The metadata predicate runs before any similarity. Over-fetches ``max(2k, 20)`` for the
    reranker; callers cut with ``rank <= top_k``.
    """
    pool = vectors.filter(metadata_filter(filters))
    fetch = max(2 * top_k, 20)
    ranked = vector_top_k(queries, pool.select(F.col("chunk_id").alias("vector_id"), "embedding"), fetch, **layout)
    ranked = materialize(ranked, "winners")  # few rows of known size, joined to the texts last
    return (ranked.join(pool.drop("embedding"), ranked.vector_id == pool.chunk_id)
            .select("query_id", "rank", "chunk_id", "paper_id", "title", "authors", "year",
                    F.col("document").alias("content"), "page_number", "chunk_type", "score",
                    F.lit("semantic").alias("source")))


def lsh_top_k(queries: DataFrame, vectors: DataFrame, k: int, bucket_length: float = 0.5,
              tables: int = 8, threshold: float = 1.2, seed: int = 7) -> DataFrame:
    """Approximate alternative: random-projection LSH, opt-in, recall below one."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    def prepared(df, key):
        return df.select(F.col(key).alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))

    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket_length,
                                        numHashTables=tables, seed=seed).fit(prepared(vectors, "vector_id"))
    pairs = model.approxSimilarityJoin(prepared(queries, "query_id"), prepared(vectors, "vector_id"),
                                       threshold, "distance")
    window = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_id").asc())
    return (pairs.select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("vector_id"),
                         F.round(1 - F.col("distance") * F.col("distance") / 2, 9).alias("score"))
            .withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k))
