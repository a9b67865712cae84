"""Writers: CSV export, citation lists, dataset assembly, reports, staged publication."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import vocabulary as V
from marginalia.operators import evaluate as E, library as L
from marginalia.operators.audit import vector_validation
from marginalia.operators.vector import vector_top_k


def write_csv(papers: DataFrame, paper_tags: DataFrame, tags: DataFrame, path: str) -> None:
    """Ten fixed columns, newest paper first across the part files, UTF-8."""
    rows = L.export_rows(papers, paper_tags, tags)
    ordered = rows.orderBy(F.col("created_at").desc(), F.col("id").cast("bigint").desc())
    (ordered.toDF(*[label for _, label in V.EXPORT_COLUMNS])
     .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))


def write_citations(papers: DataFrame, path: str, style: str = "GB/T 7714") -> None:
    L.citation_list(papers, style).orderBy("row_number").select("line").write.mode("overwrite").text(path)


def assemble_dataset(spark: SparkSession, inputs: list[str], output: str, min_items: int = 50,
                     min_papers: int = 12) -> DataFrame:
    """Merge reviewed QA files, validate them, write them ordered by ``qa_id``; nothing is written when
    validation fails. Returns the counts per split."""
    from marginalia.sources.evaluation import load_dataset
    items = load_dataset(spark, inputs)
    E.raise_if_any(E.dataset_violations(items), "dataset")
    E.raise_if_any(E.benchmark_violations(items, min_items, min_papers), "benchmark")
    items.sort("qa_id").write.mode("errorifexists").json(output)
    return E.benchmark_counts(items)


def write_report(root: str, run_id: str, items: DataFrame, overall: DataFrame, by_type: DataFrame,
                 latency: DataFrame | None = None, fingerprints: DataFrame | None = None) -> None:
    """One folder per part below ``root``; rows carry ``run_id``, so folders can be read as tables."""
    parts = {"items": items, "overall": overall, "by_type": by_type, "latency": latency, "fingerprints": fingerprints}
    for name, df in parts.items():
        if df is not None:
            (df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").partitionBy("run_id")
             .option("partitionOverwriteMode", "dynamic").parquet(os.path.join(root, name)))


# Staged publication --------------------------------------------------------------------------

def stage_table(df: DataFrame, root: str) -> str:
    """Write a new version next to the old ones; readers do not see it yet."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(os.path.join(root, "versions", version))
    return version


def publish_table(spark: SparkSession, root: str, version: str) -> None:
    """Point readers at ``version``: one appended row; older versions stay readable."""
    pointer = os.path.join(root, "pointer")
    try:
        last = spark.read.parquet(pointer).agg(F.max("seq")).first()[0] or 0
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        last = 0
    spark.createDataFrame([(last + 1, version)], "seq BIGINT, version STRING").coalesce(1).write.mode("append").parquet(pointer)


def publish_vectors(vectors: DataFrame, chunks: DataFrame, root: str, dimension: int, smoke: list[float]) -> str:
    """Stage a vector table, validate what was written, then publish it; returns the version.

    The ids must be those of ``chunks``, each once, all vectors must have ``dimension`` values, and a search for ``smoke`` must
    find something. Otherwise an error lists the problems and readers keep the version they have.
    """
    spark = vectors.sparkSession
    version = stage_table(vectors, root)
    staged = spark.read.parquet(os.path.join(root, "versions", version))
    E.raise_if_any(vector_validation(staged, chunks, dimension), "vector table")
    query = spark.createDataFrame([(0, smoke)], "query_id BIGINT, embedding ARRAY<FLOAT>")
    found = vector_top_k(query, staged.select(F.col("chunk_id").alias("vector_id"), "embedding"), 1)
    if not staged.isEmpty() and found.isEmpty():
        raise E.InvalidData("vector table is invalid: the smoke query found nothing", found)
    publish_table(spark, root, version)
    return version


def read_published(spark: SparkSession, root: str) -> DataFrame:
    version = spark.read.parquet(os.path.join(root, "pointer")).agg(F.max_by("version", "seq")).first()[0]
    return spark.read.parquet(os.path.join(root, "versions", version))
