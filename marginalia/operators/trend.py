"""Trends across evaluation runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


DEFAULT_K = 5


def with_deltas(runs: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Change of recall, mrr and ndcg against the previous run of the same series.

    NULL for the first run and when either side is missing. Runs are a small table: one row per report.
    """
    window = W.partitionBy(*(series or [])).orderBy("run_id")
    return runs.withColumns({f"delta_{m}": F.col(m) - F.lag(m).over(window) for m in ("recall", "mrr", "ndcg")})


def totals(runs: DataFrame) -> DataFrame:
    """Adds ``n_total``: positives plus negatives, NULL only when both are missing."""
    both = F.coalesce("n_positive", F.lit(0)) + F.coalesce("n_negative", F.lit(0))
    return runs.withColumn("n_total", F.when(
        F.col("n_positive").isNotNull() | F.col("n_negative").isNotNull(), both))


def metric_label(runs: DataFrame) -> DataFrame:
    """One row ``k``: that of the last run that has one, else five."""
    return runs.agg(F.coalesce(F.max_by("k", F.when(F.col("k").isNotNull(), F.col("run_id"))), F.lit(DEFAULT_K)).alias("k"))


def type_pivot(type_rows: DataFrame, run_ids: list[str] | None = None) -> DataFrame:
    """Question types down, runs across; each cell ``struct(recall, n)``, NULL when absent."""
    return (type_rows.groupBy("question_type").pivot("run_id", run_ids)
            .agg(F.first(F.struct("recall", "n"), ignorenulls=True)))
