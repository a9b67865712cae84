"""Ordered work on groups of any size.

A group (paper, thesis, conversation …) may hold a large share of the table, so nothing here
sorts or collects a whole group in one task. Rows carry a block number (``floor(position / size)``);
per-block sums form a table that is smaller by the block size, prefix sums run on that, and the
rest happens inside a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.session import cut_lineage

BLOCK = 512


def block_of(position: Column, size: int = BLOCK) -> Column:
    return F.floor(F.greatest(position, F.lit(0)) / F.lit(size)).cast("bigint")


def running_total(df: DataFrame, keys: list[str], order: list[str], block: str, value: Column,
                  out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the group (the row itself excluded).

    ``block`` must grow with ``order``: every row of a lower block precedes every row of a higher one.
    """
    valued = df.withColumn("_value", value.cast("bigint"))
    sums = valued.groupBy(*keys, block).agg(F.sum("_value").alias("_block_sum"))
    offsets = sums.select(*keys, block, F.coalesce(F.sum("_block_sum").over(
        W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    inside = F.coalesce(F.sum("_value").over(
        W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (valued.withColumn("_inside", inside).join(offsets, [*keys, block])
            .withColumn(out, F.col("_offset") + F.col("_inside"))
            .drop("_value", "_inside", "_offset"))


def row_numbers(df: DataFrame, keys: list[str], order: list[str], block: str, out: str) -> DataFrame:
    """0-based position of each row in its group."""
    return running_total(df, keys, order, block, F.lit(1), out)


def next_value(df: DataFrame, keys: list[str], order: str, block: str, value: str, out: str) -> DataFrame:
    """``value`` of the following row of the group, NULL for the last row."""
    firsts = df.groupBy(*keys, block).agg(F.min_by(value, order).alias("_first"))
    following = firsts.select(*keys, block, F.lead("_first").over(
        W.partitionBy(*keys).orderBy(block)).alias("_next_block"))
    inside = F.lead(value).over(W.partitionBy(*keys, block).orderBy(order))
    return (df.withColumn("_inside", inside).join(following, [*keys, block])
            .withColumn(out, F.coalesce("_inside", "_next_block")).drop("_inside", "_next_block"))


def global_row_number(df: DataFrame, order: list[Column], out: str = "row_number") -> DataFrame:
    """1-based number over a total order, without an unpartitioned window.

    Range partitions are sorted on their own and pinned by a checkpoint; each adds the row count of
    the partitions before it. ``order`` must be unique so that ranges split evenly.
    """
    pinned = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = pinned.select("*", F.spark_partition_id().alias("_part"),
                           F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition, so this window is bounded by the partition count.
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(
        W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return (placed.join(F.broadcast(starts), "_part")
            .withColumn(out, F.col("_start") + F.col("_pos") + 1).drop("_part", "_pos", "_start"))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", salts: int = 16,
                spread_by: list[str] | None = None) -> DataFrame:
    """Join a many-side with hot keys to a side unique on ``keys``.

    Each key of the many-side is spread over ``salts`` partitions by the hash of ``spread_by``;
    the unique side is repeated ``salts`` times. Spark still broadcasts ``one`` when it is small.
    """
    spread_cols = spread_by or [c for c in many.columns if c not in keys]
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*spread_cols), F.lit(salts)).cast("int"))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
