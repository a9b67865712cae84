"""Sharding by extendible hashing.

A document belongs to the bucket named by the leading bits of its 64-bit hash. The directory starts as one bucket; only a
bucket over the byte limit is split, on its next bit, until every shard fits. Rounds of eight bits: the
still oversized buckets are summed into at most 256 cells each, a bucket's cells are split on their own (a bounded
group), and cells that are over the limit alone go to the next round. Bytes are summed before any shuffle, texts
are not moved.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import materialize

STEP = 8
BITS = 64


def shard_hash(doc_id: str = "doc_id", text: str = "text") -> Column:
    """64 bits over id and text; rows equal in both cannot be told apart and are counted out one by one instead."""
    return F.xxhash64(F.col(doc_id).cast("string"), F.col(text))


def _prefix(hash_: Column, depth: int) -> Column:
    """The leading ``depth`` bits as a number; the whole hash at 64."""
    return F.shiftrightunsigned(hash_, BITS - depth)


def _split(limit: int, depth: int):
    """Splits one open bucket: its cells of STEP further bits to (bits, depth, bytes, rows, open)."""
    def split(cells: pd.DataFrame) -> pd.DataFrame:
        low = (cells["cell"].to_numpy() & ((1 << STEP) - 1)).tolist()
        held = {c: (int(b), int(r)) for c, b, r in zip(low, cells["bytes"], cells["rows"])}
        prefix = format(int(cells["bucket"].iloc[0]) & ((1 << depth) - 1), f"0{depth}b") if depth else ""
        out, todo = [], [(0, 0)]
        while todo:
            bits, more = todo.pop()
            low_cell, width = bits << (STEP - more), 1 << (STEP - more)
            inside = [held[c] for c in range(low_cell, low_cell + width) if c in held]
            size, rows = sum(b for b, _ in inside), sum(r for _, r in inside)
            if not rows:
                continue
            if size <= limit or more == STEP:
                name = prefix + (format(bits, f"0{more}b") if more else "")
                out.append((name, depth + more, size, rows, size > limit))
            else:
                todo += [(bits << 1, more + 1), (bits << 1 | 1, more + 1)]
        return pd.DataFrame(out, columns=["shard", "depth", "shard_bytes", "shard_docs", "open"])
    return split


def directory(cells: DataFrame, limit: int) -> DataFrame:
    """(hash, bytes, rows) summed by hash to the directory: shard, depth, shard_bytes, shard_docs.

    ``shard`` is the bit prefix as text, '' if one shard holds everything. A shard of depth 64 may exceed
    the limit: it is one document longer than the limit, or rows equal in id and text; see :func:`assign`.
    """
    spark, done, depth, left = cells.sparkSession, [], 0, cells
    schema = "shard string, depth int, shard_bytes bigint, shard_docs bigint, open boolean"
    while True:
        bucket = _prefix(F.col("hash"), depth) if depth else F.lit(0).cast("bigint")
        summed = (left.groupBy(bucket.alias("bucket"), _prefix(F.col("hash"), depth + STEP).alias("cell"))
                  .agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")))
        found = materialize(summed.groupBy("bucket").applyInPandas(_split(limit, depth), schema), "directory")
        depth += STEP
        last = depth == BITS
        done.append(found.filter(F.lit(True) if last else ~F.col("open")).drop("open"))
        still = found.filter("open")
        if last or still.isEmpty():
            break
        names = still.select(F.col("shard").alias("open_shard"))
        left = left.withColumn("open_shard", F.substring(_bit_text(F.col("hash")), 1, depth)).join(names, "open_shard").drop("open_shard")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return materialize(out, "directory")


def _bit_text(hash_: Column) -> Column:
    return F.lpad(F.conv(F.hex(hash_), 16, 2), BITS, "0")


def assign(docs: DataFrame, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, bytes (of the text in UTF-8), shard, part, depth, shard_bytes, shard_docs.

    ``part`` is 0 unless a 64-bit bucket is still too large: rows equal in id and text then fill parts one after
    another, as many per part as fit (one at least, so a document longer than the limit has a shard to itself).
    ``shard_bytes`` and ``shard_docs`` are those of the part. A null text has 0 bytes; a null id is hashed like any
    value; an empty table gives no shard; further columns are not read.
    """
    rows = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"),
                                   shard_hash(doc_id, text).alias("hash")), "hashed")
    cells = rows.groupBy("hash").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    found = directory(cells, limit)
    depths = [r[0] for r in found.select("depth").distinct().collect()]  # 64 values at most
    bits = _bit_text(F.col("hash"))
    # The directory is prefix-free: of a row's prefixes at the depths in use exactly one names a shard.
    prefixes = F.array(*[F.substring(bits, 1, d) if d else F.lit("") for d in sorted(depths) or [0]])
    placed = rows.withColumn("shard", F.explode(prefixes)).join(found, "shard")
    whole = placed.filter((F.col("depth") < BITS) | (F.col("shard_bytes") <= limit)).select(
        "doc_id", "bytes", "shard", F.lit(0).cast("bigint").alias("part"), "depth", "shard_bytes", "shard_docs")
    over = placed.filter((F.col("depth") == BITS) & (F.col("shard_bytes") > limit))
    # Equal rows are counted, not gathered, and written out again part by part.
    same = over.groupBy("doc_id", "bytes", "shard", "depth").agg(F.count(F.lit(1)).alias("n"))
    room = F.greatest(F.floor(F.lit(limit) / F.greatest("bytes", F.lit(1))), F.lit(1))
    parted = (same.withColumn("room", room).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
              .withColumn("part", F.floor(F.col("i") / F.col("room")))
              .withColumn("shard_docs", F.least("room", F.col("n") - F.col("part") * F.col("room")))
              .select("doc_id", "bytes", "shard", "part", "depth", (F.col("shard_docs") * F.col("bytes")).alias("shard_bytes"), "shard_docs"))
    return whole.unionByName(parted)

