"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of maximal runs of non-blank characters; 0 for a null text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def training_fold(doc_id: str = "doc_id") -> Column:
    """True for rows whose labels may be learned from: crc32 of the id as text is not 1 modulo 3. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def bounded_sample(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each ``group``, those with the smallest hash of ``key``.

    Groups are counted first, and a threshold on the hash leaves about twice ``most`` rows of each before they are
    ranked, so no task gathers a group of any size. Should hashes be so uneven that fewer pass, the sample is smaller.
    """
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_group_rows")).withColumnRenamed(group, "_group")
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    near = rows.join(counts, F.col(group).eqNullSafe(F.col("_group"))).filter(unit * F.col("_group_rows") <= 2 * most + 100).drop("_group", "_group_rows")
    place = F.row_number().over(W.partitionBy(group).orderBy(unit, key))
    return near.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is in ``ids``; rows with a null key stay.

    The id list is written first, so Spark knows its size when it chooses between a broadcast and a shuffle.
    """
    return docs.join(materialize(ids.select(key).distinct(), "ids"), key, "left_anti")


# Bits of a membership filter: 4 MB in all, whatever it stands for.
FILTER_BITS = 1 << 25
_FILTER_ROW = 1 << 15


def membership_filter(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap of the 64-bit hashes in column ``key``, in rows of 4096 bytes; at most FILTER_BITS / 8 bytes."""
    place = F.pmod(F.col(key), F.lit(FILTER_BITS))
    return keys.groupBy(F.floor(place / _FILTER_ROW).cast("int").alias("filter_row")).agg(
        F.bitmap_construct_agg((place % _FILTER_ROW).cast("bigint")).alias("filter_bits"))


def possible_members(rows: DataFrame, key: Column, found: DataFrame) -> DataFrame:
    """The rows whose hash may be in the filter: all members, and some others. Spares a shuffle of rows that cannot join.

    What follows must be an inner join: Spark moves a semi-join below this one, and then shuffles every row.
    """
    place = F.pmod(key, F.lit(FILTER_BITS))
    inside = (place % _FILTER_ROW).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("filter_bits"), F.floor(inside / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = rows.join(F.broadcast(found), F.floor(place / _FILTER_ROW).cast("int") == F.col("filter_row"))
    return joined.filter(F.getbit(byte, inside % 8) == 1).drop("filter_row", "filter_bits")


def heavy_threshold(rows: DataFrame, count: str, most: int) -> int:
    """The least number such that at most ``most`` rows have that count or more. Reads the distribution only: some 4 000 rows."""
    exact = 1 << 12
    step = F.when(F.col(count) < exact, F.col(count)).otherwise(F.expr(f"shiftleft(1L, length(bin({count})) - 1)"))
    sizes = sorted(rows.groupBy(step.cast("bigint").alias("least")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    held, least = 0, (sizes[0][0] * 2 if sizes else 0)
    for at, n in sizes:
        held += n
        if held > most:
            break
        least = at
    return least
