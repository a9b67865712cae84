"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are linked if one becomes the other by at most one edit of a word (substituted, inserted or deleted), or by
none. A line's variants are the line itself and the line less any one word. Lines that share a variant less the word at
the same place differ in that word at most, and a line equal to another's variant lacks one of its words. Variants are
XORs of hashes of (word, place), scanned inside the row, so all variants of a line cost as much as reading it twice. Joining equal
variants needs no pairs: each key keeps its earliest line, and every line of the key is compared with that, word by word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import Scratch, materialize
from marginalia.llm.shared import BLANKS, membership_filter, possible_members

MIN_WORDS = 5
# Words whose prefixes are scanned together; longer lines are scanned by blocks.
SCAN = 64


def _plain(docs: DataFrame, *kept: str | Column) -> DataFrame:
    """``kept``, line_no (from 0), raw, line with blank runs as single spaces; a null text has one row, of nulls."""
    rows = docs.select(*kept, F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw"))
    raw = F.col("raw")
    uneven = raw.startswith(" ") | raw.endswith(" ")
    for blank in ("  ", "\t", "\x0b", "\f", "\r"):
        uneven = uneven | raw.contains(blank)
    return rows.withColumn("line", F.when(uneven, F.trim(F.regexp_replace("raw", BLANKS, " "))).otherwise(raw))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line with blank runs as single spaces. A null text has no line."""
    return _plain(docs, "doc_id").filter("line_no is not null").select("doc_id", "line_no", "line")


def _half_keys(min_words: int) -> Column:
    """Keys two lines one edit apart share: the first or last half, by the size of the shorter (or equal) line.

    If the edit lies in one half of the shorter line, the other half is whole in both. Only lines that share a half with
    another line can have a partner; the rest need no variants.
    """
    words, n = F.col("words"), F.size("words")

    def pair(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        return [F.xxhash64(F.lit("first"), size, F.slice(words, F.lit(1), half)), F.xxhash64(F.lit("last"), size, F.slice(words, n - (size - half) + 1, size - half))]
    return F.when(n >= min_words - 1, F.array(*pair(n), *pair(n - 1)))


def linked_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no, keep, one row per line.

    ``first_*`` is the earliest line (by doc_id, then line_no; null ids last) among the line itself and those linked to it directly;
    a line is kept if that is itself. One edit counts only where the longer line has ``min_words`` words or more, so
    one in five words may differ; shorter lines are compared as they are. Lines without words are layout and
    always kept. Rows that repeat a doc_id share its line numbers, and their equal lines are kept together.
    """
    every = split_lines(docs)
    return _with_first(every, _firsts(every, min_words)).drop("line")


def _with_first(lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """``lines`` with first_doc_id, first_line_no and keep."""
    keyed = lines.select("*", *[F.when(F.col("line") != "", k).alias(f"k{i}") for i, k in enumerate(_text_key(), 1)])
    own = F.col("first").isNull()
    out = keyed.join(firsts, ["k1", "k2"], "left").withColumn("first_doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")))
    out = out.withColumn("first_line_no", F.when(own, F.col("line_no")).otherwise(F.col("first.line_no"))).drop("k1", "k2", "first")
    return out.withColumn("keep", F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no")))


def _firsts(every: DataFrame, min_words: int) -> DataFrame:
    """k1, k2, first: the texts whose first place is not the place of their only line."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "line_no")
    lines = every.filter("line <> ''").select(*_text_key(), place.alias("place"), "line")
    with Scratch(every.sparkSession) as scratch:
        halved = lines.withColumn("words", F.split("line", " ")).select("k1", "k2", "place", _half_keys(min_words).alias("halves"))
        texts = scratch.write(halved.groupBy("k1", "k2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), F.first("halves").alias("halves")), "texts")
        better = _links(lines, texts, min_words, scratch)
        joined = texts.select("k1", "k2", "place", "copies").join(better, ["k1", "k2"], "left")
        # Only lines that repeat or have an earlier neighbour need a look-up; the rest are their own first.
        return materialize(joined.filter("copies > 1 or earliest is not null").select("k1", "k2", F.least("place", F.coalesce("earliest", "place")).alias("first")), "firsts")


def _text_key() -> list[Column]:
    """128 bits that stand for a line's text."""
    return [F.xxhash64(F.lit(1), "line").alias("k1"), F.xxhash64(F.lit(2), "line").alias("k2")]


def _links(lines: DataFrame, texts: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """k1, k2, earliest: the lines that have an earlier one a word edit away."""
    halves = texts.select("k1", "k2", F.explode("halves").alias("half"))
    # A text has each of its halves once, so a half seen twice belongs to two texts.
    shared = scratch.write(halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("half"), "halves")
    likely = possible_members(halves, F.col("half"), membership_filter(shared, "half"))
    wanted = scratch.write(likely.join(shared, "half").select("k1", "k2").distinct(), "wanted")
    near = possible_members(lines, F.col("k1"), membership_filter(wanted, "k1"))
    held = scratch.write(near.join(wanted, ["k1", "k2"]).groupBy("k1", "k2").agg(F.min("place").alias("place"), F.first("line").alias("line")), "candidates")
    pairs = _shared_variants(held, min_words, scratch)
    return scratch.write(_verified(pairs, held), "links")


def _running_xor(values: Column) -> Column:
    """Of an array of longs the XORs of what lies before each place, and of all of it: one entry more. By blocks, so that long arrays cost no square."""
    def scan(items: Column, last: Callable[[Column], Column]) -> Column:
        return F.aggregate(items, F.array(F.lit(0).cast("bigint")), lambda done, x: F.concat(done, F.array(F.element_at(done, -1).bitwiseXOR(last(x)))))
    starts = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / SCAN).cast("int"))
    blocks = F.transform(starts, lambda b: scan(F.slice(values, b * SCAN + 1, F.lit(SCAN)), lambda x: x))
    offsets = scan(blocks, lambda block: F.element_at(block, -1))
    # A block's last entry is the next one's first.
    inner = F.flatten(F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda block, o: F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda x: x.bitwiseXOR(o))))
    return F.concat(inner, F.array(F.element_at(offsets, -1)))


def _variants(lines: DataFrame, min_words: int) -> DataFrame:
    """``lines`` times their variants n, at, v: the number of words before one is left out, its place (-1 for none), what is left."""
    words = F.split("line", " ")
    # Words before the gap keep their places, those after it move up by one.
    rows = lines.withColumn("here", F.transform(words, lambda w, i: F.xxhash64(i, w))).withColumn("moved", F.transform(words, lambda w, i: F.xxhash64(i - 1, w)))
    rows = rows.withColumn("before", _running_xor(F.col("here"))).withColumn("passed", _running_xor(F.col("moved"))).withColumn("n", F.size("here"))
    all_moved = F.element_at("passed", -1)
    # What depends on the whole line stays outside of the functions of its words, which would compute it for each.
    gaps = F.zip_with(F.slice("before", F.lit(1), F.col("n")), F.slice("passed", F.lit(2), F.col("n")), lambda x, y: x.bitwiseXOR(y))
    whole = F.array(F.element_at("before", -1).bitwiseXOR(all_moved))
    out = rows.select(*lines.columns, F.col("n").alias("words"), all_moved.alias("all_moved"), F.posexplode(F.concat(gaps, whole)).alias("place_out", "left"))
    last = F.col("place_out") == F.col("words")
    return out.select(*lines.columns, (F.col("words") + last.cast("int")).alias("n"), F.when(last, -1).otherwise(F.col("place_out")).alias("at"),
                      F.col("left").bitwiseXOR(F.col("all_moved")).alias("v")).filter(F.col("n") >= min_words)


def _shared_variants(held: DataFrame, min_words: int, scratch: Scratch) -> DataFrame:
    """k1, k2, earliest: for each line the earliest lines that share one of its variants, unverified."""
    key = F.xxhash64("n", "v")
    few = held.coalesce(held.sparkSession.sparkContext.defaultParallelism) if held.rdd.getNumPartitions() > held.sparkSession.sparkContext.defaultParallelism else held
    # Written, as they cost more than to read them twice.
    variants = scratch.write(_variants(few.select("k1", "k2", "place", "line"), min_words).drop("line").withColumn("key", key), "all-variants")
    several = scratch.write(variants.groupBy("key").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).filter("low < high").select("key"), "shared-variants")
    likely = possible_members(variants, F.col("key"), membership_filter(several, "key"))
    kept = scratch.write(likely.join(several, "key").drop("key"), "variants")
    scratch.drop("all-variants")
    # The same place left out on both sides is a substitution; a whole line on one side, an insertion or deletion.
    cut, full = kept.filter("at >= 0"), kept.filter("at < 0")
    return (_with_earliest(cut, cut, ["n", "v", "at"]).unionByName(_with_earliest(cut, full, ["n", "v"])).unionByName(_with_earliest(full, cut, ["n", "v"]))).distinct()


def _with_earliest(lines: DataFrame, others: DataFrame, variant: list[str]) -> DataFrame:
    least = others.groupBy(*variant).agg(F.min("place").alias("earliest"))
    return lines.select("k1", "k2", "place", *variant).join(least, variant).filter(F.col("earliest") < F.col("place")).select("k1", "k2", "earliest")


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The earliest place per line among the pairs whose words are at most one edit apart."""
    a = F.split("line", " ")
    b = F.split("other", " ")
    joined = pairs.join(lines.select("k1", "k2", "line"), ["k1", "k2"]).join(lines.select(F.col("place").alias("earliest"), F.col("line").alias("other")), "earliest")
    sized = joined.select("k1", "k2", "earliest", F.when(F.size(a) >= F.size(b), a).otherwise(b).alias("long"), F.when(F.size(a) >= F.size(b), b).otherwise(a).alias("short"))
    differ = F.zip_with(F.slice("long", F.lit(1), F.size("short")), F.col("short"), lambda x, y: x != y)
    measured = sized.withColumn("differ", differ).withColumn("at", F.array_position("differ", True))
    same_size = F.size("long") == F.size("short")
    after = F.size("short") - F.col("at").cast("int") + 1
    one_more = (F.size("long") == F.size("short") + 1) & (
        (F.col("at") == 0) | (F.slice("long", F.col("at").cast("int") + 1, after) == F.slice("short", F.greatest(F.col("at").cast("int"), F.lit(1)), after)))
    right = F.when(same_size, F.size(F.filter("differ", lambda x: x)) <= 1).otherwise(one_more)
    return measured.filter(right).groupBy("k1", "k2").agg(F.min("earliest").alias("earliest"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text: each row's kept lines in order, as one text; '' if none is kept, null texts stay null.

    Rows that repeat an id are a row each, null ids too.
    """
    lines = _plain(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "row", "doc_id")
    placed = _with_first(lines, _firsts(split_lines(docs), min_words))
    # A null text has one row, without a line.
    texts = placed.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("line_no").alias("n"),
                                      F.array_sort(F.collect_list(F.when(F.col("keep") | (F.col("line") == ""), F.struct("line_no", "raw")))).alias("rows"))
    return texts.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.transform("rows", lambda r: r["raw"]), "\n")).alias("text"))
