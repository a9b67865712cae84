"""Benchmark decontamination by spaced-seed hashing.

A mask such as ``1110111`` hashes the tokens under its ones and ignores those under its zeros, so a substituted token under a
zero does not hide a match. The hashes of every position of the test items are joined with those of every position
of the documents. A hit fixes a diagonal (document position minus item position); the token pairs along it
around the hit are compared one by one, and a window with enough equal pairs is an overlap. A hit carries the tokens that such
windows can hold, never the document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import materialize, release

WINDOW = 13
SIMILARITY = 0.8
# The masks of each width. Wherever the substitutions lie that SIMILARITY admits in a window of that width, some mask fits beside them.
_LONG = ("1110111", "110101101", "1100101011")
MASKS_OF = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "10111", "11011", "11101"),
    6: ("11111", "101111", "110111", "111011", "111101"),
    7: ("11111", "110111", "111011"),
    8: ("111111", "1101111", "1111011"),
    9: ("1111111", "11011111", "11110111", "11111011"),
    10: _LONG + ("11111001", "1010010111", "11001111"),
    11: _LONG + ("1111001111", "10011111011", "1111100111"),
    12: _LONG + ("111110011111", "111111001111"),
    13: _LONG + ("1111110011111",),
}
MASKS = tuple(sorted({m for masks in MASKS_OF.values() for m in masks}))
# Items of up to four tokens are found verbatim, wherever a text holds them.
SHORTEST = min(MASKS_OF)
# Seeds, item tokens: what one broadcast block may hold (about 100 bytes each, so some 20 MB).
BLOCK_ROWS = 200_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seed(words: str, at: Column, number: int, mask: str) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(F.col(words), at + i) for i, bit in enumerate(mask) if bit == "1"])


def _width() -> Column:
    return F.least(F.lit(WINDOW), F.size("item_tokens"))


def seeds(items: DataFrame) -> DataFrame:
    """(item_id, item_tokens) to key, item_id, item_at, span: one row per position that fits and mask of the item's width."""
    size = F.size("item_tokens")
    parts = []
    for number, mask in enumerate(MASKS):
        widths = [w for w, masks in MASKS_OF.items() if mask in masks]
        at = items.filter(_width().isin(widths)).select("item_id", "item_tokens", F.explode(F.sequence(F.lit(0), size - len(mask))).alias("item_at"))
        parts.append(at.select(_seed("item_tokens", F.col("item_at"), number, mask).alias("key"), "item_id", "item_at",
                               F.lit(len(mask)).alias("span")))
    return reduce(DataFrame.unionByName, parts)


def overlaps(docs: DataFrame, benchmark: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, item_id, matched, width, doc_start, item_start: the best overlap of each document and test item.

    ``width`` is WINDOW tokens, or the whole item if it is shorter; ``matched`` of them are equal, at least
    SIMILARITY of the width. Every such overlap is found. Starts count tokens from 0; ties go to the earliest place in the document.
    The test side is small by nature but its size is counted: it is dealt into blocks of at most about ``block_rows``
    seeds and tokens by item, each broadcast on its own and, if there are several, written before the next begins, so common
    passages neither shuffle nor gather documents. Null and
    blank texts, and items without a token, have no overlaps; an item of one to four tokens overlaps every text that holds it; items equal in id are one item's variants. Further
    columns are not read.
    """
    items = materialize(benchmark.select("item_id", tokens(F.col("text")).alias("item_tokens")).distinct(), "items")
    all_seeds = materialize(seeds(items), "seeds")
    held = items.agg(F.coalesce(F.sum(F.size("item_tokens")), F.lit(0))).first()[0] + all_seeds.count()
    blocks = max(1, -(-held // block_rows))
    cleaned = docs.select("doc_id", tokens(F.col("text")).alias("doc_tokens"))
    widths = [r[0] for r in items.select(_width()).distinct().collect()]  # WINDOW + 1 values at most
    used = [i for i, m in enumerate(MASKS) if any(m in MASKS_OF.get(w, ()) for w in widths)] or [0]
    shortest = min(len(MASKS[i]) for i in used)
    places = cleaned.filter(F.size("doc_tokens") >= shortest).select(
        "doc_id", "doc_tokens", F.explode(F.sequence(F.lit(0), F.size("doc_tokens") - shortest)).alias("doc_at"))
    keys = F.array(*[_seed("doc_tokens", F.col("doc_at"), i, MASKS[i]) for i in used])
    keyed = places.select("doc_id", "doc_tokens", "doc_at", F.explode(keys).alias("key"))
    parts = []
    for block in range(blocks):
        mine = (F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else F.lit(True)
        best = _best(_verified(_hits(keyed, all_seeds.filter(mine)).join(F.broadcast(items.filter(mine)), "item_id")))
        if blocks > 1:  # one block's broadcasts at a time
            best = materialize(best, "overlaps")
            release(docs.sparkSession)
        parts.append(best)
    return reduce(DataFrame.unionByName, parts)


def _hits(keyed: DataFrame, some_seeds: DataFrame) -> DataFrame:
    """A row per equal seed with ``near``, the document's tokens from position ``near_at`` on that windows around it can hold.

    All rows of a document leave the join together, so none may hold the whole document.
    """
    from_ = F.greatest(F.lit(0), F.col("doc_at") + F.col("span") - WINDOW)
    found = keyed.join(F.broadcast(some_seeds), "key").withColumn("near_at", from_)
    return found.select("doc_id", "item_id", "doc_at", "item_at", "span", "near_at",
                        F.slice("doc_tokens", F.col("near_at") + 1, F.lit(2 * WINDOW) - F.col("span")).alias("near"))


def _best(scored: DataFrame) -> DataFrame:
    """The best window of each document and item."""
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct(
        "matched", (-F.col("doc_start")).alias("early"), (-F.col("item_start")).alias("item_early"), "width")).alias("best"))
    return best.select("doc_id", "item_id", "best.matched", "best.width", (-F.col("best.early")).alias("doc_start"),
                       (-F.col("best.item_early")).alias("item_start"))


def _verified(hits: DataFrame) -> DataFrame:
    """The best window along the diagonal of each hit among those that hold the hit."""
    placed = hits.select("doc_id", "item_id", "near", "near_at", "item_tokens", "item_at", "span",
                         (F.col("doc_at") - F.col("item_at")).alias("diagonal"), _width().alias("width"))
    first = F.greatest(F.lit(0), F.col("item_at") + F.col("span") - F.col("width"))
    last = F.least(F.col("item_at"), F.size("item_tokens") - F.col("width"))
    ranged = placed.withColumn("first", F.least(first, last)).withColumn("last", F.greatest(first, last))
    # 1 for each equal pair from the first window's start to the last one's end.
    equal = F.transform(F.sequence("first", F.col("last") + F.col("width") - 1), lambda i: F.when(
        F.get("near", F.col("diagonal") + i - F.col("near_at")) == F.get("item_tokens", i), 1).otherwise(0))
    flagged = ranged.select("doc_id", "item_id", "diagonal", "width", "first", "last", equal.alias("equal"))
    sums = F.transform(F.sequence("first", "last"), lambda s: F.struct(
        F.aggregate(F.slice("equal", s - F.col("first") + 1, F.col("width")), F.lit(0), lambda a, x: a + x).alias("matched"), (-s).alias("start")))
    scored = flagged.withColumn("top", F.array_max(sums)).select(
        "doc_id", "item_id", "width", "top.matched", (F.col("diagonal") - F.col("top.start")).alias("doc_start"), (-F.col("top.start")).alias("item_start"))
    return scored.filter(F.col("matched") >= F.ceil(F.col("width") * F.lit(SIMILARITY)))
