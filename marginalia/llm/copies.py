"""Near copies by the Jaccard similarity of word-shingle sets: an exact prefix-filter join.

Under one order of all shingles, two sets of similarity 0.8 or more share a shingle among the first fifth (plus one) of each,
so a join on these prefixes holds every such pair; each candidate's whole sets are then compared. The order puts shingles
that are common in a sample last, so common passages seldom are in a prefix; the result is the same under any order.

Only components are wanted, so candidates come in two steps: each document of a prefix shingle with the least one there, and,
once these are linked, pairs of documents that are still in different components. A large group of near copies makes no
square of pairs. Equal sets are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.session import Scratch, materialize
from marginalia.llm.components import components
from marginalia.llm.shared import membership_filter, possible_members

SEED = 42
SHINGLE = 5
# Least similarity of a link, as a fraction in whole numbers.
SIMILARITY = (4, 5)
# Documents whose shingles are counted for the order, and how many common shingles it knows. Neither changes the result.
SAMPLE = 4000
COMMON = 100_000


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` are one shingle, none give none.

    Only A-Z is lower-cased and only ASCII blanks part words, as in ``simhash.fingerprint``.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.int64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[-n:].tolist())], dtype=np.uint64).view(np.int64))


def node(held: np.ndarray) -> int:
    """A 64-bit name of the set."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).astype(np.int64))


def prefix(held: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of the set, rare ones first; ``common`` is sorted."""
    if not len(held):
        return held
    need = -(-len(held) * SIMILARITY[0] // SIMILARITY[1])
    known = np.zeros(len(held), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, held), len(common) - 1)
        known = np.where(common[at] == held, counts[at], 0)
    return held[np.lexsort((held, known))][: len(held) - need + 1]


def _common(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles found in several documents of a sample, sorted, and in how many."""
    rows = docs.count()
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = np.concatenate([shingles(t, width) for t in batch["text"]] or [np.zeros(0, dtype=np.int64)])
            found, counts = np.unique(held, return_counts=True)
            yield pd.DataFrame({"shingle": found, "n": counts})

    counted = (docs.select("text").sample(min(1.0, SAMPLE / rows), seed=SEED).mapInPandas(each, "shingle bigint, n bigint")
               .groupBy("shingle").agg(F.sum("n").alias("n")).filter("n >= 3").orderBy(F.desc("n"), "shingle").limit(COMMON).toPandas())
    counted = counted.sort_values("shingle")
    return counted["shingle"].to_numpy(dtype=np.int64), counted["n"].to_numpy(dtype=np.int64)


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """Those of the distinct pairs (a, b) whose whole sets are similar enough.

    The texts of the nodes that occur travel compressed, about a third of their shingles' size, and are cut into shingles again where a pair meets.
    """
    wanted = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
    ids = scratch.write(nodes.join(wanted, "node", "left_semi").select("least", F.xxhash64("least").alias("id_key")).distinct(), "wanted")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pd.DataFrame({"node": np.array([node(shingles(t, width)) for t in batch["text"]], dtype=np.int64),
                                "packed": [compress((t or "").encode("utf-8", "surrogatepass")) for t in batch["text"]]})

    likely = possible_members(docs, F.xxhash64("doc_id"), membership_filter(ids, "id_key"))
    texts = likely.join(ids, F.col("doc_id").eqNullSafe(F.col("least"))).select("text").mapInPandas(named, "node bigint, packed binary")
    held = scratch.write(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")
    both = (pairs.join(held.select(F.col("node").alias("a"), F.col("packed").alias("left")), "a")
            .join(held.select(F.col("node").alias("b"), F.col("packed").alias("right")), "b"))
    over, under = SIMILARITY

    def verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sets: dict[int, np.ndarray] = {}  # a node is in many pairs of a batch

            def of(name: int, packed: bytes) -> np.ndarray:
                if name not in sets:
                    sets[name] = shingles(expand(packed).decode("utf-8", "surrogatepass"), width)
                return sets[name]

            keep = []
            for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"]):
                x, y = of(a, left), of(b, right)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                # |A and B| / |A or B| >= over / under, without division.
                keep.append(shared * (over + under) >= (len(x) + len(y)) * over)
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    edges = scratch.write(both.select("a", "b", "left", "right").mapInPandas(verified, "a bigint, b bigint"), "edges")
    scratch.drop("wanted", "texts")
    return edges


def _possible(size_x: Column, at_x: Column, size_y: Column, at_y: Column) -> Column:
    """Whether sets with a common shingle at these places of their orders can be similar: by their sizes, and by how many
    shingles can be common before that place and from it on."""
    over, under = SIMILARITY
    common = F.least(at_x, at_y) + F.least(size_x - at_x, size_y - at_y)
    return (F.least(size_x, size_y) * under >= F.greatest(size_x, size_y) * over) & (common * (over + under) >= (size_x + size_y) * over)


def _counted(met: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of rows (a, b, size_a, size_b), a row per common prefix shingle, that can be similar by their number.

    The set whose prefix ends first in the order has all its common shingles up to there in both prefixes, and at most its
    rest beyond, one less than SIMILARITY of its size; what is missing to the least overlap must be common in the prefixes.
    """
    over, under = SIMILARITY
    need = F.floor((F.col("size_a") + F.col("size_b")) * over + (over + under - 1)) / (over + under)
    rest = F.floor((F.greatest("size_a", "size_b") * over + (under - 1)) / under)
    rows = met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    return rows.filter(F.col("common") >= F.floor(need) - rest + 1).select("a", "b")


def _named(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, least, root; a node without an edge is its own root."""
    reached = components(edges).select("node", "root")
    return scratch.write(nodes.join(reached, "node", "left").withColumn("root", F.coalesce("root", "node")), "roots")


def near_copies(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, component_id: the smallest doc_id linked to it by similarity of 0.8 or more, directly or by others.

    Texts without a word are equal. A null doc_id is never a component's name while the component has another; repeated ids
    keep a row each.
    """
    docs = docs.select("doc_id", "text")
    common, counts = _common(docs, width)
    shared = docs.sparkSession.sparkContext.broadcast((common, counts))  # at most COMMON rows

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [shingles(t, width) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "node": np.array([node(h) for h in held], dtype=np.int64),
                                "size": [len(h) for h in held], "prefix": [prefix(h, *shared.value) for h in held]})

    with Scratch(docs.sparkSession) as scratch:
        marked = scratch.write(docs.mapInPandas(marks, "doc_id bigint, node bigint, size int, prefix array<bigint>"), "marks")
        ids = materialize(marked.select("doc_id", "node"), "nodes")
        nodes = scratch.write(ids.groupBy("node").agg(F.min("doc_id").alias("least")), "nodes")
        places = marked.select("node", "size", F.posexplode("prefix").alias("at", "shingle"))
        # A shingle of one set links nothing. Most are, so all of them travel only once, with nothing but their set's name, and a
        # bitmap of the others goes before the join.
        named = places.select("shingle", "node").repartition("shingle")
        first = named.groupBy("shingle").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first < last").drop("last")
        first = scratch.write(first, "first")
        likely = possible_members(places, F.col("shingle"), membership_filter(first, "shingle"))
        places = scratch.write(likely.join(first, "shingle"), "places")
        scratch.drop("marks", "first")
        heads = places.filter("node = first").select("shingle", F.col("size").alias("first_size"), F.col("at").alias("first_at")).distinct()
        least = places.filter("node > first").join(heads, "shingle").filter(_possible(F.col("first_size"), F.col("first_at"), F.col("size"), F.col("at")))
        # A pair meets here only where one of it is the first, so it may count too little; the second step sees it again.
        pairs = scratch.write(_counted(least.select(F.col("first").alias("a"), F.col("node").alias("b"), F.col("first_size").alias("size_a"), F.col("size").alias("size_b"))), "pairs")
        edges = _similar(docs, nodes, pairs, width, scratch)

        named = _named(nodes, edges, scratch)
        places = places.select("shingle", "node", "size", "at").join(named.select("node", "root"), "node")
        mixed = places.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("shingle")
        places = scratch.write(places.join(mixed, "shingle"), "mixed")
        scratch.drop("places")
        left, right = (places.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("root", "node", "size", "at")]) for side in "xy")
        roots = places.groupBy("shingle", "root").agg(F.min("size").alias("small"), F.max("size").alias("large"))
        over, under = SIMILARITY
        met = (roots.select("shingle", F.col("root").alias("root_x"), F.col("small").alias("small_x"), F.col("large").alias("large_x"))
               .join(roots.select("shingle", F.col("root").alias("root_y"), F.col("small").alias("small_y"), F.col("large").alias("large_y")), "shingle")
               .filter((F.col("root_x") < F.col("root_y")) & (F.col("large_x") * under >= F.col("small_y") * over) & (F.col("large_y") * under >= F.col("small_x") * over)))
        crossing = met.join(left, ["shingle", "root_x"]).join(right, ["shingle", "root_y"]).filter(
            _possible(F.col("size_x"), F.col("at_x"), F.col("size_y"), F.col("at_y"))).select(
            F.col("node_x").alias("a"), F.col("node_y").alias("b"), F.col("size_x").alias("size_a"), F.col("size_y").alias("size_b"))
        # Either one may come first; pairs that were dissimilar once are so still.
        crossing = _counted(crossing.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "size_a", "size_b"))
        crossing = scratch.write(crossing.join(pairs, ["a", "b"], "left_anti"), "crossing")
        scratch.drop("mixed", "roots", "pairs")
        named = _named(nodes, edges.unionByName(_similar(docs, nodes, crossing, width, scratch)), scratch)

        names = named.groupBy("root").agg(F.min("least").alias("component_id"))
        of_node = materialize(named.select("node", "root").join(names, "root").select("node", "component_id"), "components")
    return ids.join(of_node, "node").select("doc_id", "component_id")
