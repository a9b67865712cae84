"""SimHash near-duplicates by multi-index hashing.

Fingerprints are split into segments. If two of them differ in at most ``radius`` bits, some segment differs in at most
its own share of the bits (the pigeonhole principle), so a table of segment values, probed with every value in a
small Hamming ball around the query's segment, holds every partner. Probes meet the table in a join on (segment, value), and
the whole distance is verified in that join. Equal fingerprints are one row throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from marginalia.session import materialize
from marginalia.llm.components import components

SEED = 42
SHINGLE = 4
RADIUS = 4
SEGMENTS = 3


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of ``text``, each occurrence voting; 0 without words.

    Only A-Z is lower-cased. ``bytes.split`` and ``bytes.lower`` work on exactly these blanks and letters.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    # Votes by bit position, in blocks so that a long text needs no table of all its bits.
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        votes += np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


@pandas_udf(LongType())
def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed number). Null and blank texts have 0."""
    return docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text)).alias("fp"))


def _layout(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(shift, bits, ball radius) per segment; the balls' radii plus one each sum to ``radius + 1`` or more."""
    if not 1 <= segments <= radius + 1:
        raise ValueError("segments must lie between 1 and radius + 1")
    cut = [64 * i // segments for i in range(segments + 1)]
    spare = radius + 1 - segments
    return [(cut[i], cut[i + 1] - cut[i], spare // segments + (i < spare % segments)) for i in range(segments)]


def _ball(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` of the low ``bits`` bits."""
    masks = {0}
    for _ in range(radius):
        masks |= {m | 1 << b for m in masks for b in range(bits)}
    return sorted(masks)


def links(distinct: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS) -> DataFrame:
    """All pairs a < b of different fingerprints (column ``fp``) at most ``radius`` bits apart.

    More segments mean fewer probes but larger table buckets; choose them so that 64 / segments is near log2 of the
    number of fingerprints: 3 up to about 10^8, 2 beyond. The result is the same.
    """
    table, probes = [], []
    for i, (shift, bits, ball) in enumerate(_layout(segments, radius)):
        part: Column = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        table.append(F.struct(F.lit(i).alias("segment"), part.alias("value")))
        probes += [F.struct(F.lit(i).alias("segment"), part.bitwiseXOR(F.lit(m)).alias("value")) for m in _ball(bits, ball)]
    left = distinct.select(F.col("fp").alias("b"), F.explode(F.array(*probes)).alias("key")).select("b", "key.segment", "key.value")
    right = distinct.select(F.col("fp").alias("a"), F.explode(F.array(*table)).alias("key")).select("a", "key.segment", "key.value")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = left.join(right, (left.segment == right.segment) & (left.value == right.value) & (F.col("a") != F.col("b")) & close)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, segments: int = SEGMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id linked to it, directly or by others.

    A null doc_id is never a component's name while the component has another; repeated ids keep a row each.
    """
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = materialize(links(distinct, radius, segments), "links")
    reached = components(edges).select(F.col("node").alias("fp"), "root")
    named = distinct.join(reached, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = materialize(named.select("fp", "root").join(least, "root").select("fp", "component_id"), "components")
    return marked.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
