"""Target-distribution importance resampling over hashed word features.

A text, its A-Z lower-cased, goes through an untrained regex split that returns words with offsets. Windows of consecutive
offset pairs are the features; each counts in a bucket, its CRC-32 modulo the number of buckets. Two histograms, of the raw
documents and of the target texts, give every bucket a gain, the scaled log of how much likelier it is in the target; a
document weighs the sum of its features' gains. Weight plus Gumbel noise from a hash of the id is its score, and the
highest scores are a draw without replacement in proportion to the exponentials of the weights.

Texts are split once: their bucket numbers are written, and both the histogram and the weights are read from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marginalia.operators.blocks import global_row_number
from marginalia.session import materialize

# Words are runs of digits, lower-case letters and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WIDTH = 1
BUCKETS = 10_000
SCALE = 1000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
# Features whose bucket a task remembers.
REMEMBERED = 1 << 18
# Characters of a text split at a time: the regex split makes an object per word.
PART_CHARS = 1 << 20

_HASHED = "n_words bigint, n_features bigint, buckets binary"


def word_split():
    """The untrained pre-tokeniser: the matches of WORD with their offsets, what lies between them dropped."""
    from tokenizers import Regex, pre_tokenizers
    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def word_spans(split, text: str) -> list[tuple[int, int]]:
    """Offset pairs of the words of a lower-cased text. A long text is split in parts that end outside of a word."""
    if len(text) <= PART_CHARS:
        return [span for _, span in split.pre_tokenize_str(text)]
    spans, start = [], 0
    while start < len(text):
        end = min(len(text), start + PART_CHARS)
        while end < len(text) and (text[end].isdigit() or text[end] > "\x7f" or "a" <= text[end] <= "z"):
            end += 1
        spans += [(a + start, b + start) for _, (a, b) in split.pre_tokenize_str(text[start:end])]
        start = end
    return spans


def features(text: str, spans: list[tuple[int, int]], width: int) -> list[str]:
    """All runs of one to ``width`` consecutive words, joined by one space."""
    words = [text[a:b] for a, b in spans]
    out = list(words)
    for n in range(2, width + 1):
        out += [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


def hashed(docs: DataFrame, width: int = WIDTH, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, with n_words, n_features and buckets: a 32-bit number per feature, little-endian.

    A null text has no word. Columns of ``docs`` called like one of these are left out.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_words", "n_features", "buckets")]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + [_HASHED])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = word_split(), {}
        for batch in batches:
            n_words, n_features, found = [], [], []
            for value in batch.column(batch.num_columns - 1):
                low = lowered(value.as_py() or "")
                spans = word_spans(split, low)
                held = features(low, spans, width)
                if len(known) > REMEMBERED:
                    known.clear()
                for feature in set(held).difference(known):
                    known[feature] = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % buckets
                n_words.append(len(spans))
                n_features.append(len(held))
                found.append(np.array([known[f] for f in held], dtype="<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(found, pa.binary())],
                names=[*(f.name for f in kept), "n_words", "n_features", "buckets"])

    return docs.select(*[_named(f.name) for f in kept], F.col(text)).mapInArrow(each, schema)


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows of :func:`hashed`. ``buckets`` numbers reach the driver, however many rows there are."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(np.frombuffer(value.as_py() or b"", dtype="<u4"), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in rows.select("buckets").mapInArrow(each, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """A whole number per bucket: the scaled log of its share in the target by its share in the raw texts, one added to every count."""
    raw_all, target_all, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([floor(scale * log((t + 1.0) * (raw_all + n) / ((s + 1.0) * (target_all + n)))) for s, t in zip(raw.tolist(), target.tolist())],
                    dtype=np.int64)


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """``rows`` of :func:`hashed` with weight, the sum of their features' gains, instead of their buckets."""
    kept = [f for f in rows.schema.fields if f.name not in ("buckets", "weight")]
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept] + ["weight bigint"])
    shared = rows.sparkSession.sparkContext.broadcast(gain)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight = [int(shared.value[np.frombuffer(v.as_py() or b"", dtype="<u4")].sum()) for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(weight, pa.int64())], names=[*(f.name for f in kept), "weight"])

    return rows.select(*[_named(f.name) for f in kept], "buckets").mapInArrow(each, schema)


def noise(key: str, seed: int = SEED, scale: int = SCALE) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a SHA-256 of seed and key; a null key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(unit))).cast("bigint")


def ranked(docs: DataFrame, target: DataFrame, key: str = "doc_id", width: int = WIDTH, buckets: int = BUCKETS,
           min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: key, n_features, weight, score and rank, which is null for rows that are not drawn.

    Drawn are the ``percent`` hundredths (rounded down) of the rows with ``min_words`` words or more that score highest; ties
    go to the smaller key, null keys last. Null texts have no feature and weigh 0. Repeated rows are scored and drawn
    each for itself. ``target`` needs a column text; without rows of it all gains follow from the added ones.
    """
    rows = materialize(hashed(docs.select(key, "text"), width, buckets), "hashed")
    gain = gains(histogram(rows, buckets), histogram(hashed(target.select("text"), width, buckets), buckets))
    scored = materialize(weighed(rows, gain).withColumn("score", F.col("weight") + noise(key, seed)), "scored")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last(key), F.asc("n_features"), F.asc("weight")]
    placed = global_row_number(able.select(key, "n_features", "weight", "score"), order, "place")
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("bigint")
    rest = scored.filter(F.col("n_words") < min_words).select(key, "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return placed.select(key, "n_features", "weight", "score", rank.alias("rank")).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """The drawn rows of ``docs``, whole. Rows that repeat a key are all kept if one of them is drawn; a null key is never found."""
    drawn = ranked(docs, target, key, **settings).filter("rank is not null").select(key).distinct()
    return docs.join(materialize(drawn, "drawn"), key, "left_semi")


# CRC-32 byte by byte over the distinct words, from the 256 remainders of its polynomial.
SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
       lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS remainders),
texts AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
lists AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
words AS (SELECT kind, doc_id, word, count(*) AS n FROM (SELECT kind, doc_id, unnest(words) AS word FROM lists) GROUP BY ALL),
spelt AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT DISTINCT word FROM words)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2),
                                        lambda j: ('0x' || digits[2 * j + 1:2 * j + 2])::BIGINT)),
                            lambda c, b: xor(c // 256, remainders[xor(c % 256, b) + 1]))) % 10000 AS bucket FROM spelt, crc),
counts AS (SELECT bucket, sum(n) FILTER (WHERE kind = 0) AS s, sum(n) FILTER (WHERE kind = 1) AS t FROM words JOIN hashed USING (word) GROUP BY bucket),
sums AS (SELECT sum(coalesce(s, 0))::DOUBLE AS all_s, sum(coalesce(t, 0))::DOUBLE AS all_t FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS gain FROM counts, sums),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) WHERE kind = 0 GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
           FROM lists LEFT JOIN weights USING (doc_id) WHERE kind = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                  floor(10 * count(*) FILTER (WHERE n_features >= 20) OVER () / 100) AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS rank FROM placed"""
