"""The operators of this subpackage applied to the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import align, counts, decontaminate, language, lines, mixing, neighbours, pieces, resample, sharding, simhash, toxicity, warc
from marginalia.llm.shared import training_fold
from marginalia.session import checkpoint_root, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# Bytes of text a shard may hold: small enough that the test tables need several splits.
SHARD_BYTES = 8 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def query(sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return run
    return register


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
n AS (SELECT payload_digest, max(page_id) AS newest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, d.payload_digest,
       CASE WHEN newest IS NOT NULL AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM d LEFT JOIN n ON d.payload_digest = n.payload_digest AND payload_bytes >= 1000""")
def op1_warc_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Write, read back, store by digest, reconstruct; sizes and digests are those of the payloads as stored."""
    planned = warc.plan_records(table(spark, sf, "pages"), "page_id", "url", F.col("html").cast("binary"))
    heads, payloads = warc.store(warc.parsed(warc.read_archives(spark, warc.write_archives(planned))))
    whole = warc.reconstruct(heads, payloads.select("sha256", "payload_bytes", "payload_sha1"))
    return whole.select(F.col("record_key").cast("bigint").alias("page_id"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"),
                        "record_type", F.col("refers_to").cast("bigint").alias("refers_to"))


@query()
def op2_language_filters(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language.identify(docs, language.train(docs))
    return found.select("doc_id", (~training_fold()).alias("held_out"), "lang_pred", "score")


@query()
def op3_neighbour_graph(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("query") % 20 == 0)


@query()
def op4_hash_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign(table(spark, sf, "documents"), SHARD_BYTES)


@query()
def op5_toxicity_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = toxicity.scored(docs, toxicity.train(docs, table(spark, sf, "labels")))
    return found.select("doc_id", (~training_fold()).alias("held_out"), "score", "predicted", "evidence")


@query()
def op6_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query()
def op7_benchmark_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.linked_lines(table(spark, sf, "documents"))


@query(mixing.SQL)
def op9_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def token_batches(rollup: counts.Rollup, docs: DataFrame, tokenizers: dict[str, counts.Tokenizer]) -> None:
    """A life of the table: loaded under the first tokenizer, counted under the others, copies deleted, lines revised."""
    first, *others = tokenizers
    held = docs.select("doc_id", "source", "lang", "text")
    rollup.commit("1-load", inserts=counts.counted(held, {first: tokenizers[first]}))
    if others:
        rollup.commit("2-tokenizers", inserts=counts.counted(held, {o: tokenizers[o] for o in others}))
    text_key = [F.xxhash64(F.lit(i), "text").alias(f"key_{i}") for i in range(2)]
    keyed = held.filter("text is not null").select("doc_id", *text_key)
    kept = keyed.groupBy("key_0", "key_1").agg(F.min("doc_id").alias("kept")).select("key_0", "key_1", "kept")
    rollup.commit("3-copies", deletes=keyed.join(kept, ["key_0", "key_1"]).filter("doc_id > kept").select("doc_id"))
    unique_lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    remaining = keyed.join(kept, ["key_0", "key_1"]).filter("doc_id = kept").select("doc_id").distinct()
    revised = held.withColumn("shorter", unique_lines).filter("shorter <> text").select("doc_id", "source", "lang", F.col("shorter").alias("text"))
    revised = revised.join(remaining, "doc_id", "left_semi")
    rollup.commit("4-lines", revisions=counts.counted(revised, tokenizers))
    rollup.commit("3-copies", deletes=held.select("doc_id"))  # a batch sent twice, whatever it brings, changes nothing


@query()
def op10_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rollup = counts.Rollup(spark, f"{checkpoint_root(spark)}/marginalia/tokens-{uuid.uuid4().hex}")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    token_batches(rollup, table(spark, sf, "documents"), {
        "words-1": counts.white_space_words, "byte_bpe_50k": counts.byte_pairs(f"{counts.TOKENIZERS}/byte_bpe_50k.tiktoken", pattern)})
    return rollup.totals()


@query()
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.aligned(table(spark, sf, "documents"))


@query(resample.SQL)
def op12_target_resample(spark: SparkSession, sf: str) -> DataFrame:
    return resample.ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query()
def op13_piece_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    found = pieces.encoded(table(spark, sf, "documents"))
    return found.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
