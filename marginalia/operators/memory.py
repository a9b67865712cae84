"""Conversation history and bounded memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from marginalia.functions import text as X, vocabulary as V

HISTORY = 10
DIGEST_CHARS = 500
DIGEST_MIN = 5


def _retention_order():
    """Newest first for short-term rows; importance, then newest, for the others."""
    importance = F.when(F.col("memory_type") != "short_term", F.col("importance"))
    return [importance.desc_nulls_last(), F.col("created_at").desc(), F.col("id").desc()]


def enforce_capacity(memories: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """Keep at most the limit of each memory type; a limit of zero or less means no limit.

    The rank filter carries one constant (the largest limit), so each partition keeps only that many
    rows per type before the shuffle, however few types there are.
    """
    limits = {**V.MEMORY_LIMITS, **(limits or {})}
    bounded = {t: n for t, n in limits.items() if n and n > 0}
    if not bounded:
        return memories
    is_bounded = F.col("memory_type").isin(list(bounded))
    window = W.partitionBy("memory_type").orderBy(*_retention_order())
    ranked = (memories.filter(is_bounded).withColumn("_rank", F.row_number().over(window))
              .filter(F.col("_rank") <= max(bounded.values())))
    limit = F.create_map(*[F.lit(x) for pair in bounded.items() for x in pair])[F.col("memory_type")]
    kept = ranked.filter(F.col("_rank") <= limit).drop("_rank")
    return kept.unionByName(memories.filter(~F.coalesce(is_bounded, F.lit(False))))


def read_memories(memories: DataFrame, memory_type: str | None = None, limit: int | None = None) -> DataFrame:
    """Memories in reading order."""
    if memory_type is None:
        out = memories.orderBy(F.col("created_at").desc(), F.col("id").desc())
    else:
        out = memories.filter(F.col("memory_type") == memory_type).orderBy(*_retention_order())
    return out.limit(limit) if limit else out


def long_term(memories: DataFrame, limit: int = 10) -> DataFrame:
    return (memories.filter(F.col("memory_type").isin(V.LONG_TERM_TYPES))
            .orderBy(F.col("importance").desc(), F.col("created_at").desc(), F.col("id").desc()).limit(limit))


def memory_context(memories: DataFrame, owner: str | None = None, n_long: int = 5, n_short: int = 3) -> DataFrame:
    """Prompt text of the best long-term and latest short-term memories, per owner when given."""
    keys = [owner] if owner else []
    base = memories.withColumn("_kind", F.when(F.col("memory_type").isin(V.LONG_TERM_TYPES), "long")
                               .when(F.col("memory_type") == "short_term", "short")).filter(F.col("_kind").isNotNull())
    window = W.partitionBy(*keys, "_kind").orderBy(*_retention_order())
    picked = (base.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= max(n_long, n_short))
              .filter(F.col("_rank") <= F.when(F.col("_kind") == "long", n_long).otherwise(n_short)))

    def section(kind):
        rows = F.array_sort(F.collect_list(F.when(F.col("_kind") == kind, F.struct("_rank", "content"))))
        lines = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("- "), r["content"])), "\n")
        return F.when(F.size(rows) > 0, F.concat(F.lit(V.MEMORY_HEADINGS[kind] + "\n"), lines))
    return picked.groupBy(*keys).agg(F.concat_ws("\n\n", section("long"), section("short")).alias("context"))


def last_messages(messages: DataFrame, n: int = HISTORY) -> DataFrame:
    """Last ``n`` messages of each conversation; ``position`` counts from the oldest kept one."""
    window = W.partitionBy("conversation_id")
    recent = messages.withColumn("_back", F.row_number().over(
        window.orderBy(F.col("created_at").desc(), F.col("id").desc()))).filter(F.col("_back") <= n)
    return recent.withColumn("position", F.count(F.lit(1)).over(window) - F.col("_back") + 1).drop("_back")


def message_counts(messages: DataFrame) -> DataFrame:
    return messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


def digest_input(messages: DataFrame) -> DataFrame:
    """Summary input of conversations with at least five messages: last ten, 500 characters each."""
    lines = last_messages(messages).select("conversation_id", "position", F.concat(
        F.col("role"), F.lit(": "), F.left(F.coalesce("content", F.lit("")), F.lit(DIGEST_CHARS))).alias("line"))
    return (lines.groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda r: r["line"]), "\n")
        .alias("digest")).filter(F.col("n") >= DIGEST_MIN).drop("n"))


def due_digests(messages: DataFrame) -> DataFrame:
    """Digests of conversations whose message count is a multiple of five."""
    due = message_counts(messages).filter(F.col("n") % 5 == 0)
    return digest_input(messages).join(due.select("conversation_id"), "conversation_id", "left_semi")


def upsert_short_term(memories: DataFrame, summaries: DataFrame) -> DataFrame:
    """One short-term memory per conversation: new content replaces, a new conversation is added.

    ``summaries(conversation_id, content, created_at, id)``; blank content changes nothing.
    """
    new = (summaries.filter(X.non_blank(F.col("content")))
           .select(F.col("conversation_id").alias("source_conversation_id"), X.strip(F.col("content")).alias("_new"),
                   F.col("created_at").alias("_at"), F.col("id").alias("_id")))
    short = F.col("memory_type") == "short_term"
    firsts = (memories.filter(short & F.col("source_conversation_id").isNotNull())
              .groupBy("source_conversation_id").agg(F.min("id").alias("_first")))
    updated = (memories.join(firsts.join(new, "source_conversation_id"), "source_conversation_id", "left")
               .withColumn("content", F.when(F.col("id") == F.col("_first"), F.col("_new")).otherwise(F.col("content")))
               .select(*memories.columns))
    added = new.join(firsts, "source_conversation_id", "left_anti").select(
        F.col("_id").alias("id"), F.lit("short_term").alias("memory_type"), F.col("_new").alias("content"),
        "source_conversation_id", F.lit(5).alias("importance"), F.col("_at").alias("created_at"))
    return updated.unionByName(added.select(*memories.columns))
