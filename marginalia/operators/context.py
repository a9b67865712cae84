"""Prompt contexts assembled per query, conversation, paper or topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import answers as A, text as X, vocabulary as V
from marginalia.operators.blocks import block_of, running_total
from marginalia.operators.memory import last_messages

PAPER_CONTEXT_CHARS = 6000
OVERVIEW_CHARS = 600
PASSAGE_CHARS = 800


def hit_header(rank: Column) -> Column:
    """``[i] title - authors (year) 第p页`` with absent parts left out."""
    return F.concat(
        F.lit("["), rank.cast("string"), F.lit("] "), F.coalesce(X.truthy(F.col("title")), F.lit(V.UNKNOWN_TITLE)),
        F.coalesce(F.concat(F.lit(" - "), X.truthy(F.col("authors"))), F.lit("")),
        F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("year"), F.lit(0)).cast("string"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(" 第"), F.nullif(F.col("page_number"), F.lit(0)).cast("string"), F.lit("页")), F.lit("")))


def hit_block() -> Column:
    return F.concat(hit_header(F.col("rank")), F.lit("\n"), F.coalesce("content", F.lit("")), F.lit("\n"))


def passage_block() -> Column:
    """``[chunk_id] content`` with the content cut to 800 characters."""
    return F.concat(F.lit("["), F.col("chunk_id"), F.lit("] "),
                    F.left(F.coalesce("content", F.lit("")), F.lit(PASSAGE_CHARS)))


def join_blocks(hits: DataFrame, block: Column, separator: str, key: str = "query_id") -> DataFrame:
    """Blocks of each query's hits in rank order: ``(query_id, n_hits, context)``."""
    return hits.select(key, "rank", block.alias("block")).groupBy(key).agg(
        F.count(F.lit(1)).alias("n_hits"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), separator)
        .alias("context"))


def hit_contexts(hits: DataFrame) -> DataFrame:
    return join_blocks(hits, hit_block(), "\n---\n")


def passage_contexts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Context per query, a placeholder when nothing was found."""
    found = join_blocks(hits, passage_block(), "\n\n")
    return queries.select("query_id").join(found, "query_id", "left").select(
        "query_id", F.coalesce("context", F.lit(V.NO_CONTEXT_PLACEHOLDER)).alias("context"))


def paper_contexts(papers: DataFrame, chunks: DataFrame, limit: int = PAPER_CONTEXT_CHARS) -> DataFrame:
    """First characters of a processed paper's chunks in order: ``(paper_id, context)``.

    Every chunk adds at least its two-character joiner, so the first ``limit/2 + 1`` chunks reach the
    limit; the rank filter keeps each group at that size.
    """
    done = papers.filter(F.col("processed") == "done").select(F.col("id").alias("paper_id"))
    window = W.partitionBy("paper_id").orderBy("chunk_index")
    head = (chunks.select("paper_id", "chunk_index", F.left(F.coalesce("content", F.lit("")), F.lit(limit)).alias("content"))
            .withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= limit // 2 + 1))
    joined = head.groupBy("paper_id").agg(F.left(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_n", "content"))), lambda c: c["content"]), "\n\n"), F.lit(limit)).alias("context"))
    return joined.join(done, "paper_id", "left_semi")


def paper_overviews(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """``[paper_id=n] title`` and the first non-blank chunk cut to 600 characters."""
    first = (chunks.filter(X.non_blank(F.col("content"))).groupBy("paper_id")
             .agg(F.min_by(F.left(X.strip(F.col("content")), F.lit(OVERVIEW_CHARS)), "chunk_index").alias("intro")))
    return (papers.select(F.col("id").alias("paper_id"), "title").join(first, "paper_id", "left").select(
        "paper_id", F.concat(F.lit("[paper_id="), F.col("paper_id").cast("string"), F.lit("] "),
                             F.coalesce(X.truthy(F.col("title")), F.lit("(无标题)")), F.lit("\n"),
                             F.coalesce("intro", F.lit(""))).alias("overview")))


def skill_prompts(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """Role prompt of a request by template id; unknown or absent ids give NULL."""
    text = F.concat(F.col("role"), F.lit("\n\n"), F.col("instruction"), F.lit("\n\n当前用户输入：\n"),
                    F.col("text"), F.lit("\n"))
    return requests.join(templates.select("skill_id", "role", "instruction"), "skill_id", "left").withColumn(
        "skill_prompt", text).drop("role", "instruction")


def build_messages(requests: DataFrame, history: DataFrame, contexts: DataFrame, templates: DataFrame,
                   system_prompt: str, online_hint: str, guard: str = V.NO_HIT_GUARD) -> DataFrame:
    """Message list per request: system text (guard appended when nothing was found), history, context,
    external context, online hint, skill role.

    ``requests(conversation_id, text, skill_id, online, memory_context, external_context)``.
    """
    pair = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    turns = last_messages(history).groupBy("conversation_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "role", "content"))),
        lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("turns"))
    r = (skill_prompts(requests, templates).join(turns, "conversation_id", "left")
         .join(contexts.select(F.col("query_id").alias("conversation_id"), "context"), "conversation_id", "left"))
    system = F.concat(F.lit(system_prompt),
                      F.coalesce(F.concat(F.lit("\n\n"), X.truthy(F.col("memory_context"))), F.lit("")),
                      F.when(F.col("context").isNull(), F.lit("\n\n" + guard)).otherwise(""))
    online = F.coalesce("online", F.lit(False)) | A.needs_online(F.col("text"))
    optional = lambda present, content: F.when(present, pair("system", content))
    external = X.truthy(F.col("external_context"))
    tail = F.array_compact(F.array(
        optional(F.col("context").isNotNull(), F.concat(F.col("context"), F.lit("\n\n"), F.col("text"))),
        optional(external.isNotNull(), external), optional(online, F.lit(online_hint)),
        optional(F.col("skill_prompt").isNotNull(), F.col("skill_prompt"))))
    none = F.array().cast("array<struct<role:string,content:string>>")
    return r.select("conversation_id", online.alias("web_search_enabled"),
                    F.concat(F.array(pair("system", system)), F.coalesce("turns", none), tail).alias("messages"))


# Reviews over several sub-questions ----------------------------------------------------------

def sub_answers(questions: DataFrame, hits: DataFrame, answers: DataFrame) -> DataFrame:
    """State of each sub-question: ``topic_id, index, question, answer, n_chunks, ok``.

    ``hits(topic_id, index, …)``; ``answers(topic_id, index, answer, error)`` holds rows only for
    questions that were sent to the generator. No hits, a retrieval error or a generator error give the
    fixed notice and no chunks.
    """
    counts = hits.groupBy("topic_id", "index").agg(F.count(F.lit(1)).alias("n"))
    keys = ["topic_id", "index"]
    joined = questions.join(counts, keys, "left").join(answers, keys, "left")
    ok = (F.coalesce("n", F.lit(0)) > 0) & F.col("error").isNull() & F.col("answer").isNotNull() & ~F.startswith(
        F.coalesce("answer", F.lit("")), F.lit(V.GENERATOR_ERROR_PREFIX))
    return joined.select(*keys, "question", F.when(ok, F.col("answer")).otherwise(F.lit(V.INSUFFICIENT_NOTICE)).alias("answer"),
                         F.when(ok, F.col("n")).otherwise(F.lit(0)).alias("n_chunks"), ok.alias("ok"))


def generator_input(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Only sub-questions with hits reach the generator."""
    return questions.join(hits.select("topic_id", "index").distinct(), ["topic_id", "index"], "left_semi")


def global_markers(answers: DataFrame, group: str = "topic_id", block: int = 512) -> DataFrame:
    """Local ``[^i^]`` markers become global ones: ``offset + i``, offset = chunks of earlier answers.

    Markers outside 1..n are removed. Adds ``offset`` and ``global_answer``.
    """
    placed = answers.withColumn("_block", block_of(F.col("index"), block))
    shifted = running_total(placed, [group], ["index"], "_block", F.col("n_chunks"), "offset").drop("_block")
    return shifted.withColumn("global_answer", A.renumber_markers(F.col("answer"), F.col("n_chunks"), F.col("offset")))


def synthesis_contexts(numbered: DataFrame, hits: DataFrame) -> DataFrame:
    """Final context per topic: answers in order, then the global reference list."""
    block = F.concat(F.lit("### 子问题 "), F.col("index").cast("string"), F.lit("："), F.col("question"), F.lit("\n"),
                     F.col("global_answer"))
    bodies = numbered.groupBy("topic_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("index", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("body"))
    used = hits.join(numbered.filter("ok").select("topic_id", "index", "offset"), ["topic_id", "index"])
    number = F.col("offset") + F.col("rank")
    line = F.concat(F.lit("["), number.cast("string"), F.lit("] "),
                    F.coalesce(X.truthy(F.col("title")), F.lit(V.UNKNOWN_TITLE)),
                    F.coalesce(F.concat(F.lit(" 第"), F.nullif(F.col("page_number"), F.lit(0)).cast("string"), F.lit("页")), F.lit("")))
    refs = used.groupBy("topic_id").agg(F.concat(F.lit("### 全局引用清单\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(number.alias("n"), line.alias("l")))), lambda x: x["l"]), "\n")).alias("refs"))
    return bodies.join(refs, "topic_id", "left").select("topic_id", F.concat_ws("\n\n", "body", "refs").alias("context"))


def local_hits(hits: DataFrame) -> DataFrame:
    """Hits that may be cited: both a source and a paper."""
    return hits.filter(X.truthy(F.col("source")).isNotNull() & F.col("paper_id").isNotNull())
