"""Candidate question sets: material sampling and filtering of generated items."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from marginalia.functions import answers as A, text as X, vocabulary as V
from marginalia.operators.blocks import block_of, row_numbers
from marginalia.operators.quotes import quote_hits
from marginalia.session import materialize

MATERIAL_CHARS = 9000
ITEM = ("STRUCT<question: STRING, ground_truth: STRING, question_type: STRING, evidence_quote: STRING,"
        " excerpts: ARRAY<STRING>, locators: ARRAY<STRUCT<paper_id: BIGINT, excerpts: ARRAY<STRING>>>>")


def sample_positions(n):
    """First, middle, last, then five even positions (half-even rounding), distinct, 0-based."""
    last = n - 1
    even = [F.bround(F.lit(i) * last / F.lit(6.0), 0) for i in range(1, 6)]
    return F.array_distinct(F.array(F.lit(0).cast("bigint"), F.floor(n / 2), last.cast("bigint"),
                                    *[e.cast("bigint") for e in even]))


def material(papers: DataFrame, chunks: DataFrame, budget: int = MATERIAL_CHARS) -> DataFrame:
    """Text sent to the generator per paper: title, abstract, and up to eight spread excerpts that fit
    ``budget`` characters: ``(paper_id, material)``.

    Positions come from block-wise numbering, so a very long paper is never sorted in one task; at
    most eight chunks per paper are gathered.
    """
    kept = chunks.filter(X.non_blank(F.col("content"))).select("paper_id", "chunk_index", "content")
    counts = kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.select("paper_id", F.posexplode(sample_positions(F.col("n"))).alias("turn", "position"))
    numbered = row_numbers(kept.withColumn("block", block_of(F.col("chunk_index"))), ["paper_id"], ["chunk_index"],
                           "block", "position")
    picked = numbered.join(wanted, ["paper_id", "position"]).select("paper_id", "turn", X.strip(F.col("content")).alias("c"))
    lists = picked.groupBy("paper_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "c"))), lambda p: p["c"]).alias("cs"))
    head = F.array_compact(F.array(
        F.concat(F.lit("论文标题: "), F.coalesce(X.truthy(F.col("title")), F.lit("(无标题)"))),
        F.concat(F.lit("摘要: "), X.truthy(X.strip(F.coalesce("abstract", F.lit("")))))))
    used = F.aggregate("head", F.lit(0), lambda a, h: a + F.length(h))
    share = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0), budget - F.col("used") - 4 * F.size("cs")) / F.size("cs"))).cast("int")
    start = F.struct(F.col("head").alias("parts"), F.col("used").cast("int").alias("used"))

    def take(acc, text):
        room = F.lit(budget) - acc["used"] - 2
        piece = F.left(text, F.least(F.col("share"), room))
        return F.when(room > 0, F.struct(F.concat(acc["parts"], F.array(piece)).alias("parts"),
                                         (acc["used"] + F.length(piece) + 2).cast("int").alias("used"))).otherwise(acc)
    return (papers.select(F.col("id").alias("paper_id"), "title", "abstract").join(lists, "paper_id", "left")
            .withColumn("cs", F.coalesce("cs", F.array().cast("array<string>")))
            .withColumn("head", head).withColumn("used", used)
            .withColumn("share", F.when(F.size("cs") > 0, share).otherwise(F.lit(1)))
            .select("paper_id", F.array_join(F.aggregate("cs", start, take)["parts"], "\n\n").alias("material")))


def raw_items(responses: DataFrame) -> DataFrame:
    """Items of generator responses ``(paper_id, response)`` that parse: ``paper_id, pos, …``."""
    parsed = responses.withColumn("_json", A.salvage_json(F.col("response")))
    return (parsed.filter(F.col("_json").isNotNull())
            .select("paper_id", F.posexplode(A.payload_items(F.col("_json"), ITEM)).alias("pos", "item"))
            .select("paper_id", "pos", "item.*"))


def _well_formed(items: DataFrame) -> DataFrame:
    return items.filter(X.non_blank(F.col("question")) & X.non_blank(F.col("ground_truth"))
                        & F.col("question_type").isin(V.GENERATED_TYPES))


def quote_counts(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """Exact occurrences of each item's quote over the chunks of its paper: ``(paper_id, pos, n)``."""
    asked = items.select(F.col("pos").alias("quote_id"), "paper_id", X.strip(F.col("evidence_quote")).alias("quote"))
    hits = quote_hits(asked, chunks)
    return hits.groupBy("paper_id", F.col("quote_id").alias("pos")).agg(F.sum("n").alias("n"))


def accepted_by_quote(items: DataFrame, chunks: DataFrame, paper_uids: DataFrame) -> DataFrame:
    """Candidates whose quote has 20..500 characters and occurs exactly once in the paper's chunks.

    ``qa_id`` counts accepted items of the paper only. The items are written once: the search reads them several times, and
    each time the responses would be parsed anew.
    """
    good = _well_formed(items).withColumn("quote", X.strip(F.col("evidence_quote"))).filter(
        F.length("quote").between(20, 500))
    good = materialize(good.select("paper_id", "pos", "question", "ground_truth", "question_type", "evidence_quote", "quote"), "items")
    unique = quote_counts(good, chunks).filter(F.col("n") == 1).select("paper_id", "pos")
    kept = good.join(unique, ["paper_id", "pos"], "left_semi").join(
        paper_uids.select("paper_id", "paper_uid"), "paper_id")
    evidence = F.array(F.struct("paper_uid", "quote"))
    return _numbered(kept).select("paper_id", *_columns(), evidence.alias("relevant_evidence"))


def _numbered(kept: DataFrame) -> DataFrame:
    # Items of one response: a handful per paper.
    window = W.partitionBy("paper_id").orderBy("pos")
    return kept.withColumn("qa_id", F.concat(F.lit("gen-p"), F.col("paper_id").cast("string"), F.lit("-"),
                                             F.lpad(F.row_number().over(window).cast("string"), 3, "0")))


def _columns():
    return ["qa_id", X.strip(F.col("question")).alias("question"), X.strip(F.col("ground_truth")).alias("ground_truth"),
            "question_type", F.lit("llm_generated").alias("source"), F.lit(True).alias("has_answer"),
            F.lit(False).alias("reviewed")]


def verified_excerpts(excerpts: DataFrame, full_texts: DataFrame, keys: list[str], keep: int = 3) -> DataFrame:
    """First ``keep`` distinct excerpts (8+ characters) found in the paper's normalised text.

    ``excerpts(*keys, paper_id, pos_excerpt, excerpt)``; normalised = lower case, white space collapsed.
    """
    rows = (excerpts.withColumn("excerpt", X.strip(F.col("excerpt"))).filter(F.length("excerpt") >= 8)
            .groupBy(*keys, "paper_id", "excerpt").agg(F.min("pos_excerpt").alias("pos_excerpt")))
    texts = full_texts.select("paper_id", X.collapse(F.lower("text")).alias("norm"))
    # Each text travels once; adaptive execution splits the excerpts of a hot paper.
    found = rows.join(texts, "paper_id").filter(
        F.contains("norm", X.collapse(F.lower("excerpt")))).drop("norm")
    ranked = found.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "paper_id").orderBy("pos_excerpt")))
    return (ranked.filter(F.col("_n") <= keep).groupBy(*keys, "paper_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "excerpt"))), lambda e: e["excerpt"]).alias("keywords")))


def accepted_by_excerpts(items: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Legacy candidates: at least one excerpt of the item occurs in its paper."""
    good = _well_formed(items)
    excerpts = good.select("paper_id", "pos", F.posexplode("excerpts").alias("pos_excerpt", "excerpt"))
    verified = verified_excerpts(excerpts, full_texts, ["pos"])
    kept = good.join(verified, ["paper_id", "pos"])
    locator = F.array(F.struct("paper_id", "keywords"))
    return _numbered(kept).select("paper_id", *_columns(), locator.alias("relevant_chunks"))


def accepted_cross_paper(items: DataFrame, full_texts: DataFrame) -> DataFrame:
    """Comparison items with verified excerpts from at least two located papers; ids keep the position.

    ``items`` carries ``response_id`` instead of a paper.
    """
    good = _well_formed(items).filter(F.col("question_type") == "comparison")
    locs = good.select("response_id", "pos", F.posexplode("locators").alias("pos_loc", "loc"))
    excerpts = locs.select("response_id", "pos", "pos_loc", F.col("loc.paper_id").alias("paper_id"),
                           F.posexplode("loc.excerpts").alias("pos_excerpt", "excerpt"))
    verified = verified_excerpts(excerpts, full_texts, ["response_id", "pos", "pos_loc"])
    located = (verified.groupBy("response_id", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos_loc", "paper_id", "keywords"))),
                    lambda x: F.struct(x["paper_id"].alias("paper_id"), x["keywords"].alias("keywords"))).alias("relevant_chunks"))
        .filter(F.col("n") >= 2))
    kept = good.join(located, ["response_id", "pos"]).withColumn(
        "qa_id", F.concat(F.lit("gen-cross-"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")))
    return kept.select("response_id", *_columns(), "relevant_chunks")


def remaining_papers(paper_ids: DataFrame, done_items: DataFrame) -> DataFrame:
    """Papers without an item in an earlier output."""
    done = done_items.select(F.regexp_extract("qa_id", r"(?U)\Agen-p(\d+)-", 1).alias("p")).filter(F.col("p") != "")
    return paper_ids.join(done.select(F.col("p").cast("bigint").alias("paper_id")).distinct(), "paper_id", "left_anti")


def type_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"))


def paper_status(paper_ids: DataFrame, items: DataFrame) -> DataFrame:
    """Per paper whether any item was accepted and how many."""
    counts = items.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    return paper_ids.join(counts, "paper_id", "left").select(
        "paper_id", F.col("n").isNotNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n"))


def promote(items: DataFrame) -> DataFrame:
    """Reviewed candidates as benchmark items."""
    return items.drop("reviewed").withColumn("source", F.lit("imported_paper"))
