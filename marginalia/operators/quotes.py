"""Which chunks of a paper hold a quote, without comparing every quote with every chunk.

All white-space tokens of a quote but its first and last are whole tokens of any text that holds it, so three inner tokens in a
row (an anchor) are a join key; quotes with fewer tokens take runs of characters. Of a quote's anchors the rarest in
its paper is joined, and what meets is tested on the whole quote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import text as X
from marginalia.session import materialize

INNER = 3
# Lengths of character runs; a short quote takes the longest that fits it.
RUNS = (8, 4, 2, 1)


def _token_anchors(tokens: Column, first: int, count: Column) -> Column:
    """Hashes of the runs of INNER tokens among the ``count`` tokens from ``first`` on."""
    starts = F.when(count >= INNER, F.sequence(F.lit(first), count + (first - INNER))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.lit(0), F.slice(tokens, i, INNER))))


def _character_anchors(text: Column, run: Column) -> Column:
    starts = F.when(F.length(text) >= run, F.sequence(F.lit(1), F.length(text) - run + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(run, F.substring(text, i, run))))


def _run_for(text: Column) -> Column:
    fitting = F.lit(RUNS[-1])
    for run in sorted(RUNS):
        fitting = F.when(F.length(text) >= run, F.lit(run)).otherwise(fitting)
    return fitting


def quote_hits(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quote_id, paper_id, chunk_index, n: the chunks of the paper that hold the quote, and how often without overlap.

    ``quotes(quote_id, paper_id, quote)``, ``chunks(paper_id, chunk_index, content)``. Empty and null quotes have no hit. A quote one of
    whose anchors no chunk of its paper has is in none and joins nothing. Only papers with a short quote are cut into character runs.
    """
    quotes = quotes.filter(F.length("quote") > 0).select("quote_id", "paper_id", "quote")
    tokens = X.white_tokens(F.col("quote"))
    known = quotes.withColumn("tokens", tokens).withColumn("long", F.size("tokens") >= INNER + 2)
    run = _run_for(F.col("quote"))
    anchors = F.when(F.col("long"), _token_anchors(F.col("tokens"), 2, F.size("tokens") - 2)).otherwise(_character_anchors(F.col("quote"), run))
    wanted = materialize(known.select("quote_id", "paper_id", F.when(~F.col("long"), run).alias("run"), F.explode(anchors).alias("anchor")), "anchors")

    texts = chunks.select("paper_id", "chunk_index", F.coalesce("content", F.lit("")).alias("content"))
    asked = texts.join(wanted.filter("run is null").select("paper_id").distinct(), "paper_id", "left_semi")
    whole = asked.withColumn("tokens", X.white_tokens(F.col("content"))).select("paper_id", "chunk_index", F.explode(_token_anchors(F.col("tokens"), 1, F.size("tokens"))).alias("anchor"))
    runs = wanted.filter("run is not null").select("paper_id", "run").distinct()
    cut = texts.join(runs, "paper_id").select("paper_id", "chunk_index", F.explode(_character_anchors(F.col("content"), F.col("run"))).alias("anchor"))
    # Only anchors some quote of the paper asks for are kept, and counted there.
    held = materialize(whole.unionByName(cut).join(wanted.select("paper_id", "anchor").distinct(), ["paper_id", "anchor"], "left_semi"), "anchored")
    counts = held.groupBy("paper_id", "anchor").agg(F.count(F.lit(1)).alias("held"))
    rarest = (wanted.join(counts, ["paper_id", "anchor"], "left").groupBy("quote_id", "paper_id")
              .agg(F.count(F.when(F.col("held").isNull(), 1)).alias("absent"), F.min_by("anchor", F.struct("held", "anchor")).alias("anchor"))
              .filter("absent = 0").select("quote_id", "paper_id", "anchor"))
    met = held.join(rarest, ["paper_id", "anchor"]).select("quote_id", "paper_id", "chunk_index")
    tested = met.join(texts, ["paper_id", "chunk_index"]).join(quotes, ["quote_id", "paper_id"]).filter(F.contains("content", F.col("quote")))
    return tested.select("quote_id", "paper_id", "chunk_index", X.occurrences(F.col("content"), F.col("quote")).alias("n"))
