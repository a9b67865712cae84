"""Lexical chunk retrieval over whole query tables: occurrence counts, BM25, neighbour boost."""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from marginalia.functions import scoring as S, text as X, vocabulary as V
from marginalia.operators import phrases
from marginalia.operators.blocks import block_of
from marginalia.schemas import chunk_id
from marginalia.session import bounded_rows, materialize


# Chunks of one paper that travel together; a neighbour pair is at most one block apart.
NEIGHBOR_BLOCK = 256


def top_k(scored: DataFrame, k: int, key: str = "chunk_id", group: str = "query_id",
          digits: int | None = 9) -> DataFrame:
    """Best ``k`` rows per query by score descending, then key as a string.

    Scores are rounded before ordering so that summation order cannot flip a tie. The row_number
    filter lets Spark cut each partition to ``k`` rows per query before the shuffle.
    """
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    window = W.partitionBy(group).orderBy(F.col("score").desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def query_term_table(queries: DataFrame, bilingual: dict | None = None) -> DataFrame:
    """``(query_id, term)`` distinct per query."""
    return queries.select("query_id", F.explode(X.query_terms(F.col("text"), bilingual)).alias("term"))


def tokenised(chunks: DataFrame) -> DataFrame:
    return chunks.select("paper_id", "chunk_index", X.technical_tokens(F.col("content")).alias("tokens"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: chunk count and mean token count, empty chunks included."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("avg_len"))


def postings(docs: DataFrame) -> DataFrame:
    """Term frequencies ``(paper_id, chunk_index, doc_len, term, tf)`` of tokenised chunks."""
    return (docs.select("paper_id", "chunk_index", F.size("tokens").alias("doc_len"),
                        F.explode("tokens").alias("term"))
            .groupBy("paper_id", "chunk_index", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf")))


def document_frequencies(posting: DataFrame) -> DataFrame:
    return posting.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _query_postings(docs: DataFrame, terms: DataFrame, halo: bool) -> DataFrame:
    """Postings of the query vocabulary, placed by block of neighbouring chunks.

    Only tokens some query asks for are shuffled, once. Later groupings, joins and windows all contain
    (paper_id, block), so they reuse this placement. With ``halo`` the edge chunks of a block are
    also sent to the adjacent block, which makes the neighbour window complete inside a block.
    """
    wanted = terms.select("term").distinct()
    own = block_of(F.col("chunk_index"), NEIGHBOR_BLOCK)
    if halo:
        blocks = F.array_distinct(F.array(
            own, block_of(F.col("chunk_index") - 1, NEIGHBOR_BLOCK), block_of(F.col("chunk_index") + 1, NEIGHBOR_BLOCK)))
    else:
        blocks = F.array(own)
    hits = (docs.select("paper_id", "chunk_index", F.size("tokens").alias("doc_len"),
                        F.explode("tokens").alias("term"))
            .join(wanted, "term", "left_semi")
            .withColumn("block", F.explode(blocks)))
    return (hits.repartition("paper_id", "block")
            .groupBy("paper_id", "block", "chunk_index", "doc_len", "term")
            .agg(F.count(F.lit(1)).alias("tf"))
            .withColumn("home", F.col("block") == block_of(F.col("chunk_index"), NEIGHBOR_BLOCK)))


CHUNK = ["paper_id", "block", "chunk_index"]
HITS = "query_id {q}, paper_id BIGINT, chunk_index INT, score DOUBLE"
# Most (query, term) rows sent to every executor, about 50 bytes each.
BROADCAST_TERMS = 1_000_000


def bm25_scores(chunks: DataFrame, queries: DataFrame, bilingual: dict | None = None,
                neighbor_weight: float | None = None, k1: float = V.BM25_K1, b: float = V.BM25_B) -> DataFrame:
    """BM25 of every (query, chunk) pair that shares a term: ``query_id, paper_id, chunk_index, score``.

    With ``neighbor_weight`` the score also takes that share of the scores of the chunks directly
    before and after it in the same paper. The query side may have any size: all joins are by term.
    """
    docs = tokenised(chunks)
    terms = query_term_table(queries, bilingual)
    stats = corpus_stats(docs)
    n_docs, avg_len = stats.select("n_docs").scalar(), stats.select("avg_len").scalar()
    tf = _query_postings(docs, terms, halo=neighbor_weight is not None)
    df = document_frequencies(tf.filter("home"))
    idf = df.select("term", F.log(F.lit(1.0) + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / avg_len
    scored = (tf.join(terms.join(idf, "term"), "term")
              .groupBy(*CHUNK, "home", "query_id")
              .agg(F.sum(F.col("idf") * (F.col("tf") * (k1 + 1.0)) / (F.col("tf") + k1 * norm)).alias("score")))
    if neighbor_weight is not None:
        here = W.partitionBy("paper_id", "block", "query_id").orderBy("chunk_index")

        def beside(shift):
            index, score = F.lag("chunk_index", shift).over(here), F.lag("score", shift).over(here)
            return F.when(index == F.col("chunk_index") - shift, score).otherwise(0.0)
        scored = scored.withColumn("boost", beside(1) + beside(-1)).withColumn(
            "score", F.col("score") + neighbor_weight * F.col("boost"))
    return scored.filter(F.col("home") & (F.col("score") > 0)).select(
        "query_id", "paper_id", "chunk_index", "score")


def vocabulary_stats(docs: DataFrame, vocabulary) -> tuple[int, float, dict]:
    """(chunk count, mean length, document frequency per vocabulary position), one pass, no shuffle of
    the corpus: each task sends its counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = pa.array(vocabulary.value, pa.string())
        df, rows, length = np.zeros(len(words), dtype=np.int64), 0, 0
        for batch in batches:
            _, term, _ = S.term_counts(batch["tokens"], words)
            df += np.bincount(term, minlength=len(words))
            rows += batch.num_rows
            length += int(np.asarray(batch["doc_len"]).sum())
        keep = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([keep, [-1, -2]]), pa.int64()), pa.array(np.concatenate([df[keep], [rows, length]]), pa.int64())],
            names=["term", "n"])
    total = dict(docs.mapInArrow(count, "term BIGINT, n BIGINT").groupBy("term").agg(F.sum("n").alias("n")).collect())
    n_docs = total.pop(-1, 0)
    return n_docs, (total.pop(-2, 0) / n_docs if n_docs else 0.0), total


def bm25_search(chunks: DataFrame, queries: DataFrame, k: int = 20, bilingual: dict | None = None,
                neighbor_weight: float | None = None, k1: float = V.BM25_K1, b: float = V.BM25_B,
                max_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Top ``k`` chunks per query, exact; ``source`` names the profile.

    A query table within ``max_terms`` (query, term) rows goes to the executors: one pass counts
    document frequencies, a second scores each batch of chunks where it lies and emits the batch's best
    ``k`` per query. The neighbour profile first places chunks by paper block. A larger query table takes
    the join plan of ``bm25_scores``.
    """
    source = "keyword-bm25" if neighbor_weight is None else "keyword-bm25-bilingual-neighbor"
    terms = query_term_table(queries, bilingual)
    if bounded_rows(terms, max_terms, "term") is None:
        scored = bm25_scores(chunks, queries, bilingual, neighbor_weight, k1, b)
    else:
        scored = _bm25_batches(chunks, terms, k, neighbor_weight, k1, b)
    return top_k(scored.withColumn("chunk_id", chunk_id()), k).withColumn("source", F.lit(source)).select(
        "query_id", "rank", "chunk_id", "paper_id", "chunk_index", "score", "source")


def _bm25_batches(chunks: DataFrame, terms: DataFrame, k: int, neighbor_weight: float | None, k1: float,
                  b: float) -> DataFrame:
    schema = HITS.format(q=terms.schema["query_id"].dataType.simpleString())
    docs = tokenised(chunks).select("paper_id", "chunk_index", F.size("tokens").alias("doc_len"), "tokens")
    log_odds = lambda n, df: math.log(1.0 + (n - df + 0.5) / (df + 0.5))
    return _score_batches(docs, terms, k, k1, b, log_odds, schema, neighbor_weight)


def _score_batches(docs: DataFrame, terms: DataFrame, k: int, k1: float, b: float, term_weight, schema: str,
                   neighbor_weight: float | None = None, all_terms: bool = False) -> DataFrame:
    rows = [tuple(r) for r in terms.select("query_id", "term").collect()]
    if not rows:
        return terms.sparkSession.createDataFrame([], schema)
    sc = terms.sparkSession.sparkContext
    words = sc.broadcast(sorted({r[1] for r in rows}))
    n_docs, avg_len, df = vocabulary_stats(docs, words)
    if not avg_len:
        return terms.sparkSession.createDataFrame([], schema)
    idf = {w: term_weight(n_docs, df.get(i, 0)) for i, w in enumerate(words.value)}
    matrix = S.query_matrix([(q, t, idf[t]) for q, t in rows])
    needed = np.bincount(matrix.query, minlength=len(matrix.query_ids)) if all_terms else None
    shared = sc.broadcast((matrix, needed))

    def saturate(count, length):
        return count * (k1 + 1.0) / (count + k1 * (1.0 - b + b * length / avg_len))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, needed = shared.value
        vocabulary, best = pa.array(matrix.terms, pa.string()), S.Best(len(matrix.query_ids), k)
        tables = (pa.Table.from_batches([x]) for x in batches) if neighbor_weight is None else S.whole_groups(
            batches, ["paper_id", "block"])
        for table in tables:
            if table.num_rows:
                yield from S.score_batch(table, matrix, vocabulary, saturate, k, neighbor_weight, needed, best)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(shared.value[0].terms, pa.string())
        for batch in batches:
            yield S.only_known(batch, "tokens", vocabulary)

    if neighbor_weight is not None:
        # Only words some query asks for travel to their paper's block; lengths were counted before.
        docs = docs.mapInArrow(known, docs.schema)
        own = block_of(F.col("chunk_index"), NEIGHBOR_BLOCK)
        near = [block_of(F.col("chunk_index") + d, NEIGHBOR_BLOCK) for d in (-1, 1)]
        docs = (docs.withColumn("home_block", own).withColumn("block", F.explode(F.array_distinct(F.array(own, *near))))
                .withColumn("home", F.col("block") == F.col("home_block")).drop("home_block")
                .repartition("paper_id", "block").sortWithinPartitions(*CHUNK))
    return docs.mapInArrow(score, schema)


def count_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Occurrence score: for every query token (repeats count) its occurrences as a substring.

    A token holds no white space, so each occurrence lies inside one white-space word. Tokens are
    therefore matched against the distinct words of the corpus: the substrings of a word whose
    lengths occur among the tokens are joined by equality, and only (chunk, word) counts meet
    the matches. No chunk is paired with a query it shares nothing with.
    """
    tokens = (queries.select("query_id", F.explode(X.white_tokens(F.col("text"))).alias("token"))
              .select("query_id", F.lower("token").alias("token"))
              .groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times")))
    lengths = tokens.agg(F.collect_set(F.length("token")).alias("ns")).select("ns").scalar()
    words = (chunks.select("paper_id", "chunk_index", F.explode(
                X.white_tokens(F.lower(F.coalesce("content", F.lit(""))))).alias("word")))
    vocabulary = words.select("word").distinct()
    pieces = (vocabulary.withColumn("n", F.explode(lengths))
              .filter(F.length("word") >= F.col("n"))
              .withColumn("token", F.explode(F.array_distinct(F.transform(
                  F.sequence(F.lit(1), F.length("word") - F.col("n") + 1),
                  lambda i: F.substring(F.col("word"), i, F.col("n")))))))
    matches = (pieces.join(tokens.select("token").distinct(), "token", "left_semi")
               .select("word", "token", X.occurrences(F.col("word"), F.col("token")).alias("times_in_word")))
    per_chunk = (words.join(matches.select("word").distinct(), "word", "left_semi")
                 .repartition("paper_id", "chunk_index")
                 .groupBy("paper_id", "chunk_index", "word").agg(F.count(F.lit(1)).alias("n"))
                 .join(matches, "word")
                 .groupBy("paper_id", "chunk_index", "token")
                 .agg(F.sum(F.col("n") * F.col("times_in_word")).alias("n")))
    return (per_chunk.join(tokens, "token")
            .groupBy("paper_id", "chunk_index", "query_id")
            .agg(F.sum(F.col("n") * F.col("times")).alias("score"))
            .select("query_id", "paper_id", "chunk_index", F.col("score").cast("double").alias("score")))


def count_search(chunks: DataFrame, queries: DataFrame, k: int = 20, max_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Top ``k`` chunks by occurrence score.

    Query tokens within ``max_terms`` rows become one string automaton per worker; every batch of chunks is
    matched and scored where it lies. A larger query table takes the join plan of ``count_scores``.
    """
    tokens = (queries.select("query_id", F.explode(X.white_tokens(F.col("text"))).alias("token"))
              .groupBy("query_id", F.lower("token").alias("token")).agg(F.count(F.lit(1)).alias("times")))
    if bounded_rows(tokens, max_terms, "token") is None:
        scored = count_scores(chunks, queries)
    else:
        scored = _count_batches(chunks, tokens, k)
    return top_k(scored.withColumn("chunk_id", chunk_id()), k, digits=None).withColumn("source", F.lit("keyword")).select(
        "query_id", "rank", "chunk_id", "paper_id", "chunk_index", "score", "source")


def _count_batches(chunks: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    schema = HITS.format(q=tokens.schema["query_id"].dataType.simpleString())
    rows = [(r["query_id"], r["token"], float(r["times"])) for r in tokens.collect()]
    if not rows:
        return tokens.sparkSession.createDataFrame([], schema)
    shared = tokens.sparkSession.sparkContext.broadcast(S.query_matrix(rows))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        automaton = ahocorasick.Automaton()
        for i, token in enumerate(matrix.terms):
            automaton.add_word(token, i)
        automaton.make_automaton()
        looped = np.array([S.overlaps_itself(token) for token in matrix.terms])
        best = S.Best(len(matrix.query_ids), k)
        for batch in batches:
            if batch.num_rows:
                paper, index = np.asarray(batch["paper_id"]), np.asarray(batch["chunk_index"])
                row, term, value = S.count_tokens_in_words(batch["tokens"], automaton, matrix.terms, looped)
                yield from S.best_of_batch(row, term, value, paper, index, matrix, k, best)

    words = X.white_tokens(F.lower(F.coalesce("content", F.lit(""))))
    return chunks.select("paper_id", "chunk_index", words.alias("tokens")).mapInArrow(score, schema)


def keyword_scores(docs: DataFrame, terms: DataFrame, k1: float, b: float) -> DataFrame:
    """(query, paper) pairs that hold every word of the query, by joins; for query tables of any size.

    Only papers with the rarest word of a query are looked at.
    """
    stats = corpus_stats(docs)
    n_docs, avg_len = stats.select("n_docs").scalar(), stats.select("avg_len").scalar()
    tf = (docs.select("paper_id", F.size("tokens").alias("doc_len"), F.explode("tokens").alias("term"))
          .join(terms.select("term").distinct(), "term", "left_semi")
          .repartition("paper_id").groupBy("paper_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf")))
    raw_idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    df = document_frequencies(tf).select("term", "df", F.when(raw_idf > 0, raw_idf).otherwise(1e-6).alias("idf"))
    known = terms.join(df, "term")
    needed = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    rarest = (known.groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term"), F.count(F.lit(1)).alias("n_known"))
              .join(needed, "query_id").filter(F.col("n_known") == F.col("n_terms")).select("query_id", "term", "n_terms"))
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") / avg_len
    pairs = tf.select("paper_id", "term").join(rarest, "term").select("paper_id", "query_id", "n_terms")
    return (pairs.join(tf, "paper_id").join(known.select("query_id", "term", "idf"), ["query_id", "term"])
            .groupBy("paper_id", "query_id", "n_terms")
            .agg(F.count(F.lit(1)).alias("n_found"),
                 F.sum(F.col("idf") * (F.col("tf") * (k1 + 1.0)) / (F.col("tf") + k1 * norm)).alias("score"))
            .filter(F.col("n_found") == F.col("n_terms")).select("query_id", "paper_id", "score"))


def keyword_search(papers: DataFrame, queries: DataFrame, k: int = 20, k1: float = V.BM25_K1,
                   b: float = V.KEYWORD_B, max_terms: int = BROADCAST_TERMS) -> DataFrame:
    """Paper search: every query word must occur in title, authors or abstract, and the words of a token with a separator
    inside side by side in one of them; BM25 order.

    Queries of single words only take the cheaper word plans. Returns paper-level hits with score 0.0, content = abstract or title. A word in more than half of the
    papers keeps a tiny positive weight.
    """
    phrased = F.exists(X.keyword_phrases(F.col("text")), lambda p: F.size(p) > 1)
    together = materialize(phrases.query_phrases(queries.filter(phrased)), "phrases")
    queries = queries.filter(~phrased)
    terms = queries.select("query_id", F.explode(X.keyword_query(F.col("text"))).alias("term"))
    docs = papers.select(F.col("id").alias("paper_id"), X.words(
        F.concat_ws(" ", "title", "authors", "abstract")).alias("tokens"))
    if bounded_rows(terms, max_terms, "term") is None:
        matched = keyword_scores(docs, terms, k1, b)
    else:
        rows = docs.select("paper_id", F.lit(0).alias("chunk_index"), F.size("tokens").alias("doc_len"), "tokens")
        odds = lambda n, df: max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
        matched = _score_batches(rows, terms, k, k1, b, odds, HITS.format(
            q=terms.schema["query_id"].dataType.simpleString()), all_terms=True)
    if not together.isEmpty():
        matched = matched.select("query_id", "paper_id", "score").unionByName(phrases.phrase_scores(papers, together, k1, b))
    window = W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("paper_id").asc())
    best = matched.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    best = materialize(best.select("query_id", "rank", "paper_id"), "winners")  # few rows of known size, joined to the texts last
    return (best
            .join(papers.withColumnRenamed("id", "paper_id"), "paper_id")
            .select("query_id", "rank", F.lit(None).cast("string").alias("chunk_id"), "paper_id", "title",
                    "authors", "year",
                    F.coalesce(X.truthy(F.col("abstract")), F.col("title"), F.lit("")).alias("content"),
                    F.lit(None).cast("int").alias("page_number"), F.lit("abstract").alias("chunk_type"),
                    F.lit(0.0).alias("score"), F.lit("keyword").alias("source")))
