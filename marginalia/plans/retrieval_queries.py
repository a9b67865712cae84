"""Retrieval, fusion and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X, vectors as VX, vocabulary as V
from marginalia.operators import evaluate as E, fusion, ingest, lexical, phrases, retrieve as R, vector
from marginalia.plans import tables as T
from marginalia.plans.registry import query
from marginalia.plans.tables import SQL
from marginalia.schemas import chunk_id
from marginalia.session import materialize

TOKEN = "'[A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*%?'"


def _bm25_sql(name: str, chunks: str) -> None:
    """Expressions ``<name>_docs … <name>_scored`` over a chunk expression."""
    SQL[f"{name}_docs"] = f"""
SELECT paper_id, chunk_index, list_transform(regexp_extract_all(content, {TOKEN}), lambda t: lower(t)) AS toks FROM {chunks}"""
    SQL[f"{name}_stats"] = f"SELECT count(*) AS n, avg(len(toks)) AS a FROM {name}_docs"
    SQL[f"{name}_post"] = f"""
SELECT paper_id, chunk_index, dl, term, count(*) AS tf
FROM (SELECT paper_id, chunk_index, len(toks) AS dl, unnest(toks) AS term FROM {name}_docs) GROUP BY ALL"""
    SQL[f"{name}_df"] = f"SELECT term, count(*) AS df FROM {name}_post GROUP BY term"
    SQL[f"{name}_scored"] = f"""
SELECT q.query_id, p.paper_id, p.chunk_index, 'p' || p.paper_id || '_c' || p.chunk_index AS chunk_id,
       sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.1 + 0.9 * p.dl / s.a))) AS score
FROM query_terms q JOIN {name}_post p USING (term) JOIN {name}_df d USING (term) CROSS JOIN {name}_stats s
GROUP BY q.query_id, p.paper_id, p.chunk_index"""


SQL["query_terms"] = f"""
SELECT query_id, unnest(list_distinct(list_transform(regexp_extract_all(text, {TOKEN}), lambda t: lower(t)))) AS term
FROM query_table"""
_bm25_sql("bm", "line_chunks")
_bm25_sql("pb", "para_chunks")

TOP = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {src}) WHERE rank <= {k}"""


def _ranked(df):
    return df.select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query("bm25_top5", TOP.format(src="bm_scored", k=5))
def bm25_top5(spark, sf):
    return _ranked(lexical.bm25_search(T.line_chunks(spark, sf), T.query_table(spark, sf), 5))


SQL["bm_near"] = """
SELECT a.query_id, a.paper_id, a.chunk_index, a.chunk_id,
       a.score + 0.5 * (coalesce(b.score, 0) + coalesce(c.score, 0)) AS score
FROM bm_scored a
LEFT JOIN bm_scored b ON a.query_id = b.query_id AND a.paper_id = b.paper_id AND b.chunk_index = a.chunk_index - 1
LEFT JOIN bm_scored c ON a.query_id = c.query_id AND a.paper_id = c.paper_id AND c.chunk_index = a.chunk_index + 1"""


@query("bm25_neighbor_top5", TOP.format(src="bm_near", k=5))
def bm25_neighbor_top5(spark, sf):
    return _ranked(lexical.bm25_search(T.line_chunks(spark, sf), T.query_table(spark, sf), 5,
                                       bilingual=V.BILINGUAL_TERMS, neighbor_weight=0.5))


# Bilingual expansion: the source phrases are the first words of the parts' names.
_PART_TERMS = {"ring": ["the", "thion"], "the": ["erst", "of"], "de": ["la"], "der": ["und", "die"]}
SQL["wide_terms"] = f"""
SELECT query_id, unnest(list_distinct(list_concat(
  list_transform(regexp_extract_all(text, {TOKEN}), lambda t: lower(t)),
  """ + ", ".join(f"CASE WHEN contains(text, '{k}') THEN {v} ELSE []::VARCHAR[] END" for k, v in _PART_TERMS.items()) + """))) AS term
FROM query_table"""
SQL["wide_scored"] = SQL["bm_scored"].replace("query_terms", "wide_terms")


@query("bm25_bilingual_top5", TOP.format(src="wide_scored", k=5))
def bm25_bilingual_top5(spark, sf):
    return _ranked(lexical.bm25_search(T.line_chunks(spark, sf), T.query_table(spark, sf), 5, bilingual=_PART_TERMS))


@query("bilingual_query_terms", "SELECT query_id, term FROM wide_terms")
def bilingual_query_terms(spark, sf):
    return lexical.query_term_table(T.query_table(spark, sf), _PART_TERMS)


SQL["count_tokens"] = """
SELECT query_id, lower(unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: length(t) > 0))) AS token FROM query_table"""
SQL["count_scored"] = """
SELECT query_id, paper_id, chunk_index, 'p' || paper_id || '_c' || chunk_index AS chunk_id, CAST(sum(n) AS DOUBLE) AS score FROM (
  SELECT t.query_id, c.paper_id, c.chunk_index,
         t.times * ((length(c.low) - length(replace(c.low, t.token, ''))) // length(t.token)) AS n
  FROM (SELECT query_id, token, count(*) AS times FROM count_tokens GROUP BY ALL) t
  JOIN (SELECT paper_id, chunk_index, lower(content) AS low FROM line_chunks) c ON contains(c.low, t.token))
GROUP BY query_id, paper_id, chunk_index"""


@query("count_score_top5", TOP.format(src="count_scored", k=5))
def count_score_top5(spark, sf):
    return _ranked(lexical.count_search(T.line_chunks(spark, sf), T.query_table(spark, sf), 5))


SQL["kw_docs"] = """
SELECT id AS paper_id, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, authors, abstract))), '[\\p{L}\\p{N}]+') AS toks
FROM document_papers"""
SQL["kw_terms"] = """
SELECT query_id, unnest(list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+'))) AS term FROM query_table"""
SQL["kw_post"] = """
SELECT paper_id, dl, term, count(*) AS tf FROM (SELECT paper_id, len(toks) AS dl, unnest(toks) AS term FROM kw_docs) GROUP BY ALL"""
SQL["kw_scored"] = """
SELECT q.query_id, p.paper_id, count(*) AS found,
       sum(greatest(CASE WHEN d.df * 2 >= s.n THEN 1e-6 ELSE ln((s.n - d.df + 0.5) / (d.df + 0.5)) END, 1e-6)
           * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.a))) AS score
FROM kw_terms q JOIN kw_post p USING (term) JOIN (SELECT term, count(*) AS df FROM kw_post GROUP BY term) d USING (term)
CROSS JOIN (SELECT count(*) AS n, avg(len(toks)) AS a FROM kw_docs) s GROUP BY q.query_id, p.paper_id"""
SQL["kw_ranked"] = """
SELECT s.query_id, s.paper_id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.paper_id) AS rank
FROM kw_scored s JOIN (SELECT query_id, count(*) AS n FROM kw_terms GROUP BY 1) t ON s.query_id = t.query_id AND s.found = t.n"""


@query("keyword_and_search", """
SELECT r.query_id, CAST(r.rank AS INTEGER) AS rank, r.paper_id, p.title, p.authors, p.year,
       coalesce(nullif(p.abstract, ''), p.title, '') AS content, 'keyword' AS source
FROM kw_ranked r JOIN document_papers p ON p.id = r.paper_id WHERE r.rank <= 20""")
def keyword_and_search(spark, sf):
    hits = lexical.keyword_search(T.document_papers(spark, sf), T.query_table(spark, sf), 20)
    return hits.select("query_id", "rank", "paper_id", "title", "authors", "year", "content", "source")


# Phrases: positions of words, and where the differences of position and offset agree.
SQL["ph_lists"] = """
SELECT query_id, list_distinct(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '["*^:()@~<>$\\|+=\\[\\]{}!?,.;#%&/-]', ' ', 'g'), '\\s+'),
                                             lambda t: regexp_extract_all(strip_accents(lower(t)), '[\\p{L}\\p{N}]+')), lambda p: len(p) > 0)) AS phrases FROM phrase_queries"""
SQL["ph_query"] = "SELECT query_id, unnest(phrases) AS words FROM ph_lists"
SQL["ph_parts"] = "SELECT words, len(words) AS n, unnest(range(len(words))) AS off, unnest(words) AS term FROM (SELECT DISTINCT words FROM ph_query)"
SQL["ph_fields"] = """
SELECT id AS paper_id, field, regexp_extract_all(strip_accents(lower(coalesce(value, ''))), '[\\p{L}\\p{N}]+') AS toks
FROM (SELECT id, unnest([0, 1, 2]) AS field, unnest([title, authors, abstract]) AS value FROM document_papers)"""
SQL["ph_positions"] = "SELECT paper_id, field, unnest(range(len(toks))) AS pos, unnest(toks) AS term FROM ph_fields"
SQL["ph_counts"] = """
SELECT words, paper_id, count(*) AS tf FROM (
  SELECT words, n, paper_id, field, pos - off AS start, count(*) AS k FROM ph_parts JOIN ph_positions USING (term) GROUP BY ALL) WHERE k = n GROUP BY ALL"""
SQL["ph_scored"] = """
SELECT q.query_id, c.paper_id, count(*) AS found,
       sum(greatest(CASE WHEN d.df * 2 >= s.n THEN 1e-6 ELSE ln((s.n - d.df + 0.5) / (d.df + 0.5)) END, 1e-6)
           * (c.tf * 2.2) / (c.tf + 1.2 * (0.25 + 0.75 * l.dl / s.a))) AS score
FROM ph_query q JOIN ph_counts c USING (words) JOIN (SELECT words, count(*) AS df FROM ph_counts GROUP BY 1) d USING (words)
JOIN (SELECT paper_id, sum(len(toks)) AS dl FROM ph_fields GROUP BY 1) l USING (paper_id)
CROSS JOIN (SELECT count(DISTINCT paper_id) AS n, sum(len(toks)) / count(DISTINCT paper_id) AS a FROM ph_fields) s GROUP BY q.query_id, c.paper_id"""


@query("phrase_and_search", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id FROM (
  SELECT s.query_id, s.paper_id, row_number() OVER (PARTITION BY s.query_id ORDER BY round(s.score, 9) DESC, s.paper_id) AS rank
  FROM ph_scored s JOIN ph_lists t ON s.query_id = t.query_id AND s.found = len(t.phrases)) WHERE rank <= 20""")
def phrase_and_search(spark, sf):
    """Whole passages as phrases of three words each; papers that hold all phrases."""
    return lexical.keyword_search(T.document_papers(spark, sf), T.phrase_queries(spark, sf), 20).select("query_id", "rank", "paper_id")


@query("phrase_occurrences", """
SELECT array_to_string(words, ' ') AS phrase, paper_id, CAST(tf AS BIGINT) AS tf FROM ph_counts""")
def phrase_occurrences(spark, sf):
    """Places of every phrase of the passages in all papers, as their whole texts hold them."""
    wanted = phrases.query_phrases(T.phrase_queries(spark, sf)).select("phrase", "words").distinct()
    return phrases.phrase_counts(T.document_papers(spark, sf), wanted)


@query("sanitized_phrases", """
SELECT query_id, CAST(len(phrases) AS BIGINT) AS n_phrases, array_to_string(list_sort(list_transform(phrases, lambda p: array_to_string(p, ' '))), ' + ') AS phrases FROM ph_lists""")
def sanitized_phrases(spark, sf):
    q = T.phrase_queries(spark, sf).select("query_id", X.keyword_phrases(F.col("text")).alias("p"))
    return q.select("query_id", F.size("p").cast("bigint").alias("n_phrases"),
                    F.array_join(F.array_sort(F.transform("p", lambda p: F.array_join(p, " "))), " + ").alias("phrases"))


@query("technical_tokens", f"""
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, CAST(len(list_distinct(toks)) AS BIGINT) AS n_distinct,
       md5(coalesce(array_to_string(toks, ' '), '')) AS tokens_hash
FROM (SELECT doc_id, list_transform(regexp_extract_all(text, {TOKEN}), lambda t: lower(t)) AS toks FROM documents)""")
def technical_tokens(spark, sf):
    d = T.spread(T.table(spark, sf, "documents").select("doc_id", "text"))
    toks = X.technical_tokens(F.col("text"))
    return d.select("doc_id", toks.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_hash"))


@query("sanitized_queries", """
SELECT query_id, CAST(len(t) AS BIGINT) AS n_terms, array_to_string(t, ' ') AS terms FROM (
  SELECT query_id, list_filter(string_split(trim(regexp_replace(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' '), lambda x: length(x) > 0) AS t FROM query_table)""")
def sanitized_queries(spark, sf):
    q = T.query_table(spark, sf).select("query_id", X.words(F.regexp_replace("text", V.KEYWORD_SPECIAL, " ")).alias("t"))
    return q.select("query_id", F.size("t").cast("bigint").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query("term_statistics", """
SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS cf, CAST(max(tf) AS BIGINT) AS max_tf FROM bm_post GROUP BY term""")
def term_statistics(spark, sf):
    post = lexical.postings(lexical.tokenised(T.line_chunks(spark, sf)))
    return post.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query("corpus_statistics", "SELECT CAST(n AS BIGINT) AS n_docs, round(a, 9) AS avg_len FROM bm_stats")
def corpus_statistics(spark, sf):
    s = lexical.corpus_stats(lexical.tokenised(T.line_chunks(spark, sf)))
    return s.select("n_docs", F.round("avg_len", 9).alias("avg_len"))


# Vectors -------------------------------------------------------------------------------------

SQL["vec_scores"] = """
SELECT q.vec_id AS query_id, v.chunk_id, v.paper_id, v.year, v.document, round(list_inner_product(q.u, v.u), 9) AS score
FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings) q
CROSS JOIN (SELECT *, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM vector_table) v"""
SQL["vec_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec_scores"""


@query("vector_top10", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, paper_id, round(score, 6) AS score FROM vec_ranked WHERE rank <= 10""")
def vector_top10(spark, sf):
    hits = vector.vector_search(T.vector_queries(spark, sf), T.vector_table(spark, sf), 10)
    return hits.filter("rank <= 10").select("query_id", "rank", "chunk_id", "paper_id", F.round("score", 6).alias("score"))


@query("vector_top10_grid", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, paper_id, round(score, 6) AS score FROM vec_ranked WHERE rank <= 10""")
def vector_top10_grid(spark, sf):
    """The layout for query tables too large to broadcast."""
    hits = vector.vector_search(T.vector_queries(spark, sf), T.vector_table(spark, sf), 10,
                                broadcast_values=0, query_block=512, vector_block=512)
    return hits.filter("rank <= 10").select("query_id", "rank", "chunk_id", "paper_id", F.round("score", 6).alias("score"))


@query("vector_top10_filtered", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, year, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM vec_scores
  WHERE year >= 2003 AND year <= 2007) WHERE rank <= 10""")
def vector_top10_filtered(spark, sf):
    hits = vector.vector_search(T.vector_queries(spark, sf), T.vector_table(spark, sf), 10,
                                {"year_gte": 2003, "year_lte": 2007})
    return hits.filter("rank <= 10").select("query_id", "rank", "chunk_id", F.col("year").cast("int").alias("year"),
                                            F.round("score", 6).alias("score"))


@query("vector_norms", """
SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings""")
def vector_norms(spark, sf):
    e = T.table(spark, sf, "embeddings")
    return e.select("vec_id", F.round(VX.norm(F.col("embedding")), 6).alias("norm"), F.size("embedding").cast("bigint").alias("dim"))


def _digit_scorer(pairs):
    """Stand-in pair scorer: agreement of the two label texts, then the label itself."""
    return [(10.0 if a == b else 0.0) + int(b.split()[1]) / 10.0 for a, b in pairs]


@query("rerank_pool20", """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY new_score DESC, rank) AS INTEGER) AS rank, chunk_id FROM (
  SELECT r.query_id, r.rank, r.chunk_id,
         CASE WHEN r.document = 'label ' || e.label THEN 10.0 ELSE 0.0 END + CAST(string_split(r.document, ' ')[2] AS INTEGER) / 10.0 AS new_score
  FROM vec_ranked r JOIN embeddings e ON e.vec_id = r.query_id WHERE r.rank <= 20)""")
def rerank_pool20(spark, sf):
    queries = T.vector_queries(spark, sf)
    hits = vector.vector_search(queries, T.vector_table(spark, sf), 10)
    return fusion.rerank(hits, queries, _digit_scorer).select("query_id", "rank", "chunk_id")


# Fusion --------------------------------------------------------------------------------------

SQL["rrf_lists"] = """
SELECT query_id, 0 AS l, rank, chunk_id, paper_id FROM (
  SELECT query_id, chunk_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm_scored) WHERE rank <= 10
UNION ALL
SELECT query_id, 1 AS l, rank, chunk_id, paper_id FROM (
  SELECT query_id, chunk_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM count_scored) WHERE rank <= 10"""
RRF = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, {key}, round(rrf, 9) AS rrf_score FROM (
  SELECT query_id, {key}, rrf, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first_seen) AS rank FROM (
    SELECT query_id, {key}, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(l * 1000 + rank) AS first_seen FROM rrf_lists GROUP BY query_id, {key})) WHERE rank <= 5"""


def _two_lists(spark, sf):
    chunks, queries = T.line_chunks(spark, sf), T.query_table(spark, sf)
    pick = lambda df: R.as_hits(df, chunks)
    return pick(lexical.bm25_search(chunks, queries, 10)), pick(lexical.count_search(chunks, queries, 10))


@query("rrf_chunk_fusion", RRF.format(key="chunk_id"))
def rrf_chunk_fusion(spark, sf):
    out = fusion.rrf_chunks(*_two_lists(spark, sf), top_k=5)
    return out.select("query_id", "rank", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"))


@query("rrf_paper_fusion", RRF.format(key="paper_id"))
def rrf_paper_fusion(spark, sf):
    out = fusion.rrf_papers(*_two_lists(spark, sf), top_k=5)
    return out.select("query_id", "rank", "paper_id", F.round("rrf_score", 9).alias("rrf_score"))


@query("hybrid_search", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, 'hybrid' AS source FROM (
  SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first_seen) AS rank FROM (
    SELECT query_id, paper_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(l * 1000 + rank) AS first_seen FROM (
      SELECT query_id, 0 AS l, rank, paper_id FROM vec_ranked WHERE rank <= 20
      UNION ALL SELECT query_id, 1 AS l, rank, paper_id FROM kw_ranked WHERE rank <= 20) GROUP BY query_id, paper_id))
WHERE rank <= 10""")
def hybrid_search(spark, sf):
    """Vector queries that have a keyword text use both lists; the others the semantic list alone."""
    texts = T.query_table(spark, sf)
    queries = T.vector_queries(spark, sf).drop("text").join(texts, "query_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    out = R.hybrid_papers(queries, T.document_papers(spark, sf), T.vector_table(spark, sf), 10)
    return out.select("query_id", "rank", "paper_id", "source")


@query("one_flag_search", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, 'keyword' AS source FROM kw_ranked WHERE rank <= 10
UNION ALL SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, 'semantic' AS source FROM vec_ranked WHERE rank <= 10""")
def one_flag_search(spark, sf):
    """Library search with one of the two lists switched off: the other is cut to the requested size."""
    papers, vectors = T.document_papers(spark, sf), T.vector_table(spark, sf)
    keyword = R.hybrid_papers(T.query_table(spark, sf), papers, vectors, 10, use_semantic=False)
    semantic = R.hybrid_papers(T.vector_queries(spark, sf), papers, vectors, 10, use_keyword=False)
    cols = ["query_id", "rank", "paper_id", "source"]
    return keyword.select(cols).unionByName(semantic.select(cols))


@query("retrieval_profiles", " UNION ALL ".join(
    f"SELECT '{p}' AS profile, query_id, CAST(rank AS INTEGER) AS rank, chunk_id, 'keyword-only(degraded)' AS mode_used, true AS degraded FROM ("
    f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {src}) WHERE rank <= 5"
    for p, src in (("count", "count_scored"), ("bm25", "bm_scored"), ("bm25-bilingual", "bm_scored"),
                   ("bm25-bilingual-neighbor", "bm_near"))))
def retrieval_profiles(spark, sf):
    """The four lexical profiles through the evaluation retriever, without vectors."""
    chunks, queries = T.line_chunks(spark, sf), T.query_table(spark, sf)
    out = None
    for p in ("count", "bm25", "bm25-bilingual", "bm25-bilingual-neighbor"):
        part = R.retrieve(queries, chunks, None, 5, p).select(
            F.lit(p).alias("profile"), "query_id", "rank", "chunk_id", "mode_used", "degraded")
        out = part if out is None else out.unionByName(part)
    return out


@query("citation_suggestions", TOP.format(src="bm_scored", k=5))
def citation_suggestions(spark, sf):
    return _ranked(R.suggest_citations(T.query_table(spark, sf), chunks=T.line_chunks(spark, sf)))


# Evaluation ----------------------------------------------------------------------------------

SQL["quote_hits"] = """
SELECT b.item_id, c.paper_id, c.chunk_index, (length(c.content) - length(replace(c.content, b.text, ''))) // length(b.text) AS n
FROM benchmark b JOIN para_chunks c ON contains(c.content, b.text)"""


@query("passage_occurrences", """
SELECT b.item_id AS passage_id, d.doc_id AS text_id, CAST((length(d.text) - length(replace(d.text, b.text, ''))) // length(b.text) AS INTEGER) AS n
FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def passage_occurrences(spark, sf):
    return E.find_passages(T.table(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), F.col("text").alias("passage")),
                           T.spread(T.table(spark, sf, "documents")).select(F.col("doc_id").alias("text_id"), "text"))


SQL["doc_of_item"] = """
SELECT b.item_id AS evidence_id, min(d.doc_id) AS paper_id, b.text AS quote FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1, 3"""


@query("evidence_resolution", """
SELECT evidence_id, paper_id, CAST(n AS BIGINT) AS n, CASE WHEN n = 1 THEN 'ok' WHEN n = 0 THEN 'missing' ELSE 'multiple' END AS status,
       CASE WHEN n = 1 THEN 'p' || paper_id || '_c' || chunk_index END AS chunk_id FROM (
  SELECT e.evidence_id, e.paper_id, coalesce(sum(h.n), 0) AS n, min(h.chunk_index) AS chunk_index
  FROM doc_of_item e LEFT JOIN quote_hits h ON h.item_id = e.evidence_id AND h.paper_id = e.paper_id GROUP BY 1, 2)""")
def evidence_resolution(spark, sf):
    chunks = ingest.chunk_pages(T.document_pages(spark, sf), separator="\n")
    found = passage_occurrences(spark, sf).groupBy("passage_id").agg(F.min("text_id").alias("paper_id"))
    items = T.table(spark, sf, "benchmark")
    evidence = found.join(items, found.passage_id == items.item_id).select(
        F.col("passage_id").alias("evidence_id"), "paper_id", F.col("text").alias("quote"))
    return E.resolve_quotes(evidence, chunks).select("evidence_id", "paper_id", "n", "status", "chunk_id")


@query("evidence_papers", """
SELECT e.item_id AS evidence_id, min(p.id) AS paper_id, CAST(count(p.id) AS BIGINT) AS n_papers FROM benchmark e
LEFT JOIN (SELECT id, 'doi:10.1000/ord.' || id AS uid FROM papers WHERE doi IS NOT NULL) p ON p.uid = 'doi:10.1000/ord.' || e.item_id GROUP BY 1""")
def evidence_papers(spark, sf):
    ev = T.table(spark, sf, "benchmark").select(F.col("item_id").alias("evidence_id"), F.concat(
        F.lit("doi:DOI: 10.1000/ORD."), F.col("item_id").cast("string"), F.lit(",")).alias("paper_uid"))
    papers = T.papers(spark, sf).withColumn("file_sha256", F.lit(None).cast("string"))
    return E.resolve_papers(ev, papers).select("evidence_id", "paper_id", "n_papers")


SQL["locators"] = """
SELECT 'qa' || item_id AS qa_id, item_id AS paper_id, CASE WHEN item_id % 2 = 0 THEN lower(text) ELSE 'the' END AS section,
       list_transform(string_split(text, ' '), lambda k: lower(k)) AS keywords FROM benchmark"""


@query("locator_scores", """
SELECT qa_id, chunk_id, CAST(score AS INTEGER) AS score FROM (
  SELECT l.qa_id, 'p' || c.paper_id || '_c' || c.chunk_index AS chunk_id,
         CASE WHEN c.chunk_index % 3 = 0 AND contains(lower(c.content), l.section) THEN 2 ELSE 0 END
         + CASE WHEN contains(lower(c.content), l.section) THEN 1 ELSE 0 END + len(list_filter(l.keywords, lambda k: contains(lower(c.content), k))) AS score
  FROM locators l JOIN line_chunks c ON c.paper_id = l.paper_id) WHERE score > 0""")
def locator_scores(spark, sf):
    """Locators with all words of a passage as keywords and the passage or one word as section; every third chunk has its text as section title."""
    loc = T.table(spark, sf, "benchmark").select(
        F.concat(F.lit("qa"), F.col("item_id").cast("string")).alias("qa_id"), F.col("item_id").alias("paper_id"),
        F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise("the").alias("section"), F.split("text", " ").alias("keywords"))
    chunks = T.line_chunks(spark, sf).withColumn("section_title", F.when(F.col("chunk_index") % 3 == 0, F.col("content")))
    return E.locator_scores(loc, chunks).select("qa_id", "chunk_id", "score")


SQL["eval_hits"] = """
SELECT query_id AS item_id, chunk_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM pb_scored) WHERE rank <= 5"""
SQL["eval_labels"] = """
SELECT DISTINCT item_id, 'p' || paper_id || '_c' || chunk_index AS chunk_id FROM quote_hits"""
SQL["eval_items"] = """
SELECT b.item_id, CASE WHEN length(b.text) < 200 THEN 'factoid' WHEN length(b.text) < 300 THEN 'summary' ELSE 'comparison' END AS question_type,
       coalesce(l.n, 0) AS n_rel, coalesce(h.hits, 0) AS hits, h.first_rank,
       coalesce(h.dcg, 0) AS dcg, (SELECT sum(1 / log2(i + 1)) FROM range(1, CAST(least(coalesce(l.n, 0), 5) + 1 AS BIGINT)) t(i)) AS idcg
FROM benchmark b LEFT JOIN (SELECT item_id, count(*) AS n FROM eval_labels GROUP BY 1) l USING (item_id)
LEFT JOIN (SELECT item_id, count(*) AS hits, min(rank) AS first_rank, sum(1 / log2(rank + 1)) AS dcg
           FROM eval_hits JOIN eval_labels USING (item_id, chunk_id) GROUP BY 1) h USING (item_id)"""
SQL["eval_scored"] = """
SELECT item_id, question_type, n_rel > 0 AS has_answer, CASE WHEN n_rel > 0 THEN hits / n_rel END AS recall,
       CASE WHEN n_rel > 0 THEN coalesce(1.0 / first_rank, 0) END AS mrr, CASE WHEN n_rel > 0 THEN dcg / idcg END AS ndcg FROM eval_items"""


def evaluation(spark, sf, k: int = 5):
    """Chunk the documents, label every passage by containment, search by BM25, score each item."""
    chunks = materialize(ingest.chunk_pages(T.document_pages(spark, sf), separator="\n").select("paper_id", "chunk_index", "content"), "chunks")
    queries = T.query_table(spark, sf)
    hits = lexical.bm25_search(chunks, queries, k)
    labels = E.find_passages(queries.select(F.col("query_id").alias("passage_id"), F.col("text").alias("passage")),
                             chunks.select(chunk_id().alias("text_id"), F.col("content").alias("text")))
    labels = labels.select(F.col("passage_id").alias("qa_id"), F.col("text_id").alias("chunk_id"))
    n = F.length("text")
    kind = F.when(n < 200, "factoid").when(n < 300, "summary").otherwise("comparison")
    known = labels.select("qa_id").distinct().withColumn("_pos", F.lit(True))
    items = (queries.select(F.col("query_id").alias("qa_id"), kind.alias("question_type")).join(known, "qa_id", "left")
             .select("qa_id", "question_type", F.coalesce("_pos", F.lit(False)).alias("has_answer")))
    return E.score_items(items, hits.withColumnRenamed("query_id", "qa_id"), labels, k)


@query("eval_recall_mrr_ndcg", """
SELECT item_id AS qa_id, question_type, has_answer, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM eval_scored""")
def eval_recall_mrr_ndcg(spark, sf):
    return evaluation(spark, sf).select("qa_id", "question_type", "has_answer",
                                        *[F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg")])


@query("eval_by_type_rollup", """
SELECT coalesce(question_type, 'ALL') AS question_type, CAST(count(*) AS BIGINT) AS n, round(avg(recall), 6) AS recall,
       round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM eval_scored WHERE has_answer GROUP BY ROLLUP (question_type)""")
def eval_by_type_rollup(spark, sf):
    return E.by_type(evaluation(spark, sf)).select("question_type", "n", *[F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg")])


@query("eval_gate", """
SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, CAST(count_if(has_answer) AS BIGINT) AS n_positive,
       CAST(count_if(NOT has_answer) AS BIGINT) AS n_negative, avg(recall) >= 0.85 AS passed FROM eval_scored""")
def eval_gate(spark, sf):
    o = E.overall(evaluation(spark, sf), 0.85)
    return o.select(*[F.round(m, 6).alias(m) for m in ("recall", "mrr", "ndcg")], "n_positive", "n_negative", "passed")


SQL["label_hits"] = """
SELECT r.query_id, r.rank, r.chunk_id, (r.document = 'label ' || e.label) AS rel FROM vec_ranked r JOIN embeddings e ON e.vec_id = r.query_id WHERE r.rank <= 10"""


@query("vector_eval_by_label", """
SELECT e.label, round(avg(h.hits / c.n), 6) AS recall, round(avg(coalesce(1.0 / h.first_rank, 0)), 6) AS mrr FROM embeddings e
JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) c USING (label)
JOIN (SELECT query_id, count_if(rel) AS hits, min(CASE WHEN rel THEN rank END) AS first_rank FROM label_hits GROUP BY 1) h ON h.query_id = e.vec_id
GROUP BY e.label""")
def vector_eval_by_label(spark, sf):
    """Nearest neighbours judged by label. Relevant counts come from one aggregate, so no list of all
    vectors of a label is ever built."""
    q = T.vector_queries(spark, sf)
    hits = vector.vector_search(q, T.vector_table(spark, sf), 10).filter("rank <= 10")
    judged = hits.join(q.select("query_id", "text"), "query_id").withColumn("rel", F.col("content") == F.col("text"))
    per = judged.groupBy("query_id", "text").agg(F.count_if("rel").alias("hits"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"))
    sizes = q.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return per.join(sizes, "text").groupBy(F.split("text", " ")[1].cast("int").alias("label")).agg(
        F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query("latency_percentiles", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean,
       CAST(count(*) AS BIGINT) AS count FROM events GROUP BY event_type""")
def latency_percentiles(spark, sf):
    s = E.latency_stats(T.table(spark, sf, "events"), "value", ["event_type"])
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")], "count")


@query("latency_percentiles_ranged", """
SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean,
       CAST(count(*) AS BIGINT) AS count FROM events GROUP BY event_type""")
def latency_percentiles_ranged(spark, sf):
    """The method for samples with more distinct values than one task may hold."""
    s = E.latency_stats(T.table(spark, sf, "events"), "value", ["event_type"], max_values=0)
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "mean")], "count")
