"""The library's tables derived from the given parquet tables, and the same derivations in SQL.

Every function reads whole tables. ``SQL`` holds the matching common table expressions for the
checking engine; ``with_ctes`` puts the needed ones in front of a statement.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text as X
from marginalia.session import spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


SQL: dict[str, str] = {}


def with_ctes(body: str) -> str:
    """``body`` preceded by the expressions it uses, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL.items():
            if name not in needed and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(sql)
                if name not in needed:
                    needed.append(name)
    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n].strip()})" for n in needed)
    return f"WITH {ctes}\n{body.strip()}"


# Text: documents -----------------------------------------------------------------------------

def line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per document line."""
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return rows.withColumn("chunk_type", X.chunk_type(F.col("content"))).withColumn(
        "page_number", (F.floor(F.col("chunk_index") / 10) + 1).cast("int"))


SQL["line_chunks"] = """
SELECT doc_id AS paper_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS chunk_index,
       unnest(string_split(text, chr(10))) AS content FROM documents"""


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Each document as the single page of a paper."""
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        F.col("doc_id").alias("paper_id"), F.lit(1).alias("page_number"), "text")


# The paragraph chunker as a fold over the lines of a document.
SQL["folded"] = """
SELECT doc_id, list_reduce(
  list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(160))),
                             lambda x: length(x) > 0),
                 lambda x: {'done': []::VARCHAR[], 'cur': [x], 'n': CAST(length(x) AS BIGINT)}),
  lambda a, x: CASE WHEN len(a.cur) > 0 AND a.n + x.n > 512 THEN
      {'done': list_append(a.done, array_to_string(a.cur, chr(10) || chr(10))),
       'cur': list_concat(list_filter(a.cur, lambda p, i: list_sum(list_transform(a.cur[i:], lambda s: length(s))) <= 50), x.cur),
       'n': CAST(coalesce(list_sum(list_transform(list_filter(a.cur, lambda p, i: list_sum(list_transform(a.cur[i:], lambda s: length(s))) <= 50),
                                                  lambda s: length(s))), 0) + x.n AS BIGINT)}
    ELSE {'done': a.done, 'cur': list_concat(a.cur, x.cur), 'n': a.n + x.n} END,
  {'done': []::VARCHAR[], 'cur': []::VARCHAR[], 'n': CAST(0 AS BIGINT)}) AS f
FROM documents"""
SQL["fold_lists"] = """
SELECT doc_id, CASE WHEN len(f.cur) > 0 THEN list_append(f.done, array_to_string(f.cur, chr(10) || chr(10))) ELSE f.done END AS cs
FROM folded"""
SQL["para_chunks"] = """
SELECT doc_id AS paper_id, CAST(unnest(range(len(cs))) AS INTEGER) AS chunk_index, unnest(cs) AS content FROM fold_lists"""


def query_table(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def phrase_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every passage as a keyword query whose blanks are underscores but for each third one: phrases of three words."""
    words = F.split("text", " ")
    joined = F.array_join(F.transform(words, lambda w, i: F.concat(w, F.when(i % 3 == 2, " ").otherwise("_"))), "")
    return query_table(spark, sf).select("query_id", joined.alias("text"))


SQL["query_table"] = "SELECT item_id AS query_id, text FROM benchmark"
SQL["phrase_queries"] = """
SELECT item_id AS query_id, array_to_string(list_transform(string_split(text, ' '), lambda w, i: w || CASE WHEN i % 3 = 0 THEN ' ' ELSE '_' END), '') AS text FROM benchmark"""


def document_papers(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as library papers: title = first line, abstract = whole text."""
    d = spread(table(spark, sf, "documents"))
    return d.select(F.col("doc_id").alias("id"), F.split("text", "\n")[0].alias("title"), F.col("source").alias("authors"),
                    F.lit(2000).alias("year"), F.col("lang").alias("journal"), F.col("text").alias("abstract"))


SQL["document_papers"] = """
SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, source AS authors, 2000 AS year, lang AS journal,
       text AS abstract FROM documents"""


# Vectors: embeddings -------------------------------------------------------------------------

def vector_table(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as chunk vectors, ten per paper, the label as year."""
    e = spread(table(spark, sf, "embeddings"))
    paper, index = F.floor(F.col("vec_id") / 10).cast("bigint"), (F.col("vec_id") % 10).cast("int")
    return e.select(F.format_string("p%d_c%d", paper, index).alias("chunk_id"), "vec_id", paper.alias("paper_id"),
                    index.alias("chunk_index"), F.lit("paragraph").alias("chunk_type"),
                    F.format_string("Paper %d", paper).alias("title"), F.lit("").alias("authors"),
                    (F.col("label") + 2000).alias("year"), F.lit(None).cast("int").alias("page_number"),
                    F.format_string("label %d", "label").alias("document"), "embedding")


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding",
                                                 F.format_string("label %d", "label").alias("text"))


SQL["vector_table"] = """
SELECT 'p' || (vec_id // 10) || '_c' || (vec_id % 10) AS chunk_id, vec_id, vec_id // 10 AS paper_id,
       CAST(vec_id % 10 AS INTEGER) AS chunk_index, label + 2000 AS year, 'label ' || label AS document, embedding FROM embeddings"""


# Library: orders, customers, parts, line items -----------------------------------------------

def papers(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    phrase = F.concat(F.col("o_orderpriority"), F.lit(" handled for segment "), F.col("c_mktsegment"), F.lit(" of "),
                      F.col("c_name"), F.lit(". "))
    return j.select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "),
                                                  F.col("o_orderpriority")).alias("title"),
        F.concat(F.col("c_name"), F.lit(", Clerk "), (F.col("o_custkey") % 97).cast("string")).alias("authors"),
        F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("journal"),
        F.repeat(phrase, (F.col("o_orderkey") % 4).cast("int") + 1).alias("abstract"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://doi.org/10.1000/ORD."), F.col("o_orderkey").cast("string"),
                                                      F.lit("."))).alias("doi"),
        F.when(F.col("o_orderstatus") == "F", "read").when(F.col("o_orderstatus") == "O", "unread").otherwise("").alias("status"),
        F.when(F.col("o_totalprice") > 400000, "error").when(F.col("o_totalprice") > 300000, F.lit(None))
        .otherwise("done").alias("processed"),
        F.concat(F.lit("papers/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_path"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"), "o_custkey")


SQL["papers"] = """
SELECT o_orderkey AS id, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title,
       c_name || ', Clerk ' || (o_custkey % 97) AS authors, CAST(year(o_orderdate) AS INTEGER) AS year, c_mktsegment AS journal,
       repeat(o_orderpriority || ' handled for segment ' || c_mktsegment || ' of ' || c_name || '. ', CAST(o_orderkey % 4 + 1 AS INTEGER)) AS abstract,
       CASE WHEN o_orderkey % 3 = 0 THEN 'https://doi.org/10.1000/ORD.' || o_orderkey || '.' END AS doi,
       CASE o_orderstatus WHEN 'F' THEN 'read' WHEN 'O' THEN 'unread' ELSE '' END AS status,
       CASE WHEN o_totalprice > 400000 THEN 'error' WHEN o_totalprice > 300000 THEN NULL ELSE 'done' END AS processed,
       'papers/' || o_orderkey || '.pdf' AS file_path, 'order_' || o_orderkey || '.pdf' AS filename,
       CAST(o_orderdate AS TIMESTAMP) AS created_at, o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey"""


def tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.regexp_replace("p_brand", "Brand#", "").cast("bigint").alias("id"),
                                           F.col("p_brand").alias("name")).distinct()


def paper_tags(spark: SparkSession, sf: str) -> DataFrame:
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("paper_id"), F.regexp_replace("p_brand", "Brand#", "").cast("bigint").alias("tag_id")).distinct()


SQL["tags"] = "SELECT DISTINCT CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS id, p_brand AS name FROM part"
SQL["paper_tags"] = """
SELECT DISTINCT l_orderkey AS paper_id, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS tag_id
FROM lineitem JOIN part ON l_partkey = p_partkey"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed citations between papers: order to the order numbered like the part."""
    return (table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing_id"), F.col("l_partkey").alias("cited_id"))
            .filter("citing_id <> cited_id").distinct())


SQL["edges"] = "SELECT DISTINCT l_orderkey AS citing_id, l_partkey AS cited_id FROM lineitem WHERE l_orderkey <> l_partkey"


def customer_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """One query per customer; its seeds are the customer's orders."""
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("paper_id"))


SQL["customer_seeds"] = "SELECT o_custkey AS query_id, o_orderkey AS paper_id FROM orders"


# Theses: document lines as paragraphs, suppliers as files ------------------------------------

def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    rows = docs.select(F.col("doc_id").alias("thesis_id"), F.posexplode(F.split("text", "\n")).alias("index", "text"))
    style = F.when(F.col("index") % 7 == 0, "Heading 1").when(F.col("index") % 7 == 3, "Heading 2").otherwise("Normal")
    size = F.when(F.col("index") % 5 < 2, 18.0).otherwise(12.0)
    return rows.withColumn("style", style).withColumn("font_size", size)


SQL["raw_paragraphs"] = """
SELECT doc_id AS thesis_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS idx,
       unnest(string_split(text, chr(10))) AS text FROM documents"""
SQL["paragraphs"] = """
SELECT thesis_id, idx, trim(text, ' ' || chr(9) || chr(13) || chr(160)) AS text,
       CASE WHEN idx % 7 = 0 THEN 'Heading 1' WHEN idx % 7 = 3 THEN 'Heading 2' ELSE 'Normal' END AS style,
       CASE WHEN idx % 5 < 2 THEN 18.0 ELSE 12.0 END AS font_size
FROM raw_paragraphs WHERE length(trim(text, ' ' || chr(9) || chr(13) || chr(160))) > 0"""


def theses(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as thesis files with four or five chapters; the last chapter has no title or level."""
    chapter = "array(named_struct('title', concat(s_name, ' I'), 'level', 1, 'start_paragraph', 0, 'end_paragraph', 9)," \
              " named_struct('title', concat(s_name, ' II'), 'level', 2, 'start_paragraph', 10, 'end_paragraph', 19)," \
              " named_struct('title', concat(s_name, ' III'), 'level', 1, 'start_paragraph', 20, 'end_paragraph', 29)," \
              " named_struct('title', cast(null as string), 'level', cast(null as int), 'start_paragraph', 30, 'end_paragraph', 39))"
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.expr(chapter).alias("chapter_structure"))


def thesis_citations(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("thesis_id"), (F.col("l_linenumber") - 1).alias("chapter_index"),
                     F.when(F.col("l_returnflag") != "R", F.col("l_orderkey")).alias("paper_id"))


SQL["thesis_citations"] = """
SELECT l_suppkey AS thesis_id, l_linenumber - 1 AS chapter_index,
       CASE WHEN l_returnflag <> 'R' THEN l_orderkey END AS paper_id FROM lineitem"""
SQL["thesis_chapters"] = """
SELECT s_suppkey AS thesis_id, c AS chapter_index,
       CASE c WHEN 0 THEN s_name || ' I' WHEN 1 THEN s_name || ' II' WHEN 2 THEN s_name || ' III' END AS title,
       CASE c WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS level
FROM supplier CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c)"""


# Conversations, memories, samples ------------------------------------------------------------

def messages(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"),
                    "role", F.col("text").alias("content"), F.timestamp_seconds(F.col("turn") * 60).alias("created_at"), "turn")


SQL["messages"] = """
SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, role, text AS content, turn FROM conversations"""


def memories(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = (F.when(F.col("event_type") == "click", "short_term").when(F.col("event_type") == "view", "long_term")
            .when(F.col("event_type") == "purchase", "preference").when(F.col("event_type") == "signup", "fact")
            .otherwise("scratch"))
    return e.select(F.col("event_id").alias("id"), kind.alias("memory_type"), F.col("props").alias("content"),
                    F.col("user_id").alias("source_conversation_id"),
                    (F.floor("value").cast("bigint") % 10 + 1).cast("int").alias("importance"), F.col("ts").alias("created_at"))


SQL["memories"] = """
SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'short_term' WHEN 'view' THEN 'long_term' WHEN 'purchase' THEN 'preference'
       WHEN 'signup' THEN 'fact' ELSE 'scratch' END AS memory_type, props AS content, user_id AS source_conversation_id,
       CAST(CAST(floor(value) AS BIGINT) % 10 + 1 AS INTEGER) AS importance, ts AS created_at FROM events"""
