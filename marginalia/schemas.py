"""Table schemas as DDL text. Column names follow the data model of a literature library."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

PAPERS = (
    "id BIGINT, title STRING, authors STRING, year INT, journal STRING, abstract STRING, doi STRING,"
    " pages INT, file_path STRING, filename STRING, status STRING, source STRING, processed STRING,"
    " last_read_page INT, metadata_json MAP<STRING,STRING>, created_at TIMESTAMP, updated_at TIMESTAMP")
CHUNKS = (
    "paper_id BIGINT, chunk_index INT, chunk_id STRING, content STRING, page_number INT,"
    " section_title STRING, chunk_type STRING, token_count INT")
PAGES = ("paper_id BIGINT, page_number INT, text STRING")
PARAGRAPHS = (
    "thesis_id BIGINT, index INT, text STRING, style STRING, font_size DOUBLE")
CHUNK_VECTORS = (
    "chunk_id STRING, paper_id BIGINT, chunk_index INT, chunk_type STRING, title STRING, authors STRING,"
    " year INT, page_number INT, document STRING, embedding ARRAY<FLOAT>")
TAGS = ("id BIGINT, name STRING, color STRING, description STRING")
PAPER_TAGS = ("paper_id BIGINT, tag_id BIGINT")
PAPER_CITATIONS = ("citing_id BIGINT, cited_id BIGINT")
MESSAGES = (
    "id BIGINT, conversation_id BIGINT, role STRING, content STRING, created_at TIMESTAMP")
MEMORY = (
    "id BIGINT, memory_type STRING, content STRING, source_conversation_id BIGINT, importance INT,"
    " created_at TIMESTAMP")
QA = (
    "qa_id STRING, question STRING, ground_truth STRING, question_type STRING, source STRING,"
    " has_answer BOOLEAN, split STRING, reviewed BOOLEAN,"
    " relevant_chunks ARRAY<STRUCT<paper_id: BIGINT, section: STRING, keywords: ARRAY<STRING>>>,"
    " relevant_evidence ARRAY<STRUCT<paper_uid: STRING, quote: STRING>>")
FIXTURE = (
    "benchmark_id STRING, license STRING, description STRING, papers ARRAY<STRUCT<paper_uid: STRING,"
    " title: STRING, authors: STRING, year: INT, journal: STRING, abstract: STRING,"
    " chunks: ARRAY<STRUCT<chunk_index: INT, section_title: STRING, chunk_type: STRING,"
    " page_number: INT, content: STRING>>>>")
REPORT = (
    "timestamp STRING, top_k INT, retrieval_mode STRING, threshold DOUBLE, overall STRING,"
    " by_question_type ARRAY<STRUCT<question_type: STRING, n: INT, recall: DOUBLE, mrr: DOUBLE, ndcg: DOUBLE>>")
CHAPTERS = "ARRAY<STRUCT<title: STRING, level: INT, start_paragraph: INT, end_paragraph: INT>>"

# Columns every retrieval operator returns, next to query_id and rank.
HIT_COLUMNS = ["chunk_id", "paper_id", "title", "authors", "year", "content", "page_number",
               "chunk_type", "score", "source"]


def chunk_id(paper_id="paper_id", chunk_index="chunk_index") -> Column:
    """``p{paper}_c{index}``, the id that joins chunks, vectors, hits and judgements."""
    return F.concat(F.lit("p"), F.col(paper_id).cast("string"), F.lit("_c"),
                    F.col(chunk_index).cast("string"))


def conform(df: DataFrame, schema: str, defaults: dict | None = None) -> DataFrame:
    """Read an older or narrower table as ``schema``: absent columns become their default."""
    defaults = defaults or {}
    cols = []
    for field in T.StructType.fromDDL(schema).fields:
        default = F.lit(defaults.get(field.name)).cast(field.dataType)
        value = F.col(field.name).cast(field.dataType) if field.name in df.columns else default
        cols.append(F.coalesce(value, default).alias(field.name) if field.name in defaults
                    else value.alias(field.name))
    return df.select(*cols)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
