"""Chunking, metadata, thesis, graph, context and candidate-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import answers as A, frontmatter as FM, text as X, vectors as VX
from marginalia.operators import (blocks, context as C, evaluate as E, graph as G, ingest, library as L, metadata as MD,
                                  qagen as Q, retrieve as R, thesis as TH)
from marginalia.plans import tables as T
from marginalia.plans.registry import query
from marginalia.plans.tables import SQL
from marginalia.schemas import chunk_id
from marginalia.sources.documents import html_text

BLANK = "' ' || chr(9) || chr(10) || chr(13) || chr(160)"
TYPE_GROUPS = [("abstract", ["abstract", "摘要"]), ("intro", ["introduction", "intro", "引言", "前言", "背景"]),
               ("method", ["methods", "methodology", "materials and methods", "方法", "材料与方法"]),
               ("result", ["results", "实验结果", "结果"]), ("discussion", ["discussion", "讨论"]),
               ("conclusion", ["conclusion", "conclusions", "结论"])]


def _type_sql(lead: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({lead}, '{w}')" for w in ws) + f" THEN '{t}'" for t, ws in TYPE_GROUPS)
    return f"CASE {whens} ELSE 'paragraph' END"


# Chunks --------------------------------------------------------------------------------------

def para_chunks(spark, sf):
    return ingest.chunk_pages(T.document_pages(spark, sf), separator="\n")


@query("paragraph_chunks", """
SELECT paper_id, chunk_index, 'p' || paper_id || '_c' || chunk_index AS chunk_id, content, CAST(length(content) AS INTEGER) AS token_count FROM para_chunks""")
def paragraph_chunks(spark, sf):
    return para_chunks(spark, sf).select("paper_id", "chunk_index", "chunk_id", "content", "token_count")


@query("page_chunks", f"""
SELECT doc_id AS paper_id, CAST(0 AS INTEGER) AS chunk_index, trim(text, {BLANK}) AS content, {_type_sql("lower(trim(text, " + BLANK + "))")} AS chunk_type
FROM documents WHERE length(trim(text, {BLANK})) > 0""")
def page_chunks(spark, sf):
    """The default separator: documents hold no blank line, so each is one chunk."""
    return ingest.chunk_pages(T.document_pages(spark, sf)).select("paper_id", "chunk_index", "content", "chunk_type")


SQL["typed_lines"] = """
SELECT paper_id, chunk_index, CASE chunk_index % 8 WHEN 0 THEN 'Abstract' WHEN 1 THEN '1 INTRODUCTION' WHEN 2 THEN 'Methods used' WHEN 3 THEN '实验结果'
  WHEN 4 THEN 'A discussion' WHEN 5 THEN 'conclusion' ELSE 'x' END || chr(10) || chr(10) || content || chr(10) || chr(10) || 'abstract' AS content FROM line_chunks"""


@query("chunk_types", f"""
SELECT paper_id, chunk_index, {_type_sql("lower(replace(regexp_extract(content, '^(.*?' || chr(10) || chr(10) || '.*?)(' || chr(10) || chr(10) || ')', 1, 's'), chr(10) || chr(10), ' '))")} AS chunk_type FROM typed_lines""")
def chunk_types(spark, sf):
    i = F.col("chunk_index") % 8
    lead = (F.when(i == 0, "Abstract").when(i == 1, "1 INTRODUCTION").when(i == 2, "Methods used").when(i == 3, "实验结果")
            .when(i == 4, "A discussion").when(i == 5, "conclusion").otherwise("x"))
    chunks = T.line_chunks(spark, sf).withColumn("content", F.concat(lead, F.lit("\n\n"), "content", F.lit("\n\nabstract")))
    return chunks.select("paper_id", "chunk_index", X.chunk_type(F.col("content")).alias("chunk_type"))


@query("abstract_chunks", f"""
SELECT doc_id AS paper_id, 'p' || doc_id || '_c-1' AS chunk_id,
       CASE WHEN lang = 'en' THEN 'About ' || source ELSE left(trim(text, {BLANK}), 1500) END AS content,
       CASE WHEN lang = 'en' THEN NULL ELSE 1 END AS page_number FROM documents WHERE lang = 'en' OR length(trim(text, {BLANK})) > 0""")
def abstract_chunks(spark, sf):
    papers = T.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(
        F.col("lang") == "en", F.concat(F.lit(" About "), F.col("source"), F.lit("\n"))).otherwise(" ").alias("abstract"))
    return ingest.abstract_chunks(papers, T.document_pages(spark, sf)).select("paper_id", "chunk_id", "content", "page_number")


@query("full_texts", """
SELECT doc_id AS paper_id, sha256(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))) AS text_hash FROM documents""")
def full_texts(spark, sf):
    pages = T.line_chunks(spark, sf).select("paper_id", F.col("chunk_index").alias("page_number"), F.col("content").alias("text"))
    return ingest.full_texts(pages).select("paper_id", F.sha2("text", 256).alias("text_hash"))


@query("vector_records", """
SELECT 'p' || c.paper_id || '_c' || c.chunk_index AS chunk_id, coalesce(l.label_text, '') AS title, l.label_text IS NULL AS orphan, length(c.content) AS n
FROM line_chunks c LEFT JOIN (SELECT doc_id, 'quality ' || quality AS label_text FROM labels) l ON l.doc_id = c.paper_id""")
def vector_records(spark, sf):
    owners = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.format_string("quality %d", "quality").alias("title"),
                                                F.lit(None).cast("string").alias("authors"), F.lit(None).cast("int").alias("year"))
    rec = ingest.vector_records(T.line_chunks(spark, sf), owners)
    return rec.select("chunk_id", "title", "orphan", F.length("document").cast("bigint").alias("n"))


@query("vector_upsert", """
SELECT chunk_id, CAST(max(batch) AS BIGINT) AS batch, CAST(count(*) AS BIGINT) AS versions FROM (
  SELECT chunk_id, 1 AS batch FROM vector_table UNION ALL SELECT 'p' || paper_id || '_c' || (chunk_index + 5), 2 FROM vector_table) GROUP BY 1""")
def vector_upsert(spark, sf):
    v = T.vector_table(spark, sf)
    old = v.withColumn("batch_ts", F.lit(1).cast("bigint"))
    new = (v.withColumn("chunk_index", F.col("chunk_index") + 5).withColumn("chunk_id", F.lit(None).cast("string"))
           .withColumn("batch_ts", F.lit(2).cast("bigint")))
    out = ingest.upsert_vectors(old, new).select("chunk_id", F.col("batch_ts").alias("batch"))
    seen = old.select("chunk_id").unionByName(new.select(chunk_id().alias("chunk_id"))).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("versions"))
    return out.join(seen, "chunk_id")


@query("replaced_papers", """
SELECT paper_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(content)) AS BIGINT) AS chars FROM (
  SELECT * FROM line_chunks WHERE paper_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT * FROM para_chunks WHERE paper_id IN (SELECT doc_id FROM labels)) GROUP BY 1""")
def replaced_papers(spark, sf):
    cols = ["paper_id", "chunk_index", "content"]
    batch = T.table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"))
    out = ingest.replace_papers(T.line_chunks(spark, sf).select(*cols), para_chunks(spark, sf).select(*cols), batch)
    return out.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("chars"))


@query("embedding_inputs", """
SELECT doc_id, sha256(CASE WHEN len(t) > 512 THEN array_to_string(t[1:512], ' ') ELSE text END) AS input_hash, CAST(len(t) AS BIGINT) AS n_tokens FROM (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: length(x) > 0) AS t FROM documents)""")
def embedding_inputs(spark, sf):
    d = T.spread(T.table(spark, sf, "documents"))
    return d.select("doc_id", F.sha2(X.embed_text(F.col("text")), 256).alias("input_hash"),
                    F.size(X.white_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("hashed_embeddings")
def hashed_embeddings(spark, sf):
    """Every line embedded by the deterministic embedder; the norms are one or zero."""
    embed = VX.embedder(VX.hashing_embedder(64))
    rows = VX.with_embeddings(T.line_chunks(spark, sf), "content", embed)
    return rows.select("paper_id", "chunk_index", F.round(VX.norm(F.col("embedding")), 4).alias("norm"))


@query("page_texts", """
SELECT page_id AS paper_id, url FROM pages""")
def page_texts(spark, sf):
    """Web pages through the page extractor; every page keeps its row."""
    p = T.spread(T.table(spark, sf, "pages"))
    return p.withColumn("text", html_text(F.col("html"))).filter(F.length("text") >= 0).select(F.col("page_id").alias("paper_id"), "url")


# Metadata ------------------------------------------------------------------------------------

NOISE_SQL = " OR ".join(f"contains(lower(x), '{n}')" for n in (
    "abstract", "introduction", "keywords", "arxiv", "preprint", "journal", "proceedings", "conference", "university", "department",
    "email", "tel:", "fax:", "doi:", "https://", "figure", "table", "references", "acknowledgements", "related work", "original article",
    "article info", "received:", "accepted:", "published", "contents lists", "journal homepage", "all rights reserved", "copyright",
    "pattern analysis and applications", "medical image analysis"))
SQL["front_lines"] = f"""
SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\\n\\r\\v\\f\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: trim(x, {BLANK})), lambda x: length(x) > 0) AS lines FROM documents"""
SQL["front_places"] = f"""
SELECT doc_id, lines, list_filter(list_transform(lines, lambda x, i: CASE WHEN length(x) > 10 AND length(x) < 300 AND NOT ({NOISE_SQL})
       AND NOT regexp_full_match(x, '[^\\p{{L}}_]+') THEN i END), lambda i: i IS NOT NULL) AS places FROM front_lines"""


@query("front_titles", """
SELECT doc_id, CAST(coalesce(places[1] - 1, 999) AS INTEGER) AS line,
       CASE WHEN places[2] = places[1] + 1 AND right(lines[places[1]], 1) NOT IN ('.', ':', '?', '!') THEN lines[places[1]] || ' ' || lines[places[1] + 1]
            ELSE lines[places[1]] END AS title FROM front_places""")
def front_titles(spark, sf):
    d = T.spread(T.table(spark, sf, "documents"))
    t = d.select("doc_id", FM.infer_title(F.col("text")).alias("t"))
    return t.select("doc_id", "t.line", "t.title")


SQL["title_rows"] = "SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents"


@query("title_quality", """
SELECT doc_id, CASE WHEN length(title) = 0 THEN 0.0::DOUBLE ELSE
  0.5::DOUBLE * len(list_filter(['with','for','of','and','based','via','using','towards','learning','network','networks','model','models','analysis','prediction','segmentation',
    'classification','detection','multi','cross','hierarchical','graph','image','pathology'], lambda w: contains(lower(title), w)))
  - len(list_filter(['we propose','in this paper','this study','existing methods','recent years','however','therefore','thus','models often'], lambda w: contains(lower(title), w)))
  + CASE WHEN length(title) BETWEEN 20 AND 150 THEN 1 ELSE 0 END
  - CASE WHEN regexp_matches(title, '(?i)^(The|This|These|In|However|Therefore)\\b') THEN 2 ELSE 0 END END AS quality FROM title_rows""")
def title_quality(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.split("text", "\n")[0].alias("title"))
    return d.select("doc_id", FM.title_quality(F.col("title")).alias("quality"))


SQL["id_rows"] = """
SELECT o_orderkey, 'see https://doi.org/10.' || (1000 + o_custkey % 9000) || '/A.' || o_orderkey || '(x), Copyright © ' || year(o_orderdate) || ' or 1901' AS text FROM orders"""


@query("doi_and_year", """
SELECT o_orderkey, nullif(regexp_extract(text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), '') AS doi, CAST(regexp_extract(text, 'Copyright © (\\d{4})', 1) AS INTEGER) AS year,
       lower(regexp_replace(nullif(regexp_extract(text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), ''), '[.,;:)\\]}]+$', '')) AS normal,
       'doi:' || lower(regexp_replace(nullif(regexp_extract(text, '10\\.\\d{4,9}/[-._;()/:A-Za-z0-9]+'), ''), '[.,;:)\\]}]+$', '')) AS uid FROM id_rows""")
def doi_and_year(spark, sf):
    o = T.table(spark, sf, "orders")
    text = F.concat(F.lit("see https://doi.org/10."), (F.col("o_custkey") % 9000 + 1000).cast("string"), F.lit("/A."), F.col("o_orderkey").cast("string"),
                    F.lit("(x), Copyright © "), F.year("o_orderdate").cast("string"), F.lit(" or 1901"))
    d = o.select("o_orderkey", text.alias("text")).select("o_orderkey", X.first_doi(F.col("text")).alias("doi"), X.first_year(F.col("text")).alias("year"))
    raw = F.concat(F.lit(" HTTPS://dx.doi.org/"), F.col("doi"))
    return d.select("o_orderkey", "doi", "year", X.normalize_doi(raw).alias("normal"), X.paper_uid(raw, F.lit("0")).alias("uid"))


@query("front_metadata")
def front_metadata(spark, sf):
    """DOI, year, title and authors of every document's text."""
    return MD.front_candidates(T.spread(T.table(spark, sf, "documents")).select(F.col("doc_id").alias("paper_id"), "text"))


@query("front_authors", """
SELECT c_custkey AS paper_id, CASE c_custkey % 3 WHEN 0 THEN marked || ', ' || second WHEN 1 THEN marked || ', ' || second || ', Carol White' ELSE first END AS authors,
       CASE c_custkey % 3 WHEN 2 THEN 999 ELSE 1 END AS line FROM
  (SELECT c_custkey, 'Ann ' || upper(left(c_mktsegment, 1)) || regexp_replace(lower(substr(c_mktsegment, 2)), '[a-d]$', '') AS marked, -- a last a to d counts as a footnote mark
          'Ann ' || upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS first, 'Tom ' || (['Stone', 'Miller', 'Young', 'Fox', 'Grey'])[c_nationkey % 5 + 1] AS second
   FROM customer)""")
def front_authors(spark, sf):
    """Front pages that name their authors behind a label, in lines below the title, or in addresses only."""
    c = T.spread(T.table(spark, sf, "customer"))
    first = F.concat(F.lit("Ann "), F.initcap("c_mktsegment"))
    second = F.concat(F.lit("Tom "), F.element_at(F.array(*map(F.lit, ("Stone", "Miller", "Young", "Fox", "Grey"))), (F.col("c_nationkey") % 5 + 1).cast("int")))
    head = F.concat(F.lit("Retrieval of Records for Customer "), F.col("c_name"), F.lit(".\n"))
    text = (F.when(F.col("c_custkey") % 3 == 0, F.concat(head, F.lit("Authors: "), first, F.lit("1; "), second, F.lit("*\nAbstract\nBody text")))
            .when(F.col("c_custkey") % 3 == 1, F.concat(head, first, F.lit("1,2, "), second, F.lit(" and Carol White\nUniversity of Somewhere\nAbstract\nBody text")))
            .otherwise(F.concat(head, F.lit("see ann."), F.lower("c_mktsegment"), F.lit("3@cs.school.edu and x@mail.com\nAbstract"))))
    found = MD.front_candidates(c.select(F.col("c_custkey").alias("paper_id"), text.alias("text")))
    return found.select("paper_id", "authors", F.col("authors_line").alias("line"))


@query("metadata_merge", """
SELECT o_orderkey AS paper_id, CASE WHEN o_orderkey % 2 = 0 THEN 'A, B, C' ELSE 'X, Y' END AS authors, CASE WHEN o_custkey % 2 = 0 THEN 1990 ELSE 2001 END AS year,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Deep graph learning for image segmentation' ELSE 'Base title' END AS title, CASE WHEN o_custkey % 2 = 0 THEN '10.1/a' ELSE '10.1/b' END AS doi FROM orders""")
def metadata_merge(spark, sf):
    o = T.spread(T.table(spark, sf, "orders").select("o_orderkey", "o_custkey")).withColumn("paper_id", F.col("o_orderkey"))
    even_c, none = F.col("o_custkey") % 2 == 0, F.lit(None)
    base = o.select("paper_id", F.lit("Base title").alias("title"), none.cast("string").alias("authors"), none.cast("int").alias("year"), none.cast("string").alias("doi"))
    a = o.select("paper_id", F.when(even_c, "10.1/a").alias("doi"), F.when(even_c, 1990).alias("year"),
                 F.when(F.col("o_orderkey") % 2 == 0, "A, B, C").otherwise("D").alias("authors"), F.lit("However this study").alias("title"), F.lit(0).alias("title_line"))
    b = o.select("paper_id", F.lit("10.1/b").alias("doi"), F.lit(2001).alias("year"), F.lit("X, Y").alias("authors"),
                 F.when(F.col("o_orderkey") % 3 == 0, "Deep graph learning for image segmentation").alias("title"), F.lit(4).alias("title_line"))
    return MD.merge_candidates(base, a, b).select("paper_id", "authors", "year", "title", "doi")


@query("metadata_cleanup", """
SELECT doc_id, CASE WHEN lang = 'en' THEN 'my file v1' ELSE trim(regexp_replace(string_split(text, chr(10))[1], '[ \\t\\n\\r\\f\\v\\x{a0}\\x{2000}-\\x{200a}\\x{3000}]+', ' ', 'g')) END AS title FROM documents WHERE lang = 'en' OR string_split(text, chr(10))[1] <> ''""")
def metadata_cleanup(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") != "en", F.split("text", "\n")[0]).alias("title"), F.lit("my_file_v1.pdf").alias("filename"),
                                              "lang").filter("lang = 'en' OR title <> ''")
    return MD.clean_metadata(d).select("doc_id", "title")


# Tags ----------------------------------------------------------------------------------------

SQL["tag_text"] = """
SELECT p_partkey, lower(p_name || ' ' || CASE p_type WHEN 'PROMO' THEN 'A Survey of Deep Learning' WHEN 'ECONOMY' THEN 'CNN and Transformer PREDICTION' WHEN 'SMALL' THEN 'radiomic ct scan' ELSE 'none' END || ' ' || p_brand) AS t FROM part"""


def _tag_papers(spark, sf):
    p = T.table(spark, sf, "part")
    kind = (F.when(F.col("p_type") == "PROMO", "A Survey of Deep Learning").when(F.col("p_type") == "ECONOMY", "CNN and Transformer PREDICTION")
            .when(F.col("p_type") == "SMALL", "radiomic ct scan").otherwise("none"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), kind.alias("abstract"), F.col("p_brand").alias("journal"))


def _rule_sql():
    from marginalia.functions.vocabulary import TAG_RULES
    return " UNION ALL ".join(f"SELECT p_partkey AS paper_id, '{tag}' AS tag FROM tag_text WHERE " + " OR ".join(f"contains(t, '{k}')" for k in kws)
                              for tag, kws in TAG_RULES.items())


SQL["rule_tag_rows"] = _rule_sql()


@query("rule_tags", "SELECT paper_id, tag FROM rule_tag_rows")
def rule_tags(spark, sf):
    return L.paper_rule_tags(_tag_papers(spark, sf)).select("paper_id", "tag")


@query("collected_tags", """
SELECT p_partkey AS paper_id, t AS tag FROM part CROSS JOIN (SELECT unnest(['alpha', '深度学习']) AS t)
UNION ALL SELECT paper_id, tag FROM rule_tag_rows WHERE tag NOT IN ('深度学习', '综述')""")
def collected_tags(spark, sf):
    """Model tags come first; one rule tag is attached already."""
    papers = _tag_papers(spark, sf)
    responses = papers.select(F.col("id").alias("paper_id"), F.lit("- alpha\n1. \"深度学习\"\n\n").alias("response"))
    attached = papers.select(F.col("id").alias("paper_id"), F.lit("综述").alias("name"))
    return L.collect_tags(papers, responses, attached).select("paper_id", "tag")


@query("tag_cleaning", """
SELECT p_partkey, '•' || p_name AS clean, 'é ' || p_name AS repaired FROM part""")
def tag_cleaning(spark, sf):
    p = T.table(spark, sf, "part")
    broken = F.concat(F.lit("Ã©"), F.lit(" "), F.col("p_name"))
    return p.select("p_partkey", X.clean_tag(F.concat(F.lit(" 12. •"), F.col("p_name"), F.lit("​\" "))).alias("clean"),
                    X.clean_tag(broken).alias("repaired"))


# Theses --------------------------------------------------------------------------------------

SQL["heads"] = """
SELECT thesis_id, idx, trim(regexp_replace(regexp_replace(string_split(text, chr(9))[1], '\\s+\\.\\.\\.\\s*\\d+$', ''), '\\s+\\d+$', ''), ' ' || chr(9) || chr(13) || chr(160)) AS title,
       CASE style WHEN 'Heading 1' THEN 1 WHEN 'Heading 2' THEN 2 ELSE 2 END AS level FROM paragraphs WHERE style <> 'Normal' OR regexp_matches(text, '^\\d+(\\.\\d+)+\\s+')"""
SQL["chapter_rows"] = """
SELECT h.thesis_id, title, level, idx AS start_paragraph, coalesce(lead(idx) OVER (PARTITION BY h.thesis_id ORDER BY idx) - 1, last_idx) AS end_paragraph
FROM heads h JOIN (SELECT thesis_id, max(idx) AS last_idx FROM paragraphs GROUP BY 1) m USING (thesis_id)"""


@query("thesis_chapters", "SELECT thesis_id, title, CAST(level AS INTEGER) AS level, start_paragraph, CAST(end_paragraph AS INTEGER) AS end_paragraph FROM chapter_rows")
def thesis_chapters(spark, sf):
    return TH.chapters(T.paragraphs(spark, sf))


SQL["placed"] = """
SELECT p.thesis_id, p.idx, p.text, (SELECT min(c.n) FROM (SELECT *, row_number() OVER (PARTITION BY thesis_id ORDER BY start_paragraph) - 1 AS n FROM chapter_rows) c
  WHERE c.thesis_id = p.thesis_id AND p.idx BETWEEN c.start_paragraph AND c.end_paragraph) AS chapter_index FROM paragraphs p"""


def _with_structures(spark, sf):
    p = TH.kept_paragraphs(T.paragraphs(spark, sf))
    return p, TH.chapter_structure(TH.chapters(T.paragraphs(spark, sf)))


@query("chapter_range_join", "SELECT thesis_id, idx, CAST(chapter_index AS INTEGER) AS chapter_index FROM placed")
def chapter_range_join(spark, sf):
    p, s = _with_structures(spark, sf)
    return TH.with_chapter(p, s).select("thesis_id", F.col("index").alias("idx"), "chapter_index")


@query("chapter_texts", """
SELECT thesis_id, CAST(chapter_index AS INTEGER) AS chapter_index, sha256(left(string_agg(text, chr(10) ORDER BY idx), 6000)) AS text_hash FROM placed WHERE chapter_index IS NOT NULL
GROUP BY 1, 2 HAVING length(trim(left(string_agg(text, chr(10) ORDER BY idx), 6000))) >= 30""")
def chapter_texts(spark, sf):
    p, s = _with_structures(spark, sf)
    return TH.analysis_texts(TH.chapter_texts(p, s, TH.CHAPTER_CHARS)).select("thesis_id", "chapter_index", F.sha2("text", 256).alias("text_hash"))


@query("document_sizes", """
SELECT thesis_id, CAST(length(replace(string_agg(text, chr(10) ORDER BY idx), ' ', '')) AS BIGINT) AS word_count FROM paragraphs GROUP BY 1""")
def document_sizes(spark, sf):
    return TH.document_sizes(TH.kept_paragraphs(T.paragraphs(spark, sf)))


@query("thesis_titles")
def thesis_titles(spark, sf):
    return TH.thesis_titles(T.paragraphs(spark, sf))


SQL["cited_lines"] = """
SELECT thesis_id, idx, text || ' [' || (idx + 1) || ', ' || (idx + 2) || '] and (Smith et al., ' || (1990 + idx % 30) || 'a) plus [x]' AS text FROM paragraphs"""


@query("in_text_citations", """
SELECT c.thesis_id, c.idx, p.chapter_index, c.citation_text FROM (
  SELECT thesis_id, idx, unnest(regexp_extract_all(text, '\\[\\d+(?:\\s*[,-]\\s*\\d+)*\\]')) AS citation_text FROM cited_lines
  UNION ALL SELECT thesis_id, idx, unnest(regexp_extract_all(text, '\\([A-Z][a-zA-Z\\s,\\.]+(?:et al\\.)?,\\s*\\d{4}[a-z]?\\)')) FROM cited_lines) c
JOIN (SELECT thesis_id, idx, CAST(chapter_index AS INTEGER) AS chapter_index FROM placed) p ON p.thesis_id = c.thesis_id AND p.idx = c.idx""")
def in_text_citations(spark, sf):
    p, s = _with_structures(spark, sf)
    i = F.col("index")
    text = F.concat("text", F.lit(" ["), (i + 1).cast("string"), F.lit(", "), (i + 2).cast("string"), F.lit("] and (Smith et al., "),
                    (i % 30 + 1990).cast("string"), F.lit("a) plus [x]"))
    return TH.scan_citations(p.withColumn("text", text), s).select("thesis_id", F.col("index").alias("idx"), "chapter_index", "citation_text")


@query("citation_map", """
SELECT c.thesis_id, CAST(c.chapter_index AS INTEGER) AS chapter_index, coalesce(c.title, '第' || (c.chapter_index + 1) || '章') AS chapter_title,
       CAST(coalesce(c.level, 1) AS INTEGER) AS level, coalesce(p.ids, '') AS paper_ids, CAST(coalesce(p.n, 0) AS BIGINT) AS n_titles, CAST(coalesce(k.n, 0) AS BIGINT) AS citation_count
FROM thesis_chapters c LEFT JOIN (SELECT thesis_id, chapter_index, count(*) AS n FROM thesis_citations GROUP BY 1, 2) k USING (thesis_id, chapter_index)
LEFT JOIN (SELECT thesis_id, chapter_index, string_agg(CAST(paper_id AS VARCHAR), ',' ORDER BY paper_id) AS ids, count(*) AS n
           FROM (SELECT DISTINCT thesis_id, chapter_index, paper_id FROM thesis_citations WHERE paper_id <> 0) GROUP BY 1, 2) p USING (thesis_id, chapter_index)""")
def citation_map(spark, sf):
    m = TH.citation_map(T.theses(spark, sf), T.thesis_citations(spark, sf), T.papers(spark, sf))
    return m.select("thesis_id", "chapter_index", "chapter_title", "level",
                    F.array_join(F.transform("paper_ids", lambda x: x.cast("string")), ",").alias("paper_ids"),
                    F.size(F.map_keys("paper_titles")).cast("bigint").alias("n_titles"), "citation_count")


@query("citation_totals", """
SELECT thesis_id, CAST(count(*) AS BIGINT) AS total_citations, CAST(count_if(paper_id <> 0) AS BIGINT) AS matched_citations FROM thesis_citations GROUP BY 1""")
def citation_totals(spark, sf):
    return TH.citation_totals(T.thesis_citations(spark, sf))


@query("graph_links", """
SELECT 'p' || t.paper_id AS source, 't' || t.thesis_id || '_ch' || t.chapter_index AS target, coalesce(c.title, '第' || (t.chapter_index + 1) || '章') AS chapter_title, CAST(count(*) AS BIGINT) AS n
FROM thesis_citations t LEFT JOIN thesis_chapters c USING (thesis_id, chapter_index) WHERE t.paper_id IS NOT NULL GROUP BY 1, 2, 3""")
def graph_links(spark, sf):
    links = TH.graph_links(T.theses(spark, sf), T.thesis_citations(spark, sf))
    return links.groupBy("source", "target", "chapter_title").agg(F.count(F.lit(1)).alias("n"))


@query("graph_nodes", """
SELECT 'p' || id AS id, title AS name, 'paper' AS type FROM papers
UNION ALL SELECT DISTINCT 't' || t.thesis_id || '_ch' || t.chapter_index, coalesce(c.title, '第' || (t.chapter_index + 1) || '章'), 'chapter'
FROM thesis_citations t LEFT JOIN thesis_chapters c USING (thesis_id, chapter_index) WHERE t.paper_id IS NOT NULL""")
def graph_nodes(spark, sf):
    return TH.graph_nodes(T.papers(spark, sf), TH.graph_links(T.theses(spark, sf), T.thesis_citations(spark, sf)))


SQL["name_citations"] = """
SELECT DISTINCT CASE WHEN c_custkey % 11 = 0 THEN '[' || c_custkey || ']' WHEN c_custkey % 3 = 0 THEN '(Customer et al., ' || year(o_orderdate) || ')'
  WHEN c_custkey % 3 = 1 THEN '(Stomer & Clerk, ' || year(o_orderdate) || ')' ELSE 'Nobody, ' || year(o_orderdate) END AS citation_text, c_custkey % 11 = 0 AS numbered, c_custkey % 3 AS kind, year(o_orderdate) AS y
FROM orders JOIN customer ON o_custkey = c_custkey"""


@query("author_year_match", """
SELECT citation_text, CASE WHEN numbered OR kind = 2 THEN NULL ELSE (SELECT min(id) FROM papers p WHERE p.year = y AND contains(lower(p.authors), CASE kind WHEN 0 THEN 'customer' ELSE 'stomer' END)
  AND (kind = 0 OR contains(lower(p.authors), 'clerk'))) END AS paper_id FROM name_citations""")
def author_year_match(spark, sf):
    o, c = T.table(spark, sf, "orders"), T.table(spark, sf, "customer")
    y, k = F.year("o_orderdate").cast("string"), F.col("c_custkey")
    text = (F.when(k % 11 == 0, F.concat(F.lit("["), k.cast("string"), F.lit("]"))).when(k % 3 == 0, F.concat(F.lit("(Customer et al., "), y, F.lit(")")))
            .when(k % 3 == 1, F.concat(F.lit("(Stomer & Clerk, "), y, F.lit(")"))).otherwise(F.concat(F.lit("Nobody, "), y)))
    rows = o.join(c, o.o_custkey == c.c_custkey).select(text.alias("citation_text"), (k % 11 == 0).alias("numbered"), (k % 3).alias("kind"), y.alias("y")).distinct()
    return TH.match_author_year(rows, T.papers(spark, sf)).select("citation_text", "paper_id")


# Graph ---------------------------------------------------------------------------------------

SQL["adjacent"] = "SELECT citing_id AS node, cited_id AS nb FROM edges UNION SELECT cited_id, citing_id FROM edges"
SQL["hop1"] = """
SELECT DISTINCT s.query_id, a.nb AS paper_id FROM customer_seeds s JOIN adjacent a ON a.node = s.paper_id
WHERE NOT EXISTS (SELECT 1 FROM customer_seeds z WHERE z.query_id = s.query_id AND z.paper_id = a.nb)"""
SQL["hop2"] = """
SELECT query_id, paper_id FROM hop1 UNION SELECT h.query_id, a.nb FROM hop1 h JOIN adjacent a ON a.node = h.paper_id
WHERE NOT EXISTS (SELECT 1 FROM customer_seeds z WHERE z.query_id = h.query_id AND z.paper_id = a.nb)"""


@query("neighbors_1hop", "SELECT query_id, paper_id FROM hop1")
def neighbors_1hop(spark, sf):
    return G.neighbors(T.customer_seeds(spark, sf), T.edges(spark, sf), 1)


@query("neighbors_2hop", "SELECT query_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(paper_id) AS BIGINT) AS id_sum FROM hop2 GROUP BY 1")
def neighbors_2hop(spark, sf):
    """Totals of what each customer's orders reach, made a slice of the customers at a time."""
    return G.neighbors(T.customer_seeds(spark, sf), T.edges(spark, sf), 2, finish=lambda out: out.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("paper_id").alias("id_sum")))


SQL["centers"] = "SELECT min(o_orderkey) AS center_id FROM orders GROUP BY o_custkey"
SQL["touching"] = "SELECT DISTINCT c.center_id, e.citing_id, e.cited_id FROM centers c JOIN edges e ON e.citing_id = c.center_id OR e.cited_id = c.center_id"


def _centers(spark, sf):
    return T.table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("center_id")).select("center_id")


@query("subgraph_1hop", "SELECT center_id, citing_id, cited_id FROM touching")
def subgraph_1hop(spark, sf):
    return G.subgraph_edges(_centers(spark, sf), T.edges(spark, sf))


@query("subgraph_nodes", """
SELECT n.center_id, n.id, p.title, p.year FROM (SELECT center_id, citing_id AS id FROM touching UNION SELECT center_id, cited_id FROM touching UNION SELECT center_id, center_id FROM centers) n JOIN papers p USING (id)""")
def subgraph_nodes(spark, sf):
    return G.subgraph_nodes(_centers(spark, sf), T.edges(spark, sf), T.papers(spark, sf))


SQL["rep_chunks"] = f"""
SELECT paper_id, chunk_index, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN kind = 'abstract' THEN 0 ELSE 1 END, chunk_index) AS pick
FROM (SELECT paper_id, chunk_index, CASE WHEN chunk_index = 3 THEN 'abstract' ELSE 'paragraph' END AS kind FROM line_chunks)"""


@query("representative_chunks", "SELECT 'p' || paper_id || '_c' || chunk_index AS chunk_id, CAST(pick AS INTEGER) AS pick FROM rep_chunks WHERE pick <= 2")
def representative_chunks(spark, sf):
    chunks = T.line_chunks(spark, sf).withColumn("chunk_type", F.when(F.col("chunk_index") == 3, "abstract").otherwise("paragraph"))
    return G.representative_chunks(chunks).select("chunk_id", "pick")


# Documents cite the documents numbered like the parts of the order with their number.
SQL["doc_edges"] = "SELECT DISTINCT l_orderkey AS citing_id, l_partkey AS cited_id FROM lineitem JOIN (SELECT doc_id FROM documents) a ON a.doc_id = l_orderkey JOIN (SELECT doc_id AS d2 FROM documents) b ON b.d2 = l_partkey WHERE l_orderkey <> l_partkey"
SQL["expand_hits"] = """
SELECT query_id, rank, chunk_id, paper_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm_scored) WHERE rank <= 5"""
SQL["expand_new"] = """
SELECT DISTINCT h.query_id, a.nb AS paper_id FROM expand_hits h JOIN (SELECT citing_id AS node, cited_id AS nb FROM doc_edges UNION SELECT cited_id, citing_id FROM doc_edges) a ON a.node = h.paper_id
WHERE NOT EXISTS (SELECT 1 FROM expand_hits z WHERE z.query_id = h.query_id AND z.paper_id = a.nb)"""
SQL["expand_lists"] = """
SELECT query_id, 0 AS l, rank, chunk_id FROM expand_hits UNION ALL
SELECT n.query_id, 1, row_number() OVER (PARTITION BY n.query_id ORDER BY n.paper_id, r.pick), 'p' || r.paper_id || '_c' || r.chunk_index
FROM expand_new n JOIN (SELECT * FROM typed_reps WHERE pick <= 2) r USING (paper_id)"""
SQL["typed_reps"] = f"""
SELECT paper_id, chunk_index, row_number() OVER (PARTITION BY paper_id ORDER BY CASE WHEN contains(lower(content), 'abstract') OR contains(content, '摘要') THEN 0 ELSE 1 END, chunk_index) AS pick FROM line_chunks"""


@query("graph_expand_top5", """
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id FROM (
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, seen) AS rank FROM (
    SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(l * 100000000 + rank) AS seen FROM expand_lists GROUP BY 1, 2)) WHERE rank <= 5""")
def graph_expand_top5(spark, sf):
    from marginalia.operators import lexical
    chunks = T.line_chunks(spark, sf)
    papers = T.document_papers(spark, sf)
    ids = T.table(spark, sf, "documents").select(F.col("doc_id").alias("cited_id"))
    edges = (T.edges(spark, sf).join(ids, "cited_id", "left_semi")
             .join(ids.withColumnRenamed("cited_id", "citing_id"), "citing_id", "left_semi").select("citing_id", "cited_id"))
    hits = R.as_hits(lexical.bm25_search(chunks, T.query_table(spark, sf), 5), chunks)
    return G.graph_expand(hits, edges, chunks, papers).select("query_id", "rank", "chunk_id")


def _reference_texts(spark, sf):
    """Documents that end in a reference list: the cited titles are first lines of other documents,
    some shortened, one quoted; the list is derived from the line items."""
    docs = T.spread(T.table(spark, sf, "documents").select("doc_id", "text"))
    titles = docs.select(F.col("doc_id").alias("cited"), X.collapse(F.split("text", "\n")[0]).alias("t"))
    li = T.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("cited")).distinct()
    spoiled = F.when(F.col("cited") % 3 == 0, F.substr("t", F.lit(3))).otherwise(F.col("t"))
    refs = (li.join(titles, "cited").filter(F.length("t") >= 12)
            .select("doc_id", "cited", F.concat(F.lit('] Anon. "'), F.regexp_replace(spoiled, '["“”「」]', ""), F.lit('", 2020.')).alias("e"))
            .groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("cited", "e"))).alias("es")))
    lines = F.array_join(F.transform("es", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), x["e"])), "\n")
    return docs.join(refs, "doc_id").select(F.col("doc_id").alias("paper_id"),
                                            F.concat("text", F.lit("\nReferences\n"), lines).alias("text"))


@query("reference_entries", """
SELECT doc_id AS paper_id, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT DISTINCT l_orderkey AS doc_id, l_partkey FROM lineitem JOIN (SELECT doc_id AS cited, trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g')) AS t FROM documents) c ON c.cited = l_partkey
  WHERE length(t) >= 12 AND l_orderkey IN (SELECT doc_id FROM documents)) GROUP BY 1""")
def reference_entries(spark, sf):
    t = _reference_texts(spark, sf)
    return t.select("paper_id", F.size(X.reference_entries(X.references_section(F.col("text")))).cast("bigint").alias("n"))


@query("fuzzy_title_edges")
def fuzzy_title_edges(spark, sf):
    papers = T.document_papers(spark, sf).select("id", "title")
    return G.title_edges(G.reference_candidates(_reference_texts(spark, sf)), papers)


# Contexts ------------------------------------------------------------------------------------

SQL["top5"] = """
SELECT b.*, c.content FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm_scored) b
JOIN line_chunks c ON c.paper_id = b.paper_id AND c.chunk_index = b.chunk_index WHERE b.rank <= 5"""


def _hits(spark, sf):
    from marginalia.operators import lexical
    chunks = T.line_chunks(spark, sf)
    return R.as_hits(lexical.bm25_search(chunks, T.query_table(spark, sf), 5), chunks)


@query("context_blocks", """
SELECT query_id, CAST(count(*) AS BIGINT) AS n_hits, sha256(string_agg('[' || rank || '] 未知文献 第' || (chunk_index // 10 + 1) || '页' || chr(10) || content || chr(10), chr(10) || '---' || chr(10) ORDER BY rank)) AS context_hash FROM top5 GROUP BY 1""")
def context_blocks(spark, sf):
    return C.hit_contexts(_hits(spark, sf)).select("query_id", "n_hits", F.sha2("context", 256).alias("context_hash"))


@query("passage_contexts", """
SELECT q.query_id, coalesce(string_agg('[' || chunk_id || '] ' || left(content, 800), chr(10) || chr(10) ORDER BY rank), '（未检索到任何资料）') AS context FROM query_table q LEFT JOIN top5 USING (query_id) GROUP BY 1""")
def passage_contexts(spark, sf):
    return C.passage_contexts(T.query_table(spark, sf), _hits(spark, sf))


@query("paper_contexts", """
SELECT paper_id, sha256(left(string_agg(content, chr(10) || chr(10) ORDER BY chunk_index), 6000)) AS context_hash FROM line_chunks
WHERE paper_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY 1""")
def paper_contexts(spark, sf):
    papers = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "done").otherwise("error").alias("processed"))
    return C.paper_contexts(papers, T.line_chunks(spark, sf)).select("paper_id", F.sha2("context", 256).alias("context_hash"))


@query("paper_overviews", """
SELECT id AS paper_id, '[paper_id=' || id || '] ' || coalesce(nullif(title, ''), '(无标题)') || chr(10) || coalesce(left(intro, 600), '') AS overview FROM document_papers LEFT JOIN (
  SELECT paper_id, arg_min(trim(content, ' ' || chr(9) || chr(13) || chr(160)), chunk_index) AS intro FROM line_chunks WHERE length(trim(content, ' ' || chr(9) || chr(13) || chr(160))) > 0 GROUP BY 1) ON paper_id = id""")
def paper_overviews(spark, sf):
    return C.paper_overviews(T.document_papers(spark, sf), T.line_chunks(spark, sf))


# Turns as sub-answers of a topic; a turn has as many chunks as its number plus one.
SQL["turn_answers"] = """
SELECT conv_id AS topic_id, turn AS idx, turn % 4 AS n_chunks, text || ' [^1^] and [^' || turn || '^] or [^99^].' AS answer, text FROM conversations"""


def _turn_answers(spark, sf):
    c = T.table(spark, sf, "conversations")
    answer = F.concat(F.col("text"), F.lit(" [^1^] and [^"), F.col("turn").cast("string"), F.lit("^] or [^99^]."))
    return c.select(F.col("conv_id").alias("topic_id"), F.col("turn").alias("index"), (F.col("turn") % 4).cast("int").alias("n_chunks"), answer.alias("answer"), "text")


SQL["turn_global"] = """
SELECT topic_id, idx, text, CAST(coalesce(sum(n_chunks) OVER w, 0) AS BIGINT) AS off,
       left(answer, strpos(answer, '[^1^]') - 1) || CASE WHEN n_chunks >= 1 THEN '[^' || CAST(coalesce(sum(n_chunks) OVER w, 0) + 1 AS BIGINT) || '^]' ELSE '' END
       || ' and ' || CASE WHEN idx BETWEEN 1 AND n_chunks THEN '[^' || CAST(coalesce(sum(n_chunks) OVER w, 0) + idx AS BIGINT) || '^]' ELSE '' END || ' or .' AS global_answer
FROM turn_answers WINDOW w AS (PARTITION BY topic_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("running_citation_offset", "SELECT topic_id, idx, off, global_answer FROM turn_global")
def running_citation_offset(spark, sf):
    out = C.global_markers(_turn_answers(spark, sf), block=3)
    return out.select("topic_id", F.col("index").alias("idx"), F.col("offset").alias("off"), "global_answer")


@query("marker_verification", """
SELECT topic_id, idx, CAST(3 AS INTEGER) AS total, CAST(CASE WHEN n_chunks >= 1 THEN 1 ELSE 0 END + CASE WHEN idx BETWEEN 1 AND n_chunks THEN 1 ELSE 0 END AS INTEGER) AS valid,
       left(answer, strpos(answer, '[^1^]') - 1) || CASE WHEN n_chunks >= 1 THEN '[^1^]' ELSE '' END || ' and ' || CASE WHEN idx BETWEEN 1 AND n_chunks THEN '[^' || idx || '^]' ELSE '' END || ' or .' AS clean
FROM turn_answers""")
def marker_verification(spark, sf):
    t = _turn_answers(spark, sf)
    r = A.marker_report(F.col("answer"), F.col("n_chunks"))
    return t.select("topic_id", F.col("index").alias("idx"), r["total"].alias("total"), r["valid"].alias("valid"),
                    A.clean_markers(F.col("answer"), F.col("n_chunks")).alias("clean"))


SQL["generated"] = """
SELECT conv_id, turn, role <> 'system' AS has_answer, CASE WHEN turn = 1 THEN '  ' WHEN turn = 2 THEN ' [调用 LLM 出错: x]' WHEN turn = 3 THEN '不知道。'
  ELSE text || ' [p' || conv_id || '_c' || turn || '] [p1_c-1] [p1_c-1]' END AS answer, text || '，the；' || role AS truth,
  ['p' || conv_id || '_c' || turn, 'p' || conv_id || '_c99'] AS rel FROM conversations"""


def _generated(spark, sf):
    c = T.table(spark, sf, "conversations")
    ref = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_c"), F.col("turn").cast("string"))
    answer = (F.when(F.col("turn") == 1, "  ").when(F.col("turn") == 2, " [调用 LLM 出错: x]").when(F.col("turn") == 3, "不知道。")
              .otherwise(F.concat(F.col("text"), F.lit(" ["), ref, F.lit("] [p1_c-1] [p1_c-1]"))))
    return c.select("conv_id", "turn", (F.col("role") != "system").alias("has_answer"), answer.alias("answer"),
                    F.concat(F.col("text"), F.lit("，the；"), "role").alias("ground_truth"),
                    F.array(ref, F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_c99"))).alias("relevant_ids"))


SQL["gen_cited"] = "SELECT *, list_distinct(regexp_extract_all(answer, '\\[(p\\d+_c-?\\d+)\\]', 1)) AS cited FROM generated"
SQL["gen_scores"] = """
SELECT conv_id, turn, has_answer, answer, len(list_intersect(cited, rel)) / greatest(len(cited), 1) AS p, len(list_intersect(cited, rel)) / len(rel) AS r,
  len(list_filter(list_filter(list_transform(string_split_regex(truth, '[、，,；;]'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> ''), lambda x: contains(lower(answer), lower(x))))
  / len(list_filter(list_transform(string_split_regex(truth, '[、，,；;]'), lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '')) AS hit,
  CASE WHEN trim(answer) = '' THEN 'empty_response' WHEN starts_with(trim(answer), '[调用 LLM 出错:') THEN 'llm_error_response' END AS err, contains(answer, '不知道') AS refused FROM gen_cited"""


@query("answer_scores", """
SELECT conv_id, turn, round(CASE WHEN has_answer THEN p END, 6) AS citation_precision, round(CASE WHEN has_answer THEN r END, 6) AS citation_recall,
       round(CASE WHEN has_answer THEN CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END END, 6) AS citation_f1, round(CASE WHEN has_answer THEN hit END, 6) AS keyword_hit_rate,
       err AS generation_error, CASE WHEN NOT has_answer THEN refused END AS refused FROM gen_scores""")
def answer_scores(spark, sf):
    s = E.score_answers(_generated(spark, sf))
    return s.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("citation_precision", "citation_recall", "citation_f1", "keyword_hit_rate")],
                    "generation_error", "refused")


@query("generation_summary", """
SELECT CAST(count(*) AS BIGINT) AS attempted, CAST(count_if(err IS NULL) AS BIGINT) AS succeeded, CAST(count(err) AS BIGINT) AS error_count,
       round(avg(CASE WHEN has_answer THEN p END), 6) AS citation_precision, round(avg(CASE WHEN has_answer THEN r END), 6) AS citation_recall,
       round(avg(CASE WHEN has_answer THEN hit END), 6) AS keyword_hit_rate, CAST(count_if(NOT has_answer) AS BIGINT) AS negative_total,
       round(count_if(NOT has_answer AND refused) / count_if(NOT has_answer), 6) AS negative_refusal_rate FROM gen_scores""")
def generation_summary(spark, sf):
    s = E.generation_summary(E.score_answers(_generated(spark, sf)))
    return s.select("attempted", "succeeded", "error_count", *[F.round(c, 6).alias(c) for c in ("citation_precision", "citation_recall", "keyword_hit_rate")],
                    "negative_total", F.round("negative_refusal_rate", 6).alias("negative_refusal_rate"))


@query("generation_errors", "SELECT err AS generation_error, CAST(count(*) AS BIGINT) AS n FROM gen_scores WHERE err IS NOT NULL GROUP BY 1")
def generation_errors(spark, sf):
    return E.generation_errors(E.score_answers(_generated(spark, sf)))


@query("question_routing", """
SELECT conv_id, turn, len(list_filter(['最新','最近','news','latest','recent','2024','2025','2026','搜索','查一下','网上','google','百度','arxiv'], lambda w: contains(lower(text || ' ArXiv'[1:(turn % 2) * 6]), w))) > 0 AS online,
       len(list_filter(['arxiv','论文检索','最新研究','未收录','没有收录','不在库中'], lambda w: contains(lower(text || ' ArXiv'[1:(turn % 2) * 6]), w))) > 0 AS external FROM conversations""")
def question_routing(spark, sf):
    c = T.table(spark, sf, "conversations").withColumn("q", F.concat("text", F.when(F.col("turn") % 2 == 1, " ArXiv").otherwise("")))
    return c.select("conv_id", "turn", A.needs_online(F.col("q")).alias("online"), A.needs_external(F.col("q")).alias("external"))


@query("sub_question_lists", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '?|k?' END AS questions FROM events""")
def sub_question_lists(spark, sf):
    e = T.table(spark, sf, "events")
    body = F.concat(F.lit('["'), F.col("event_type"), F.lit('?", 7, "  ", " k? "]'))
    raw = (F.when(F.col("event_type") == "error", "[调用 LLM 出错: x]").when(F.col("event_type") == "click", body)
           .when(F.col("event_type") == "view", F.concat(F.lit('{"questions": [], "sub_questions": '), body, F.lit("}")))
           .otherwise(F.concat(F.lit('{"questions": '), body, F.lit("}"))))
    return e.select("event_id", F.array_join(A.sub_questions(raw), "|").alias("questions"))


@query("sub_answer_status", """
SELECT topic_id, idx, text AS question, CASE WHEN n_chunks > 0 AND idx <> 2 THEN answer ELSE '该子问题检索不足。' END AS answer, CAST(CASE WHEN n_chunks > 0 AND idx <> 2 THEN n_chunks ELSE 0 END AS BIGINT) AS n_chunks,
       n_chunks > 0 AND idx <> 2 AS ok FROM turn_answers""")
def sub_answer_status(spark, sf):
    t = _turn_answers(spark, sf)
    hits = t.filter("n_chunks > 0").select("topic_id", "index", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))).alias("rank"))
    answers = C.generator_input(t, hits).select("topic_id", "index", F.when(F.col("index") == 2, "[调用 LLM 出错: x]").otherwise(F.col("answer")).alias("answer"),
                                               F.lit(None).cast("string").alias("error"))
    out = C.sub_answers(t.select("topic_id", "index", F.col("text").alias("question")), hits, answers)
    return out.select("topic_id", F.col("index").alias("idx"), "question", "answer", F.col("n_chunks").cast("bigint").alias("n_chunks"), "ok")


@query("synthesis_contexts", """
SELECT topic_id, string_agg('### 子问题 ' || idx || '：' || text || chr(10) || global_answer, chr(10) || chr(10) ORDER BY idx) || coalesce(chr(10) || chr(10) || '### 全局引用清单' || chr(10) || any_value(refs), '') AS context FROM turn_global
LEFT JOIN (SELECT topic_id, string_agg('[' || n || '] 未知文献', chr(10) ORDER BY n) AS refs FROM (SELECT topic_id, unnest(range(1, CAST(sum(n_chunks) AS BIGINT) + 1)) AS n FROM turn_answers GROUP BY 1) GROUP BY 1) USING (topic_id) GROUP BY 1""")
def synthesis_contexts(spark, sf):
    t = _turn_answers(spark, sf).withColumn("question", F.col("text")).withColumn("ok", F.lit(True))
    hits = t.filter("n_chunks > 0").select("topic_id", "index", F.explode(F.sequence(F.lit(1), F.col("n_chunks"))).alias("rank"),
                                          F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("page_number"))
    return C.synthesis_contexts(C.global_markers(t), hits)


@query("message_lists", """
SELECT conversation_id, CAST(least(n, 10) + 1 + CASE WHEN conversation_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN conversation_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN conversation_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_messages,
       CASE WHEN conversation_id % 2 = 0 THEN 'S' ELSE 'S' || chr(10) || chr(10) || 'G' END AS system_text FROM (SELECT conversation_id, count(*) AS n FROM messages GROUP BY 1)""")
def message_lists(spark, sf):
    m = T.messages(spark, sf)
    cid = F.col("conversation_id")
    req = m.select("conversation_id").distinct().select(
        "conversation_id", F.lit("q").alias("text"), F.when(cid % 3 == 0, "s1").otherwise("absent").alias("skill_id"), (cid % 5 == 0).alias("online"),
        F.lit("").alias("memory_context"), F.lit("").alias("external_context"))
    ctx = req.filter(cid % 2 == 0).select(F.col("conversation_id").alias("query_id"), F.lit("C").alias("context"))
    templates = m.select(F.lit("s1").alias("skill_id"), F.lit("R").alias("role"), F.lit("I").alias("instruction")).distinct()
    out = C.build_messages(req, m, ctx, templates, "S", "H", "G")
    return out.select("conversation_id", F.size("messages").cast("bigint").alias("n_messages"), F.col("messages")[0]["content"].alias("system_text"))


SQL["message_rows"] = """
SELECT conv_id AS conversation_id, list({'role': role, 'content': text} ORDER BY turn, role, text) AS ms, sum(length(text)) - 1500 AS over FROM conversations GROUP BY conv_id"""
# The messages give up their heads one after another: a fold over the list of those that are not system messages.
SQL["message_cuts"] = """
SELECT conversation_id, ms, over, list_filter(ms, lambda m: m.role <> 'system') AS rest,
  list_reduce(list_transform(list_filter(ms, lambda m: m.role <> 'system'), lambda m: {'over': CAST(length(m.content) AS HUGEINT), 'cuts': []::INTEGER[]}),
    lambda s, m: {'over': s.over - CASE WHEN s.over > 0 THEN least(greatest(m.over - 300, 0), s.over // greatest(len(list_filter(ms, lambda x: x.role <> 'system')), 1)) ELSE 0 END,
                  'cuts': list_append(s.cuts, CAST(CASE WHEN s.over > 0 THEN least(greatest(m.over - 300, 0), s.over // greatest(len(list_filter(ms, lambda x: x.role <> 'system')), 1)) ELSE 0 END AS INTEGER))},
    {'over': CAST(over AS HUGEINT), 'cuts': []::INTEGER[]}) AS f FROM message_rows"""


@query("trimmed_messages", """
SELECT conversation_id, CASE WHEN over <= 0 THEN array_to_string(list_transform(ms, lambda m: m.role || ':' || m.content), '|') ELSE
  array_to_string(list_concat(list_transform(list_filter(ms, lambda m: m.role = 'system'), lambda m: m.role || ':' || m.content),
    list_transform(list_filter(rest, lambda m, i: NOT (f.over > 0 AND len(rest) > 2) OR i > len(rest) - 2), lambda m, i:
      m.role || ':' || substr(m.content, f.cuts[i + CASE WHEN f.over > 0 AND len(rest) > 2 THEN len(rest) - 2 ELSE 0 END] + 1))), '|') END AS messages FROM message_cuts""")
def trimmed_messages(spark, sf):
    """Each conversation's messages fitted into 1500 characters, roles and texts whole."""
    m = T.messages(spark, sf)
    lists = m.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))), lambda x: F.struct(
        x["role"].alias("role"), x["content"].alias("content"))).alias("ms"))
    return lists.select("conversation_id", F.array_join(F.transform(A.fit_messages(F.col("ms"), 1500), lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


@query("local_hits", "SELECT event_id FROM events WHERE event_type <> 'error' AND event_id % 3 <> 0")
def local_hits(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("source"),
                                           F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("paper_id"))
    return C.local_hits(e).select("event_id")


# Candidate sets ------------------------------------------------------------------------------

SQL["material_rows"] = """
SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY chunk_index) - 1 AS pos, count(*) OVER (PARTITION BY paper_id) AS n,
       trim(content, ' ' || chr(9) || chr(13) || chr(160)) AS c FROM line_chunks WHERE length(trim(content, ' ' || chr(9) || chr(13) || chr(160))) > 0"""
SQL["material_wanted"] = """
SELECT paper_id, unnest(list_distinct(list_concat([0, n // 2, n - 1], list_transform([1, 2, 3, 4, 5], lambda i: CAST(round_even(i * (n - 1) / 6.0, 0) AS BIGINT))))) AS pos
FROM (SELECT DISTINCT paper_id, n FROM material_rows)"""


@query("material_positions", "SELECT r.paper_id, CAST(r.pos AS BIGINT) AS position, length(r.c) AS n FROM material_rows r JOIN material_wanted w ON w.paper_id = r.paper_id AND w.pos = r.pos")
def material_positions(spark, sf):
    kept = T.line_chunks(spark, sf).filter(X.non_blank(F.col("content")))
    counts = kept.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))
    wanted = counts.select("paper_id", F.explode(Q.sample_positions(F.col("n"))).alias("position"))
    placed = blocks.row_numbers(kept.withColumn("block", blocks.block_of(F.col("chunk_index"), 16)), ["paper_id"], ["chunk_index"], "block", "position")
    return placed.join(wanted, ["paper_id", "position"]).select("paper_id", "position", F.length(X.strip(F.col("content"))).cast("bigint").alias("n"))


@query("material_sample")
def material_sample(spark, sf):
    return Q.material(T.document_papers(spark, sf).withColumn("abstract", F.lit(None).cast("string")), T.line_chunks(spark, sf))


def _responses(spark, sf):
    """One generator answer per document: a fenced list with a verbatim quote, a missing quote and a bad type."""
    d = T.spread(T.table(spark, sf, "documents"))
    item = lambda q, kind, quote: F.struct(F.lit(q).alias("question"), F.lit(" a ").alias("ground_truth"), F.lit(kind).alias("question_type"), quote.alias("evidence_quote"))
    quote = F.split("text", "\n")[0]
    items = F.array(item(" q1 ", "factoid", quote), item("q2", "summary", F.lit("this quote does not occur anywhere")), item("q3", "out_of_scope", quote),
                    item("q4", "comparison", quote), item(" ", "factoid", quote))
    return d.select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("Sure!\n```json\n{\"items\": "), F.to_json(items), F.lit("}\n```")).alias("response"))


SQL["quote_rows"] = """
SELECT doc_id, q, (SELECT coalesce(sum((length(l) - length(replace(l, q, ''))) // length(q)), 0) FROM (SELECT unnest(string_split(text, chr(10))) AS l)) AS n FROM (
  SELECT doc_id, text, trim(string_split(text, chr(10))[1], ' ' || chr(9) || chr(13) || chr(160)) AS q FROM documents) WHERE length(q) BETWEEN 20 AND 500"""


@query("candidate_items", """
SELECT doc_id AS paper_id, 'gen-p' || doc_id || '-' || i AS qa_id, q AS question FROM quote_rows CROSS JOIN (SELECT unnest(['001', '002']) AS i, unnest(['q1', 'q4']) AS q) WHERE n = 1""".replace("q AS question FROM quote_rows CROSS JOIN (SELECT unnest(['001', '002']) AS i, unnest(['q1', 'q4']) AS q)", "k.q AS question FROM quote_rows CROSS JOIN (SELECT unnest(['001', '002']) AS i, unnest(['q1', 'q4']) AS q) k"))
def candidate_items(spark, sf):
    uids = T.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("doi:"), F.col("doc_id").cast("string")).alias("paper_uid"))
    out = Q.accepted_by_quote(Q.raw_items(_responses(spark, sf)), T.line_chunks(spark, sf), uids)
    return out.select("paper_id", "qa_id", "question")


@query("candidate_status", """
SELECT doc_id AS paper_id, n IS NOT NULL AS ok, CAST(CASE WHEN n IS NOT NULL THEN 2 ELSE 0 END AS BIGINT) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN (SELECT doc_id, n FROM quote_rows WHERE n = 1) USING (doc_id)""")
def candidate_status(spark, sf):
    ids = T.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"))
    return Q.paper_status(ids, candidate_items(spark, sf))


@query("candidate_types", """
SELECT question_type, CAST((SELECT count(*) FROM quote_rows WHERE n = 1) AS BIGINT) AS n FROM (SELECT unnest(['factoid', 'comparison']) AS question_type)""")
def candidate_types(spark, sf):
    uids = T.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("doi:x").alias("paper_uid"))
    return Q.type_counts(Q.promote(Q.accepted_by_quote(Q.raw_items(_responses(spark, sf)), T.line_chunks(spark, sf), uids)))


@query("remaining_papers", "SELECT doc_id AS paper_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def remaining_papers(spark, sf):
    ids = T.table(spark, sf, "documents").select(F.col("doc_id").alias("paper_id"))
    done = T.table(spark, sf, "labels").select(F.format_string("gen-p%d-001", "doc_id").alias("qa_id"))
    return Q.remaining_papers(ids, done)


@query("excerpt_candidates", """
SELECT doc_id AS paper_id, 'gen-p' || doc_id || '-001' AS qa_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: length(trim(l, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) >= 8)) > 0""")
def excerpt_candidates(spark, sf):
    d = T.spread(T.table(spark, sf, "documents"))
    items = d.select(F.col("doc_id").alias("paper_id"), F.lit(0).alias("pos"), F.lit("q").alias("question"), F.lit("a").alias("ground_truth"),
                     F.lit("summary").alias("question_type"), F.concat(F.array(F.lit("no such excerpt at all")), F.split(F.lower("text"), "\n")).alias("excerpts"))
    return Q.accepted_by_excerpts(items, d.withColumnRenamed("doc_id", "paper_id")).select("paper_id", "qa_id")


@query("cross_paper_candidates", """
SELECT c_custkey AS response_id, 'gen-cross-001' AS qa_id, 2 AS n FROM customer JOIN documents a ON a.doc_id = c_custkey JOIN documents b ON b.doc_id = c_custkey + 1
WHERE len(list_filter(string_split(a.text, chr(10)), lambda l: length(trim(l, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) >= 8)) > 0 AND len(list_filter(string_split(b.text, chr(10)), lambda l: length(trim(l, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) >= 8)) > 0""")
def cross_paper_candidates(spark, sf):
    """Customer n's response compares documents n and n+1."""
    d = T.spread(T.table(spark, sf, "documents")).select("doc_id", "text")
    c = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("response_id"))
    locs = c.select("response_id", F.explode(F.array(F.col("response_id"), F.col("response_id") + 1)).alias("doc_id")).join(d, "doc_id")
    loc = F.struct(F.col("doc_id").alias("paper_id"), F.split("text", "\n").alias("excerpts"))
    items = locs.groupBy("response_id").agg(F.array_sort(F.collect_list(loc)).alias("locators")).select(
        "response_id", F.lit(0).alias("pos"), F.lit("q").alias("question"), F.lit("a").alias("ground_truth"), F.lit("comparison").alias("question_type"), "locators")
    out = Q.accepted_cross_paper(items, d.withColumnRenamed("doc_id", "paper_id"))
    return out.select("response_id", "qa_id", F.size("relevant_chunks").alias("n"))
