"""Library, tag, export, memory and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.operators import audit, evaluate as E, ingest, library as L, memory as M, trend
from marginalia.plans import tables as T
from marginalia.plans.registry import query
from marginalia.plans.tables import SQL

STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


def _stamp(df):
    return df.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


# Listings ------------------------------------------------------------------------------------

@query("library_listing", f"""
SELECT id, title, status, {STAMP} AS created_at FROM papers
WHERE status = 'read' AND (title ILIKE '%urgent%' OR authors ILIKE '%urgent%' OR abstract ILIKE '%urgent%')
  AND id IN (SELECT paper_id FROM paper_tags JOIN tags ON tags.id = tag_id WHERE name IN ('Brand#1', 'Brand#7', 'Brand#12'))
ORDER BY papers.created_at DESC, id DESC LIMIT 200 OFFSET 10""")
def library_listing(spark, sf):
    page, _ = L.list_papers(T.papers(spark, sf), T.paper_tags(spark, sf), T.tags(spark, sf), skip=10, limit=500,
                            status="read", tag="Brand#1, Brand#7,Brand#12", q="urgent")
    return _stamp(page.select("id", "title", "status", "created_at"))


@query("library_total", """
SELECT CAST(count(*) AS BIGINT) AS total FROM papers
WHERE (title ILIKE '%g_t%' OR authors ILIKE '%g_t%' OR abstract ILIKE '%g_t%')
  AND id IN (SELECT paper_id FROM paper_tags JOIN tags ON tags.id = tag_id WHERE name IN ('Brand#3', 'Brand#4'))""")
def library_total(spark, sf):
    return L.list_papers(T.papers(spark, sf), T.paper_tags(spark, sf), T.tags(spark, sf), tag="Brand#3,Brand#4", q="g_t")[1]


@query("like_search", """
SELECT id, title, authors FROM papers WHERE title ILIKE '%MACHINERY%' OR authors ILIKE '%MACHINERY%' OR abstract ILIKE '%MACHINERY%'
ORDER BY id LIMIT 50""")
def like_search(spark, sf):
    return L.search_like(T.papers(spark, sf), "machinery", 80).select("id", "title", "authors")


@query("brief_listing", """
SELECT id, title, authors, year, journal, CASE WHEN length(abstract) > 200 THEN left(abstract, 200) || '...' ELSE abstract END AS abstract, status
FROM papers WHERE status = 'unread' ORDER BY created_at DESC, id DESC LIMIT 100 OFFSET 5""")
def brief_listing(spark, sf):
    return L.list_brief(T.papers(spark, sf), 5, 1000, "unread")


@query("paper_briefs", """
SELECT id, title, authors, year, journal, CASE WHEN length(abstract) > 200 THEN left(abstract, 200) || '...' ELSE abstract END AS abstract, status FROM papers""")
def paper_briefs(spark, sf):
    return L.brief(T.papers(spark, sf))


# Statistics ----------------------------------------------------------------------------------

@query("stats_by_year", "SELECT CAST(year AS VARCHAR) AS year, CAST(count(*) AS BIGINT) AS n FROM papers WHERE year <> 0 GROUP BY 1")
def stats_by_year(spark, sf):
    return L.by_year(T.papers(spark, sf))


@query("stats_by_status", "SELECT coalesce(nullif(status, ''), 'unread') AS status, CAST(count(*) AS BIGINT) AS n FROM papers GROUP BY 1")
def stats_by_status(spark, sf):
    return L.by_status(T.papers(spark, sf))


@query("stats_top_tags", """
SELECT name, CAST(count(*) AS BIGINT) AS n FROM paper_tags JOIN tags ON tags.id = tag_id GROUP BY name ORDER BY n DESC, name LIMIT 20""")
def stats_top_tags(spark, sf):
    return L.by_tag(T.paper_tags(spark, sf), T.tags(spark, sf))


@query("stats_top_authors", """
SELECT author, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT id, unnest(range(len(string_split(authors, ',')))) AS pos, trim(unnest(string_split(authors, ','))) AS author FROM papers)
WHERE author <> '' GROUP BY author ORDER BY n DESC, min(id * 100 + pos) LIMIT 10""")
def stats_top_authors(spark, sf):
    return L.top_authors(T.papers(spark, sf))


@query("library_grouping_sets", """
SELECT CASE grouping(s, p) WHEN 1 THEN 'status' WHEN 2 THEN 'processed' ELSE 'total' END AS kind,
       coalesce(CASE grouping(s, p) WHEN 1 THEN s WHEN 2 THEN p END, '') AS value, CAST(count(*) AS BIGINT) AS n
FROM (SELECT coalesce(nullif(status, ''), 'unknown') AS s, coalesce(nullif(processed, ''), 'unknown') AS p FROM papers)
GROUP BY GROUPING SETS ((s), (p), ())""")
def library_grouping_sets(spark, sf):
    return L.library_counts(T.papers(spark, sf))


@query("chunk_counts", "SELECT paper_id, CAST(count(*) AS BIGINT) AS n FROM line_chunks GROUP BY paper_id")
def chunk_counts(spark, sf):
    return L.chunk_counts(T.line_chunks(spark, sf))


# Batch updates -------------------------------------------------------------------------------

@query("batch_status_update", """
SELECT id, CASE WHEN id IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'important' ELSE status END AS status FROM papers""")
def batch_status_update(spark, sf):
    ids = T.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_id"))
    return L.update_status(T.papers(spark, sf), ids, "important").select("id", "status")


@query("batch_tag_add", """
SELECT paper_id, name FROM (
  SELECT paper_id, name FROM paper_tags JOIN tags ON tags.id = tag_id
  UNION SELECT o_orderkey, t FROM orders CROSS JOIN (SELECT unnest(['Brand#1', 'favourite']) AS t) WHERE o_orderpriority = '1-URGENT')""")
def batch_tag_add(spark, sf):
    ids = T.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper_id"))
    names, links = L.add_tags(T.paper_tags(spark, sf), T.tags(spark, sf), ids, ["Brand#1", "favourite"])
    return links.join(names.select(F.col("id").alias("tag_id"), "name"), "tag_id").select("paper_id", "name")


@query("batch_tag_remove", """
SELECT paper_id, tag_id FROM paper_tags WHERE NOT (tag_id IN (1, 2) AND paper_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'))""")
def batch_tag_remove(spark, sf):
    ids = T.table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("paper_id"))
    return L.remove_tags(T.paper_tags(spark, sf), T.tags(spark, sf), ids, ["Brand#1", "Brand#2"])


@query("cascade_delete", """
SELECT 'papers' AS name, CAST(count(*) AS BIGINT) AS n FROM papers WHERE id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'paper_tags', count(*) FROM paper_tags WHERE paper_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'edges', count(*) FROM edges WHERE citing_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
  AND cited_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'citations', count(*) FROM thesis_citations WHERE paper_id IS NULL OR paper_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark, sf):
    ids = T.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("paper_id"))
    left = ingest.delete_papers(ids, {"papers": T.papers(spark, sf), "paper_tags": T.paper_tags(spark, sf),
                                      "edges": T.edges(spark, sf), "citations": T.thesis_citations(spark, sf)})
    out = None
    for name, df in left.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("metadata_overlay", """
SELECT p.id, CASE WHEN p.id % 2 = 0 THEN upper(p.title) ELSE p.title END AS title,
       CASE WHEN p.id % 5 = 0 THEN 1999 ELSE p.year END AS year, p.journal, coalesce(p.doi, 'doi' || p.id) AS doi,
       CASE WHEN p.id % 2 = 0 THEN 'new' ELSE 'old' END AS shared
FROM (SELECT id, title, year, journal, CASE WHEN doi IS NULL THEN NULL ELSE 'doi' || id END AS doi FROM papers) p""")
def metadata_overlay(spark, sf):
    base = T.papers(spark, sf).withColumn("metadata_json", F.create_map(F.lit("k"), F.lit("old"), F.lit("b"), F.lit("1")))
    even = F.col("id") % 2 == 0
    enhanced = base.select(
        "id", F.when(even, F.upper("title")).otherwise("").alias("title"), F.lit(None).cast("string").alias("authors"),
        F.when(F.col("id") % 5 == 0, 1999).otherwise(0).alias("year"), F.lit("").alias("journal"),
        F.lit(None).cast("string").alias("abstract"), F.concat(F.lit("doi"), F.col("id").cast("string")).alias("doi"),
        F.when(even, F.create_map(F.lit("k"), F.lit("new"))).alias("metadata_json"))
    out = ingest.overlay_metadata(base, enhanced)
    return out.select("id", "title", "year", "journal", "doi", F.element_at("metadata_json", "k").alias("shared"))


# Exports -------------------------------------------------------------------------------------

SQL["tag_lists"] = """
SELECT paper_id, string_agg(name, ', ' ORDER BY tag_id) AS tags FROM paper_tags JOIN tags ON tags.id = tag_id GROUP BY paper_id"""


@query("export_rows", f"""
SELECT CAST(id AS VARCHAR) AS id, title, authors, CAST(year AS VARCHAR) AS year, journal, coalesce(doi, '') AS doi, status,
       coalesce(t.tags, '') AS tags, filename, {STAMP} AS created_at FROM papers LEFT JOIN tag_lists t ON t.paper_id = id""")
def export_rows(spark, sf):
    return L.export_rows(T.papers(spark, sf), T.paper_tags(spark, sf), T.tags(spark, sf))


@query("citation_strings", """
SELECT id, authors || ' (' || year || '). ' || title || '. ' || journal AS apa, authors || '. "' || title || '." ' || journal || ', ' || year || '.' AS mla,
       authors || '. ' || title || '[J]. ' || journal || ', ' || year || '.' AS gbt FROM papers""")
def citation_strings(spark, sf):
    cols = [F.col(c) for c in ("authors", "title", "year", "journal")]
    return T.papers(spark, sf).select("id", *[X.format_citation(s, *cols).alias(n) for s, n in (
        ("APA", "apa"), ("MLA", "mla"), ("GB/T 7714", "gbt"))])


@query("numbered_citations", """
SELECT CAST(n AS BIGINT) AS row_number, '[' || n || '] ' || authors || '. ' || title || '[J]. ' || journal || ', ' || year || '.' AS line
FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS n FROM papers)""")
def numbered_citations(spark, sf):
    return L.citation_list(T.papers(spark, sf))


@query("ordered_listings", """
SELECT 'tags' AS kind, name AS item, CAST(row_number() OVER (ORDER BY name, id) AS BIGINT) AS pos FROM tags
UNION ALL SELECT 'theses', CAST(id AS VARCHAR), row_number() OVER (ORDER BY created_at DESC, id) FROM papers
UNION ALL SELECT 'conversations', CAST(conversation_id AS VARCHAR), row_number() OVER (ORDER BY u DESC, conversation_id) FROM (SELECT conversation_id, max(turn) AS u FROM messages GROUP BY 1)""")
def ordered_listings(spark, sf):
    """Tags by name, theses by creation and conversations by their last message; the numbering shows the order."""
    from marginalia.operators.blocks import global_row_number
    tables = {"tags": (T.tags(spark, sf), "id", "name"), "theses": (T.papers(spark, sf).select("id", "created_at"), "id", "id"),
              "conversations": (T.messages(spark, sf).groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_at").alias("updated_at")), "id", "id")}
    out = None
    for kind, (rows, key, item) in tables.items():
        numbered = global_row_number(rows, [*L.listing_order(kind), F.col(key).asc()], "pos").select(
            F.lit(kind).alias("kind"), F.col(item).cast("string").alias("item"), "pos")
        out = numbered if out is None else out.unionByName(numbered)
    return out


@query("ordered_annotations", """
SELECT user_id AS paper_id, event_id AS id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(value) AS BIGINT), ts, event_id) AS BIGINT) AS pos FROM events""")
def ordered_annotations(spark, sf):
    """Events as annotations of papers, by page, then time."""
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("id"), F.floor("value").cast("bigint").alias("page_number"), F.col("ts").alias("created_at"))
    return L.ordered_annotations(e, block=16).select("paper_id", "id", "pos")


# Memories ------------------------------------------------------------------------------------

SQL["memory_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY CASE WHEN memory_type <> 'short_term' THEN importance END DESC NULLS LAST,
  created_at DESC, id DESC) AS rn FROM memories"""


@query("memory_eviction", """
SELECT id, memory_type, importance FROM memory_ranked
WHERE rn <= CASE memory_type WHEN 'short_term' THEN 20 WHEN 'long_term' THEN 100 WHEN 'preference' THEN 50 WHEN 'fact' THEN 200 ELSE 1000000000 END""")
def memory_eviction(spark, sf):
    return M.enforce_capacity(T.memories(spark, sf)).select("id", "memory_type", "importance")


@query("memory_reading", "SELECT id, CAST(rn AS INTEGER) AS pos FROM memory_ranked WHERE memory_type = 'preference' AND rn <= 25")
def memory_reading(spark, sf):
    from pyspark.sql import Window as W
    rows = M.read_memories(T.memories(spark, sf), "preference", 25)
    return rows.select("id", F.row_number().over(W.orderBy(F.col("importance").desc(), F.col("created_at").desc(), F.col("id").desc())).alias("pos"))


@query("long_term_memories", """
SELECT id, memory_type FROM memories WHERE memory_type IN ('long_term', 'preference', 'fact')
ORDER BY importance DESC, created_at DESC, id DESC LIMIT 10""")
def long_term_memories(spark, sf):
    return M.long_term(T.memories(spark, sf)).select("id", "memory_type")


SQL["owner_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY source_conversation_id, kind ORDER BY CASE WHEN kind = 'long' THEN importance END DESC NULLS LAST,
  created_at DESC, id DESC) AS r FROM (SELECT *, CASE WHEN memory_type = 'short_term' THEN 'short' ELSE 'long' END AS kind FROM memories WHERE memory_type <> 'scratch')"""


@query("memory_context", """
SELECT source_conversation_id, concat_ws(chr(10) || chr(10),
  '用户背景与偏好：' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY r) FILTER (WHERE kind = 'long' AND r <= 5),
  '近期讨论主题：' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY r) FILTER (WHERE kind = 'short' AND r <= 3)) AS context
FROM owner_ranked GROUP BY 1""")
def memory_context(spark, sf):
    return M.memory_context(T.memories(spark, sf), "source_conversation_id")


@query("last10_history", """
SELECT conversation_id, id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS BIGINT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS b FROM messages) WHERE b <= 10""")
def last10_history(spark, sf):
    return M.last_messages(T.messages(spark, sf)).select("conversation_id", "id", "position")


@query("message_counts", "SELECT conversation_id, CAST(count(*) AS BIGINT) AS n FROM messages GROUP BY 1")
def message_counts(spark, sf):
    return M.message_counts(T.messages(spark, sf))


SQL["digests"] = """
SELECT conversation_id, any_value(total) AS total, string_agg(role || ': ' || left(content, 500), chr(10) ORDER BY turn) AS digest FROM (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS b, count(*) OVER (PARTITION BY conversation_id) AS total FROM messages)
WHERE b <= 10 AND total >= 5 GROUP BY 1"""


@query("digest_input", "SELECT conversation_id, digest FROM digests")
def digest_input(spark, sf):
    return M.digest_input(T.messages(spark, sf))


@query("due_digests", "SELECT conversation_id, digest FROM digests WHERE total % 5 = 0")
def due_digests(spark, sf):
    return M.due_digests(T.messages(spark, sf))


@query("short_term_upsert", """
SELECT source_conversation_id, content, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT m.source_conversation_id, CASE WHEN m.id = f.first_id AND s.conv_id IS NOT NULL THEN 'digest ' || s.conv_id ELSE m.content END AS content
  FROM memories m LEFT JOIN (SELECT source_conversation_id, min(id) AS first_id FROM memories WHERE memory_type = 'short_term' GROUP BY 1) f USING (source_conversation_id)
  LEFT JOIN (SELECT DISTINCT conv_id FROM conversations) s ON s.conv_id = m.source_conversation_id
  UNION ALL SELECT conv_id, 'digest ' || conv_id FROM (SELECT DISTINCT conv_id FROM conversations)
  WHERE conv_id NOT IN (SELECT source_conversation_id FROM memories WHERE memory_type = 'short_term')) GROUP BY 1, 2""")
def short_term_upsert(spark, sf):
    new = T.messages(spark, sf).select("conversation_id").distinct().select(
        "conversation_id", F.concat(F.lit(" digest "), F.col("conversation_id").cast("string")).alias("content"),
        F.lit(None).cast("timestamp").alias("created_at"), (-F.col("conversation_id") - 1).alias("id"))
    out = M.upsert_short_term(T.memories(spark, sf), new)
    return out.groupBy("source_conversation_id", "content").agg(F.count(F.lit(1)).alias("n"))


# Trends --------------------------------------------------------------------------------------

SQL["runs"] = """
SELECT event_type AS series, strftime(ts, '%Y%m%d') AS run_id, avg(value) / 1000 AS recall, avg(value) / 2000 AS mrr,
       CASE WHEN count(*) % 7 = 0 THEN NULL ELSE max(value) / 1000 END AS ndcg, CASE WHEN count(*) % 5 = 0 THEN NULL ELSE count(*) END AS n_positive,
       CAST(NULL AS BIGINT) AS n_negative, CAST(count(*) % 10 AS INTEGER) AS k FROM events GROUP BY 1, 2"""


def runs(spark, sf):
    """One evaluation-like run per event type and day."""
    n = F.count(F.lit(1))
    return T.table(spark, sf, "events").groupBy(F.col("event_type").alias("series"), F.date_format("ts", "yyyyMMdd").alias("run_id")).agg(
        (F.avg("value") / 1000).alias("recall"), (F.avg("value") / 2000).alias("mrr"),
        F.when(n % 7 != 0, F.max("value") / 1000).alias("ndcg"), F.when(n % 5 != 0, n).alias("n_positive"),
        F.lit(None).cast("bigint").alias("n_negative"), (n % 10).cast("int").alias("k"))


@query("trend_delta", """
SELECT series, run_id, round(recall - lag(recall) OVER w, 6) AS delta_recall, round(mrr - lag(mrr) OVER w, 6) AS delta_mrr,
       round(ndcg - lag(ndcg) OVER w, 6) AS delta_ndcg FROM runs WINDOW w AS (PARTITION BY series ORDER BY run_id)""")
def trend_delta(spark, sf):
    out = trend.with_deltas(runs(spark, sf), ["series"])
    return out.select("series", "run_id", *[F.round(f"delta_{m}", 6).alias(f"delta_{m}") for m in ("recall", "mrr", "ndcg")])


@query("trend_totals", """
SELECT series, run_id, CAST(coalesce(n_positive, 0) AS BIGINT) AS total_or_zero, n_positive IS NULL AS missing FROM runs""")
def trend_totals(spark, sf):
    out = trend.totals(runs(spark, sf))
    return out.select("series", "run_id", F.coalesce("n_total", F.lit(0)).alias("total_or_zero"), F.col("n_total").isNull().alias("missing"))


@query("trend_metric_label", "SELECT coalesce(arg_max(k, run_id || series) FILTER (WHERE k IS NOT NULL), 5) AS k FROM runs")
def trend_metric_label(spark, sf):
    r = runs(spark, sf)
    return trend.metric_label(r.withColumn("run_id", F.concat("run_id", "series")))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("trend_pivot", "SELECT run_id AS question_type, " + ", ".join(
    f"round(max(CASE WHEN series = '{t}' THEN recall END), 6) AS {t}_recall, CAST(max(CASE WHEN series = '{t}' THEN n_positive END) AS BIGINT) AS {t}_n"
    for t in _TYPES) + " FROM runs GROUP BY run_id")
def trend_pivot(spark, sf):
    """Days down, event types across: the same pivot as question types by runs."""
    rows = runs(spark, sf).select(F.col("run_id").alias("question_type"), F.col("series").alias("run_id"), "recall", F.col("n_positive").alias("n"))
    p = trend.type_pivot(rows, _TYPES)
    return p.select("question_type", *[c for t in _TYPES for c in (
        F.round(F.col(t)["recall"], 6).alias(f"{t}_recall"), F.col(t)["n"].alias(f"{t}_n"))])


# Audits --------------------------------------------------------------------------------------

@query("orphan_audit", """
SELECT 'tags without paper' AS name, CAST(count(*) AS BIGINT) AS n FROM paper_tags WHERE NOT EXISTS (SELECT 1 FROM papers p WHERE p.id = paper_id AND p.status <> '')
UNION ALL SELECT 'edges citing', count(*) FROM edges WHERE citing_id NOT IN (SELECT id FROM papers WHERE status <> '')
UNION ALL SELECT 'edges cited', count(*) FROM edges WHERE cited_id NOT IN (SELECT id FROM papers WHERE status <> '')
UNION ALL SELECT 'labels without document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def orphan_audit(spark, sf):
    kept = T.papers(spark, sf).filter("status <> ''").select("id")
    e = T.edges(spark, sf)
    docs = T.table(spark, sf, "documents").select("doc_id")
    return audit.foreign_key_audit([
        ("tags without paper", T.paper_tags(spark, sf), "paper_id", kept, "id"), ("edges citing", e, "citing_id", kept, "id"),
        ("edges cited", e, "cited_id", kept, "id"), ("labels without document", T.table(spark, sf, "labels"), "doc_id", docs, "doc_id")])


@query("orphan_repair", """
SELECT false AS dry_run, CAST(count(*) AS BIGINT) AS would_delete, CAST(count(*) AS BIGINT) AS deleted, CAST(0 AS BIGINT) AS remaining
FROM paper_tags WHERE paper_id NOT IN (SELECT id FROM papers WHERE status <> '')""")
def orphan_repair(spark, sf):
    kept = T.papers(spark, sf).filter("status <> ''").select("id")
    return audit.repair_links(T.paper_tags(spark, sf), kept, dry_run=False)[1]


@query("orphan_repair_rows", "SELECT paper_id, tag_id FROM paper_tags WHERE paper_id IN (SELECT id FROM papers WHERE status <> '')")
def orphan_repair_rows(spark, sf):
    kept = T.papers(spark, sf).filter("status <> ''").select("id")
    return audit.repair_links(T.paper_tags(spark, sf), kept, dry_run=False)[0].select("paper_id", "tag_id")


SQL["files"] = "SELECT 'doc/' || doc_id AS path, sha256(text) AS sha256 FROM documents"


def _files(spark, sf):
    d = T.spread(T.table(spark, sf, "documents"))
    return d.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))


def _file_papers(spark, sf):
    lb = T.table(spark, sf, "labels")
    return lb.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc/"), (F.col("doc_id") + F.col("toxic") * 1000000).cast("string")).alias("file_path"),
                     F.when(F.col("quality") == 1, "done").otherwise("error").alias("processed"), F.lit(None).cast("string").alias("doi"))


SQL["file_papers"] = """
SELECT doc_id AS id, 'doc/' || (doc_id + toxic * 1000000) AS file_path, CASE WHEN quality = 1 THEN 'done' ELSE 'error' END AS processed FROM labels"""


@query("corpus_audit", """
SELECT CAST((SELECT count(*) FROM files) AS BIGINT) AS physical_files, CAST((SELECT count(DISTINCT sha256) FROM files) AS BIGINT) AS unique_contents,
       CAST((SELECT count(*) - count(DISTINCT sha256) FROM files) AS BIGINT) AS duplicate_files, CAST(count(*) AS BIGINT) AS papers,
       CAST(count_if(processed = 'done') AS BIGINT) AS processed_done, CAST((SELECT count(*) FROM line_chunks) AS BIGINT) AS chunks,
       CAST(count_if(file_path NOT IN (SELECT path FROM files)) AS BIGINT) AS missing_sources FROM file_papers""")
def corpus_audit(spark, sf):
    return audit.corpus_audit(_files(spark, sf), _file_papers(spark, sf), T.line_chunks(spark, sf))


SQL["manifests"] = """
SELECT paper_id, sha256('[' || string_agg('{"block":' || b || ',"sha256":"' || h || '"}', ',' ORDER BY b) || ']') AS manifest FROM (
  SELECT paper_id, CAST(floor(chunk_index / 512) AS BIGINT) AS b,
         sha256('[' || string_agg('{"chunk_index":' || chunk_index || ',"content_sha256":"' || sha256(content) || '"}', ',' ORDER BY chunk_index) || ']') AS h
  FROM line_chunks GROUP BY 1, 2) GROUP BY paper_id"""


@query("chunk_manifests", "SELECT paper_id, manifest FROM manifests")
def chunk_manifests(spark, sf):
    return audit.chunk_manifests(T.line_chunks(spark, sf).select("paper_id", "chunk_index", "content"))


@query("document_audit", """
SELECT p.id AS paper_id, 'sha256:' || f.sha256 AS paper_uid, f.sha256, p.processed, CAST(coalesce(c.n, 0) AS BIGINT) AS chunk_count,
       coalesce(m.manifest, sha256('[]')) AS chunk_manifest, CAST(coalesce(k.n, 0) AS BIGINT) AS physical_copies
FROM file_papers p LEFT JOIN files f ON f.path = p.file_path LEFT JOIN (SELECT sha256, count(*) AS n FROM files GROUP BY 1) k ON k.sha256 = f.sha256
LEFT JOIN (SELECT paper_id, count(*) AS n FROM line_chunks GROUP BY 1) c ON c.paper_id = p.id LEFT JOIN manifests m ON m.paper_id = p.id""")
def document_audit(spark, sf):
    return audit.document_audit(_files(spark, sf), _file_papers(spark, sf), T.line_chunks(spark, sf))


def _set_hash_sql(h: str) -> str:
    parts = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr({h}, {15 * i + 1}, 15)) AS UBIGINT)), 0) AS VARCHAR)" for i in range(4))
    return f"sha256(concat_ws(':', CAST(count({h}) AS VARCHAR), {parts}))"


@query("manifest_hash", f"""
SELECT {_set_hash_sql('h')} AS corpus_manifest, CAST(count(*) AS BIGINT) AS n_chunks FROM (
  SELECT sha256(concat_ws('|', CASE WHEN l.doc_id IS NOT NULL THEN 'doi:' || paper_id ELSE 'orphan:' || sha256(content) END, chunk_index, sha256(content))) AS h
  FROM line_chunks LEFT JOIN labels l ON l.doc_id = paper_id)""")
def manifest_hash(spark, sf):
    uids = T.table(spark, sf, "labels").select(F.col("doc_id").alias("paper_id"), F.concat(F.lit("doi:"), F.col("doc_id").cast("string")).alias("paper_uid"))
    return audit.corpus_fingerprint(T.line_chunks(spark, sf), uids)


@query("duplicate_audit", """
SELECT sha256, CAST(count(*) AS BIGINT) AS n FROM files GROUP BY 1 HAVING count(*) > 1""")
def duplicate_audit(spark, sf):
    return _files(spark, sf).groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("new_documents", """
SELECT min('doc/' || doc_id) AS path, md5(text) AS md5 FROM documents
WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) GROUP BY md5(text)""")
def new_documents(spark, sf):
    """Content-hash dedup: labelled documents count as already in the library."""
    from marginalia.sources.documents import new_documents as fresh
    d = T.spread(T.table(spark, sf, "documents"))
    docs = d.select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("md5"))
    known = docs.join(T.table(spark, sf, "labels"), "doc_id", "left_semi").select("md5")
    return fresh(docs, known).select("path", "md5")


@query("vector_validation", """
SELECT 'missing vector' AS problem, CAST(count(*) AS BIGINT) AS n FROM line_chunks WHERE 'p' || paper_id || '_c' || chunk_index NOT IN (SELECT chunk_id FROM vector_table)
UNION ALL SELECT 'unknown id', count(*) FROM vector_table WHERE chunk_id NOT IN (SELECT 'p' || paper_id || '_c' || chunk_index FROM line_chunks)""")
def vector_validation(spark, sf):
    return audit.vector_validation(T.vector_table(spark, sf), T.line_chunks(spark, sf), 64)


@query("orphan_vectors", """
SELECT chunk_id, paper_id FROM (SELECT CASE WHEN chunk_index = 0 THEN 'p' || paper_id || '_c-1' ELSE chunk_id END AS chunk_id, paper_id FROM vector_table)
WHERE paper_id IN (SELECT doc_id FROM labels)""")
def orphan_vectors(spark, sf):
    v = T.vector_table(spark, sf).withColumn("chunk_id", F.when(
        F.col("chunk_index") == 0, F.format_string("p%d_abstract", "paper_id")).otherwise(F.col("chunk_id")))
    alive = T.table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    return ingest.migrate_abstract_ids(v, alive).select("chunk_id", "paper_id")


# Benchmark validation ------------------------------------------------------------------------

SQL["qa_rows"] = """
SELECT d.doc_id, 'qa' || (d.doc_id - d.doc_id % 50 * (CASE WHEN d.doc_id % 400 < 50 THEN 1 ELSE 0 END)) AS qa_id, string_split(text, chr(10))[1] AS question,
       CASE WHEN n_chars < 200 THEN '  ' ELSE text END AS ground_truth, CASE lang WHEN 'en' THEN 'factoid' WHEN 'fr' THEN 'summary' WHEN 'de' THEN 'comparison' ELSE 'essay' END AS question_type,
       CASE WHEN source IN ('src1', 'src2') THEN 'web' ELSE 'synthetic' END AS source, l.quality = 1 AS has_answer,
       CASE WHEN d.doc_id % 3 = 0 THEN 'dev' WHEN d.doc_id % 3 = 1 THEN 'train' ELSE 'test' END AS split, toxic = 0 AS reviewed,
       'doi:' || source || '/' || lang AS uid, text AS quote FROM documents d LEFT JOIN labels l USING (doc_id)"""


def qa_rows(spark, sf):
    d = T.table(spark, sf, "documents").join(T.table(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    qid = i - (i % 50) * F.when(i % 400 < 50, 1).otherwise(0)
    return d.select(
        "doc_id", F.concat(F.lit("qa"), qid.cast("string")).alias("qa_id"), F.split("text", "\n")[0].alias("question"),
        F.when(F.col("n_chars") < 200, "  ").otherwise(F.col("text")).alias("ground_truth"),
        F.when(F.col("lang") == "en", "factoid").when(F.col("lang") == "fr", "summary").when(F.col("lang") == "de", "comparison").otherwise("essay").alias("question_type"),
        F.when(F.col("source").isin("src1", "src2"), "web").otherwise("synthetic").alias("source"), (F.col("quality") == 1).alias("has_answer"),
        F.when(i % 3 == 0, "dev").when(i % 3 == 1, "train").otherwise("test").alias("split"), (F.col("toxic") == 0).alias("reviewed"),
        F.lit(None).cast("array<struct<paper_id:bigint,section:string,keywords:array<string>>>").alias("relevant_chunks"),
        F.array(F.struct(F.concat(F.lit("doi:"), F.col("source"), F.lit("/"), F.col("lang")).alias("paper_uid"),
                         F.col("text").alias("quote"))).alias("relevant_evidence"))


@query("quality_violations", """
SELECT qa_id, problem, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT qa_id, 'missing required field' AS problem FROM qa_rows WHERE has_answer IS NULL
  UNION ALL SELECT qa_id, 'question is blank' FROM qa_rows WHERE has_answer IS NOT NULL AND trim(question) = ''
  UNION ALL SELECT qa_id, 'ground_truth is blank' FROM qa_rows WHERE has_answer IS NOT NULL AND trim(ground_truth) = ''
  UNION ALL SELECT qa_id, 'illegal question_type' FROM qa_rows WHERE has_answer IS NOT NULL AND question_type = 'essay'
  UNION ALL SELECT qa_id, 'illegal source' FROM qa_rows WHERE has_answer IS NOT NULL AND source = 'web'
  UNION ALL SELECT qa_id, 'negative with labels' FROM qa_rows WHERE NOT has_answer
  UNION ALL SELECT qa_id, 'quote under 20 characters' FROM qa_rows WHERE has_answer IS NOT NULL AND length(trim(quote, ' ' || chr(10))) < 20
  UNION ALL SELECT qa_id, 'qa_id repeated' FROM qa_rows WHERE has_answer IS NOT NULL GROUP BY qa_id HAVING count(*) > 1) GROUP BY 1, 2""")
def quality_violations(spark, sf):
    return E.dataset_violations(qa_rows(spark, sf)).groupBy("qa_id", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("split_leakage", """
SELECT subject, problem, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT qa_id AS subject, 'not reviewed' AS problem FROM qa_rows WHERE NOT coalesce(reviewed, false)
  UNION ALL SELECT qa_id, 'illegal split' FROM qa_rows WHERE split = 'test'
  UNION ALL SELECT uid, 'paper in several splits' FROM qa_rows WHERE split <> 'test' GROUP BY uid HAVING count(DISTINCT split) > 1) GROUP BY 1, 2""")
def split_leakage(spark, sf):
    return E.benchmark_violations(qa_rows(spark, sf)).groupBy("subject", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("benchmark_counts", """
SELECT split, CAST(count(DISTINCT qa_id) AS BIGINT) AS items, CAST(count(DISTINCT uid) AS BIGINT) AS papers FROM qa_rows GROUP BY split""")
def benchmark_counts(spark, sf):
    return E.benchmark_counts(qa_rows(spark, sf))


@query("split_selection", "SELECT qa_id, question_type FROM qa_rows WHERE split = 'dev'")
def split_selection(spark, sf):
    return E.select_split(qa_rows(spark, sf), "dev").select("qa_id", "question_type")


@query("qa_whitelist", """
SELECT q.qa_id, CAST(w.pos AS INTEGER) AS position FROM qa_rows q JOIN (SELECT unnest(['qa107', 'qa103', 'qa111']) AS qa_id, unnest([0, 1, 2]) AS pos) w USING (qa_id)""")
def qa_whitelist(spark, sf):
    return E.select_qa(qa_rows(spark, sf), ["qa107", "qa103", "qa107", "qa111"]).select("qa_id", "position")


@query("corpus_violations", """
SELECT paper_uid, problem, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT paper_uid, 'title is blank' AS problem FROM (SELECT 'doi:' || doc_id AS paper_uid, string_split(text, chr(10))[1] AS title FROM documents) WHERE trim(title) = ''
  UNION ALL SELECT 'doi:' || paper_id, 'content under 20 characters' FROM line_chunks WHERE length(trim(content, ' ' || chr(9) || chr(13) || chr(160))) < 20) GROUP BY 1, 2""")
def corpus_violations(spark, sf):
    uid = lambda c: F.concat(F.lit("doi:"), F.col(c).cast("string")).alias("paper_uid")
    papers = T.document_papers(spark, sf).select(uid("id"), "title")
    chunks = T.line_chunks(spark, sf).select(uid("paper_id"), "chunk_index", "content")
    return E.corpus_violations(papers, chunks).groupBy("paper_uid", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("qrels_hash", f"""
SELECT {_set_hash_sql('h')} AS qrels FROM (
  SELECT sha256('{{"qa_id":"' || qa_id || '"' || CASE WHEN has_answer IS NULL THEN '' ELSE ',"has_answer":' || has_answer END ||
                ',"relevant_evidence":[{{"paper_uid":"' || uid || '","quote":' || replace(CAST(to_json(left(quote, 0)) AS VARCHAR), '/', '\\/') || '}}]}}') AS h FROM qa_rows)""")
def qrels_hash(spark, sf):
    rows = qa_rows(spark, sf).withColumn("relevant_evidence", F.transform("relevant_evidence", lambda e: F.struct(
        e["paper_uid"].alias("paper_uid"), F.lit("").alias("quote"))))
    return audit.qrels_fingerprint(rows)


@query("comparison_keys", """
SELECT qa_id, concat_ws(':', sha256(question), sha256(quote), sha256(uid), 'hybrid', 'bm25', '5') AS comparison_key FROM qa_rows""")
def comparison_keys(spark, sf):
    e = F.col("relevant_evidence")[0]
    return qa_rows(spark, sf).select("qa_id", E.comparison_key(
        F.sha2("question", 256), F.sha2(e["quote"], 256), F.sha2(e["paper_uid"], 256), "hybrid", "bm25", 5).alias("comparison_key"))


@query("unresolved_items", """
SELECT CAST(doc_id AS VARCHAR) AS qa_id, 'no label could be resolved' AS problem FROM documents d WHERE n_chars >= 200 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unresolved_items(spark, sf):
    """Documents of some length as positive items, the label table as what could be resolved."""
    items = T.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("qa_id"), (F.col("n_chars") >= 200).alias("has_answer"))
    return E.unresolved(items, T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("qa_id")))
