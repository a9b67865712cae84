"""Library tables: listings, statistics, batch updates, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import text as X, vocabulary as V
from marginalia.operators.blocks import block_of, global_row_number, row_numbers
from marginalia.schemas import any_of

BRIEF_CHARS = 200


# Listings ------------------------------------------------------------------------------------

def like_any(pattern: str, columns: list[str]) -> Column:
    """Case-insensitive ``LIKE %pattern%`` on any column; % and _ stay wildcards."""
    return any_of([F.coalesce(F.ilike(F.col(c), F.lit(f"%{pattern}%")), F.lit(False)) for c in columns])


def select_papers(papers: DataFrame, paper_tags: DataFrame | None = None, tags: DataFrame | None = None,
                  status: str | None = None, tag: str | None = None, q: str | None = None) -> DataFrame:
    """Papers matching an optional status, any of a comma list of tags, and a text pattern."""
    out = papers
    if status:
        out = out.filter(F.col("status") == status)
    names = [t.strip() for t in (tag or "").split(",") if t.strip()]
    if names:
        wanted = paper_tags.join(tags.filter(F.col("name").isin(names)), paper_tags.tag_id == tags.id)
        out = out.join(wanted.select("paper_id"), out.id == F.col("paper_id"), "left_semi")
    if q:
        out = out.filter(like_any(q, ["title", "authors", "abstract"]))
    return out


def list_papers(papers: DataFrame, paper_tags: DataFrame | None = None, tags: DataFrame | None = None,
                skip: int = 0, limit: int = 20, **criteria) -> tuple[DataFrame, DataFrame]:
    """(page, total): newest first, page size within 1..200, total counted before paging."""
    matched = select_papers(papers, paper_tags, tags, **criteria)
    page = matched.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(skip).limit(min(max(limit, 1), 200))
    return page, matched.agg(F.count(F.lit(1)).alias("total"))


def search_like(papers: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Fallback search without an index, at most 50 rows."""
    return (papers.filter(like_any(query, ["title", "authors", "abstract"]))
            .orderBy("id").limit(min(max(limit, 1), 50)))


def brief(papers: DataFrame) -> DataFrame:
    """Listing columns with the abstract cut to 200 characters."""
    text = F.coalesce("abstract", F.lit(""))
    cut = F.when(F.length(text) > BRIEF_CHARS, F.concat(F.left(text, F.lit(BRIEF_CHARS)), F.lit("..."))).otherwise(text)
    return papers.select("id", "title", "authors", "year", "journal", cut.alias("abstract"), "status")


def list_brief(papers: DataFrame, skip: int = 0, limit: int = 20, status: str | None = None) -> DataFrame:
    rows = papers.filter(F.col("status") == status) if status else papers
    return brief(rows.orderBy(F.col("created_at").desc(), F.col("id").desc())
                 .offset(max(0, skip)).limit(min(max(limit, 1), 100)))


# Statistics ----------------------------------------------------------------------------------

def by_year(papers: DataFrame) -> DataFrame:
    return (papers.filter(F.col("year") != 0).groupBy(F.col("year").cast("string").alias("year"))
            .agg(F.count(F.lit(1)).alias("n")))


def by_status(papers: DataFrame) -> DataFrame:
    return (papers.groupBy(F.coalesce(X.truthy(F.col("status")), F.lit("unread")).alias("status"))
            .agg(F.count(F.lit(1)).alias("n")))


def by_tag(paper_tags: DataFrame, tags: DataFrame, top: int = 20) -> DataFrame:
    """Tags by number of papers. Counts run before the name join, so a popular tag stays small."""
    counts = paper_tags.groupBy("tag_id").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return (named.groupBy("name").agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), F.col("name")).limit(top))


def top_authors(papers: DataFrame, top: int = 10) -> DataFrame:
    """Authors by number of mentions; ties go to the first appearance."""
    names = (papers.select("id", F.posexplode(F.split("authors", ",")).alias("pos", "raw"))
             .select("id", "pos", X.strip(F.col("raw")).alias("author")).filter(F.length("author") > 0))
    return (names.groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("_first"))
            .orderBy(F.col("n").desc(), F.col("_first").asc()).limit(top).drop("_first"))


def library_counts(papers: DataFrame) -> DataFrame:
    """Total and counts by status and by processing state in one pass: ``(kind, value, n)``."""
    unknown = lambda c: F.coalesce(X.truthy(F.col(c)), F.lit("unknown"))
    rows = papers.select(unknown("status").alias("status"), unknown("processed").alias("processed"))
    grouped = rows.groupingSets([["status"], ["processed"], []], "status", "processed").agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 1, "status").when(F.col("g") == 2, "processed").otherwise("total")
    return grouped.select(kind.alias("kind"), F.coalesce(
        F.when(F.col("g") == 1, F.col("status")).when(F.col("g") == 2, F.col("processed")), F.lit("")).alias("value"), "n")


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("n"))


# Batch updates -------------------------------------------------------------------------------

def update_status(papers: DataFrame, ids: DataFrame, status: str) -> DataFrame:
    """Set the status of every paper in ``ids(paper_id)``."""
    hit = ids.select(F.col("paper_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    return (papers.join(hit, "id", "left")
            .withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status")))
            .drop("_hit").select(*papers.columns))


def add_tags(paper_tags: DataFrame, tags: DataFrame, ids: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tags, paper_tags) after attaching every name to every paper; missing tags are created."""
    wanted = list(dict.fromkeys(names))
    known = {r["name"] for r in tags.filter(F.col("name").isin(wanted)).select("name").distinct().collect()}
    missing = [n for n in wanted if n not in known]
    top = tags.agg(F.max("id")).first()[0] or 0
    created = tags.sparkSession.createDataFrame(
        [(top + i, n) for i, n in enumerate(missing, start=1)], "id BIGINT, name STRING")
    all_tags = tags.unionByName(created, allowMissingColumns=True)
    tag_ids = {r["name"]: r["id"] for r in all_tags.filter(F.col("name").isin(wanted))
               .groupBy("name").agg(F.min("id").alias("id")).collect()}
    links = ids.select("paper_id").distinct().withColumn(
        "tag_id", F.explode(F.array(*[F.lit(i).cast("bigint") for i in tag_ids.values()])))
    return all_tags, paper_tags.select("paper_id", "tag_id").unionByName(links).distinct()


def remove_tags(paper_tags: DataFrame, tags: DataFrame, ids: DataFrame, names: list[str]) -> DataFrame:
    doomed = [r["id"] for r in tags.filter(F.col("name").isin(names)).select("id").collect()] if names else []
    matched = ids.select("paper_id").distinct()
    touched = paper_tags.filter(F.col("tag_id").isin(doomed))
    return (paper_tags.filter(~F.col("tag_id").isin(doomed))
            .unionByName(touched.join(matched, "paper_id", "left_anti")))


def paper_rule_tags(papers: DataFrame) -> DataFrame:
    """Rule tags of each paper, one row per tag in rule order."""
    tags = X.rule_tags(F.col("title"), F.col("abstract"), F.col("journal"))
    return papers.select(F.col("id").alias("paper_id"), F.posexplode(tags).alias("pos", "tag"))


def collect_tags(papers: DataFrame, responses: DataFrame, attached: DataFrame) -> DataFrame:
    """New tags per paper: model tags before rule tags, five at most, those attached already left out."""
    joined = papers.join(responses.select(F.col("paper_id").alias("id"), "response"), "id", "left")
    merged = X.merge_tags(X.model_tags(F.col("response")),
                          X.rule_tags(F.col("title"), F.col("abstract"), F.col("journal")))
    rows = (joined.select(F.col("id").alias("paper_id"), F.posexplode(merged).alias("pos", "raw"))
            .select("paper_id", "pos", X.clean_tag(F.col("raw")).alias("tag")).filter(F.length("tag") > 0))
    named = rows.groupBy("paper_id", "tag").agg(F.min("pos").alias("pos"))
    return named.join(attached.select("paper_id", F.col("name").alias("tag")), ["paper_id", "tag"], "left_anti")


# Exports -------------------------------------------------------------------------------------

def export_rows(papers: DataFrame, paper_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """The ten export columns as text, tags joined by comma, newest first order left to the writer."""
    names = (paper_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
             .select("paper_id", "tag_id", "name").distinct()
             .groupBy("paper_id").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("tag_id", "name"))), lambda t: t["name"]), ", ").alias("tags")))
    joined = papers.join(names.withColumnRenamed("paper_id", "id"), "id", "left")

    def cell(name):
        if name == "created_at":
            value = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
        elif name == "year":
            value = F.nullif(F.col("year"), F.lit(0)).cast("string")
        elif name in joined.columns:
            value = F.col(name).cast("string")
        else:
            value = F.lit(None).cast("string")
        return F.coalesce(value, F.lit("")).alias(name)
    return joined.select(*[cell(name) for name, _ in V.EXPORT_COLUMNS])


def citation_list(papers: DataFrame, style: str = "GB/T 7714") -> DataFrame:
    """Numbered reference lines, newest paper first: ``(row_number, line)``."""
    style = style.upper()
    style = style if style in ("APA", "MLA") else "GB/T 7714"
    rows = papers.select("id", "created_at", X.format_citation(
        style, F.col("authors"), F.col("title"), F.col("year"), F.col("journal")).alias("text"))
    numbered = global_row_number(rows, [F.col("created_at").desc_nulls_last(), F.col("id").desc()])
    return numbered.select("row_number", F.concat(F.lit("["), F.col("row_number").cast("string"), F.lit("] "),
                                                  F.col("text")).alias("line"))


def ordered_annotations(annotations: DataFrame, block: int = 512) -> DataFrame:
    """Annotations with their place ``pos`` (from 1) in the paper's listing: by page, then creation, then id.

    Numbered by blocks of pages, so a paper with any number of annotations is not sorted in one task.
    """
    rows = annotations.withColumn("page_block", block_of(F.coalesce("page_number", F.lit(0)), block))
    return row_numbers(rows, ["paper_id"], ["page_number", "created_at", "id"], "page_block", "pos").withColumn("pos", F.col("pos") + 1).drop("page_block")


def listing_order(kind: str) -> list[Column]:
    """Sort keys of the simple listings."""
    return {"annotations": [F.col("page_number").asc(), F.col("created_at").asc()],
            "tags": [F.col("name").asc()],
            "theses": [F.col("created_at").desc()],
            "conversations": [F.col("updated_at").desc()]}[kind]
