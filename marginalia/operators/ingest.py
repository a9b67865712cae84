"""Pages to chunks to vectors, and the maintenance of those tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from marginalia.functions import text as X, vocabulary as V
from marginalia.functions.chunking import BLANK_LINE, chunker
from marginalia.operators.blocks import block_of, running_total, salted_join
from marginalia.schemas import chunk_id
from marginalia.session import materialize

PAGE_BLOCK = 256


def chunk_pages(pages: DataFrame, size: int = V.CHUNK_SIZE, overlap: int = V.CHUNK_OVERLAP,
                separator: str = BLANK_LINE, write: Callable[[DataFrame, str], DataFrame] = materialize) -> DataFrame:
    """Typed chunks of ``pages(paper_id, page_number, text)``; pages never mix.

    The fold is local to a page and runs once: each page's chunks are written as one list with their number. ``chunk_index``
    counts them by page and position, from running sums over the pages' numbers alone, by page block, so a very long paper is
    not gathered in one task. (paper_id, page_number) is the pages' key. ``write`` keeps the lists, a job's scratch for instance.
    """
    split = chunker(size, overlap, separator)
    lists = pages.select("paper_id", "page_number", split("text").alias("chunks"))
    lists = write(lists.withColumn("n", F.coalesce(F.size("chunks"), F.lit(0))), "chunked")
    sizes = lists.select("paper_id", "page_number", "n").withColumn("block", block_of(F.col("page_number"), PAGE_BLOCK))
    before = running_total(sizes, ["paper_id"], ["page_number"], "block", F.col("n"), "before").select("paper_id", "page_number", "before")
    numbered = (lists.join(before, ["paper_id", "page_number"])
                .select("paper_id", "page_number", "before", F.posexplode("chunks").alias("pos", "content"))
                .withColumn("chunk_index", F.col("before") + F.col("pos")))
    return numbered.select(
        "paper_id", F.col("chunk_index").cast("int").alias("chunk_index"), chunk_id().alias("chunk_id"), "content",
        "page_number", F.lit(None).cast("string").alias("section_title"),
        X.chunk_type(F.col("content")).alias("chunk_type"), F.length("content").alias("token_count"))


def abstract_chunks(papers: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunk -1 of each paper: its abstract, else the first page cut to 1500 characters."""
    first = pages.groupBy("paper_id").agg(F.min_by(F.struct("page_number", "text"), "page_number").alias("p"))
    abstract = X.truthy(X.strip(F.coalesce("abstract", F.lit(""))))
    page_text = X.truthy(X.strip(F.coalesce("p.text", F.lit(""))))
    return (papers.select(F.col("id").alias("paper_id"), "abstract").join(first, "paper_id", "left")
            .select("paper_id", F.lit(-1).alias("chunk_index"),
                    F.concat(F.lit("p"), F.col("paper_id").cast("string"), F.lit("_c-1")).alias("chunk_id"),
                    F.coalesce(abstract, F.left(page_text, F.lit(V.ABSTRACT_FALLBACK_CHARS))).alias("content"),
                    F.when(abstract.isNull(), F.col("p.page_number")).alias("page_number"),
                    F.lit(None).cast("string").alias("section_title"), F.lit("abstract").alias("chunk_type"),
                    F.lit(None).cast("int").alias("token_count"))
            .filter(F.col("content").isNotNull()))


def full_texts(pages: DataFrame, joiner: str = "\n\n") -> DataFrame:
    """Whole text per paper; the row is the document itself."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy("paper_id").agg(F.array_join(
        F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), joiner).alias("text"))


def replace_papers(old: DataFrame, new: DataFrame, batch: DataFrame) -> DataFrame:
    """All rows of the batch's papers come from ``new``; other papers keep theirs."""
    ids = batch.select("paper_id").distinct()
    return old.join(ids, "paper_id", "left_anti").unionByName(new.join(ids, "paper_id", "left_semi"))


def vector_records(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """Records to embed, with defaults. A chunk without a paper has ``orphan`` true; see
    ``require_no_orphans``."""
    owners = papers.select(F.col("id").alias("paper_id"), "title", "authors", "year", F.lit(True).alias("known"))
    joined = salted_join(chunks, owners, ["paper_id"], "left", spread_by=["chunk_index"])
    return joined.select(
        chunk_id().alias("chunk_id"), "paper_id", "chunk_index",
        F.coalesce(X.truthy(F.col("chunk_type")), F.lit("paragraph")).alias("chunk_type"),
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("authors", F.lit("")).alias("authors"), "year",
        "page_number", F.coalesce("content", F.lit("")).alias("document"), F.col("known").isNull().alias("orphan"))


def require_no_orphans(records: DataFrame) -> DataFrame:
    bad = records.filter("orphan").select("paper_id").take(1)
    if bad:
        raise ValueError(f"chunk refers to a missing paper: {bad[0]['paper_id']}")
    return records.drop("orphan")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest row per ``chunk_id``. Rows of ``new`` without an id get ``p{paper}_c{index}``.

    Both sides carry ``batch_ts``; the aggregate combines on the map side, so a chunk written in
    many batches never gathers its copies.
    """
    new = new.withColumn("chunk_id", F.coalesce("chunk_id", chunk_id()))
    both = old.unionByName(new, allowMissingColumns=True)
    payload = [c for c in both.columns if c != "chunk_id"]
    newest = both.groupBy("chunk_id").agg(F.max_by(F.struct(*payload), "batch_ts").alias("r"))
    return newest.select("chunk_id", "r.*")


def write_vectors(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Overwrite only the paper buckets present in ``df``; call with complete buckets."""
    (df.withColumn("paper_bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int"))
     .repartition("paper_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("paper_bucket").parquet(path))


def delete_papers(ids: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Cascade delete. ``tables`` maps a table name to its DataFrame; edge tables lose rows on either end."""
    gone = ids.select("paper_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "papers":
            out[name] = df.join(gone, df.id == gone.paper_id, "left_anti")
        elif "citing_id" in df.columns:
            out[name] = (df.join(gone, df.citing_id == gone.paper_id, "left_anti")
                         .join(gone, F.col("cited_id") == gone.paper_id, "left_anti"))
        else:
            out[name] = df.join(gone, "paper_id", "left_anti")
    return out


def overlay_metadata(papers: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Enhanced value where it is not empty; JSON maps merged, the enhanced side wins."""
    fields = ["title", "authors", "year", "journal", "abstract", "doi"]
    e = enhanced.select(F.col("id"), *[F.col(f).alias(f"e_{f}") for f in fields],
                        F.col("metadata_json").alias("e_map"))
    joined = papers.join(e, "id", "left")
    empty = F.create_map().cast("map<string,string>")
    base, top = F.coalesce("metadata_json", empty), F.coalesce("e_map", empty)
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(top, k)), top)

    def pick(f):
        new = F.nullif(F.col("e_year"), F.lit(0)) if f == "year" else X.truthy(F.col(f"e_{f}"))
        return F.coalesce(new, F.col(f)).alias(f)
    return joined.select(*[pick(c) if c in fields else
                           (F.when(F.col("e_map").isNotNull(), merged).otherwise(F.col(c)).alias(c)
                            if c == "metadata_json" else F.col(c)) for c in papers.columns])


def migrate_abstract_ids(vectors: DataFrame, papers: DataFrame) -> DataFrame:
    """Drop vectors of missing papers and rename ``p{n}_abstract`` to ``p{n}_c-1``."""
    alive = vectors.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_semi")
    return alive.withColumn("chunk_id", F.regexp_replace("chunk_id", r"^p(\d+)_abstract$", r"p$1_c-1"))

