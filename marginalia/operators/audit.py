"""Integrity audits, manifests and repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions import text as X
from marginalia.schemas import chunk_id



def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str = "id") -> DataFrame:
    """Child rows whose key is set and names no parent."""
    keys = parent.select(F.col(pk).alias(fk)).distinct()
    return child.filter(F.col(fk).isNotNull()).join(keys, fk, "left_anti")


def foreign_key_audit(links: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Violations per foreign key: ``(name, n)`` for each (name, child, fk, parent, pk)."""
    counts = [orphans(child, parent, fk, pk).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
              for name, child, fk, parent, pk in links]
    return reduce(DataFrame.unionByName, counts)


def repair_links(paper_tags: DataFrame, papers: DataFrame, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links after repair, report). The source table is untouched; a dry run keeps every row.

    ``report(dry_run, would_delete, deleted, remaining)``.
    """
    keys = papers.select(F.col("id").alias("paper_id")).distinct().withColumn("_known", F.lit(True))
    flagged = paper_tags.join(keys, "paper_id", "left").withColumn("_bad", F.col("_known").isNull())
    kept = (flagged if dry_run else flagged.filter(~F.col("_bad"))).drop("_known", "_bad")
    deleted = F.lit(0) if dry_run else F.col("would_delete")
    report = (flagged.agg(F.count_if("_bad").alias("would_delete"))
              .select(F.lit(dry_run).alias("dry_run"), "would_delete", deleted.alias("deleted"),
                      (F.col("would_delete") - deleted).alias("remaining")))
    return kept, report


# Manifests -----------------------------------------------------------------------------------

MANIFEST_BLOCK = 512


def chunk_manifests(chunks: DataFrame, block: int = MANIFEST_BLOCK) -> DataFrame:
    """SHA-256 of a paper's chunks in two levels: ``(paper_id, manifest)``.

    A block of ``block`` chunk numbers is hashed as its ordered ``[{chunk_index, content_sha256}]`` list, the paper as the ordered
    ``[{block, sha256}]`` list of its blocks. One definition for papers of any length, and a paper with a large part of all chunks is spread over its blocks.
    """
    entry = F.struct("chunk_index", F.sha2(F.coalesce("content", F.lit("")), 256).alias("content_sha256"))
    number = F.floor(F.col("chunk_index") / F.lit(block)).cast("bigint")
    blocks = chunks.select("paper_id", number.alias("block"), entry.alias("e")).groupBy("paper_id", "block").agg(
        F.sha2(F.to_json(F.array_sort(F.collect_list("e"))), 256).alias("sha256"))
    return blocks.groupBy("paper_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("block", "sha256")))), 256).alias("manifest"))


def set_hash(row_hash: Column) -> Column:
    """Aggregate: order-free fingerprint of hex SHA-256 values.

    Four 60-bit parts are summed, which needs no sort and no collected list; equal multisets give equal
    fingerprints, whatever the ids, the order or the partitioning.
    """
    def part(i):
        piece = F.conv(F.substring(row_hash, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(piece), F.lit(0).cast("decimal(30,0)")).cast("decimal(30,0)").cast("string")
    return F.sha2(F.concat_ws(":", F.count(row_hash).cast("string"), *[part(i) for i in range(4)]), 256)


def corpus_fingerprint(chunks: DataFrame, paper_uids: DataFrame) -> DataFrame:
    """One row ``(corpus_manifest, n_chunks)`` over (paper uid, chunk index, content hash).

    A chunk whose paper has no uid is identified by its own content.
    """
    sha = F.sha2(F.coalesce("content", F.lit("")), 256)
    rows = (chunks.join(paper_uids.select("paper_id", "paper_uid"), "paper_id", "left")
            .withColumn("_c", sha)
            .withColumn("_uid", F.coalesce("paper_uid", F.concat(F.lit("orphan:"), F.col("_c")))))
    key = F.sha2(F.concat_ws("|", "_uid", F.col("chunk_index").cast("string"), "_c"), 256)
    return rows.select(key.alias("h")).agg(set_hash(F.col("h")).alias("corpus_manifest"),
                                           F.count(F.lit(1)).alias("n_chunks"))


def qrels_fingerprint(items: DataFrame) -> DataFrame:
    """One row ``qrels``: fingerprint of ids, answer flags and labels, without question or answer text."""
    row = F.sha2(F.to_json(F.struct("qa_id", "has_answer", "relevant_evidence", "relevant_chunks")), 256)
    return items.select(row.alias("h")).agg(set_hash(F.col("h")).alias("qrels"))


def corpus_audit(files: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: physical files, distinct contents, surplus copies, papers, processed, chunks, missing sources.

    ``files(path, sha256)``, ``papers(id, file_path, processed)``.
    """
    f = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("physical_files"), F.count(F.lit(1)).alias("unique_contents"))
    missing = papers.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    p = papers.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("processed") == "done").alias("processed_done"))
    one = lambda df, c: df.select(c).scalar()
    return p.select(
        one(f, "physical_files").alias("physical_files"), one(f, "unique_contents").alias("unique_contents"),
        (one(f, "physical_files") - one(f, "unique_contents")).alias("duplicate_files"), "papers", "processed_done",
        one(chunks.agg(F.count(F.lit(1)).alias("n")), "n").alias("chunks"),
        one(missing.agg(F.count(F.lit(1)).alias("n")), "n").alias("missing_sources"))


def document_audit(files: DataFrame, papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per paper: uid, file hash, state, chunk count, chunk manifest and number of physical copies."""
    by_path = files.groupBy(F.col("path").alias("file_path")).agg(F.min("sha256").alias("sha256"))
    copies = files.groupBy("sha256").agg(F.count(F.lit(1)).alias("physical_copies"))
    counts = chunks.groupBy("paper_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    empty = F.sha2(F.lit("[]"), 256)
    return (papers.select(F.col("id").alias("paper_id"), "doi", "file_path", "processed")
            .join(by_path, "file_path", "left").join(copies, "sha256", "left")
            .join(counts, "paper_id", "left").join(chunk_manifests(chunks), "paper_id", "left")
            .select("paper_id", F.when(F.col("sha256").isNotNull(), X.paper_uid(F.col("doi"), F.col("sha256")))
                    .alias("paper_uid"), "sha256", "processed",
                    F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
                    F.coalesce("manifest", empty).alias("chunk_manifest"),
                    F.coalesce("physical_copies", F.lit(0)).alias("physical_copies")))


def document_set_hash(documents: DataFrame) -> DataFrame:
    """One row: fingerprint of the per-document audit, independent of paper ids."""
    row = F.sha2(F.to_json(F.struct("paper_uid", "sha256", "processed", "chunk_count", "chunk_manifest",
                                    "physical_copies")), 256)
    return documents.select(row.alias("h")).agg(set_hash(F.col("h")).alias("manifest"))


def vector_validation(vectors: DataFrame, chunks: DataFrame, dimension: int) -> DataFrame:
    """Vector table against the chunk table: ``(problem, n)``, no rows when they agree."""
    # One shuffle by id; a repeated id is combined before it travels.
    have = vectors.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("copies"),
                                           F.count_if(F.size("embedding") != dimension).alias("bad"))
    want = chunks.select(chunk_id().alias("chunk_id")).distinct().withColumn("wanted", F.lit(True))
    both = want.join(have, "chunk_id", "full_outer")
    problems = both.agg(
        F.count_if(F.col("copies").isNull()).alias("missing vector"),
        F.count_if(F.col("wanted").isNull()).alias("unknown id"),
        F.count_if(F.col("copies") > 1).alias("repeated id"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("wrong dimension"))
    return problems.unpivot([], ["missing vector", "unknown id", "repeated id", "wrong dimension"],
                            "problem", "n").filter(F.col("n") > 0)
