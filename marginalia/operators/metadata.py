"""Metadata extraction over a table of front-page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.functions import frontmatter as M, text as X


def front_candidates(fronts: DataFrame) -> DataFrame:
    """``(paper_id, text)`` to one metadata candidate per row."""
    return (fronts.withColumn("_f", M.front_matter(F.col("text")))
            .select("paper_id", X.first_doi(F.col("text")).alias("doi"), X.first_year(F.col("text")).alias("year"),
                    "_f.title", "_f.title_line", "_f.authors", "_f.authors_line"))


def merge_candidates(base: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Merge embedded metadata with two extractions of the same paper.

    DOI and year: first one present. Authors: the longer list, ties to the first. Title: higher quality
    minus a hundredth per line; it replaces the embedded title only when better.
    ``base(paper_id, title, authors, year, doi)``.
    """
    def side(df, p):
        return df.select("paper_id", *[F.col(c).alias(f"{p}_{c}") for c in ("doi", "year", "authors", "title", "title_line")])
    j = base.join(side(first, "a"), "paper_id", "left").join(side(second, "b"), "paper_id", "left")
    n_authors = lambda c: F.when(F.col(c).isNull(), 0).otherwise(
        F.size(F.filter(F.split(c, ","), lambda p: X.non_blank(p))))
    authors = X.let(F.struct(n_authors("a_authors").alias("a"), n_authors("b_authors").alias("b")), lambda n: (
        F.when((n["a"] == 0) & (n["b"] == 0), F.col("authors"))
        .when((n["a"] >= n["b"]) & X.truthy(F.col("a_authors")).isNotNull(), F.col("a_authors"))
        .when(X.truthy(F.col("b_authors")).isNotNull(), F.col("b_authors")).otherwise(F.col("authors"))))
    rank = lambda p: M.title_quality(F.col(f"{p}_title")) - F.coalesce(f"{p}_title_line", F.lit(M.NO_LINE)) * 0.01
    best = F.when(rank("a") >= rank("b"), F.col("a_title")).otherwise(F.col("b_title"))

    def kept(best):
        better = X.truthy(best).isNotNull() & (
            X.truthy(F.col("title")).isNull() | (M.title_quality(best) > M.title_quality(F.col("title"))))
        return F.when(better, best).otherwise(F.col("title"))
    return j.select(
        "paper_id", X.let(best, kept).alias("title"), authors.alias("authors"),
        F.coalesce(F.nullif("year", F.lit(0)), F.nullif("a_year", F.lit(0)), F.nullif("b_year", F.lit(0))).alias("year"),
        F.coalesce(X.truthy(F.col("doi")), X.truthy(F.col("a_doi")), X.truthy(F.col("b_doi"))).alias("doi"))


def clean_metadata(papers: DataFrame) -> DataFrame:
    """Title falls back to the file stem; white space is collapsed in the text fields."""
    stem = F.replace(F.regexp_replace("filename", r"(?s)(.)\.[^.]*\z", "$1"), F.lit("_"), F.lit(" "))
    out = papers.withColumn("title", F.coalesce(X.truthy(F.col("title")), stem))
    for name in ("title", "authors", "journal", "abstract", "doi"):
        if name in out.columns:
            out = out.withColumn(name, X.collapse(F.col(name)))
    return out
