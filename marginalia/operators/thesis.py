"""Thesis paragraphs: chapters, in-text citations, chapter-to-paper maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import text as X, vocabulary as V
from marginalia.operators.blocks import BLOCK, block_of, next_value, salted_join

CHAPTER_CHARS = 6000
CHAPTER_MIN_CHARS = 30


def kept_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Stripped paragraphs that are not blank and not contents, header, footer or caption."""
    style = F.coalesce(X.strip(F.col("style")), F.lit("Normal"))
    return (paragraphs.withColumn("text", X.strip(F.col("text"))).withColumn("style", style)
            .filter((F.length("text") > 0) & ~F.lower("style").isin(V.IGNORED_STYLES)))


def chapters(paragraphs: DataFrame) -> DataFrame:
    """Headings with their extent: ``thesis_id, title, level, start_paragraph, end_paragraph``.

    A chapter ends before the next kept heading of any level; the last one at the last paragraph.
    """
    kept = kept_paragraphs(paragraphs)
    heads = (kept.filter(X.is_heading(F.col("style"), F.col("text")))
             .withColumn("title", X.clean_heading(F.col("text")))
             .withColumn("level", X.heading_level(F.col("style"), F.col("title")))
             .filter(~F.col("title").isin(V.CONTENTS_HEADINGS))
             .withColumn("block", block_of(F.col("index"), BLOCK * 8)))
    last = kept.groupBy("thesis_id").agg(F.max("index").alias("last_index"))
    ended = next_value(heads, ["thesis_id"], "index", "block", "index", "next_start").join(last, "thesis_id")
    return ended.select("thesis_id", "title", "level", F.col("index").alias("start_paragraph"),
                        F.coalesce(F.col("next_start") - 1, F.col("last_index")).alias("end_paragraph"))


def chapter_structure(chapter_rows: DataFrame) -> DataFrame:
    """One row per thesis with the chapter array, in text order."""
    item = F.struct("start_paragraph", "title", "level", "end_paragraph")
    fields = F.transform(F.array_sort(F.collect_list(item)), lambda c: F.struct(
        c["title"].alias("title"), c["level"].alias("level"), c["start_paragraph"].alias("start_paragraph"),
        c["end_paragraph"].alias("end_paragraph")))
    return chapter_rows.groupBy("thesis_id").agg(fields.alias("chapter_structure"))


def first_chapter(structure: Column, index: Column) -> Column:
    """0-based number of the first chapter whose range holds ``index``, else NULL."""
    hits = F.filter(F.transform(structure, lambda c, i: F.when(
        (c["start_paragraph"] <= index) & (index <= c["end_paragraph"]), i)), lambda i: i.isNotNull())
    return F.get(hits, F.lit(0))


def with_chapter(paragraphs: DataFrame, structures: DataFrame) -> DataFrame:
    """Adds ``chapter_index``. The chapter array travels with its thesis, so a paragraph meets
    one row instead of one row per chapter."""
    joined = salted_join(paragraphs, structures.select("thesis_id", "chapter_structure"), ["thesis_id"], "left",
                         spread_by=["index"])
    return joined.withColumn("chapter_index", first_chapter(F.col("chapter_structure"), F.col("index"))).drop(
        "chapter_structure")


def scan_citations(paragraphs: DataFrame, structures: DataFrame) -> DataFrame:
    """In-text citations, one row per match, with paragraph and chapter."""
    rows = paragraphs.select("thesis_id", "index", F.col("text").alias("context"),
                             F.posexplode(X.in_text_citations(F.col("text"))).alias("pos", "c"))
    return with_chapter(rows.select("thesis_id", "index", "pos", "c.citation_text", "c.raw_numbers", "context"),
                        structures)


AUTHOR_YEAR = r"\(?([A-Za-z\s,\.&]+),?\s*([0-9]{4})"


def parse_author_year(text: Column) -> Column:
    """``struct(surnames, year)`` of an author-year citation; NULL for ``[n]`` and other text."""
    parsed = F.struct(X.surnames(X.strip(F.regexp_extract(text, AUTHOR_YEAR, 1))).alias("surnames"),
                      F.regexp_extract(text, AUTHOR_YEAR, 2).cast("int").alias("year"))
    return F.when(~text.rlike(r"(?U)\[\d+\]") & text.rlike(AUTHOR_YEAR), parsed)


def match_author_year(citations: DataFrame, papers: DataFrame, key: str = "citation_text") -> DataFrame:
    """First paper (lowest id) of the cited year whose author string contains every surname.

    A surname is one word-character run, so it lies inside one such run of the author string:
    surnames meet the distinct author words by equal substrings. One surname needs only the lowest
    paper per (year, word); several surnames start from the one with the fewest papers and test the
    others on the row. Equal citations are matched once.
    """
    wanted = (citations.select(parse_author_year(F.col(key)).alias("p")).filter(F.size("p.surnames") > 0)
              .select(F.array_sort(F.array_distinct("p.surnames")).alias("surnames"), "p.year").distinct())
    names = wanted.select(F.explode("surnames").alias("surname")).distinct()
    lengths = names.agg(F.collect_set(F.length("surname")).alias("ns")).select("ns").scalar()
    years = wanted.select("year").distinct()
    lowered = (papers.filter(F.col("authors").isNotNull())
               .select(F.col("id").alias("paper_id"), "year", F.lower("authors").alias("authors"))
               .join(years, "year", "left_semi"))
    words = lowered.select("paper_id", "year", "authors", F.explode(F.array_distinct(
        F.regexp_extract_all(F.col("authors"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("word"))
    pieces = (words.select("word").distinct().withColumn("n", F.explode(lengths))
              .filter(F.length("word") >= F.col("n"))
              .withColumn("surname", F.explode(F.array_distinct(F.transform(
                  F.sequence(F.lit(1), F.length("word") - F.col("n") + 1),
                  lambda i: F.substring(F.col("word"), i, F.col("n")))))))
    inside = pieces.join(names, "surname", "left_semi").select("surname", "word")
    summary = (words.groupBy("year", "word").agg(F.min("paper_id").alias("low"), F.count(F.lit(1)).alias("n"))
               .join(inside, "word").groupBy("year", "surname")
               .agg(F.min("low").alias("low"), F.sum("n").alias("n")))
    per_name = wanted.select("surnames", "year", F.explode("surnames").alias("surname")).join(
        summary, ["year", "surname"])
    complete = (per_name.groupBy("surnames", "year")
                .agg(F.count(F.lit(1)).alias("found"), F.min_by(F.struct("surname", "low"), "n").alias("rare"))
                .filter(F.col("found") == F.size("surnames")))
    single = complete.filter(F.size("surnames") == 1).select("surnames", "year", F.col("rare.low").alias("paper_id"))
    several = (complete.filter(F.size("surnames") > 1).select("surnames", "year", F.col("rare.surname").alias("surname"))
               .join(inside, "surname").join(words, ["year", "word"])
               .filter(F.forall("surnames", lambda s: F.contains(F.col("authors"), s)))
               .groupBy("surnames", "year").agg(F.min("paper_id").alias("paper_id")))
    matched = single.unionByName(several)
    parsed = citations.withColumn("_p", parse_author_year(F.col(key)))
    keyed = (parsed.withColumn("surnames", F.array_sort(F.array_distinct("_p.surnames")))
             .withColumn("year", F.col("_p.year")).drop("_p"))
    return salted_join(keyed, matched, ["surnames", "year"], "left").drop("surnames", "year")


def citation_map(theses: DataFrame, citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Per chapter: sorted distinct papers, their titles and the number of citations.

    Counts and distinct papers are reduced per (thesis, chapter) before they meet the chapters.
    """
    rows = theses.select(F.col("id").alias("thesis_id"), F.posexplode("chapter_structure").alias("chapter_index", "c"))
    counts = citations.groupBy("thesis_id", "chapter_index").agg(F.count(F.lit(1)).alias("citation_count"))
    cited = (citations.filter(F.col("paper_id") != 0).select("thesis_id", "chapter_index", "paper_id").distinct()
             .join(papers.select(F.col("id").alias("paper_id"), F.col("title").alias("paper_title")), "paper_id", "left")
             .groupBy("thesis_id", "chapter_index")
             .agg(F.array_sort(F.collect_list(F.struct("paper_id", "paper_title"))).alias("p")))
    keys = ["thesis_id", "chapter_index"]
    return (rows.join(counts, keys, "left").join(cited, keys, "left").select(
        "thesis_id", "chapter_index",
        F.coalesce("c.title", F.concat(F.lit("第"), (F.col("chapter_index") + 1).cast("string"), F.lit("章")))
        .alias("chapter_title"),
        F.coalesce("c.level", F.lit(1)).alias("level"),
        F.coalesce("p.paper_id", F.array().cast("array<bigint>")).alias("paper_ids"),
        F.map_from_entries(F.coalesce("p", F.array().cast("array<struct<paper_id:bigint,paper_title:string>>")))
        .alias("paper_titles"),
        F.coalesce("citation_count", F.lit(0)).alias("citation_count")))


def citation_totals(citations: DataFrame) -> DataFrame:
    return citations.groupBy("thesis_id").agg(
        F.count(F.lit(1)).alias("total_citations"),
        F.count(F.when(F.col("paper_id") != 0, 1)).alias("matched_citations"))


def graph_links(theses: DataFrame, citations: DataFrame) -> DataFrame:
    """Paper-to-chapter links, repeats kept, with the chapter title or ``第n章``."""
    linked = citations.filter(F.col("paper_id").isNotNull() & F.col("chapter_index").isNotNull())
    joined = salted_join(linked, theses.select(F.col("id").alias("thesis_id"), "chapter_structure"), ["thesis_id"])
    ordinal = F.concat(F.lit("第"), (F.col("chapter_index") + 1).cast("string"), F.lit("章"))
    return joined.select(
        F.concat(F.lit("p"), F.col("paper_id").cast("string")).alias("source"),
        F.concat(F.lit("t"), F.col("thesis_id").cast("string"), F.lit("_ch"),
                 F.col("chapter_index").cast("string")).alias("target"),
        F.coalesce(F.get("chapter_structure", F.col("chapter_index").cast("int"))["title"], ordinal).alias("chapter_title"),
        F.lit(1).alias("value"))


def graph_nodes(papers: DataFrame, links: DataFrame) -> DataFrame:
    """Paper nodes and one node per linked chapter."""
    paper_nodes = papers.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"),
                                F.coalesce(X.truthy(F.col("title")), F.col("filename")).alias("name"),
                                F.lit("paper").alias("type"))
    chapter_nodes = (links.groupBy(F.col("target").alias("id")).agg(F.min("chapter_title").alias("name"))
                     .withColumn("type", F.lit("chapter")))
    return paper_nodes.unionByName(chapter_nodes)


def chapter_texts(paragraphs: DataFrame, structures: DataFrame, limit: int | None = None) -> DataFrame:
    """Paragraphs of each chapter joined by newline: ``thesis_id, chapter_index, text``.

    With ``limit`` only the first so many characters: every paragraph adds at least its newline, so the first ``limit + 1``
    reach it, and no longer chapter is gathered.
    """
    rows = with_chapter(paragraphs.select("thesis_id", "index", "text"), structures).filter(
        F.col("chapter_index").isNotNull())
    if limit is not None:
        place = F.row_number().over(W.partitionBy("thesis_id", "chapter_index").orderBy("index"))
        rows = rows.withColumn("text", F.left("text", F.lit(limit))).withColumn("_n", place).filter(F.col("_n") <= limit + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda p: p["text"]), "\n")
    return rows.groupBy("thesis_id", "chapter_index").agg((text if limit is None else F.left(text, F.lit(limit))).alias("text"))


def analysis_texts(texts: DataFrame) -> DataFrame:
    """Review input: the first 6000 characters; under 30 (stripped) are rejected."""
    cut = texts.withColumn("text", F.left("text", F.lit(CHAPTER_CHARS)))
    return cut.filter(F.length(X.strip(F.col("text"))) >= CHAPTER_MIN_CHARS)


def document_sizes(paragraphs: DataFrame) -> DataFrame:
    """Characters per thesis without blanks, newlines between paragraphs included."""
    bare = F.length(F.replace("text", F.lit(" "), F.lit("")))
    return paragraphs.groupBy("thesis_id").agg((F.sum(bare) + F.count(F.lit(1)) - 1).alias("word_count"))


def thesis_titles(paragraphs: DataFrame) -> DataFrame:
    """Cover title: longest run of adjacent large-font paragraphs among the first 30, 12..120
    characters; else the longest plain paragraph of 15..80 characters among the first 25."""
    window = W.partitionBy("thesis_id").orderBy("index")
    front = (kept_paragraphs(paragraphs).withColumn("pos", F.row_number().over(window)).filter(F.col("pos") <= 30)
             .filter(~X.contains_any(F.col("text"), V.THESIS_TITLE_NOISE)))
    island = F.col("index") - F.row_number().over(window)
    big = front.filter(F.col("font_size") >= 16).withColumn("island", island)
    runs = big.groupBy("thesis_id", "island").agg(
        F.min("index").alias("start"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda p: p["text"]), "")
        .alias("text"))
    best = F.max(F.struct(F.length("text").alias("n"), (-F.col("start")).alias("s"), F.col("text").alias("t")))
    by_font = runs.groupBy("thesis_id").agg(best.alias("b")).filter(F.col("b.n").between(12, 120)).select(
        "thesis_id", F.col("b.t").alias("font_title"))
    plain = front.filter((F.col("pos") <= 25) & ~F.col("text").rlike(r"[:：/\\。！？.,，=]")
                         & F.length("text").between(15, 80) & F.col("style").isin("Normal", "Title", "标题"))
    by_text = plain.groupBy("thesis_id").agg(F.max(F.struct(
        F.length("text").alias("n"), (-F.col("index")).alias("s"), F.col("text").alias("t"))).alias("b")).select(
        "thesis_id", F.col("b.t").alias("text_title"))
    ids = paragraphs.select("thesis_id").distinct()
    return ids.join(by_font, "thesis_id", "left").join(by_text, "thesis_id", "left").select(
        "thesis_id", F.coalesce("font_title", "text_title").alias("title"))
