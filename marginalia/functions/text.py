"""String expressions shared by the operators; everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

from marginalia.functions import vocabulary as V

# Unicode white space plus the four separators Java's class leaves out.
WS = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lit_array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


# The characters of WS, for trimming without a regular expression.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends."""
    return F.btrim(col, F.lit(SPACES))


def collapse(col: Column) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, rf"(?U){WS}+", " "))


def non_blank(col: Column) -> Column:
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def truthy(col: Column) -> Column:
    """The value, or NULL for an empty string."""
    return let(col, lambda value: F.nullif(value, F.lit("")))


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping exact occurrences of ``needle`` (not empty) in ``text``."""
    return ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle)).cast("int")


def contains_any(text: Column, words: list[str]) -> Column:
    return let(text, lambda t: F.exists(lit_array(words), lambda w: F.contains(t, w)))


def split_lines(col: Column) -> Column:
    return F.split(col, LINE_BREAK)


def white_tokens(col: Column) -> Column:
    """White-space separated tokens, none empty."""
    return F.filter(F.split(col, rf"(?U){WS}+"), lambda t: F.length(t) > 0)


def technical_tokens(col: Column) -> Column:
    """Lower-cased ASCII technical anchors such as ``reco-mil``, ``1e-4`` or ``87.3%``."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(V.TECHNICAL_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def query_terms(col: Column, bilingual: dict[str, list[str]] | None = None) -> Column:
    """Distinct query tokens, optionally widened by the terms of every phrase in the query."""
    tokens = technical_tokens(col)
    if bilingual:
        extra = [F.when(F.contains(col, F.lit(k)), lit_array(v)).otherwise(lit_array([]))
                 for k, v in bilingual.items()]
        tokens = F.concat(tokens, *extra)
    return F.array_distinct(tokens)


def _fold_table() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic blocks and their base letters."""
    source, target = [], []
    for code in [*range(0xC0, 0x530), *range(0x1E00, 0x2000)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if base != char and char == char.lower():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _fold_table()


def fold(col: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(col), _FOLD_FROM, _FOLD_TO)


def words(col: Column) -> Column:
    """Letter/digit runs, lower-cased and folded: the keyword-index tokeniser."""
    return F.regexp_extract_all(fold(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keyword_query(col: Column) -> Column:
    """Sanitised keyword query as an array of AND-ed words; empty means no search."""
    return F.array_distinct(words(F.regexp_replace(col, V.KEYWORD_SPECIAL, " ")))


def keyword_phrases(col: Column) -> Column:
    """Sanitised keyword query as an array of AND-ed phrases: the words of each token, which must stand side by side."""
    tokens = white_tokens(F.regexp_replace(F.coalesce(col, F.lit("")), V.KEYWORD_SPECIAL, " "))
    return F.array_distinct(F.filter(F.transform(tokens, lambda t: words(t)), lambda p: F.size(p) > 0))


# Identifiers ---------------------------------------------------------------------------------

def first_doi(col: Column) -> Column:
    return truthy(F.regexp_extract(col, r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+", 0))


def normalize_doi(col: Column) -> Column:
    bare = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.regexp_replace(F.lower(strip(bare)), r"[.,;:)\]}]+\z", "")


def paper_uid(doi: Column, file_sha256: Column) -> Column:
    """``doi:…`` when there is a DOI, else ``sha256:…`` of the source file, else NULL."""
    return F.coalesce(F.concat(F.lit("doi:"), truthy(normalize_doi(doi))),
                      F.concat(F.lit("sha256:"), file_sha256))


def first_year(col: Column) -> Column:
    copyright_year = F.regexp_extract(col, r"(?U)[Cc]opyright\s*[©]?\s*([0-9]{4})", 1)
    plain_year = F.regexp_extract(col, r"(?U)\b(19[0-9]{2}|20[0-9]{2})\b", 1)
    return F.coalesce(truthy(copyright_year), truthy(plain_year)).cast("int")


# Reference lists -----------------------------------------------------------------------------

REFERENCES_HEADING = rf"(?iU)\A{WS}*(references|bibliography|参考文献){WS}*\.?{WS}*\z"


def references_section(full_text: Column) -> Column:
    """Text after the last stand-alone references heading; NULL when there is none."""
    def after(lines, last):
        tail = F.slice(lines, last + F.lit(2), F.greatest(F.size(lines) - last - 1, F.lit(0)))
        return F.when(last.isNotNull(), truthy(strip(F.array_join(tail, "\n"))))

    def heading(lines):
        return F.array_max(F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(REFERENCES_HEADING), i)), lambda i: i.isNotNull()))
    return let(split_lines(F.coalesce(full_text, F.lit(""))), lambda lines: let(heading(lines), lambda last: after(lines, last)))


def reference_entries(section: Column) -> Column:
    """Numbered entries of a references section; continuation lines are appended."""
    lines = F.filter(F.transform(split_lines(section), lambda x: strip(x)), lambda x: F.length(x) > 0)
    marked = F.transform(lines, lambda x: F.when(
        x.rlike(rf"(?U)\A(\[[0-9]{{1,3}}\]|[0-9]{{1,3}}[.)]{WS}+)"),
        F.concat(F.lit("\x01"),
                 F.regexp_replace(F.regexp_replace(x, rf"(?U)\A\[[0-9]{{1,3}}\]{WS}*", ""),
                                  rf"(?U)\A[0-9]{{1,3}}[.)]{WS}+", ""))).otherwise(x))
    opened = let(F.split(F.array_join(marked, " "), "\x01"), lambda parts: F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.filter(F.transform(opened, lambda e: strip(e)), lambda e: F.length(e) > 0)


def title_candidate(entry: Column) -> Column:
    """Quoted text, else the longest segment before the first year; under 10 characters NULL."""
    quoted = truthy(F.regexp_extract(entry, '["“「](.+?)["”」]', 1))
    head = F.split(entry, r"(?U)\b(?:19|20)[0-9]{2}[a-z]?\b", 2)[0]
    segments = F.filter(F.transform(F.split(head, "[.,;。，；]"), lambda s: strip(s)),
                        lambda s: F.length(s) > 0)
    longest = F.array_max(F.transform(segments, lambda s, i: F.struct(
        F.length(s).alias("n"), (-i).alias("i"), s.alias("s"))))["s"]
    edge = " .,;:'\"“”‘’()[]<>"
    cleaned = F.btrim(collapse(F.coalesce(quoted, longest)), F.lit(edge))
    return let(cleaned, lambda title: F.when(F.length(title) >= V.TITLE_MIN_CHARS, title))


def normalize_title(col: Column) -> Column:
    return collapse(F.lower(F.coalesce(col, F.lit(""))))


# Chunk typing --------------------------------------------------------------------------------

def chunk_type(content: Column) -> Column:
    """Type by the first matching keyword group in the first two paragraphs."""
    def named(lead):
        out = None
        for name, keywords in V.SECTION_KEYWORDS:
            found = F.exists(lit_array(keywords), lambda w: F.contains(lead, w))
            out = (F.when if out is None else out.when)(found, name)
        return out.otherwise("paragraph")
    return let(F.lower(F.array_join(F.slice(F.split(content, "\n\n"), 1, 2), " ")), named)


def embed_text(col: Column) -> Column:
    """Text for the embedder: cut after 512 white-space tokens, else unchanged."""
    tokens = white_tokens(col)
    return F.when(F.size(tokens) > V.EMBED_MAX_TOKENS,
                  F.array_join(F.slice(tokens, 1, V.EMBED_MAX_TOKENS), " ")).otherwise(col)


# Thesis text ---------------------------------------------------------------------------------

CHAPTER_MARK = r"^第[一二三四五六七八九十0-9]+章"


def is_heading(style: Column, text: Column) -> Column:
    return (F.contains(style, F.lit("Heading")) | F.contains(style, F.lit("标题"))
            | text.rlike(CHAPTER_MARK) | text.rlike(r"(?U)^\d+(\.\d+)+\s+"))


def clean_heading(text: Column) -> Column:
    head = F.split(text, r"\t+", 2)[0]
    head = F.regexp_replace(head, r"(?U)\s+\.\.\.\s*\d+\z", "")
    return strip(F.regexp_replace(head, r"(?U)\s+\d+\z", ""))


def heading_level(style: Column, text: Column) -> Column:
    out = F.when(text.rlike(CHAPTER_MARK), 1)
    for level in (1, 2, 3, 4):
        out = out.when(F.contains(style, F.lit(f"Heading {level}")) | F.contains(style, F.lit(f"标题 {level}")), level)
    return (out.when(text.rlike(r"(?U)^\d+\.\d+\.\d+\.\d+\s"), 4)
            .when(text.rlike(r"(?U)^\d+\.\d+\.\d+\s"), 3).otherwise(2))


BRACKET_CITATION = r"(?U)\[(\d+(?:\s*[,-]\s*\d+)*)\]"
PAREN_CITATION = r"\(([A-Z][a-zA-Z\s,\.]+(?:et al\.)?,\s*\d{4}[a-z]?)\)"


def in_text_citations(text: Column) -> Column:
    """Bracket citations first, then author-year ones, each with its group text."""
    def found(pattern):
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        group = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        return F.transform(F.arrays_zip(whole.alias("w"), group.alias("g")), lambda z: F.struct(
            z["w"].alias("citation_text"), z["g"].alias("raw_numbers")))
    return F.concat(found(BRACKET_CITATION), found(PAREN_CITATION))


def surnames(authors: Column) -> Column:
    """First word of each author of an in-text citation, lower-cased."""
    plain = F.replace(F.replace(authors, F.lit("et al."), F.lit("")), F.lit("et al"), F.lit(""))
    parts = F.transform(F.split(plain, r"(?U),|\band\b|&"), lambda p: strip(p))
    firsts = F.transform(parts, lambda p: F.lower(
        F.regexp_replace(F.split(p, rf"(?U){WS}+", 2)[0], r"(?U)[^\w]", "")))
    return F.filter(firsts, lambda s: F.length(s) > 0)


# Tags ----------------------------------------------------------------------------------------

def repair_encoding(col: Column) -> Column:
    """Undo UTF-8 text that was decoded as Latin-1; other text is unchanged."""
    only_latin1 = ~col.rlike(r"[^\x00-\xFF]")
    suspicious = col.rlike("[Ãäåæ]")
    raw = F.encode(col, "ISO-8859-1")
    safe = F.when(only_latin1 & suspicious, raw)
    return F.when(F.is_valid_utf8(safe.cast("string")), safe.cast("string")).otherwise(col)


def clean_tag(col: Column) -> Column:
    text = strip(repair_encoding(F.coalesce(col, F.lit(""))))
    text = F.regexp_replace(text, r"(?U)^[-\d•*·]+[.\\s]*", "")
    text = F.btrim(text, F.lit("\"'"))
    return strip(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^\t ]]", ""))


def rule_tags(title: Column, abstract: Column, journal: Column) -> Column:
    """Tags whose keywords occur in the lower-cased text, in rule order."""
    text = F.lower(F.concat_ws(" ", truthy(title), truthy(abstract), truthy(journal)))
    return F.array_compact(F.array(*[F.when(contains_any(text, kws), F.lit(tag))
                                     for tag, kws in V.TAG_RULES.items()]))


def merge_tags(model_tags: Column, rules: Column) -> Column:
    """Model tags first, trimmed and distinct, at most five."""
    merged = F.filter(F.transform(F.concat(model_tags, rules), lambda t: strip(t)), lambda t: F.length(t) > 0)
    return F.slice(F.array_distinct(merged), 1, V.MAX_TAGS)


def model_tags(response: Column) -> Column:
    """Tags of a generated answer: one per line, cleaned, at most five."""
    cleaned = F.transform(split_lines(F.coalesce(response, F.lit(""))), lambda t: clean_tag(t))
    return F.slice(F.filter(cleaned, lambda t: F.length(t) > 0), 1, 5)


# Citations -----------------------------------------------------------------------------------

def format_citation(style: str, authors: Column, title: Column, year: Column, journal: Column) -> Column:
    """One reference line in APA, MLA or GB/T 7714 style."""
    a = F.coalesce(truthy(authors), F.lit("匿名"))
    t = F.coalesce(truthy(title), F.lit("未命名"))
    y = F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit("n.d."))
    j = F.coalesce(journal, F.lit(""))
    if style == "APA":
        line = F.concat(a, F.lit(" ("), y, F.lit("). "), t, F.lit(". "), j)
    elif style == "MLA":
        line = F.concat(a, F.lit('. "'), t, F.lit('." '), j, F.lit(", "), y, F.lit("."))
    else:
        line = F.concat(a, F.lit(". "), t, F.lit("[J]. "), j, F.lit(", "), y, F.lit("."))
    return strip(line)
