"""Binary documents: upload gate, content-hash dedup, pluggable page extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.functions import vocabulary as V

PAGE_ROWS = "path STRING, page_number INT, text STRING, error STRING"


def scan_documents(spark: SparkSession, path: str, max_bytes: int = V.PDF_MAX_BYTES) -> DataFrame:
    """All files under ``path`` with ``reject_reason`` (NULL = accepted).

    Size and name are checked first; the content of an oversized file is replaced by NULL before it
    is hashed or shuffled.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return gate(raw, max_bytes)


def gate(raw: DataFrame, max_bytes: int = V.PDF_MAX_BYTES) -> DataFrame:
    reason = (F.when(~F.lower("path").rlike(r"\.pdf\z"), "extension")
              .when(F.col("length") > max_bytes, "size")
              .when(~F.coalesce(F.substring("content", 1, 5) == F.lit(b"%PDF-"), F.lit(False)), "signature"))
    return (raw.withColumn("reject_reason", reason)
            .withColumn("content", F.when(F.col("reject_reason").isNull(), F.col("content"))))


def accepted(scanned: DataFrame) -> DataFrame:
    return (scanned.filter(F.col("reject_reason").isNull()).drop("reject_reason")
            .withColumn("md5", F.md5("content")).withColumn("sha256", F.sha2("content", 256)))


def rejected(scanned: DataFrame) -> DataFrame:
    return scanned.filter(F.col("reject_reason").isNotNull()).select("path", "length", "reject_reason")


def new_documents(documents: DataFrame, known: DataFrame, md5: str = "md5") -> DataFrame:
    """One row per unseen content hash, the lowest path of each.

    Hash and path alone are grouped (a group of copies shrinks on the map side); the bytes are
    only read for the chosen paths.
    """
    chosen = (documents.groupBy(md5).agg(F.min("path").alias("path"))
              .join(known.select(md5).distinct(), md5, "left_anti").select("path"))
    return documents.join(chosen, "path", "left_semi")


def extract_pages(documents: DataFrame, extractor: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, page_number, text, error`` with pages from 1. A failing document gives one error row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = extractor(bytes(content))
                    yield pd.DataFrame({"path": path, "page_number": range(1, len(pages) + 1), "text": pages,
                                        "error": None})
                except Exception as exc:
                    yield pd.DataFrame({"path": [path], "page_number": [None], "text": [None],
                                        "error": [type(exc).__name__]})
    return documents.select("path", "content").mapInPandas(run, PAGE_ROWS)


def html_text(html: Column) -> Column:
    """Visible text of a web page, one line per block element."""
    body = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " ")
    body = F.regexp_replace(body, r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        body = F.replace(body, F.lit(entity), F.lit(char))
    return body
