"""Evaluation inputs: QA lines, benchmark corpora, report folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.functions import text as X
from marginalia.schemas import FIXTURE, QA, REPORT, chunk_id


def load_dataset(spark: SparkSession, path: str | list[str], strict: bool = True) -> DataFrame:
    """QA items from JSON lines; blank lines are skipped. With ``strict`` a line that is not a JSON object
    raises, naming file and content."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(
        X.non_blank(F.col("value")))
    parsed = lines.withColumn("_object", F.try_parse_json("value").isNotNull() & F.startswith(X.strip(F.col("value")), F.lit("{")))
    bad = ~F.col("_object")
    if strict:
        broken = parsed.filter(bad).select("_file", "value").take(1)
        if broken:
            number = _line_number(spark, broken[0]["_file"], broken[0]["value"])
            raise ValueError(f"{broken[0]['_file']} line {number} is not a JSON object")
    return parsed.filter("_object").select(F.from_json("value", QA).alias("r")).select("r.*")


def _line_number(spark: SparkSession, path: str, value: str) -> int | None:
    """First line of one file that equals ``value``, counted inside the file's single text split."""
    rows = (spark.read.text(path, wholetext=True)
            .select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("n", "line"))
            .filter(F.col("line") == value).agg(F.min("n").alias("n")).first())
    return None if rows["n"] is None else rows["n"] + 1


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(papers, chunks) of a nested benchmark corpus; paper ids are 1-based positions."""
    doc = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    rows = doc.select(F.posexplode("papers").alias("pos", "p")).withColumn("id", (F.col("pos") + 1).cast("bigint"))
    papers = rows.select(
        "id", F.col("p.paper_uid").alias("paper_uid"), F.col("p.title").alias("title"),
        F.coalesce("p.authors", F.lit("Evaluation Team")).alias("authors"),
        F.coalesce("p.year", F.lit(2026)).alias("year"),
        F.coalesce("p.journal", F.lit("Synthetic Evaluation Corpus")).alias("journal"),
        F.col("p.abstract").alias("abstract"), F.regexp_replace("p.paper_uid", r"\Adoi:", "").alias("doi"),
        F.lit("synthetic").alias("source"), F.lit("done").alias("processed"))
    chunks = (rows.select(F.col("id").alias("paper_id"), F.col("p.paper_uid").alias("paper_uid"),
                          F.explode("p.chunks").alias("c"))
              .select("paper_id", "paper_uid", "c.chunk_index", "c.section_title",
                      F.coalesce("c.chunk_type", F.lit("paragraph")).alias("chunk_type"), "c.page_number", "c.content"))
    return papers, chunks.withColumn("chunk_id", chunk_id())


def load_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, by_type) of a report folder. Broken files are left out; missing fields are NULL.

    ``run_id`` is the file stem, or the folder of a ``run_id=…`` layout; metric keys such as ``recall@5`` are found by pattern.
    """
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json\z", "")
    raw = files.select("value", F.col("run_id").cast("string") if "run_id" in files.columns else stem.alias("run_id"))
    parsed = (raw.filter(F.try_parse_json("value").isNotNull() & F.startswith(X.strip(F.col("value")), F.lit("{")))
              .select("run_id", F.from_json("value", REPORT).alias("r"),
                      F.get_json_object("value", "$.overall").alias("overall")))
    # Numbers only: a text value under a metric key counts as missing.
    metrics = F.transform_values(F.from_json("overall", "MAP<STRING,STRING>"), lambda k, v: F.try_variant_get(
        F.try_parse_json(v), "$", "double"))
    pick = lambda pattern: F.get(F.map_values(F.map_filter("m", lambda k, v: k.rlike(pattern))), F.lit(0))
    key = lambda pattern: F.get(F.filter(F.map_keys("m"), lambda k: k.rlike(pattern)), F.lit(0))
    k_of = lambda pattern: F.regexp_extract(key(pattern), r"@(\d+)\z", 1).cast("int")
    runs = parsed.withColumn("m", F.coalesce(metrics, F.create_map().cast("map<string,double>"))).select(
        "run_id", "r.timestamp", "r.retrieval_mode", F.coalesce(
            F.nullif(k_of(r"\Arecall@\d+\z"), F.lit(0)), F.nullif(k_of(r"\Andcg@\d+\z"), F.lit(0))).alias("k"),
        pick(r"\Arecall@\d+\z").alias("recall"), pick(r"\Amrr\z").alias("mrr"),
        pick(r"\Andcg@\d+\z").alias("ndcg"), pick(r"\An_positive\z").cast("int").alias("n_positive"),
        pick(r"\An_negative\z").cast("int").alias("n_negative"))
    types = parsed.select("run_id", F.explode("r.by_question_type").alias("t")).filter(
        F.col("t.question_type").isNotNull()).select("run_id", "t.*")
    return runs, types
