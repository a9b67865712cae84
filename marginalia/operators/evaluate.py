"""Evaluation: label resolution, item metrics, roll-ups, latency, generation summary, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from marginalia.functions import answers as A, metrics as M, text as X, vocabulary as V
from marginalia.operators.quotes import quote_hits
from marginalia.operators.blocks import salted_join
from marginalia.schemas import chunk_id
from marginalia.session import cut_lineage, materialize

# Distinct values a single percentile buffer may hold before the ranged method takes over.
PERCENTILE_VALUES = 2_000_000
# Problems quoted in an error message; the table it names holds all.
SHOWN = 50


# Selecting items -----------------------------------------------------------------------------

def select_split(items: DataFrame, split: str = "all") -> DataFrame:
    """Items of one split; an explicit split without rows is an error."""
    if split == "all":
        return items
    out = items.filter(F.col("split") == split)
    if out.isEmpty():
        raise ValueError(f"split={split} has no items")
    return out


def select_qa(items: DataFrame, qa_ids: list[str]) -> DataFrame:
    """Requested items in requested order (``position``); an unknown id is an error."""
    wanted = items.sparkSession.createDataFrame(
        [(q, i) for i, q in enumerate(dict.fromkeys(qa_ids))], "qa_id STRING, position INT")
    missing = [r["qa_id"] for r in wanted.join(items, "qa_id", "left_anti").orderBy("position").collect()]
    if missing:
        raise ValueError("unknown qa_id: " + ", ".join(missing))
    return items.join(wanted, "qa_id")


# Label resolution ----------------------------------------------------------------------------

def resolve_papers(evidence: DataFrame, papers: DataFrame) -> DataFrame:
    """Evidence ``paper_uid`` to a paper by DOI or file hash: adds ``paper_id`` and ``n_papers``."""
    doi = F.when(F.startswith("paper_uid", F.lit("doi:")),
                 F.concat(F.lit("doi:"), X.normalize_doi(F.substr("paper_uid", F.lit(5)))))
    sha = F.when(F.startswith("paper_uid", F.lit("sha256:")), F.lower("paper_uid"))
    keyed = evidence.withColumn("_uid", F.coalesce(doi, sha))
    uids = papers.select(F.col("id").alias("paper_id"), F.explode(F.array_compact(F.array(
        F.concat(F.lit("doi:"), X.truthy(X.normalize_doi(F.col("doi")))),
        F.concat(F.lit("sha256:"), F.lower("file_sha256"))))).alias("_uid"))
    owners = uids.groupBy("_uid").agg(F.min("paper_id").alias("paper_id"),
                                      F.countDistinct("paper_id").alias("n_papers"))
    return (keyed.join(owners, "_uid", "left").drop("_uid")
            .withColumn("n_papers", F.coalesce("n_papers", F.lit(0))))


def resolve_quotes(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence ``(evidence_id, paper_id, quote)`` to the chunk that holds the quote.

    Counts exact non-overlapping occurrences over all chunks of the paper. ``status`` is ``ok`` for
    exactly one, else ``missing`` or ``multiple``. See :func:`quotes.quote_hits` for the join.
    """
    asked = evidence.select(F.col("evidence_id").alias("quote_id"), "paper_id", X.strip(F.col("quote")).alias("quote"))
    hits = quote_hits(asked, chunks).withColumnRenamed("quote_id", "evidence_id")
    counts = hits.groupBy("evidence_id").agg(F.sum("n").alias("n"), F.min("chunk_index").alias("chunk_index"))
    joined = evidence.join(counts, "evidence_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "missing").otherwise("multiple")
    return joined.withColumn("status", status).withColumn(
        "chunk_id", F.when(F.col("n") == 1, chunk_id())).drop("chunk_index")


SHINGLE = 3


def find_passages(passages: DataFrame, texts: DataFrame, prefix: int = 24) -> DataFrame:
    """Texts that hold each passage verbatim, without an owner key: ``(passage_id, text_id, n)``.

    ``passages(passage_id, passage)``, ``texts(text_id, text)``. All tokens of a passage but the first
    and last are whole tokens of any text that holds it, so three inner tokens in a row form the join
    key. Passages with fewer than five tokens use their first ``prefix`` characters against windows of
    the texts. Every equality hit is then tested on the whole passage.
    """
    tokens = X.white_tokens(F.col("passage"))
    keyed = passages.withColumn("_t", tokens).withColumn("_long", F.size("_t") >= SHINGLE + 2)
    long = keyed.filter("_long").select("passage_id", "passage", F.array_join(F.slice("_t", 2, SHINGLE), " ").alias("key"))
    short = keyed.filter(~F.col("_long") & (F.length("passage") > 0)).select(
        "passage_id", "passage", F.left("passage", F.lit(prefix)).alias("key"))
    shingles = (texts.select("text_id", X.white_tokens(F.col("text")).alias("t"))
                .filter(F.size("t") >= SHINGLE)
                .select("text_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - SHINGLE + 1),
                                                         lambda i: F.array_join(F.slice("t", i, SHINGLE), " "))).alias("key")))
    lengths = short.agg(F.collect_set(F.length("key")).alias("ns")).select("ns").scalar()
    windows = (texts.select("text_id", "text", F.explode(lengths).alias("n")).filter(F.length("text") >= F.col("n"))
               .select("text_id", F.explode(F.transform(
                   F.sequence(F.lit(1), F.length("text") - F.col("n") + 1),
                   lambda i: F.substring(F.col("text"), i, F.col("n")))).alias("key")))
    pairs = (shingles.join(long, "key").select("text_id", "passage_id", "passage")
             .unionByName(windows.join(short, "key").select("text_id", "passage_id", "passage")).distinct())
    return (pairs.join(texts, "text_id").filter(F.contains("text", F.col("passage")))
            .select("passage_id", "text_id", X.occurrences(F.col("text"), F.col("passage")).alias("n")))


def locator_scores(locators: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of a located paper scored by section and keywords: ``(qa_id, chunk_id, score, rank)``.

    Section in the chunk's section title +2, in its content +1, each keyword in the content +1; the best
    locator counts per chunk; only positive scores; order score, paper, index.
    """
    loc = locators.select(
        "qa_id", "paper_id", F.lower(X.strip(F.coalesce("section", F.lit("")))).alias("section"),
        F.filter(F.transform(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(X.strip(k))),
                 lambda k: F.length(k) > 0).alias("keywords"))
    loc = materialize(loc.withColumn("locator", F.monotonically_increasing_id()), "locators")
    # Every word asked for once per paper, then brought back to the locators that ask for it.
    sections = loc.filter(F.length("section") > 0).select("locator", "qa_id", "paper_id", F.col("section").alias("quote"), F.lit(1).alias("times"))
    keywords = loc.select("locator", "qa_id", "paper_id", F.explode("keywords").alias("quote")).groupBy("locator", "qa_id", "paper_id", "quote").agg(
        F.count(F.lit(1)).cast("int").alias("times"))
    lowered = chunks.select("paper_id", "chunk_index", F.lower("content").alias("content"), F.lower("section_title").alias("title"))
    titles = lowered.filter(F.length("title") > 0).select("paper_id", "title").distinct().withColumn("chunk_index", F.xxhash64("title"))

    def held(asked: DataFrame, texts: DataFrame) -> DataFrame:
        asked = asked.withColumn("quote_id", F.sha2("quote", 256))
        hits = quote_hits(asked.select("quote_id", "paper_id", "quote").distinct(), texts)
        return asked.join(hits.select("quote_id", "paper_id", "chunk_index"), ["quote_id", "paper_id"]).select("locator", "qa_id", "paper_id", "chunk_index", "times")

    in_title = held(sections, titles.withColumnRenamed("title", "content")).withColumnRenamed("chunk_index", "title_key")
    titled = lowered.select("paper_id", "chunk_index", F.xxhash64("title").alias("title_key")).join(in_title, ["paper_id", "title_key"]).select(
        "locator", "qa_id", "paper_id", "chunk_index", F.lit(2).alias("times"))
    points = titled.unionByName(held(sections.unionByName(keywords), lowered))
    best = (points.groupBy("locator", "qa_id", "paper_id", "chunk_index").agg(F.sum("times").alias("score"))
            .groupBy("qa_id", "paper_id", "chunk_index").agg(F.max("score").cast("int").alias("score")))
    return best.withColumn("chunk_id", chunk_id())


def unresolved(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids of the positive items without a resolvable label: ``(qa_id, problem)``."""
    return (items.filter("has_answer").join(labels.select("qa_id").distinct(), "qa_id", "left_anti")
            .select("qa_id", F.lit("no label could be resolved").alias("problem")).distinct())


def require_resolved(items: DataFrame, labels: DataFrame) -> None:
    """Abort when a positive item has no resolvable label; see :func:`raise_if_any` for the list of ids."""
    raise_if_any(unresolved(items, labels), "evaluation set")


# Metrics -------------------------------------------------------------------------------------

def score_items(items: DataFrame, hits: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Item table: retrieved ids, number of relevant ids, recall@k, reciprocal rank and NDCG@k.

    ``items(qa_id, question_type, has_answer)``, ``hits(qa_id, rank, chunk_id)`` (already cut to the
    retriever's list), ``labels(qa_id, chunk_id)``. Metrics are NULL for negatives.

    Hits meet labels by (item, chunk), and metrics are sums over the ranks that met, so an item may have any number of labels: they
    are counted, never gathered. A chunk listed twice counts at its first place; NDCG takes repeated ids out
    before it cuts, recall cuts first.
    """
    known = labels.filter("qa_id is not null and chunk_id is not null").select("qa_id", "chunk_id").distinct()
    order = W.partitionBy("qa_id").orderBy("rank", "chunk_id")
    placed = hits.select("qa_id", "rank", "chunk_id").withColumn("place", F.row_number().over(order))
    once = placed.groupBy("qa_id", "chunk_id").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("times"))
    once = once.withColumn("shown", F.row_number().over(W.partitionBy("qa_id").orderBy("place")))
    met = once.join(known, ["qa_id", "chunk_id"], "left_semi")
    found = met.groupBy("qa_id").agg(
        F.count(F.when(F.col("place") <= k, 1)).alias("found"), F.min("place").alias("first"),
        F.sum(F.when(F.col("shown") <= k, F.lit(1.0) / F.log2(F.col("shown") + 1.0)).otherwise(0.0)).alias("dcg"))
    relevant = known.groupBy("qa_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    retrieved = hits.groupBy("qa_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("retrieved_ids"))
    joined = (items.join(retrieved, "qa_id", "left").join(relevant, "qa_id", "left").join(found, "qa_id", "left")
              .withColumn("retrieved_ids", F.coalesce("retrieved_ids", F.array().cast("array<string>")))
              .withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0))))
    return joined.withColumns({
        "recall": F.when(F.col("has_answer"), M.share_found(F.col("found"), F.col("n_relevant"), k)),
        "mrr": F.when(F.col("has_answer"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))),
        "ndcg": F.when(F.col("has_answer"), M.gain_share(F.col("dcg"), F.col("n_relevant"), k))}).drop("found", "first", "dcg")


def by_type(scored: DataFrame) -> DataFrame:
    """Mean metrics of the positives per question type plus an ALL row."""
    rolled = (scored.filter("has_answer").rollup("question_type")
              .agg(F.grouping("question_type").alias("_all"), F.count(F.lit(1)).alias("n"),
                   F.avg("recall").alias("recall"), F.avg("mrr").alias("mrr"), F.avg("ndcg").alias("ndcg")))
    return rolled.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col("question_type")).alias("question_type"),
                         "n", "recall", "mrr", "ndcg")


def overall(scored: DataFrame, threshold: float = 0.0) -> DataFrame:
    """One row: means over positives, counts, runtime-degradation count and the gate."""
    out = scored.agg(
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("mrr"), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"), F.count_if(F.col("has_answer")).alias("n_positive"),
        F.count_if(~F.col("has_answer")).alias("n_negative"),
        (F.count_if(F.col("retrieval_error").isNotNull()) if "retrieval_error" in scored.columns
         else F.lit(0)).alias("runtime_degraded"))
    return out.withColumn("passed", (F.col("recall") >= threshold) & (F.col("runtime_degraded") == 0))


def comparison_key(dataset: Column, qrels: Column, corpus: Column, mode: str, profile: str, k: int) -> Column:
    """Runs with equal keys may be compared."""
    return F.concat_ws(":", dataset, qrels, corpus, F.lit(mode), F.lit(profile), F.lit(str(k)))


def exact_percentiles(df: DataFrame, value: str, percentiles: list[float], keys: list[str],
                      max_values: int = PERCENTILE_VALUES) -> DataFrame:
    """Exact linearly interpolated percentiles per key, columns ``p0, p1 …``.

    Equal values collapse to counts on the map side. When a key has few distinct values the built-in
    percentile reads the counts; otherwise the (key, value) pairs are range-partitioned, and each range
    finds the ranks that fall into it.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    largest = (df.groupBy(*keys).agg(F.approx_count_distinct(value).alias("d")).agg(F.max("d").alias("d")).first()["d"])
    if (largest or 0) <= max_values:
        arr = F.percentile(value, [float(p) for p in percentiles], F.col("_n"))
        return counts.groupBy(*keys).agg(arr.alias("_p")).select(
            *keys, *[F.col("_p")[i].alias(f"p{i}") for i in range(len(percentiles))])
    order = [*[F.col(c).asc() for c in keys], F.col(value).asc()]
    pinned = cut_lineage(counts.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    sums = pinned.groupBy(*keys, "_part").agg(F.sum("_n").alias("_s"))
    # One row per key and range.
    offset = sums.select(*keys, "_part", F.coalesce(F.sum("_s").over(
        W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
        F.sum("_s").over(W.partitionBy(*keys)).alias("_total"))
    inside = W.partitionBy(*keys, "_part").orderBy(value)
    placed = (pinned.join(offset, [*keys, "_part"])
              .withColumn("_hi", F.col("_off") + F.sum("_n").over(inside))
              .withColumn("_lo", F.col("_hi") - F.col("_n")))
    picks = []
    for i, p in enumerate(percentiles):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        at = lambda r: F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col(value)))
        picks += [at(low).alias(f"_a{i}"), at(high).alias(f"_b{i}"), F.max(rank - low).alias(f"_f{i}")]
    return placed.groupBy(*keys).agg(*picks).select(*keys, *[
        (F.col(f"_a{i}") + F.col(f"_f{i}") * (F.col(f"_b{i}") - F.col(f"_a{i}"))).alias(f"p{i}")
        for i in range(len(percentiles))])


def latency_stats(samples: DataFrame, value: str = "latency_ms", keys: list[str] | None = None,
                  max_values: int = PERCENTILE_VALUES) -> DataFrame:
    """p50, p95, mean and count; zeros when there are no samples at all (no keys)."""
    keys = keys or []
    basics = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    if keys:
        p = exact_percentiles(samples, value, [0.5, 0.95], keys, max_values)
        return basics.join(p, keys).select(*keys, F.col("p0").alias("p50"), F.col("p1").alias("p95"), "mean", "count")
    keyed = samples.withColumn("_k", F.lit(0))
    p = exact_percentiles(keyed, value, [0.5, 0.95], ["_k"], max_values)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (basics.withColumn("_k", F.lit(0)).join(p, "_k", "left")
            .select(zero("p0").alias("p50"), zero("p1").alias("p95"), zero("mean").alias("mean"), "count"))


# Generated answers ---------------------------------------------------------------------------

def score_answers(answers: DataFrame) -> DataFrame:
    """Answer table ``(qa_id, has_answer, ground_truth, relevant_ids, answer[, exception])`` with citation
    scores and keyword hits for positives, refusal for negatives, and the error kind."""
    raised = F.col("exception") if "exception" in answers.columns else F.lit(None).cast("string")
    cited = A.chunk_citations(F.col("answer"))
    scores = M.citation_scores(F.col("citations"), F.col("relevant_ids"))
    base = (answers.withColumn("citations", cited)
            .withColumn("generation_error", F.coalesce(raised, A.error_kind(F.col("answer"))))
            .withColumn("_s", F.when(F.col("has_answer"), scores)))
    return base.withColumns({
        "citation_precision": F.col("_s.precision"), "citation_recall": F.col("_s.recall"),
        "citation_f1": F.col("_s.f1"), "citation_coverage": F.col("_s.coverage"),
        "keyword_hit_rate": F.when(F.col("has_answer"), M.keyword_hit_rate(F.col("answer"), F.col("ground_truth"))),
        "refused": F.when(~F.col("has_answer"), A.is_refusal(F.col("answer")))}).drop("_s")


def generation_summary(scored: DataFrame) -> DataFrame:
    """One row of generation totals; the refusal rate is NULL without negatives."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    out = scored.agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(F.col("generation_error").isNull()).alias("succeeded"),
        F.count("generation_error").alias("error_count"), mean("citation_precision"), mean("citation_recall"),
        mean("citation_f1"), mean("citation_coverage"), mean("keyword_hit_rate"),
        F.count_if(~F.col("has_answer")).alias("negative_total"),
        F.count_if(F.coalesce("refused", F.lit(False))).alias("negative_refused"))
    return out.withColumn("negative_refusal_rate", F.col("negative_refused") / F.nullif(F.col("negative_total"), F.lit(0)))


def generation_errors(scored: DataFrame) -> DataFrame:
    return (scored.filter(F.col("generation_error").isNotNull())
            .groupBy("generation_error").agg(F.count(F.lit(1)).alias("n")))


# Validation ----------------------------------------------------------------------------------

def _messages(*rules: tuple[Column, str]) -> Column:
    """Messages of the rules that fire; an unknown condition does not fire."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(msg)) for cond, msg in rules]))


def dataset_violations(items: DataFrame) -> DataFrame:
    """All rule violations of a QA table: ``(qa_id, problem)``."""
    blank = lambda c: ~X.non_blank(F.coalesce(c, F.lit("")))
    required = ["qa_id", "question", "ground_truth", "question_type", "source", "has_answer"]
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col(name).isNull()
    legacy, evidence = F.col("relevant_chunks").isNotNull(), F.col("relevant_evidence").isNotNull()
    one_kind = legacy != evidence
    uid = lambda e: (e["paper_uid"].rlike(r"(?U)\Adoi:.*\S") | e["paper_uid"].rlike(r"\Asha256:[0-9a-fA-F]{64}\z"))
    bad_uid = F.exists("relevant_evidence", lambda e: ~F.coalesce(uid(e), F.lit(False)))
    bad_quote = F.exists("relevant_evidence", lambda e: F.coalesce(F.length(X.strip(e["quote"])), F.lit(0)) < 20)
    bad_paper = F.exists("relevant_chunks", lambda c: c["paper_id"].isNull())
    bad_locator = F.exists("relevant_chunks", lambda c: c["section"].isNull() & (
        F.coalesce(F.size(c["keywords"]), F.lit(0)) <= 0))
    no_labels = F.coalesce(F.size("relevant_evidence"), F.lit(0)) <= 0
    rules = _messages(
        (absent, "missing required field"),
        (~absent & (F.col("qa_id") == ""), "qa_id is empty"),
        (~absent & blank(F.col("question")), "question is blank"),
        (~absent & blank(F.col("ground_truth")), "ground_truth is blank"),
        (~absent & ~F.col("question_type").isin(V.QUESTION_TYPES), "illegal question_type"),
        (~absent & ~F.col("source").isin(V.QA_SOURCES), "illegal source"),
        (~absent & ~one_kind, "needs exactly one of relevant_chunks and relevant_evidence"),
        (~absent & one_kind & legacy & ~F.col("has_answer") & (F.size("relevant_chunks") > 0), "negative with labels"),
        (~absent & one_kind & legacy & bad_paper, "locator without paper_id"),
        (~absent & one_kind & legacy & bad_locator, "locator without section and keywords"),
        (~absent & one_kind & evidence & F.col("has_answer") & no_labels, "positive without evidence"),
        (~absent & one_kind & evidence & ~F.col("has_answer") & (F.size("relevant_evidence") > 0), "negative with labels"),
        (~absent & one_kind & evidence & bad_uid, "illegal paper_uid"),
        (~absent & one_kind & evidence & bad_quote, "quote under 20 characters"))
    broken = items.select("qa_id", F.explode(rules).alias("problem"))
    repeats = (items.filter(~absent & (F.col("qa_id") != "")).groupBy("qa_id").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > 1).select("qa_id", F.lit("qa_id repeated").alias("problem")))
    return broken.unionByName(repeats)


def corpus_violations(papers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Violations of a benchmark corpus: ``(paper_uid, problem)``.

    ``papers(paper_uid, title)``, ``chunks(paper_uid, chunk_index, content)``.
    """
    uid = F.coalesce("paper_uid", F.lit(""))
    p = papers.select("paper_uid", F.explode(_messages(
        (~(F.startswith(uid, F.lit("doi:")) & (F.length(uid) > 4)), "paper_uid must be doi:<doi>"),
        (~X.non_blank(F.coalesce("title", F.lit(""))), "title is blank"))).alias("problem"))
    twice = (papers.groupBy("paper_uid").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
             .select("paper_uid", F.lit("paper_uid repeated").alias("problem")))
    c = chunks.select("paper_uid", F.explode(_messages(
        (F.col("chunk_index").isNull(), "chunk_index must be an integer"),
        (F.coalesce(F.length(X.strip(F.col("content"))), F.lit(0)) < 20, "content under 20 characters")))
        .alias("problem"))
    index_twice = (chunks.filter(F.col("chunk_index").isNotNull()).groupBy("paper_uid", "chunk_index")
                   .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
                   .select("paper_uid", F.lit("chunk_index repeated").alias("problem")))
    empty = (papers.select("paper_uid").join(chunks.select("paper_uid").distinct(), "paper_uid", "left_anti")
             .select("paper_uid", F.lit("paper without chunks").alias("problem")))
    return p.unionByName(twice).unionByName(c).unionByName(index_twice).unionByName(empty)


def benchmark_violations(items: DataFrame, min_items: int = 50, min_papers: int = 12) -> DataFrame:
    """Reviewed flag, legal split, one split per paper and minimum sizes: ``(subject, problem)``."""
    legal = F.coalesce(F.col("split").isin(V.SPLITS), F.lit(False))
    rows = items.select(F.col("qa_id").alias("subject"), F.explode(_messages(
        (~F.coalesce("reviewed", F.lit(False)), "not reviewed"), (~legal, "illegal split"))).alias("problem"))
    uids = items.filter(legal).select("split", F.explode("relevant_evidence.paper_uid").alias("subject"))
    leaks = (uids.groupBy("subject").agg(F.countDistinct("split").alias("n")).filter(F.col("n") > 1)
             .select("subject", F.lit("paper in several splits").alias("problem")))
    few_items = items.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < min_items).select(
        F.lit("dataset").alias("subject"), F.lit("too few items").alias("problem"))
    few_papers = uids.agg(F.countDistinct("subject").alias("n")).filter(F.col("n") < min_papers).select(
        F.lit("dataset").alias("subject"), F.lit("too few papers").alias("problem"))
    return rows.unionByName(leaks).unionByName(few_items).unionByName(few_papers)


def benchmark_counts(items: DataFrame) -> DataFrame:
    """Items per split with the number of papers their evidence covers."""
    uids = items.select("split", "qa_id", F.explode_outer("relevant_evidence.paper_uid").alias("uid"))
    return uids.groupBy("split").agg(F.countDistinct("qa_id").alias("items"), F.countDistinct("uid").alias("papers"))


def raise_if_any(violations: DataFrame, what: str) -> None:
    """Raise one error for all violations.

    The whole list is written to a table in the shared folder; the message gives their number, that place and as many of
    them, in order, as a message can hold.
    """
    if violations.isEmpty():
        return
    listed = materialize(violations, "violations")
    n = listed.count()
    shown = [": ".join(map(str, r)) for r in listed.orderBy(*listed.columns).limit(SHOWN).collect()]
    more = f"\n  and {n - len(shown)} more" if n > len(shown) else ""
    raise InvalidData(f"{what} is invalid, {n} problems, all listed in {listed.inputFiles()[0].rsplit('/', 1)[0]}:\n  - " + "\n  - ".join(shown) + more, listed)


class InvalidData(ValueError):
    """An invalid data set; ``violations`` is the table of everything found."""

    def __init__(self, message: str, violations: DataFrame):
        super().__init__(message)
        self.violations = violations
