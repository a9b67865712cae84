"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Each query runs
into a sink that discards rows, twice; the better time counts, and ``first`` gives the first one, which holds compilation and,
for the first query, the start of the JVM. ``per_call_ms`` divides the retrieval times by the number of questions answered in
the one job, so it states throughput; ``pairs_per_sec`` multiplies by the chunks.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "bm25_top5", "bm25_neighbor_top5", "count_score_top5", "keyword_and_search", "vector_top10", "hybrid_search",
    "rrf_chunk_fusion", "eval_by_type_rollup", "passage_occurrences", "paragraph_chunks", "term_statistics",
    "neighbors_1hop", "neighbors_2hop", "graph_expand_top5", "fuzzy_title_edges", "author_year_match", "citation_map",
    "thesis_chapters", "stats_top_tags", "stats_top_authors", "library_grouping_sets", "export_rows", "numbered_citations",
    "memory_eviction", "digest_input", "latency_percentiles", "trend_pivot", "manifest_hash", "vector_validation",
    "material_sample", "candidate_items",
]
RETRIEVAL = ["bm25_top5", "bm25_neighbor_top5", "count_score_top5", "keyword_and_search"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from marginalia.session import build_session
    from marginalia.plans import catalogue, tables as T

    spark = build_session("marginalia-bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, times, first = catalogue.queries(), {}, {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            first.setdefault(name, round(took, 3))
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr)
    n_queries = T.query_table(spark, sf).count()
    n_chunks = T.line_chunks(spark, sf).count()
    timed = [n for n in RETRIEVAL if n in times]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first": first,
        "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "questions": n_queries, "chunks": n_chunks,
        "per_call_ms": {n: round(1000 * times[n] / n_queries, 2) for n in timed},
        "pairs_per_sec": {n: round(n_queries * n_chunks / times[n]) for n in timed}}))
    spark.stop()


if __name__ == "__main__":
    main()
