"""All registered queries."""

from __future__ import annotations

from marginalia.plans import registry, retrieval_queries, library_queries, text_queries, job_queries  # noqa: F401  (later ones use earlier tables)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
