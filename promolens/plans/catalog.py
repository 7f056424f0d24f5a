"""All registered queries."""

from __future__ import annotations

from promolens.plans import history_queries, ingest_queries, job_queries, market_queries, text_queries

GROUPS = (market_queries, ingest_queries, text_queries, history_queries, job_queries)


def queries() -> dict:
    return {name: fn for g in GROUPS for name, fn in g.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for g in GROUPS for name, sql in g.ORACLE.items()}
