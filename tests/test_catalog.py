"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import compare
from promolens.plans import catalog

BASE = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()
# The heavier half runs in tools/compare.py; these cover every operator family.
NAMES = [
    "category_gap", "company_overview", "gap_trend", "strategy_map", "benefit_benchmark", "weekly_changes", "risk_lists",
    "feed_a_records", "page_block_links", "insert_if_new", "normalised_urls", "latest_insights", "manual_edits", "probe_cutoff",
    "candidate_lines", "document_sections", "rule_insights", "parsed_responses",
    "header_kpis", "status_counts", "intelligence", "hybrid_insights", "request_prompts", "page_containers",
    "extract_job_updates", "extract_job_sections", "extract_job_jobs", "backfilled_sections", "backfilled_insights", "direct_entry",
]


@pytest.fixture(scope="module")
def con():
    return compare.duck(BASE)


@pytest.mark.skipif(not os.path.isdir(BASE), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    note, _, ok = compare.compare(spark, con, BASE, name, QUERIES[name], ORACLE[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)
