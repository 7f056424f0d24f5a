"""Headline queries, one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once after one warm-up query; results are consumed in full by
the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "company_overview", "statistics", "weekly_trend", "strategy_map", "compare_matrix_category", "benefit_benchmark",
    "category_gap", "gap_trend", "comparison_table", "company_briefing", "risk_lists", "weekly_changes", "intelligence",
    "latest_insights", "insert_if_new", "feed_a_records", "normalised_urls", "manual_edits", "probe_cutoff",
    "candidate_lines", "document_sections", "extracted_pages", "rule_insights", "hybrid_insights", "parsed_responses",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from promolens.plans import catalog
    from promolens.session import tuned

    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        tuned(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, base).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run("company_overview")
    took = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": Path(base).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
