"""The extraction job: pending promotions and their pages to every table that an extraction changes.

The result of a batch is staged first, one row per pending promotion; pages are parsed for it and never again. Updates,
sections, insights, snapshots and job transitions are projections of the staged rows, each written under the batch id.
A batch that is run again, after a failure or by a repeated trigger, finds its staged rows and writes the same files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens import schemas
from promolens.functions import records
from promolens.functions.rows import computed_once, exploded
from promolens.operators import history, mutations, storage
from promolens.operators.ingest import extraction_plan, pending_extraction
from promolens.operators.ranking import first_seen
from promolens.operators.responses import parse_responses
from promolens.operators.scoring import hybrid_insights, rule_insights
from promolens.operators.structure import extract_pages
from promolens.params import Params

NO_PAGE = "no page"
LOCKED = "skipped (locked)"
FIELDS = ("title", "period", "benefit_type", "benefit_value", "conditions", "target_segment", "one_line_summary", "raw_text")
CARRIED = ("error", "source", "insight", "extracted_json", "page_text", "answer_category", "answer_threat")
DERIVED = ("period_start", "period_end", "benefit_amount_won", "benefit_pct", "status")
INSIGHT = (
    "benefit_level", "benefit_score", "target_clarity", "objective_tags", "target_tags", "channel_tags",
    "competitive_points", "promo_strategies", "evidence", "threat_reason", "marketing_takeaway",
    "insight_confidence", "section_coverage",
)


def landed_pages(pages: DataFrame) -> DataFrame:
    """The newest page of each address (of equal age the first by text)."""
    age = [F.desc_nulls_last("captured_at")] if "captured_at" in pages.columns else []
    return first_seen(pages, ["url"], [*age, F.asc("html")]).select("url", "html")


def with_pages(addresses: DataFrame, pages: DataFrame) -> DataFrame:
    """The ids that have an address with a landed page."""
    return addresses.select("id", "url").join(pages.select("url"), "url", "left_semi").select("id").distinct()


def extracted(events: DataFrame, pages: DataFrame, params: Params, responses: DataFrame) -> DataFrame:
    """Promotions with their page's fields laid over the stored ones, the insight of the page and its section map.

    ``responses`` (id, answer) are parsed model answers; without one the rules decide. ``error`` tells why a promotion
    has no result: no page, or a page that says the promotion is gone. The stored rows of an id travel with its pages as
    the array ``same``, so they are read once and not joined again; each page is laid over each of them.
    """
    stored = F.collect_list(F.struct("url", "company", *FIELDS))
    ours = events.groupBy("id").agg(stored.alias("same"))
    found = exploded(ours, ["id", "same"], F.col("same.url"), "url").join(landed_pages(pages), "url", "left")
    missing = F.col("html").isNull()
    read = extract_pages(found.withColumn("_missing", missing), params.vocab)
    error = F.when(F.col("_missing"), NO_PAGE).otherwise(F.col("error"))
    fields = computed_once(read, {**{c: F.col(c) for c in (*FIELDS, "marketing_content")}, "error": error})
    none = F.lit(None).cast("string")
    rated = rule_insights(fields.withColumns({"category": none, "threat_level": none}), params.vocab)
    as_json = F.to_json(F.struct(*FIELDS, "marketing_content"))
    rated = hybrid_insights(rated.withColumn("extracted_json", as_json).withColumn("page_text", F.col("raw_text")), responses)
    insight = F.struct(*INSIGHT, F.col("insight_threat").alias("threat_level"))
    carried = rated.withColumns({"insight": insight, "answer_category": F.col("category"), "answer_threat": F.col("threat_level")})
    both = exploded(carried, ["id", *FIELDS, "marketing_content", "same", *CARRIED], F.col("same"), "x")
    return records.laid_over(both, params, (*CARRIED, "same"), new="")


def _no_answers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], f"id BIGINT, answer STRUCT<{schemas.RESPONSE_JSON}>")


def _bare(rows: DataFrame, error: str | None, like: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "id", "url", "company", "action", F.lit(error).cast("string").alias("error"), none.alias("source"),
        F.lit(None).cast(like.schema["result"].dataType).alias("result"))


def _answers(responses: DataFrame) -> DataFrame:
    """Parsed answers; each text is parsed once, and only after the joins below it."""
    if "answer" in responses.columns:
        return responses
    return computed_once(parse_responses(responses).select("id", "answer"), {"answer": F.col("answer")})


def with_result(
    events: DataFrame, ids: DataFrame, pages: DataFrame, locks: DataFrame, params: Params, responses: DataFrame,
    lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The staged rows of the promotions to extract whose id is in ``ids`` (or null, which finds no result).

    Only they, and the answers about them, are read whole and meet the pages.
    """
    near = events.join(ids, "id", "left_semi") if lookup is None else lookup(ids)
    answers = _answers(responses.join(ids, "id", "left_semi"))
    extract = F.col("action") == "extract"
    done = extracted(extraction_plan(pending_extraction(near), locks).where(extract), pages, params, answers)
    names = [c for c in done.columns if c not in ("id", "same")]
    rows = exploded(done, ["id", *names], F.col("same"), "p").select(
        "id", "p.url", "p.company", F.lit("extract").alias("action"), "error",
        F.when(F.col("error").isNull(), F.col("source")).alias("source"), F.struct(*names).alias("result"))
    nameless = extraction_plan(pending_extraction(events.where(F.col("id").isNull())), locks).where(extract)
    return rows.union(_bare(nameless, None, rows))


def without_result(events: DataFrame, ids: DataFrame, locks: DataFrame, responses: DataFrame, like: DataFrame) -> DataFrame:
    """The staged rows of promotions that are extracted in vain, as no page landed, and of those that are not extracted.

    Repeated ids and answers give as many rows here as they give where there is a page.
    """
    extract = F.col("action") == "extract"
    answers = _answers(responses).where(F.col("answer").isNotNull()).groupBy("id").agg(F.count("*").alias("_k"))
    plan = extraction_plan(pending_extraction(events), locks).select("id", "url", "company", "action")
    ours = F.count_if(extract).over(Window.partitionBy("id"))
    counted = plan.withColumn("_n", ours).join(answers, "id", "left").join(ids.withColumn("_paged", F.lit(True)), "id", "left")
    times = F.when((F.col("_n") == 0) | F.col("id").isNull(), 1).otherwise(F.col("_n") * F.col("_n") * F.coalesce("_k", F.lit(1)))
    idle = counted.where(~extract | (F.col("id").isNotNull() & F.col("_paged").isNull()))
    rows = exploded(idle, ["id", "url", "company", "action"], F.array_repeat(F.lit(True), times.cast("int")), "_row")
    return _bare(rows, NO_PAGE, like).withColumn("error", F.when(extract, F.col("error")))


def staged_results(
    events: DataFrame, pages: DataFrame, locks: DataFrame, params: Params, at: Column, responses: DataFrame | None = None,
    addresses: DataFrame | None = None, lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The rows of ``staged`` that updates, sections, insights and snapshots are made of.

    ``responses`` are model answers, as texts (id, response) or parsed (id, answer). Where events are costly to compute,
    ``addresses`` (id, url) are theirs and ``lookup`` gives the events of a table of ids.
    """
    responses = _no_answers(events.sparkSession) if responses is None else responses
    ids = with_pages(events if addresses is None else addresses, pages)
    return with_result(events, ids, pages, locks, params, responses, lookup).withColumn("at", at)


def staged(
    events: DataFrame, pages: DataFrame, locks: DataFrame, params: Params, at: Column, responses: DataFrame | None = None,
    addresses: DataFrame | None = None, lookup: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per pending promotion: what the run does with it and, where it is extracted, the result."""
    responses = _no_answers(events.sparkSession) if responses is None else responses
    ids = with_pages(events if addresses is None else addresses, pages)
    rows = with_result(events, ids, pages, locks, params, responses, lookup)
    return rows.union(without_result(events, ids, locks, responses, rows)).withColumn("at", at)


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("action") == "extract") & F.col("error").isNull())


# ---- projections of the staged rows ------------------------------------------------------

def update_rows(rows: DataFrame) -> DataFrame:
    """New values of the extracted promotions; content and insight as JSON, category and threat only from an answer."""
    r = lambda c: F.col(f"result.{c}")
    return succeeded(rows).select(
        "id", *[r(c).alias(c) for c in (*FIELDS, *DERIVED)], r("answer_category").alias("category"),
        r("answer_threat").alias("threat_level"), F.to_json(r("marketing_content")).alias("marketing_content"),
        F.to_json(r("insight")).alias("marketing_insights"))


def section_rows(rows: DataFrame, params: Params) -> DataFrame:
    content = succeeded(rows).select(F.col("id").alias("event_id"), F.col("result.marketing_content").alias("_m"))
    return history.section_rows(content, F.col("_m"), params.vocab.section_names)


def insight_rows(rows: DataFrame) -> DataFrame:
    return succeeded(rows).select(F.col("id").alias("event_id"), "result.insight.*", "source", F.col("at").alias("generated_at"))


def snapshot_rows(rows: DataFrame) -> DataFrame:
    """What was read from the page, before it was laid over stored values."""
    return succeeded(rows).select(
        F.col("id").alias("event_id"), F.lit(None).cast("string").alias("raw_html"), F.col("result.page_text").alias("raw_text"),
        F.col("result.extracted_json").alias("extracted_json"), F.lit(None).cast("int").alias("extraction_latency_ms"),
        F.lit(None).cast("double").alias("noise_ratio"), F.col("at").alias("captured_at"))


def job_rows(rows: DataFrame, batch: int | Column) -> DataFrame:
    """Transitions of the batch's jobs. Locked promotions succeed at once; addresses that are not http get no job."""
    step = lambda seq, status, error=None: F.struct(
        F.lit(seq).alias("seq"), F.lit(status).alias("status"), (F.lit(None) if error is None else error).cast("string").alias("error"))
    ran = F.array(step(0, "pending"), step(1, "running"), F.struct(
        F.lit(2).alias("seq"), F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"), F.col("error").alias("error")))
    held = F.array(step(0, "pending"), step(1, "success", F.lit(LOCKED)))
    batch = F.lit(batch) if isinstance(batch, int) else batch
    return rows.where(F.col("action") != "failed").select(
        F.concat_ws(":", batch.cast("string"), F.col("id").cast("string")).alias("job_id"), F.lit("extract").alias("job_type"),
        F.col("id").alias("event_id"), "company", "at",
        F.explode(F.when(F.col("action") == "skipped", held).otherwise(ran)).alias("_s"),
    ).select("job_id", "job_type", "event_id", "company", "at", "_s.*")


# ---- a batch, and the tables after it ------------------------------------------------------

def run_batch(
    events: DataFrame, pages: DataFrame, locks: DataFrame, params: Params, root: str, batch: int, at: Column,
    responses: DataFrame | None = None,
) -> DataFrame:
    """Run batch ``batch`` and write its five results below ``root``; returns the staged rows.

    Promotions that were locked or failed stay without content, so the next batch over the table takes them up again,
    whether or not new ones came.
    """
    spark = events.sparkSession
    path = f"{root}/staged/batch={batch}"
    if not storage.complete(spark, path):
        staged(events, pages, locks, params, at, responses).write.mode("overwrite").parquet(path)
    rows = spark.read.parquet(path)
    tables = {
        "updates": update_rows(rows), "sections": section_rows(rows, params), "insights": insight_rows(rows),
        "snapshots": snapshot_rows(rows), "jobs": job_rows(rows, batch),
    }
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    return rows


def read_results(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All batches of one result, with their ``batch``."""
    return spark.read.parquet(f"{root}/{name}")


def latest_batch(updates: DataFrame) -> DataFrame:
    """The last batch that extracted each promotion."""
    return updates.groupBy(F.col("id").alias("event_id")).agg(F.max("batch").alias("batch"))


def events_after(events: DataFrame, updates: DataFrame, params: Params) -> DataFrame:
    last = latest_batch(updates).withColumnRenamed("event_id", "id")
    return mutations.apply_updates(events, updates.join(last, ["id", "batch"], "left_semi").drop("batch"), params)


def sections_after(stored: DataFrame, sections: DataFrame, updates: DataFrame) -> DataFrame:
    last = latest_batch(updates)
    fresh = sections.join(last, ["event_id", "batch"], "left_semi").drop("batch")
    return history.replace_sections(stored, fresh, last)


def insights_after(stored: DataFrame, insights: DataFrame) -> DataFrame:
    """New rows replace stored ones of the same source; of several batches the last one's stays."""
    last = first_seen(insights, ["event_id", "source"], [F.desc("batch")]).drop("batch")
    return history.replace_insights(stored, last)


# ---- children of older rows ------------------------------------------------------------------

def backfilled_sections(events: DataFrame, stored: DataFrame, params: Params) -> DataFrame:
    """Section rows of promotions whose stored content has none yet."""
    filled = events.where(records.has_json_content(F.col("marketing_content")))
    content = mutations.missing_children(filled, stored).select(
        F.col("id").alias("event_id"), records.content_map(F.col("marketing_content")).alias("_m"))
    return history.section_rows(content.where(F.col("_m").isNotNull()), F.col("_m"), params.vocab.section_names)


def backfilled_insights(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Rule insights of promotions whose stored insight has no row yet."""
    filled = events.where(records.has_json_content(F.col("marketing_insights")))
    read = mutations.missing_children(filled, stored).select(
        F.col("id").alias("event_id"), records.insight_struct(F.col("marketing_insights")).alias("_i"))
    return read.select(
        "event_id", "_i.benefit_level", "_i.competitive_points", "_i.promo_strategies", "_i.objective_tags", F.lit("rule").alias("source"))
