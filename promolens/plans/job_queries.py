"""Registered queries: the extraction job over stored promotions and landed pages, children of older rows, direct entry."""

from __future__ import annotations

from pyspark.sql import functions as F

from promolens.operators import extract_job as ej
from promolens.operators import history as hi
from promolens.operators import ingest as ing
from promolens.plans import adapters as ad
from promolens.plans import oracle_views as ov
from promolens.plans import text_queries as tq
from promolens.plans.flat import flat
from promolens.plans.history_queries import SECTIONS
from promolens.plans.history_queries import _sections as stored_sections
from promolens.plans.ingest_queries import CANON, DATES, DAY, LOCKED, S, _submitted
from promolens.plans.settings import AS_OF, PARAMS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BATCH = 7


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, base: flat(fn(spark, base))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


#: The staged rows in SQL: plan, stored promotion, page (if one landed) and model answer (if one is valid).
STAGED = "WITH " + ov.CAMPAIGNS + LOCKED + f""", x AS ({tq.ORACLE['extracted_pages']}), {ov.RESPONSES.strip()},
  staged AS (SELECT c.id, c.company, p.action, x.page_id IS NOT NULL AS landed, coalesce(r.ok, false) AS answered, r.k, r.threat, r.event_type,
    coalesce(nullif(x.title, ''), nullif(c.title, ''), '') AS title, coalesce(nullif(x.period, ''), nullif(c.period, ''), '') AS period,
    coalesce(nullif(x.benefit_value, ''), nullif(c.benefit_value, ''), '') AS benefit_value, coalesce(nullif(x.conditions, ''), c.conditions) AS conditions,
    coalesce(nullif(x.target_segment, ''), c.target_segment) AS target_segment, coalesce(nullif(x.benefit_type, ''), c.benefit_type) AS benefit_type,
    x.title AS page_title, x.raw_text AS page_text, c.one_line_summary AS old_summary, {', '.join('x.' + s for s in tq.SECTION_COLUMNS.values())}
    FROM plan p JOIN campaigns c ON c.id = p.id LEFT JOIN x ON x.page_id = c.id AND p.action = 'extract' LEFT JOIN responses r ON r.id = c.id),
  done AS (SELECT * FROM staged WHERE action = 'extract' AND landed)
"""


def _staged(spark, base, staged=ej.staged_results):
    events = ad.campaigns(spark, base)
    pages = ad.promo_pages(spark, base).select("page_id", "html")
    addresses = ad.campaign_addresses(spark, base)
    landed = addresses.withColumnRenamed("id", "page_id").join(pages, "page_id").select("url", "html")
    answers = ad.response_texts(spark, base).select("id", "response")
    at = F.lit(f"{AS_OF} 06:00:00").cast("timestamp_ntz")
    return staged(
        events, landed, hi.lock_state(ad.locks(spark, base)), PARAMS, at, answers, addresses,
        lambda ids: ad.campaigns(spark, base, ids))


END = ov.period_end("period")


@query("extract_job_updates", STAGED + f"""SELECT id, title, period, benefit_type, benefit_value, conditions, target_segment,
  CASE WHEN answered THEN 'summary ' || k ELSE coalesce(nullif(page_title, ''), old_summary) END AS one_line_summary, strftime({ov.period_start('period')}, '%Y-%m-%d') AS period_start,
  strftime({END}, '%Y-%m-%d') AS period_end, {ov.amount('benefit_value')} AS benefit_amount_won, {ov.pct('benefit_value')} AS benefit_pct,
  CASE WHEN {END} IS NULL THEN 'unknown' WHEN {END} >= {DAY} THEN 'active' ELSE 'ended' END AS status,
  CASE WHEN answered THEN event_type END AS category, CASE WHEN answered THEN threat END AS threat_level FROM done""")
def extract_job_updates(spark, base):
    return ej.update_rows(_staged(spark, base)).drop("raw_text", "marketing_content", "marketing_insights")


SECTION_SQL = " UNION ALL ".join(
    f"SELECT id AS event_id, '{name}' AS section_type, {column} AS contents FROM done WHERE {column} <> ''" for name, column in tq.SECTION_COLUMNS.items())


@query("extract_job_sections", STAGED + SECTION_SQL)
def extract_job_sections(spark, base):
    rows = ej.section_rows(_staged(spark, base), PARAMS)
    item = F.array_sort(F.collect_list(F.struct("sort_order", "content")))
    return rows.groupBy("event_id", "section_type").agg(F.array_join(F.transform(item, lambda x: x["content"]), " | ").alias("contents"))


@query("extract_job_snapshots", STAGED + f"""SELECT id AS event_id, page_text AS raw_text, page_title AS title,
  array_to_string(list_filter([{', '.join(tq.SECTION_COLUMNS.values())}], lambda s: s <> ''), ' | ') AS contents, '{AS_OF} 06:00:00' AS captured_at FROM done""")
def extract_job_snapshots(spark, base):
    shots = ej.snapshot_rows(_staged(spark, base))
    read = F.from_json("extracted_json", "title string, marketing_content map<string,array<string>>")
    texts = F.flatten(F.array(*[F.col("_x.marketing_content")[name] for name in tq.SECTION_COLUMNS]))
    return shots.withColumn("_x", read).select("event_id", "raw_text", "_x.title", F.array_join(texts, " | ").alias("contents"), "captured_at")


@query("extract_job_insights", STAGED + """SELECT id AS event_id, CASE WHEN answered THEN 'gemini' ELSE 'rule' END AS source,
  CASE WHEN answered THEN 0.85 ELSE 0.5 END::DOUBLE AS insight_confidence, CASE WHEN answered THEN threat END AS threat_level,
  CASE WHEN answered THEN 'takeaway ' || k END AS marketing_takeaway FROM done""")
def extract_job_insights(spark, base):
    return ej.insight_rows(_staged(spark, base)).select("event_id", "source", "insight_confidence", "threat_level", "marketing_takeaway")


@query("extract_job_jobs", STAGED + f"""SELECT '{BATCH}:' || id AS job_id, CASE WHEN action = 'skipped' OR landed THEN 'success' ELSE 'failed' END AS status,
  (action = 'extract' AND NOT landed)::BIGINT AS retry_count, CASE WHEN action = 'skipped' THEN '{ej.LOCKED}' WHEN NOT landed THEN '{ej.NO_PAGE}' END AS last_error,
  '{AS_OF} 06:00:00' AS finished_at FROM staged WHERE action <> 'failed'""")
def extract_job_jobs(spark, base):
    return hi.job_state(ej.job_rows(_staged(spark, base, ej.staged), BATCH)).drop("started_at")


C = "WITH " + ov.CAMPAIGNS


@query("backfilled_sections", C + SECTIONS + """SELECT event_id, section_type, content, sort_order::BIGINT AS sort_order FROM parts
  WHERE event_id NOT IN (SELECT event_id FROM parts WHERE event_id IN (SELECT c_custkey FROM customer))""")
def backfilled_sections(spark, base):
    old = ad.table(spark, base, "customer").select(F.col("c_custkey").alias("event_id"))
    stored = stored_sections(spark, base).join(old, "event_id", "left_semi")
    return ej.backfilled_sections(ad.campaigns(spark, base), stored, PARAMS)


@query("backfilled_insights", C + ", " + ov.INSIGHTS.strip() + """SELECT id AS event_id, level AS benefit_level, array_to_string(points, ' | ') AS competitive_points,
  array_to_string(strategies, ' | ') AS promo_strategies, CASE WHEN id % 6 = 2 THEN '' ELSE segment END AS objective_tags, 'rule' AS source
  FROM campaigns WHERE has_insight AND id NOT IN (SELECT event_id FROM insights)""")
def backfilled_insights(spark, base):
    return ej.backfilled_insights(ad.campaigns(spark, base), ad.insights(spark, base))


@query("direct_entry", S + f""", firsts AS (SELECT * FROM submissions WHERE order_status = 'P' QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival) = 1),
  fresh AS ({CANON} firsts f WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.order_status = 'F' AND s.url = f.url))
  SELECT arrival, url, company, {DATES} FROM fresh""")
def direct_entry(spark, base):
    by_hand = ad.submissions(spark, base).where(F.col("order_status") == "P")
    stored = _submitted(spark, base).where(F.col("order_status") == "F").select("url")
    return ing.direct_entry(by_hand, stored, [F.asc("arrival")], PARAMS).select(
        "arrival", "url", "company", "period_start", "period_end", "benefit_amount_won", "benefit_pct", "status")
