"""Registered queries: history tables, joined views and order-dependent scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from promolens.functions import records
from promolens.operators import history as hi
from promolens.operators.ranking import miss_run_cutoff
from promolens.plans import adapters as ad
from promolens.plans import oracle_views as ov
from promolens.plans.flat import flat
from promolens.plans.settings import PARAMS

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, base: flat(fn(spark, base))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


C = "WITH " + ov.CAMPAIGNS
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
PRIO = "CASE source WHEN 'gemini' THEN 0 WHEN 'hybrid' THEN 1 WHEN 'rule' THEN 2 ELSE 3 END"
LATEST = f""", latest AS (SELECT * FROM insights QUALIFY row_number() OVER (
  PARTITION BY event_id ORDER BY {PRIO}, generated_at DESC, id DESC) = 1)"""


@query("latest_insights", "WITH " + ov.INSIGHTS + LATEST + "SELECT event_id, id, source, benefit_level FROM latest")
def latest_insights(spark, base):
    return hi.latest_insight(ad.insights(spark, base)).select("event_id", "id", "source", "benefit_level")


@query("insights_with_events", C + "," + ov.INSIGHTS + "SELECT i.id, i.event_id, c.company, c.title FROM insights i JOIN campaigns c ON c.id = i.event_id")
def insights_with_events(spark, base):
    return hi.with_insight(ad.insights(spark, base), ad.campaigns(spark, base)).select("id", "event_id", "company", "title")


@query("replaced_insights", "WITH " + ov.INSIGHTS + """, fresh AS (SELECT DISTINCT event_id, 'rule' AS source FROM insights WHERE k < 30)
  SELECT event_id, source, coalesce(benefit_level, '-') AS benefit_level FROM insights i
  WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.event_id = i.event_id AND f.source = i.source)
  UNION ALL SELECT event_id, source, '높음' FROM fresh""")
def replaced_insights(spark, base):
    stored = ad.insights(spark, base)
    low = F.col("competitive_points")[0].isin(*[f"k{i}" for i in range(30)])
    fresh = stored.where(low).select("event_id").distinct().select(
        "event_id", F.lit("rule").alias("source"), F.lit("높음").alias("benefit_level"), F.lit(1).alias("unknown_key")
    )
    return hi.replace_insights(stored, fresh).select("event_id", "source", "benefit_level")


SECTIONS = """, parts AS (
  SELECT id AS event_id, '혜택_상세' AS section_type, title || ' 혜택' AS content, 0 AS sort_order FROM campaigns WHERE has_content
  UNION ALL SELECT id, '참여방법', '앱 응모', 1 FROM campaigns WHERE has_content
  UNION ALL SELECT id, '참여방법', segment, 2 FROM campaigns WHERE has_content
  UNION ALL SELECT id, '파트너십', '스타벅스', 3 FROM campaigns WHERE has_content AND id % 2 = 0)
"""


def _sections(spark, base):
    rows = ad.campaigns(spark, base).select(
        F.col("id").alias("event_id"), records.content_map(F.col("marketing_content")).alias("m")
    ).where(F.col("m").isNotNull())
    return hi.section_rows(rows, F.col("m"), PARAMS.vocab.section_names)


@query("section_rows", C + SECTIONS + "SELECT event_id, section_type, content, sort_order::BIGINT AS sort_order FROM parts")
def section_rows(spark, base):
    return _sections(spark, base)


@query("replaced_sections", C + SECTIONS + """SELECT event_id, section_type, sort_order::BIGINT AS sort_order FROM parts WHERE event_id NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT c_custkey, 'new', 0 FROM customer""")
def replaced_sections(spark, base):
    fresh = ad.table(spark, base, "customer").select(
        F.col("c_custkey").alias("event_id"), F.lit("new").alias("section_type"), F.col("c_name").alias("content"),
        F.lit(0).alias("sort_order"),
    )
    return hi.replace_sections(_sections(spark, base), fresh, fresh).select("event_id", "section_type", "sort_order")


@query("snapshot_history", "WITH " + ov.SNAPSHOTS + f"""SELECT event_id, {TS.format('captured_at')} AS captured_at, extraction_latency_ms::BIGINT AS extraction_latency_ms,
  length(raw_text) AS raw_text_len FROM snapshots ORDER BY event_id, captured_at DESC""")
def snapshot_history(spark, base):
    return hi.snapshot_history(ad.snapshots(spark, base)).orderBy(*hi.newest_first())


@query("snapshot_changes", f"""WITH caps AS (
  SELECT turn AS event_id, TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600) AS captured_at, role AS raw_text FROM conversations)
  SELECT event_id, {TS.format('captured_at')} AS captured_at, CASE WHEN lag(raw_text) OVER w IS NULL THEN 'first'
    WHEN raw_text = lag(raw_text) OVER w THEN 'unchanged' ELSE 'changed' END AS change
  FROM caps WINDOW w AS (PARTITION BY event_id ORDER BY captured_at)""")
def snapshot_changes(spark, base):
    # One promotion per turn number, captured hourly, so that days and hot groups both occur.
    caps = ad.table(spark, base, "conversations").select(
        F.col("turn").alias("event_id"), F.col("role").alias("raw_text"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600).cast("timestamp_ntz").alias("captured_at"),
    )
    return hi.snapshot_changes(caps)


@query("edit_history", "WITH " + ov.EDITS + f"""SELECT event_id, field_name, editor, {TS.format('edited_at')} AS edited_at, length(old_value) AS old_len
  FROM edits ORDER BY event_id, edited_at DESC""")
def edit_history(spark, base):
    rows = hi.edit_history(ad.edits(spark, base))
    return rows.select("event_id", "field_name", "editor", "edited_at", F.length("old_value").cast("bigint").alias("old_len"))


AUDIT = """ FROM edits WHERE editor = 'user' AND edited_at >= TIMESTAMP '2024-01-11' AND edited_at <= TIMESTAMP '2024-03-01'"""


def _audit(spark, base):
    import datetime as dt

    return hi.audit_log(ad.edits(spark, base), editor="user", since=dt.datetime(2024, 1, 11), until=dt.datetime(2024, 3, 1))


@query("audit_page", "WITH " + ov.EDITS + f"SELECT event_id, field_name, {TS.format('edited_at')} AS edited_at FROM (SELECT * {AUDIT} ORDER BY edited_at DESC, event_id LIMIT 20 OFFSET 20)")
def audit_page(spark, base):
    return hi.audit_page(_audit(spark, base), page=2, size=20).select("event_id", "field_name", "edited_at")


@query("audit_total", "WITH " + ov.EDITS + "SELECT count(*) AS total" + AUDIT)
def audit_total(spark, base):
    return _audit(spark, base).agg(F.count("*").alias("total"))


def _edit_batch(spark, base):
    """Edit requests on promotions: lines rewrite titles and categories of their order."""
    return ad.table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("event_id"),
        ad.pick(F.col("l_linenumber") % 4, "title", "category", "benefit_value", "url").alias("field_name"),
        F.when(F.col("l_returnflag") == "A", "").when(F.col("l_returnflag") == "N", F.col("l_shipdate").cast("string")).alias("new_value"),
        F.col("l_linestatus").alias("editor"), F.col("l_shipdate").alias("edited_at"), F.lit("fix").alias("reason"),
        F.col("l_linenumber").alias("seq"),
    )


@query("manual_edits", C + f"""SELECT event_id, field_name, old_value, new_value, editor, {TS.format('edited_at')} AS edited_at FROM (
  SELECT c.id AS event_id, e.f AS field_name, coalesce(last_value(e.v IGNORE NULLS) OVER (PARTITION BY c.id, e.f ORDER BY e.l_shipdate, e.l_linenumber, e.v NULLS FIRST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CASE e.f WHEN 'title' THEN c.title WHEN 'category' THEN c.category ELSE c.benefit_value END) AS old_value,
    e.v AS new_value, e.l_linestatus AS editor, e.l_shipdate AS edited_at
  FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'category' WHEN 2 THEN 'benefit_value' ELSE 'url' END AS f,
      CASE l_returnflag WHEN 'A' THEN '' WHEN 'N' THEN strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS v FROM lineitem) e
  JOIN campaigns c ON c.id = e.l_orderkey WHERE e.f <> 'url')
  WHERE coalesce(old_value, '') <> coalesce(new_value, '')""")
def manual_edits(spark, base):
    return hi.manual_edits(ad.campaigns(spark, base), _edit_batch(spark, base)).drop("reason", "seq")


@query("edited_events", C + """, ed AS (SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'category' ELSE 'benefit_value' END AS f,
    strftime(max(l_shipdate), '%Y-%m-%d %H:%M:%S') AS v FROM lineitem WHERE l_linenumber % 4 <> 3 AND l_returnflag = 'N' GROUP BY 1, 2)
  SELECT c.id, coalesce(t.v, title) AS title, coalesce(g.v, category) AS category, coalesce(b.v, benefit_value) AS benefit_value, benefit_amount_won
  FROM campaigns c LEFT JOIN ed t ON t.l_orderkey = c.id AND t.f = 'title' LEFT JOIN ed g ON g.l_orderkey = c.id AND g.f = 'category'
  LEFT JOIN ed b ON b.l_orderkey = c.id AND b.f = 'benefit_value'""")
def edited_events(spark, base):
    from promolens.operators.mutations import apply_updates

    events = ad.campaigns(spark, base)
    batch = _edit_batch(spark, base).where(F.coalesce(F.col("new_value"), F.lit("")) != "")
    updates = hi.edit_updates(hi.manual_edits(events, batch))
    return apply_updates(events, updates, PARAMS).select("id", "title", "category", "benefit_value", "benefit_amount_won")


LOCK = """lock_last AS (SELECT o_custkey AS event_id, o_orderstatus = 'F' AS is_locked, o_orderpriority AS locked_by, o_orderdate AS locked_at FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)"""


@query("lock_state", f"""WITH {LOCK} SELECT event_id, is_locked, CASE WHEN is_locked THEN locked_by END AS locked_by,
  CASE WHEN is_locked THEN {TS.format('locked_at')} END AS locked_at FROM lock_last""")
def lock_state(spark, base):
    return hi.lock_state(ad.locks(spark, base))


@query("applied_locks", f"""WITH {LOCK} SELECT c_custkey AS event_id, coalesce(l.is_locked, c_nationkey % 2 = 0) AS is_locked
  FROM customer LEFT JOIN lock_last l ON l.event_id = c_custkey""")
def applied_locks(spark, base):
    stored = ad.table(spark, base, "customer").select(
        F.col("c_custkey").alias("event_id"), (F.col("c_nationkey") % 2 == 0).alias("is_locked"),
        F.lit("admin").alias("locked_by"), F.lit(None).cast("timestamp_ntz").alias("locked_at"),
    )
    return hi.apply_locks(stored, ad.locks(spark, base)).select("event_id", "is_locked")


@query("toggled_locks", """SELECT o_custkey AS event_id, (c_nationkey % 2 = 0) <> (count(*) % 2 = 1) AS is_locked FROM orders JOIN customer ON c_custkey = o_custkey
  GROUP BY o_custkey, c_nationkey""")
def toggled_locks(spark, base):
    stored = ad.table(spark, base, "customer").select(
        F.col("c_custkey").alias("event_id"), (F.col("c_nationkey") % 2 == 0).alias("is_locked")
    )
    return hi.toggle_locks(stored, ad.locks(spark, base)).select("event_id", "is_locked")


def _transitions(spark, base):
    return ad.jobs(spark, base).select(
        F.col("event_id").alias("job_id"), F.col("id").alias("seq"), "status", F.col("started_at").alias("at"),
        F.col("last_error").alias("error"),
    )


@query("job_state", "WITH " + ov.JOBS + f"""SELECT event_id AS job_id, arg_max(status, id) AS status, count(*) FILTER (status = 'failed') AS retry_count,
  arg_max(last_error, id) FILTER (last_error <> '') AS last_error, {TS.format('min(started_at)')} AS started_at,
  {TS.format("max(started_at) FILTER (status IN ('success', 'failed'))")} AS finished_at FROM jobs GROUP BY event_id""")
def job_state(spark, base):
    return hi.job_state(_transitions(spark, base))


@query("retried_jobs", "WITH " + ov.JOBS + "SELECT id, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status FROM jobs")
def retried_jobs(spark, base):
    return hi.retry_failed(ad.jobs(spark, base)).select("id", "status")


@query("job_log", "WITH " + ov.JOBS + "SELECT id, job_type, status, last_error FROM jobs WHERE job_type = 'extract' AND status = 'failed' ORDER BY id DESC LIMIT 50")
def job_log(spark, base):
    return hi.job_log(ad.jobs(spark, base), job_type="extract", status="failed").select("id", "job_type", "status", "last_error")


@query("job_stats", "WITH " + ov.JOBS + "SELECT job_type, status, count(*) AS n FROM jobs GROUP BY ALL")
def job_stats(spark, base):
    return hi.job_stats(ad.jobs(spark, base))


VIEW = C + SECTIONS + "," + ov.INSIGHTS + LATEST + "," + ov.SNAPSHOTS + "," + LOCK + """,
shots AS (SELECT event_id, count(*) AS n FROM snapshots GROUP BY 1), secs AS (SELECT event_id, count(*) AS n, string_agg(section_type || ': ' || content, ' | ' ORDER BY sort_order) AS texts FROM parts GROUP BY 1),
view AS (SELECT c.*, i.benefit_level AS ins_level, i.source AS insight_source, i.k, i.event_type, CASE i.k % 3 WHEN 0 THEN '높음' WHEN 1 THEN '보통' END AS clarity, coalesce(s.texts, '') AS section_texts, coalesce(s.n, 0) AS section_count, coalesce(h.n, 0) AS snapshot_count,
  coalesce(l.is_locked, false) AS locked, i.event_id IS NOT NULL AS found FROM campaigns c LEFT JOIN latest i ON i.event_id = c.id LEFT JOIN secs s ON s.event_id = c.id
  LEFT JOIN shots h ON h.event_id = c.id LEFT JOIN lock_last l ON l.event_id = c.id)
"""


def _view(spark, base):
    return hi.intelligence(
        ad.campaigns(spark, base), ad.insights(spark, base), _sections(spark, base), ad.snapshots(spark, base),
        hi.lock_state(ad.locks(spark, base)),
    )


@query("intelligence", VIEW + """SELECT id, company, title, ins_level AS benefit_level, insight_source, section_count, snapshot_count, locked, clarity AS target_clarity,
  CASE WHEN found THEN CASE k % 2 WHEN 0 THEN 'High' ELSE 'Low' END END AS insight_threat, CASE WHEN found THEN 'e' || k END AS evidence, section_texts FROM view""")
def intelligence(spark, base):
    return _view(spark, base).select(
        "id", "company", "title", "benefit_level", "insight_source", "section_count", "snapshot_count", "locked",
        "target_clarity", "insight_threat", F.get("evidence", F.lit(0)).alias("evidence"),
        F.array_join(F.transform("sections", lambda s: F.concat(s["section_type"], F.lit(": "), s["content"])), " | ").alias("section_texts"),
    )


@query("side_by_side", VIEW + """, chosen AS (SELECT * FROM view WHERE visible ORDER BY benefit_amount_won DESC NULLS LAST, id LIMIT 4)
  SELECT id, n AS attribute_no, a AS attribute, v AS value FROM (SELECT id, unnest([
    {'n': 1::BIGINT, 'a': 'company', 'v': company}, {'n': 2, 'a': 'title', 'v': title}, {'n': 3, 'a': 'period', 'v': coalesce(nullif(period, ''), '-')},
    {'n': 4, 'a': 'benefit_value', 'v': coalesce(nullif(benefit_value, ''), '-')}, {'n': 5, 'a': 'benefit_type', 'v': coalesce(benefit_type, '-')},
    {'n': 6, 'a': 'conditions', 'v': coalesce(conditions, '-')}, {'n': 7, 'a': 'target_segment', 'v': target_segment}, {'n': 8, 'a': 'category', 'v': coalesce(category, '-')},
    {'n': 9, 'a': 'benefit_level', 'v': coalesce(ins_level, '-')}, {'n': 10, 'a': 'target_clarity', 'v': coalesce(clarity, '-')},
    {'n': 11, 'a': 'competitive_points', 'v': CASE WHEN found THEN 'k' || k ELSE '-' END}, {'n': 12, 'a': 'promo_strategies', 'v': coalesce(event_type, '-')},
    {'n': 13, 'a': 'marketing_takeaway', 'v': coalesce('takeaway ' || k, '')}], recursive := true) FROM chosen)""")
def side_by_side(spark, base):
    chosen = ad.campaigns(spark, base).where(records.visible(PARAMS)).orderBy(
        F.desc_nulls_last("benefit_amount_won"), F.asc("id")
    ).limit(4).select("id")
    return hi.side_by_side(_view(spark, base), chosen)


@query("probe_cutoff", """WITH scan AS (SELECT source, d.doc_id AS id,
    CASE WHEN l.quality IS NULL THEN 'miss' WHEN l.toxic = 1 THEN 'junk' WHEN l.quality = 0 THEN 'short' ELSE 'hit' END AS outcome,
    row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS rn FROM documents d LEFT JOIN labels l USING (doc_id)),
  based AS (SELECT *, coalesce(max(CASE WHEN outcome = 'junk' THEN rn - 1 WHEN outcome <> 'miss' THEN rn END) OVER (PARTITION BY source ORDER BY rn), 0) AS base FROM scan),
  stops AS (SELECT source, min(id) AS stop_id FROM based WHERE outcome IN ('miss', 'junk') AND rn - base >= 5 GROUP BY source)
  SELECT s.source, s.id AS probe_id, t.stop_id FROM scan s LEFT JOIN stops t USING (source) WHERE outcome = 'hit' AND (t.stop_id IS NULL OR s.id < t.stop_id)""")
def probe_cutoff(spark, base):
    probes = ad.probes(spark, base)
    stops = miss_run_cutoff(
        probes, "source", "probe_id", F.col("outcome").isin("miss", "junk"), F.col("outcome") != "miss", 5, bucket_width=64
    )
    kept = probes.where(F.col("outcome") == "hit").join(stops, "source", "left")
    return kept.where(F.col("stop_id").isNull() | (F.col("probe_id") < F.col("stop_id"))).drop("outcome")
