"""Registered queries: competitive analytics over the campaign view."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from promolens.operators import analytics as an
from promolens.plans import adapters as ad
from promolens.plans import oracle_views as ov
from promolens.plans.flat import flat
from promolens.plans.settings import AS_OF, COMPANIES, FOCAL, PARAMS, PREFERRED, TREND_SINCE, TREND_UNTIL
from promolens.vocabulary import (
    COMMON_PHRASES, DIMENSION_METRICS, HIGH_VALUE_WORDS, RECURRING_HINT_WORDS, RECURRING_WORDS,
    REPEAT_HINT_WORDS, REPEAT_WORDS,
)

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
CI = "WITH " + ov.CAMPAIGNS + "," + ov.INSIGHTS
DAY = f"DATE '{AS_OF}'"
ACT = ov.lenient_active(str(AS_OF))
END = ov.lenient_end()

OVERVIEW_CTE = f""",
counts AS (
  SELECT company, count(*) AS collected_count, count(*) FILTER (visible) AS visible_count,
    count(*) FILTER (visible AND period_end >= {DAY}) AS active_count,
    count(*) FILTER (visible AND period_end < {DAY}) AS ended_count,
    count(*) FILTER (has_content) AS extracted_count, count(*) FILTER (has_insight) AS insight_count,
    count(*) FILTER (level = '높음') AS level_1, count(*) FILTER (level = '중상') AS level_2,
    count(*) FILTER (level = '보통') AS level_3, count(*) FILTER (level = '낮음') AS level_4,
    sum(CASE level WHEN '높음' THEN 4.0::DOUBLE WHEN '중상' THEN 3.0 WHEN '보통' THEN 2.0 WHEN '낮음' THEN 1.0 END) AS score
  FROM campaigns GROUP BY company
),
tops AS (
  SELECT company, kind, string_agg(v, ' | ' ORDER BY rk) AS vals FROM (
    SELECT *, row_number() OVER (PARTITION BY company, kind ORDER BY n DESC, fid, fpos, v) AS rk FROM (
      SELECT company, kind, v, count(*) AS n, min(id) AS fid, arg_min(pos, id) AS fpos FROM (
        SELECT company, id, 'point' AS kind, unnest(points) AS v, generate_subscripts(points, 1) AS pos FROM campaigns
        UNION ALL
        SELECT company, id, 'strategy', unnest(strategies), generate_subscripts(strategies, 1) FROM campaigns)
      GROUP BY company, kind, v)) WHERE rk <= 3 GROUP BY company, kind
),
overview AS (
  SELECT c.* EXCLUDE (score), {ov.rate('extracted_count', 'collected_count')} AS extraction_rate,
    {ov.rate('insight_count', 'collected_count')} AS insight_rate,
    coalesce(round_even(score / nullif(level_1 + level_2 + level_3 + level_4, 0), 2), 0.0)::DOUBLE AS avg_benefit_score,
    coalesce(p.vals, '') AS top_competitive_points, coalesce(s.vals, '') AS top_promo_strategies
  FROM counts c LEFT JOIN tops p ON p.company = c.company AND p.kind = 'point'
  LEFT JOIN tops s ON s.company = c.company AND s.kind = 'strategy'
)
"""


def _overview(spark, base):
    return an.company_overview(ad.campaigns(spark, base), PARAMS)


@query("company_overview", C + OVERVIEW_CTE + "SELECT * FROM overview ORDER BY collected_count DESC, company")
def company_overview(spark, base):
    return _overview(spark, base).orderBy(*an.overview_order())


TOTAL_SQL = ", ".join(f"coalesce(sum({c}_count), 0)::BIGINT AS {c}_total" for c in an.COUNTS)


@query("overview_totals", C + OVERVIEW_CTE + f"""SELECT *,
  {ov.rate('extracted_total', 'collected_total')} AS extraction_rate,
  {ov.rate('insight_total', 'collected_total')} AS insight_rate FROM (SELECT {TOTAL_SQL} FROM overview)""")
def overview_totals(spark, base):
    return an.overview_totals(_overview(spark, base))


@query("statistics", C + """
SELECT kind, key, n, last_updated FROM (
  SELECT 'company' AS kind, company AS key, count(*) AS n, NULL::VARCHAR AS last_updated FROM campaigns WHERE visible GROUP BY company
  UNION ALL SELECT 'category', category, count(*), NULL FROM campaigns WHERE visible AND category <> '' GROUP BY category
  UNION ALL SELECT 'threat', t.v, count(c.id), NULL FROM (VALUES ('High'), ('Mid'), ('Low')) t(v)
    LEFT JOIN campaigns c ON c.visible AND c.threat_level = t.v GROUP BY t.v
  UNION ALL SELECT 'total', '', count(*), strftime(max(created_at), '%Y-%m-%d %H:%M:%S') FROM campaigns WHERE visible)""")
def statistics(spark, base):
    return an.statistics(ad.campaigns(spark, base), PARAMS)


@query("header_kpis", C + f""", flagged AS (SELECT *, {ACT} AS act FROM campaigns)
SELECT count(*) FILTER (visible) AS total, count(*) FILTER (visible AND act) AS active,
  count(*) FILTER (visible AND NOT act) AS ended, count(*) FILTER (visible AND id % 6 IN (1, 2, 4, 5)) AS insights,
  {ov.rate('count(*) FILTER (has_content)', 'count(*)')} AS extraction_rate, count(DISTINCT company) AS companies
FROM flagged""")
def header_kpis(spark, base):
    return an.header_kpis(ad.campaigns(spark, base), PARAMS)


@query("weekly_trend", C + f"""
SELECT week, count(*) FILTER (kind = 's') AS started, count(*) FILTER (kind = 'e') AS ended FROM (
  SELECT 's' AS kind, {ov.week('period_start')} AS week FROM campaigns
    WHERE period_start BETWEEN DATE '{TREND_SINCE}' AND DATE '{TREND_UNTIL}'
  UNION ALL SELECT 'e', {ov.week('period_end')} FROM campaigns
    WHERE period_start IS NOT NULL AND period_end BETWEEN DATE '{TREND_SINCE}' AND DATE '{TREND_UNTIL}')
GROUP BY week ORDER BY week""")
def weekly_trend(spark, base):
    return an.weekly_trend(ad.campaigns(spark, base), TREND_SINCE, TREND_UNTIL).orderBy("week")


def _tag_sql(tags: str, name: str, where: str = "") -> str:
    return CI + f"""SELECT company, {name}, count(*) AS n FROM (
      SELECT c.company, unnest(i.{tags}) AS {name} FROM insights i JOIN campaigns c ON c.id = i.event_id)
      {where} GROUP BY company, {name}"""


@query("strategy_map", _tag_sql("objective_tags", "tag"))
def strategy_map(spark, base):
    return an.strategy_map(ad.insights(spark, base), ad.campaigns(spark, base))


def _matrix(axis):
    def run(spark, base):
        return an.compare_matrix(ad.campaigns(spark, base), ad.insights(spark, base), axis, PARAMS)

    return run


for _axis in ("category", "benefit_type"):
    query(f"compare_matrix_{_axis}", C + f"""SELECT company, {_axis} AS value, count(*) AS n FROM campaigns
      WHERE visible AND {_axis} <> '' GROUP BY company, {_axis}""")(_matrix(_axis))
query("compare_matrix_target", _tag_sql("target_tags", "value", "WHERE value <> ''"))(_matrix("target"))
query("compare_matrix_strategy", _tag_sql("objective_tags", "value", "WHERE value <> ''"))(_matrix("strategy"))

TAGS = ["객단가증대", "디지털전환", "리텐션", "브랜드강화", "신규유치", "제휴확장"]


@query("strategy_map_wide", CI + "SELECT company, " + ", ".join(
    f"count(*) FILTER (tag = '{t}') AS \"{t}\"" for t in TAGS) + """ FROM (
    SELECT c.company, unnest(i.objective_tags) AS tag FROM insights i JOIN campaigns c ON c.id = i.event_id) GROUP BY company""")
def strategy_map_wide(spark, base):
    cells = an.strategy_map(ad.insights(spark, base), ad.campaigns(spark, base))
    return an.widen(cells, "company", "tag", TAGS)


@query("latest_strategy_map", CI + """, latest AS (
  SELECT * FROM insights QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY
    CASE source WHEN 'gemini' THEN 0 WHEN 'hybrid' THEN 1 WHEN 'rule' THEN 2 ELSE 3 END, generated_at DESC, id DESC) = 1)
SELECT company, tag, count(*) AS n FROM (
  SELECT c.company, unnest(i.objective_tags) AS tag FROM latest i JOIN campaigns c ON c.id = i.event_id) GROUP BY company, tag""")
def latest_strategy_map(spark, base):
    from promolens.operators.history import latest_insight

    return an.strategy_map(latest_insight(ad.insights(spark, base)), ad.campaigns(spark, base))


@query("matrix_heat", C + """SELECT company, value, n, CASE WHEN n = 0 THEN 0 WHEN n <= 2 THEN 1 WHEN n <= 5 THEN 2 ELSE 3 END::BIGINT AS heat
  FROM (SELECT company, category AS value, count(*) AS n FROM campaigns WHERE visible AND category <> '' GROUP BY 1, 2)""")
def matrix_heat(spark, base):
    return an.with_heat(_matrix("category")(spark, base))


@query("matrix_columns", C + """SELECT DISTINCT category AS value FROM campaigns WHERE visible AND category <> ''""")
def matrix_columns(spark, base):
    return _matrix("category")(spark, base).select("value").distinct().orderBy("value")


@query("benefit_benchmark", C + """SELECT company, count(*) AS count,
  coalesce(round_even(sum(nullif(benefit_amount_won, 0))::DOUBLE / count(nullif(benefit_amount_won, 0)), 0)::BIGINT, 0) AS avg_amount,
  coalesce(max(nullif(benefit_amount_won, 0)), 0) AS max_amount,
  coalesce(round_even(avg(nullif(benefit_pct, 0)), 1), 0.0)::DOUBLE AS avg_pct, coalesce(max(nullif(benefit_pct, 0)), 0.0)::DOUBLE AS max_pct
  FROM campaigns WHERE benefit_amount_won IS NOT NULL GROUP BY company""")
def benefit_benchmark(spark, base):
    return an.benefit_benchmark(ad.campaigns(spark, base))


@query("benefit_benchmark_items", C + """SELECT company, id, title, category, benefit_amount_won, benefit_pct, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company ORDER BY id) AS rank FROM campaigns WHERE benefit_amount_won IS NOT NULL)
  WHERE rank <= 20""")
def benefit_benchmark_items(spark, base):
    return an.benchmark_items(ad.campaigns(spark, base), PARAMS)


GAP_CTE = f""",
active AS (SELECT * FROM campaigns WHERE visible AND period_end >= {DAY}),
gap AS (
  SELECT category, count(*) FILTER (company <> '{FOCAL}') AS competitor_count FROM active
  WHERE category <> '' GROUP BY category HAVING count(*) FILTER (company = '{FOCAL}') = 0
)
"""


@query("category_gap", C + GAP_CTE + "SELECT category, competitor_count FROM gap ORDER BY competitor_count DESC, category")
def category_gap(spark, base):
    return an.category_gap(ad.campaigns(spark, base), PARAMS).orderBy(*an.gap_order())


@query("category_gap_rivals", C + GAP_CTE + """SELECT * FROM (
  SELECT category, row_number() OVER (PARTITION BY category ORDER BY id) AS rank, id, company, title, benefit_value, period
  FROM active JOIN gap USING (category)) WHERE rank <= 10""")
def category_gap_rivals(spark, base):
    return an.gap_rivals(ad.campaigns(spark, base), PARAMS)


@query("category_gap_totals", C + GAP_CTE + f"""SELECT count(*) AS total_active,
  count(*) FILTER (company = '{FOCAL}') AS focal_active FROM active""")
def category_gap_totals(spark, base):
    return an.gap_totals(ad.campaigns(spark, base), PARAMS)


GRID_CTE = f""",
grid AS (SELECT w AS week_no, {DAY} - cast((7 - w) * 7 AS INT) AS ref_date FROM range(8) t(w)),
running AS (SELECT g.week_no, g.ref_date, c.company, c.category FROM grid g JOIN campaigns c
  ON c.visible AND g.ref_date BETWEEN c.period_start AND c.period_end),
week_gaps AS (SELECT week_no, category FROM running WHERE category <> ''
  GROUP BY week_no, category HAVING count(*) FILTER (company = '{FOCAL}') = 0)
"""


@query("weekly_active", C + GRID_CTE + f"""SELECT {ov.week('ref_date')} AS week, strftime(ref_date, '%Y-%m-%d') AS ref_date,
  company, count(*) AS n FROM running GROUP BY ALL""")
def weekly_active(spark, base):
    return an.weekly_active(ad.campaigns(spark, base), PARAMS)


TREND_TAIL = f""", trend AS (SELECT g.week_no::BIGINT AS week_no, strftime(g.ref_date, '%Y-%m-%d') AS ref_date, {ov.week('g.ref_date')} AS week,
  (SELECT count(*) FROM week_gaps a WHERE a.week_no = g.week_no) AS gap_count,
  (SELECT count(*) FROM week_gaps a WHERE a.week_no = g.week_no AND NOT EXISTS (
     SELECT 1 FROM week_gaps b WHERE b.category = a.category AND b.week_no = a.week_no - 1)) AS new_gap_count,
  (SELECT count(*) FROM week_gaps a WHERE a.week_no = g.week_no - 1 AND NOT EXISTS (
     SELECT 1 FROM week_gaps b WHERE b.category = a.category AND b.week_no = a.week_no + 1)) AS resolved_gap_count
  FROM grid g)
"""


@query("gap_trend", C + GRID_CTE + TREND_TAIL + """SELECT *, coalesce(gap_count - lag(gap_count) OVER (ORDER BY week_no), 0) AS gap_delta
  FROM trend ORDER BY week_no""")
def gap_trend(spark, base):
    return an.gap_trend(ad.campaigns(spark, base), PARAMS).orderBy("week_no")


@query("gap_trend_current", C + GRID_CTE + "SELECT category FROM week_gaps WHERE week_no = 7 ORDER BY category")
def gap_trend_current(spark, base):
    return an.current_gaps(ad.campaigns(spark, base), PARAMS).orderBy("category")


@query("lenient_gap_list", C + f"""SELECT category || ' ' || benefit_type AS category,
  count(*) FILTER (NOT contains(nation, 'TION_7')) AS competitor_count
  FROM campaigns WHERE visible AND {ACT} AND category <> '' GROUP BY ALL
  HAVING count(*) FILTER (contains(nation, 'TION_7')) = 0 AND count(*) > 0""")
def lenient_gap_list(spark, base):
    loose = replace(PARAMS, focal="TION_7", focal_match="contains")
    finer = ad.campaigns(spark, base).withColumns(
        {"company": F.col("nation"), "category": F.concat("category", F.lit(" "), "benefit_type")}
    )
    return an.lenient_gaps(finer, loose)


PROFILE_CTE = f""",
shown AS (
  SELECT *, concat_ws(' ', title, coalesce(category, ''), coalesce(benefit_value, ''), coalesce(conditions, ''), target_segment, one_line_summary,
      coalesce(raw_text, '')) AS blob,
    CASE WHEN period_start IS NULL OR period_end IS NULL THEN 0 ELSE greatest(period_end - period_start + 1, 0) END AS days
  FROM campaigns WHERE visible
),
profile AS (
  SELECT company, count(*) AS events, count(*) FILTER (lower(threat_level) = 'high') AS high_threat_count,
    count(*) FILTER (status = 'active') AS status_active, count(*) FILTER (status = 'ended') AS status_ended,
    count(*) FILTER (status IS NULL) AS status_unknown,
    coalesce(round_even(sum(nullif(benefit_amount_won, 0))::DOUBLE / count(nullif(benefit_amount_won, 0)), 0)::BIGINT, 0) AS avg_benefit_amount_won,
    coalesce(round_even(avg(nullif(benefit_pct, 0)), 1), 0.0)::DOUBLE AS avg_benefit_pct,
    count(*) FILTER ({ov.any_of('blob', HIGH_VALUE_WORDS)}) AS high_value_hits,
    count(*) FILTER ({ov.any_of('blob', RECURRING_WORDS)}) AS recurring_hits,
    count(*) FILTER ({ov.any_of('blob', REPEAT_WORDS)}) AS repeat_hits, count(*) FILTER (days >= 60) AS long_period_hits
  FROM shown GROUP BY company
),
cats AS (SELECT company, category, count(*) AS n, min(id) AS fid FROM shown WHERE category <> '' GROUP BY 1, 2),
mix AS (
  SELECT company, count(*) AS categories, sum(n * ln(n)) AS nlogn, sum(n) AS nn,
    list(category ORDER BY n DESC, fid)[1:3] AS cat_list FROM cats GROUP BY company
),
snap AS (
  SELECT o.*, p.* EXCLUDE (company), coalesce(m.categories, 0) AS categories, m.nlogn, m.nn, coalesce(m.cat_list, []) AS cat_list
  FROM overview o LEFT JOIN profile p USING (company) LEFT JOIN mix m USING (company)
)
"""
SNAP = C + OVERVIEW_CTE + PROFILE_CTE
SNAP_COLUMNS = (
    "company, collected_count, visible_count, active_count, ended_count, extraction_rate, insight_rate, avg_benefit_score, "
    "top_competitive_points, top_promo_strategies, high_threat_count, status_active, status_ended, status_unknown, "
    "avg_benefit_amount_won, avg_benefit_pct"
)


def _snapshot(spark, base):
    events = ad.campaigns(spark, base)
    return an.company_snapshot(events, PARAMS)


@query("company_snapshot", SNAP + f"SELECT {SNAP_COLUMNS}, array_to_string(cat_list, ' | ') AS top_categories FROM snap")
def company_snapshot(spark, base):
    return _snapshot(spark, base).select(*SNAP_COLUMNS.split(", "), "top_categories")


@query("status_counts", C + "SELECT company, coalesce(nullif(status, ''), 'unknown') AS status, count(*) AS n FROM campaigns WHERE visible GROUP BY ALL")
def status_counts(spark, base):
    return an.status_counts(ad.campaigns(spark, base), PARAMS)


@query("recent_events", C + """SELECT company, id, title, category, benefit_value, period, status, threat_level,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, rank FROM (SELECT *, row_number() OVER (
    PARTITION BY company ORDER BY created_at DESC NULLS LAST, id) AS rank FROM campaigns WHERE visible) WHERE rank <= 5""")
def recent_events(spark, base):
    return an.recent_events(ad.campaigns(spark, base), PARAMS)


FIRST_TWO = "array_to_string(string_split({0}, ' | ')[1:2], ', ')"


@query("company_briefing", SNAP + f"""SELECT company,
  company || '은 현재 ' || active_count || '건의 이벤트를 진행 중이며, ' || ct || ' 카테고리에 집중하고 있습니다. 주요 전략은 ' || st || ' 중심입니다.' AS overview,
  st AS key_strategy, array_to_string(cat_list, ' | ') AS strongest_categories,
  coalesce(nullif(concat_ws(' / ', CASE WHEN avg_benefit_amount_won <> 0 THEN '평균 ' || format('{{:,}}', avg_benefit_amount_won) || '원' END,
    CASE WHEN avg_benefit_pct <> 0 THEN '평균 ' || printf('%.1f', avg_benefit_pct) || '%' END), '') || ' 수준', '혜택 데이터 부족') AS avg_benefit_assessment,
  '전반적 고객층 대상' AS target_focus,
  coalesce(nullif({FIRST_TWO.format('top_competitive_points')}, ''), ct || ' 영역에서 경쟁 심화') AS rival_threat,
  ct || ' 카테고리에서 차별화된 혜택 구조 설계가 필요합니다.' AS recommended_counter
FROM (SELECT *, coalesce(nullif(array_to_string(cat_list[1:2], ', '), ''), '다양한 카테고리') AS ct,
  coalesce(nullif({FIRST_TWO.format('top_promo_strategies')}, ''), '일반 프로모션') AS st FROM snap)""")
def company_briefing(spark, base):
    return an.company_briefing(_snapshot(spark, base))


SCORES = f""", words AS (SELECT *, concat_ws(' ', array_to_string(cat_list, ' '), replace(top_competitive_points, ' | ', ' '),
    replace(top_promo_strategies, ' | ', ' ')) AS w FROM snap),
scores AS (SELECT company,
  least(100.0, high_value_hits / events * 65 + least(22.0, avg_benefit_amount_won / 18000.0) + least(13.0, avg_benefit_pct * 0.9)
    + least(8.0, avg_benefit_score * 2.0))::DOUBLE AS high_value_score,
  least(100.0, recurring_hits / events * 80 + long_period_hits / events * 20
    + CASE WHEN {ov.any_of('w', RECURRING_HINT_WORDS)} THEN 18 ELSE 0 END)::DOUBLE AS recurring_score,
  least(100.0, categories * 10 + CASE WHEN categories > 1 THEN -(nlogn - nn * ln(events)) / events / ln(categories) ELSE 0 END * 45
    + least(15.0, events * 0.8))::DOUBLE AS diversity_score,
  least(100.0, repeat_hits / events * 70 + long_period_hits / events * 30
    + CASE WHEN {ov.any_of('w', REPEAT_HINT_WORDS)} THEN 15 ELSE 0 END
    + least(10.0, active_count / nullif(visible_count, 0) * 12.0))::DOUBLE AS repeatability_score FROM words)
"""
LEVEL_SQL = ("CASE WHEN {0} >= 85 THEN '매우 높음' WHEN {0} >= 65 THEN '높음' WHEN {0} >= 45 THEN '중간' "
             "WHEN {0} >= 25 THEN '낮음' ELSE '매우 낮음' END")


@query("dimension_scores", SNAP + SCORES + "SELECT company, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in an.SCORE_COLUMNS) + " FROM scores")
def dimension_scores(spark, base):
    scores = an.dimension_scores(_snapshot(spark, base))
    return scores.select("company", *[F.round(c, 6).alias(c) for c in an.SCORE_COLUMNS])


LEVELS_SQL = " UNION ALL ".join(
    f"SELECT company, {i + 1}::BIGINT AS metric_no, '{m}' AS metric, {LEVEL_SQL.format(c)} AS level FROM scores"
    for i, (m, c) in enumerate(zip(DIMENSION_METRICS, an.SCORE_COLUMNS))
)


@query("dimension_levels", SNAP + SCORES + LEVELS_SQL)
def dimension_levels(spark, base):
    return an.dimension_levels(an.dimension_scores(_snapshot(spark, base)))


@query("comparison_table", SNAP + SCORES + f", levels AS ({LEVELS_SQL}) SELECT metric_no, metric, " + ", ".join(
    f"coalesce(max(level) FILTER (company = '{c}'), '중간') AS \"{c}\"" for c in COMPANIES) + " FROM levels GROUP BY 1, 2 ORDER BY 1")
def comparison_table(spark, base):
    levels = an.dimension_levels(an.dimension_scores(_snapshot(spark, base)))
    return an.comparison_table(levels, COMPANIES).orderBy("metric_no")


CORPUS_CTE = """, picked AS (SELECT company, raw_text AS t, row_number() OVER (
    PARTITION BY company ORDER BY created_at DESC NULLS LAST, id) AS rk FROM campaigns WHERE visible AND length(raw_text) > 30),
corpus AS (SELECT company, string_agg(t, chr(10) ORDER BY rk) AS corpus FROM picked WHERE rk <= 20 GROUP BY company)
"""


@query("company_corpus", C + CORPUS_CTE + "SELECT * FROM corpus")
def company_corpus(spark, base):
    return an.company_corpus(ad.campaigns(spark, base), PARAMS)


@query("phrase_presence", C + CORPUS_CTE + " UNION ALL ".join(
    f"SELECT {i + 1}::BIGINT AS phrase_no, '{p}' AS phrase WHERE EXISTS (SELECT 1 FROM picked WHERE contains(t, '{p}'))"
    for i, p in enumerate(COMMON_PHRASES)))
def phrase_presence(spark, base):
    return an.phrase_presence(an.corpus_texts(ad.campaigns(spark, base), PARAMS))


LISTED_CTE = f""", listed AS (SELECT *, {ACT} AS act, company = '{FOCAL}' AS focal, {END} AS end_day FROM campaigns WHERE visible),
rivals AS (SELECT * FROM listed WHERE act AND NOT focal)
"""


@query("marketing_board", C + LISTED_CTE + f"""SELECT count(*) AS active_rivals,
  count(*) FILTER (end_day - {DAY} BETWEEN 0 AND 14) AS ending_soon, count(*) FILTER (NOT has_insight) AS pending,
  count(*) FILTER (created_at >= {DAY} - 7) AS new_rivals FROM rivals""")
def marketing_board(spark, base):
    return an.marketing_board(ad.campaigns(spark, base), PARAMS)


@query("top_rival_benefits", C + LISTED_CTE + """SELECT id, company, title, coalesce(benefit_amount_won, 0) AS amount,
  coalesce(benefit_pct, 0.0)::DOUBLE AS pct, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM rivals
  ORDER BY amount DESC, pct DESC, rivals.created_at DESC NULLS LAST, id LIMIT 6""")
def top_rival_benefits(spark, base):
    return an.top_rival_benefits(ad.campaigns(spark, base), PARAMS)


@query("pending_by_company", C + LISTED_CTE + """SELECT company, count(*) AS n FROM rivals WHERE NOT has_insight
  GROUP BY company ORDER BY n DESC, company LIMIT 3""")
def pending_by_company(spark, base):
    return an.pending_by_company(ad.campaigns(spark, base), PARAMS)


@query("urgent_rivals", C + LISTED_CTE + f"""SELECT id, company, title,
  CASE level WHEN '높음' THEN 4.0 WHEN '중상' THEN 3.0 WHEN '보통' THEN 2.0 WHEN '낮음' THEN 1.0 ELSE 0.0 END::DOUBLE AS score
  FROM rivals WHERE created_at >= {DAY} - 7 ORDER BY score DESC, id LIMIT 5""")
def urgent_rivals(spark, base):
    return an.urgent_rivals(ad.campaigns(spark, base), PARAMS)


@query("rival_feed", C + LISTED_CTE + """SELECT id, company, title, act AS active, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM listed WHERE NOT focal ORDER BY act DESC, listed.created_at DESC NULLS LAST, id LIMIT 5""")
def rival_feed(spark, base):
    return an.rival_feed(ad.campaigns(spark, base), PARAMS)


RISK_CTE = LISTED_CTE + """, cells AS (SELECT category, company, count(*) AS n FROM listed WHERE act AND category <> '' GROUP BY 1, 2),
risk AS (SELECT category, sum(n)::BIGINT AS total, count(*) AS companies, count(*) >= 2 AND sum(n) >= 3 AS hot,
  count(*) = 1 AND sum(n) >= 2 AS exclusive, CASE WHEN count(*) = 1 THEN min(company) END AS owner FROM cells GROUP BY category)
"""


@query("risk_cells", C + RISK_CTE + "SELECT * FROM cells")
def risk_cells(spark, base):
    return an.risk_cells(ad.campaigns(spark, base), PARAMS)


@query("risk_map", C + RISK_CTE + "SELECT * FROM risk")
def risk_map(spark, base):
    return an.risk_categories(an.risk_cells(ad.campaigns(spark, base), PARAMS))


@query("risk_lists", C + RISK_CTE + """SELECT list, rank, category, total, companies FROM (
  SELECT *, row_number() OVER (PARTITION BY list ORDER BY total DESC, category) AS rank FROM (
    SELECT 'hot' AS list, 5 AS cap, * FROM risk WHERE hot UNION ALL SELECT 'exclusive', 4, * FROM risk WHERE exclusive
    UNION ALL SELECT 'table', 12, * FROM risk)) WHERE rank <= cap""")
def risk_lists(spark, base):
    return an.risk_lists(an.risk_categories(an.risk_cells(ad.campaigns(spark, base), PARAMS)))


WEEK_CTE = f""", marks AS (
  SELECT id, company, title, 'new' AS kind FROM campaigns WHERE visible AND cast(created_at AS DATE) BETWEEN DATE '2001-07-16' AND DATE '2001-07-22'
  UNION ALL SELECT id, company, title, 'ending' FROM campaigns WHERE visible
    AND {ov.loose_date(ov.after_tilde())} BETWEEN DATE '2001-07-16' AND DATE '2001-07-22')
"""


@query("weekly_changes", C + WEEK_CTE + "SELECT kind, company, count(*) AS n FROM marks GROUP BY kind, company")
def weekly_changes(spark, base):
    return an.weekly_changes(ad.campaigns(spark, base), PARAMS)


@query("weekly_change_items", C + WEEK_CTE + """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, company ORDER BY id) AS rank FROM marks) WHERE rank <= 3""")
def weekly_change_items(spark, base):
    return an.weekly_change_items(ad.campaigns(spark, base), PARAMS)


@query("company_order", C + """SELECT company, n FROM (SELECT company, count(*) AS n FROM campaigns GROUP BY company)""")
def company_order(spark, base):
    return an.company_order(ad.campaigns(spark, base).groupBy("company").agg(F.count("*").alias("n")), PREFERRED)
