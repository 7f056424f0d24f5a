"""DuckDB definitions of the adapter views, for checking results.

They restate the views of ``adapters`` in SQL over the same parquet tables.
"""

from __future__ import annotations

from promolens.functions import amounts, periods


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def clean(c: str) -> str:
    return f"coalesce(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def empty_value(c: str) -> str:
    return (
        f"(coalesce({strip(c)}, '') IN ('', '정보 없음', '정보없음', '제목 없음', '상세 페이지 참조', '-', ' / ', '/')"
        f" OR coalesce(contains({c}, '정보 없음') OR contains({c}, '정보없음'), false))"
    )


def meaningful(title: str = "title", period: str = "period") -> str:
    t = f"coalesce({strip(title)}, '')"
    return (
        f"({t} NOT IN ('', '정보 없음', '정보없음', '제목 없음', '상세 페이지 참조', '-', ' / ', '/')"
        f" AND NOT starts_with({t}, '이벤트에 응모되었습니다') AND NOT starts_with({t}, '이벤트에 응모 되었습니다')"
        f" AND NOT (contains({t}, '마이홈 앱의') AND contains({t}, '자산 연결')) AND NOT {empty_value(period)})"
    )


def group(c: str, pattern: str, n: int) -> str:
    return f"regexp_extract({c}, '{pattern}', {n})"


def safe_date(c: str, pattern: str, y: int) -> str:
    """Date from three captured groups, two-digit years in this century."""
    year = f"try_cast({group(c, pattern, y)} AS INT)"
    return (
        f"try_cast(printf('%04d-%02d-%02d', CASE WHEN {year} < 100 THEN {year} + 2000 ELSE {year} END, "
        f"try_cast({group(c, pattern, y + 1)} AS INT), try_cast({group(c, pattern, y + 2)} AS INT)) AS DATE)"
    )


def period_start(c: str) -> str:
    p = periods.STORED_RANGE
    return f"CASE WHEN {safe_date(c, p, 4)} IS NOT NULL THEN {safe_date(c, p, 1)} END"


def period_end(c: str) -> str:
    p = periods.STORED_RANGE
    return f"CASE WHEN {safe_date(c, p, 1)} IS NOT NULL THEN {safe_date(c, p, 4)} END"


def amount(c: str) -> str:
    bare = f"replace(replace({c}, ',', ''), ' ', '')"
    p = amounts.STORED_AMOUNT
    unit = f"CASE {group(bare, p, 2)} WHEN '만' THEN 10000 WHEN '천' THEN 1000 ELSE 1 END"
    return f"try_cast(nullif({group(bare, p, 1)}, '') AS BIGINT) * {unit}"


def pct(c: str) -> str:
    bare = f"replace(replace({c}, ',', ''), ' ', '')"
    return f"try_cast(nullif({group(bare, amounts.STORED_PCT, 1)}, '') AS DOUBLE)"


def loose_date(c: str) -> str:
    t = f"translate(regexp_replace({c}, '\\s+', '', 'g'), './', '--')"
    return f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_cast({t} AS DATE) END"


def after_tilde(c: str = "period") -> str:
    return f"coalesce(string_split({c}, '~')[2], '')"


def lenient_active(as_of: str) -> str:
    return (
        f"CASE WHEN status = 'active' THEN true WHEN status = 'ended' THEN false WHEN {after_tilde()} = '' THEN true "
        f"ELSE coalesce({loose_date(after_tilde())} >= DATE '{as_of}', false) END"
    )


def lenient_end(start: str = "period_end") -> str:
    tail = (
        f"CASE WHEN contains(period, '~') THEN {after_tilde()} "
        f"ELSE {group('period', periods.TRAILING_DATE, 1)} END"
    )
    return f"coalesce({start}, {loose_date(tail)})"


def week(d: str) -> str:
    return f"strftime({d}, '%Y-W%W')"


def rate(n: str, d: str) -> str:
    return f"coalesce(cast(round_even(100.0 * {n} / nullif({d}, 0), 0) AS BIGINT), 0)"


CAMPAIGN_TEXTS = """
first_lines AS (
  SELECT l_orderkey, l_partkey, l_discount FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_discount) = 1
),
order_rows AS (
  SELECT o.*, c.c_mktsegment AS segment, n.n_name AS nation, r.r_name AS company, p.p_name, p.p_brand, p.p_type,
    coalesce(cast(round(l.l_discount * 100) AS INT), 0) AS disc,
    cast(o_orderdate AS DATE) AS start_date, cast(o_orderdate AS DATE) + 30 AS end_date,
    cast(floor(o_totalprice) AS BIGINT) AS won, substr(o_orderpriority, 1, 1) AS urgency
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN first_lines l ON o.o_orderkey = l.l_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
campaign_texts AS (
  SELECT o_orderkey AS id, company, p_brand AS category, p_type AS benefit_type, segment, nation,
    o_orderpriority AS priority, o_custkey AS customer_id, o_orderstatus AS order_status, start_date, end_date, won,
    CASE WHEN o_orderkey % 37 = 0 THEN '' WHEN o_orderkey % 53 = 0 THEN 'ftp://files.example.com/' || o_orderkey
      ELSE 'https://' || lower(company) || '.example.com/' ||
        CASE o_orderkey % 6 WHEN 0 THEN 'event/detail/' WHEN 1 THEN 'Event/Detail/' ELSE 'promo/' END || o_orderkey END AS url,
    CASE WHEN o_orderkey % 41 = 0 THEN '제목 없음' WHEN o_orderkey % 43 = 0 THEN '이벤트에 응모되었습니다'
      WHEN o_orderkey % 47 = 0 THEN '마이홈 앱의 자산 연결 안내'
      ELSE coalesce(p_name, 'promo') || ' ' || nation || CASE o_orderkey % 5 WHEN 0 THEN ' 할인' WHEN 1 THEN ' 무이자 할부'
        WHEN 2 THEN ' 프리미엄 여행' WHEN 3 THEN ' 자동차 정기' ELSE ' 매월 적립' END END AS title,
    CASE o_orderkey % 23 WHEN 0 THEN '정보 없음'
      WHEN 1 THEN CASE WHEN start_date >= DATE '2000-01-01' THEN strftime(start_date, '%y.%m.%d') || '~' || strftime(end_date, '%y.%m.%d')
        ELSE strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d') END
      WHEN 2 THEN strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y') || '.02.30'
      WHEN 3 THEN NULL WHEN 4 THEN strftime(start_date, '%Y-%m-%d') || ' ~ ' || strftime(end_date, '%Y-%m-%d')
      WHEN 5 THEN '~' || strftime(end_date, '%Y.%m.%d') WHEN 6 THEN strftime(start_date, '%Y.%m.%d') || '부터'
      WHEN 7 THEN ' ' ELSE strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d') END AS period,
    CASE o_orderkey % 7 WHEN 0 THEN format('{:,}', won) || '원' WHEN 1 THEN (won // 10000) || '만원'
      WHEN 2 THEN disc || '% (최대 ' || (won // 10000) || '만원)' WHEN 3 THEN disc || '% 할인'
      WHEN 4 THEN '정보 없음' WHEN 5 THEN (won // 1000) || '천원 캐시백' END AS benefit_value,
    CASE urgency WHEN '1' THEN '앱에서 응모 후 결제 시 최대 1회' WHEN '2' THEN '기존 고객 전월 실적 충족'
      WHEN '3' THEN '온라인 결제 월 한도 적용' WHEN '5' THEN ' / ' END AS conditions,
    segment || CASE o_orderstatus WHEN 'F' THEN ' 신규 고객' WHEN 'O' THEN ' VIP 회원' ELSE ' 전체' END AS target_segment,
    CASE WHEN urgency IN ('1', '2') THEN 'High' WHEN urgency = '3' THEN 'Mid' ELSE 'Low' END AS threat_level,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'ended' END AS status,
    o_orderdate + to_days(cast(o_orderkey % 7 AS INT)) AS created_at
  FROM order_rows
)
"""

CAMPAIGNS = CAMPAIGN_TEXTS + f""",
campaigns AS (
  SELECT *, title AS one_line_summary,
    CASE WHEN id % 11 <> 0 THEN concat_ws(' ', title, benefit_value, conditions, target_segment) END AS raw_text,
    id % 5 = 3 AS has_content,
    id % 6 IN (1, 2, 5) AS has_insight,
    CASE WHEN id % 6 IN (1, 2, 5) THEN CASE id % 4 WHEN 0 THEN '높음' WHEN 1 THEN '중상' WHEN 2 THEN '보통' ELSE '낮음' END END AS level,
    CASE WHEN id % 6 IN (1, 2, 5) THEN [segment, priority] ELSE [] END AS points,
    CASE WHEN id % 6 IN (1, 2, 5) THEN [nation] ELSE [] END AS strategies,
    {period_start('period')} AS period_start, {period_end('period')} AS period_end,
    {amount('benefit_value')} AS benefit_amount_won, {pct('benefit_value')} AS benefit_pct,
    {meaningful()} AS visible
  FROM campaign_texts
)
"""

SUBMISSIONS = CAMPAIGN_TEXTS + """,
submissions AS (
  SELECT id AS arrival, company, title, period, benefit_value, conditions, target_segment, order_status,
    'https://' || lower(company) || '.example.com/offer?id=' || customer_id || '&rank=' || substr(priority, 1, 1) AS url,
    concat_ws(' ', title, benefit_value, conditions) AS raw_text
  FROM campaign_texts
)
"""

INSIGHTS = """
insights AS (
  SELECT event_id AS id, (event_id - event_id % 3) * 2 AS event_id,
    CASE event_type WHEN 'view' THEN 'gemini' WHEN 'click' THEN 'hybrid' WHEN 'purchase' THEN 'rule'
      WHEN 'signup' THEN 'rule' ELSE 'legacy' END AS source,
    CASE k % 4 WHEN 0 THEN '높음' WHEN 1 THEN '중상' WHEN 2 THEN '보통' ELSE '낮음' END AS benefit_level,
    value AS benefit_score, event_type, k, ts AS generated_at,
    CASE k % 10 WHEN 4 THEN ['신규유치', ''] WHEN 5 THEN ['리텐션', '객단가증대'] WHEN 6 THEN ['디지털전환']
      WHEN 7 THEN ['제휴확장', '브랜드강화', '신규유치'] WHEN 8 THEN ['리텐션'] WHEN 9 THEN ['브랜드강화', '디지털전환']
      ELSE [] END AS objective_tags,
    CASE k % 4 WHEN 0 THEN ['VIP'] WHEN 1 THEN ['신규', '기존'] WHEN 2 THEN ['전연령'] ELSE [] END AS target_tags
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)
"""

JOBS = """
jobs AS (
  SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'ingest'
      WHEN event_type IN ('purchase', 'signup') THEN 'extract' ELSE 'insight' END AS job_type,
    user_id AS event_id,
    CASE WHEN value < 20 THEN 'success' WHEN value < 60 THEN 'failed' WHEN value < 120 THEN 'running' ELSE 'pending' END AS status,
    CASE WHEN value >= 20 AND value < 60 THEN 'error ' || json_extract_string(props, '$.k') END AS last_error,
    ts AS started_at
  FROM events
)
"""

SNAPSHOTS = """
snapshots AS (
  SELECT conv_id AS event_id, text AS raw_text, turn * 10 AS extraction_latency_ms,
    TIMESTAMP '2024-01-01' + to_seconds(conv_id * 86400 + turn * 60) AS captured_at, turn
  FROM conversations
)
"""

EDITS = """
edits AS (
  SELECT c.conv_id AS event_id,
    CASE c.turn % 7 WHEN 0 THEN 'title' WHEN 1 THEN 'period' WHEN 2 THEN 'benefit_value' WHEN 3 THEN 'benefit_type'
      WHEN 4 THEN 'conditions' WHEN 5 THEN 'target_segment' ELSE 'category' END AS field_name,
    p.text AS old_value, c.text AS new_value, c.role AS editor,
    TIMESTAMP '2024-01-01' + to_seconds(c.conv_id * 86400 + c.turn * 60) AS edited_at, c.turn
  FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
)
"""


def first_rule(c: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN {any_of(c, words)} THEN '{label}'" for label, words in rules)
    return f"CASE {cases} ELSE '{default}' END"


def labels(*rules: tuple[str, str]) -> str:
    """List of the labels whose conditions hold, in order."""
    items = ", ".join(f"CASE WHEN {cond} THEN '{label}' END" for cond, label in rules)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def canonical_period(c: str) -> str:
    """List-page period; inputs here have four-digit years on both sides or no match."""
    p = periods.LIST_RANGE
    part = lambda n: f"try_cast({group(c, p, n)} AS INT)"
    year = lambda n: f"CASE WHEN {part(n)} < 100 THEN {part(n)} + 2000 ELSE {part(n)} END"
    return (
        f"CASE WHEN regexp_matches({c}, '{p}') THEN printf('%04d.%02d.%02d~%04d.%02d.%02d', {year(1)}, {part(2)}, {part(3)}, "
        f"CASE WHEN {year(4)} < 1000 THEN {year(1)} ELSE {year(4)} END, {part(5)}, {part(6)}) ELSE {clean(c)} END"
    )


def unescape(c: str) -> str:
    from promolens.functions.markup import ENTITIES

    for entity, char in ENTITIES:
        c = f"replace({c}, '{entity.replace(chr(39), chr(39) * 2)}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


def inline_text(c: str, joiner: str = "") -> str:
    return f"trim(regexp_replace({unescape(f'''regexp_replace({c}, '(?s)<[^>]*>', '{joiner}', 'g')''')}, '\\s+', ' ', 'g'))"


def drop_elements(c: str, tags) -> str:
    c = f"regexp_replace({c}, '(?s)<!--.*?-->', '', 'g')"
    for tag in tags:
        c = f"regexp_replace({c}, '(?is)<{tag}\\b[^>]*>.*?</{tag}>', '', 'g')"
    return c


def text_blocks(c: str) -> str:
    from promolens.functions.markup import BLOCK_EDGE

    pieces = f"regexp_split_to_array({c}, '{BLOCK_EDGE}')"
    return f"list_filter(list_transform({pieces}, lambda x: {inline_text('x')}), lambda x: x <> '')"


PROMO_PAGES = """
promo_pages AS (
  SELECT page_id, url, d, replace(html, '<article>', '<article><p class="period">' || CASE page_id % 4
      WHEN 0 THEN '이벤트 기간 2026.02.' || d || '(월) ~ 2026.03.' || d WHEN 1 THEN '진행기간 26.02.' || d || ' ~ 03.' || d
      WHEN 2 THEN '2026년 2월 ' || d || '일 ~ 2026년 3월 ' || d || '일' ELSE '기간 별도 안내' END ||
    '</p><p>대상카드 제휴 고객 캐시백 1' || d || ',000원 혜택</p><ul class="eventList"><li><a href="javascript:goDetail(''' || page_id ||
    ''', ''A'')"><strong class="tit">오퍼 ' || page_id || ' 할인 혜택</strong><span>2026.1.' || d || ' ~ 2026.2.' || d ||
    '</span></a></li><li><a href="/evt/view.do?id=' || page_id || '&amp;utm_source=list">이벤트</a>추가 이벤트 ' || page_id ||
    ' 안내 · 2026.03.' || d || ' ~ 2026.04.' || d || '</li><li><a href="#" onclick="openEvent(''' || page_id ||
    ''')">더보기 이벤트</a></li></ul><div class=''event-detail wide''><div><span>전월 실적 1' || d || '만원 이상 결제 &#49888;용카드 회원</span>' ||
    '<div id="gnb"><span>메뉴 혜택 모음</span></div></div><table><tr><th>구분</th><td><ul><li>즉시할인 혜택 ' || d ||
    '%</li></ul></td></tr></table><img alt=''행사 그림 ' || page_id || ''' src="/i.png"></div>') AS html
  FROM (SELECT *, lpad((page_id % 28 + 1)::VARCHAR, 2, '0') AS d FROM pages)
)
"""

RESPONSES = """
responses AS (
  SELECT event_id AS id, event_type, k, CASE k % 5 WHEN 0 THEN '높음' WHEN 1 THEN '중상' WHEN 2 THEN '보통' WHEN 3 THEN '낮음' ELSE '' END AS level,
    CASE k % 3 WHEN 0 THEN 'High' WHEN 1 THEN 'Mid' ELSE 'Low' END AS threat, event_id % 6 <= 3 AS ok
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)
"""
