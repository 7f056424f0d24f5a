"""Registered queries: sources, normalisation, ingest and mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from promolens.functions import amounts, periods, records, text, urls
from promolens.operators import filters as fl
from promolens.operators import ingest as ing
from promolens.operators import mutations as mu
from promolens.plans import adapters as ad
from promolens.plans import oracle_views as ov
from promolens.plans import page_views as pv
from promolens.plans.flat import flat
from promolens.plans.settings import AS_OF, PARAMS
from promolens.sources import captures, feeds, pages
from promolens.vocabulary import (
    CATEGORY_DEFAULT, CATEGORY_RULES, LEGACY_CATEGORY_DEFAULT, LEGACY_CATEGORY_RULES, LEGACY_THREAT_RULES,
    THREAT_DEFAULT, THREAT_RULES,
)

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
V = PARAMS.vocab
DAY = f"DATE '{AS_OF}'"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, base: flat(fn(spark, base))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


T = "WITH " + ov.CAMPAIGN_TEXTS
C = "WITH " + ov.CAMPAIGNS
S = "WITH " + ov.SUBMISSIONS
RECORD = ["url", "company", "title", "period", "category", "threat_level", "raw_text"]


def _built(inner: str, order_cols: str = "id") -> str:
    """Category and threat of staged rows with clean url, title, period and raw_text."""
    return f"""SELECT {order_cols}, url, company, title, period,
      {ov.first_rule("(title || ' ' || raw_text)", CATEGORY_RULES, CATEGORY_DEFAULT)} AS category,
      {ov.first_rule("(title || ' ' || period || ' ' || raw_text)", THREAT_RULES, THREAT_DEFAULT)} AS threat_level, raw_text
      FROM ({inner})"""


# ---- sources --------------------------------------------------------------------------

A_BASE = "https://www.example.com/mob/list/main.shc?src=R01"


@query("feed_a_records", T + _built("""
  SELECT id, company, 'https://www.example.com/evt/view?id=' || id AS url, title,
    strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d') AS period,
    concat_ws(' | ', title, nullif(trim(coalesce(conditions, '')), ''), strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d')) AS raw_text
  FROM campaign_texts WHERE id % 4 = 0
  UNION ALL SELECT id, company, 'https://www.example.com/a?a=' || id || '&b=2', title,
    strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d'),
    concat_ws(' | ', title, title, strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d'))
  FROM campaign_texts WHERE id % 4 = 1
  UNION ALL SELECT id, company, 'https://www.example.com/mob/evt/always?id=' || id, '상시 ' || nation, strftime(start_date, '%Y.%m.%d'),
    '상시 ' || nation || ' | ' || strftime(start_date, '%Y.%m.%d') FROM campaign_texts WHERE id % 2 = 0"""))
def feed_a_records(spark, base):
    items = feeds.feed_a_items(ad.feed_a_documents(spark, base))
    staged = feeds.feed_a_records(items, F.col("company"), A_BASE, V)
    return records.accepted(records.build_records(staged, V)).select("id", *RECORD)


@query("feed_a_quarantine", T + """
  SELECT id, 'url' AS reject_reason FROM campaign_texts WHERE id % 4 = 2 UNION ALL SELECT id, 'title' FROM campaign_texts WHERE id % 4 = 3""")
def feed_a_quarantine(spark, base):
    items = feeds.feed_a_items(ad.feed_a_documents(spark, base))
    staged = feeds.feed_a_records(items, F.col("company"), A_BASE, V)
    return records.quarantined(records.build_records(staged, V)).select("id", "reject_reason")


def _spaced(c: str) -> str:
    return f"year({c}) || '. ' || month({c}) || '. ' || day({c})"


@query("feed_b_records", T + _built(f"""
  SELECT id, company, 'https://www.example.com/cpb/detail.hc?bnftWebEvntCd=EV' || id AS url, title,
    {_spaced('start_date')} || '~' || {_spaced('end_date')} AS period,
    concat_ws(' | ', title, {_spaced('start_date')}, {_spaced('end_date')}, nullif(trim(coalesce(conditions, '')), '')) AS raw_text
  FROM campaign_texts WHERE id % 10 <> 0"""))
def feed_b_records(spark, base):
    items = feeds.feed_b_items(ad.feed_b_documents(spark, base))
    staged = feeds.feed_b_records(items, F.col("company"), "https://www.example.com/cpb/list.hc", "/cpb/detail.hc", V)
    return records.accepted(records.build_records(staged, V)).select("id", *RECORD)


@query("list_row_records", T + _built("""
  SELECT id, company, 'https://www.example.com/cpb/view.hc?code=' || id AS url, title,
    strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d') AS period, concat_ws(' ', title, benefit_value) AS raw_text
  FROM campaign_texts WHERE id % 9 <> 0"""))
def list_row_records(spark, base):
    staged = feeds.list_row_records(ad.list_rows(spark, base), F.col("company"), "https://www.example.com/cpb/list.hc")
    return records.accepted(records.build_records(staged, V)).select("id", *RECORD)


@query("dump_records", T + f"""
  SELECT id, CASE WHEN id % 3 <> 0 THEN 'https://www.example.com/ing?cms_id=9' || id ELSE 'https://www.example.com/view.do?evtId=C' || id END AS url,
    company, title, CASE WHEN id % 5 = 0 THEN '정보 없음' ELSE strftime(start_date, '%Y.%m.%d') || '~' || strftime(end_date, '%Y.%m.%d') END AS period,
    {ov.first_rule('title', LEGACY_CATEGORY_RULES, LEGACY_CATEGORY_DEFAULT)} AS category,
    {ov.first_rule('title', LEGACY_THREAT_RULES, THREAT_DEFAULT)} AS threat_level
  FROM campaign_texts WHERE id % 8 <> 0""")
def dump_records(spark, base):
    items = feeds.dump_items(ad.dump_documents(spark, base))
    found = feeds.dump_records(
        items.drop("company"), "x", "https://www.example.com/ing?cms_id=", "https://www.example.com/view.do?evtId="
    )
    names = ad.campaign_texts(spark, base).select("id", F.col("company").alias("_c"))
    return found.join(names, "id").withColumn("company", F.col("_c")).select(
        "id", "url", "company", "title", "period", "category", "threat_level"
    )


@query("useful_captures", """SELECT event_id AS id FROM (SELECT *, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
  WHERE k % 3 <> 1 AND k % 4 <> 0 AND event_type IN ('view', 'purchase') AND k % 7 <> 0 AND k % 5 <> 0
    AND length('{"title":"') + k + length('","u":' || user_id || ',"pad":"') + 60 + 2 >= 100""")
def useful_captures(spark, base):
    return captures.useful_captures(ad.capture_log(spark, base), V).select("id")


@query("search_hits", """SELECT c_custkey AS query, p::BIGINT AS position, u AS url FROM (
  SELECT c_custkey, 0 AS p, 'https://www.kbcard.com/event/' || c_custkey AS u FROM customer
  UNION ALL SELECT c_custkey, 1, 'https://www.samsungcard.com/benefit/' || c_nationkey FROM customer
  UNION ALL SELECT c_custkey, 2, 'https://m.shinhancard.com/event?s=' || c_mktsegment FROM customer)""")
def search_hits(spark, base):
    return captures.search_hits(ad.search_pages(spark, base), V)


@query("search_hits_distinct", """SELECT 'https://www.kbcard.com/event/' || c_custkey AS url FROM customer
  UNION SELECT 'https://www.samsungcard.com/benefit/' || c_nationkey FROM customer
  UNION SELECT 'https://m.shinhancard.com/event?s=' || c_mktsegment FROM customer""")
def search_hits_distinct(spark, base):
    return captures.distinct_hits(captures.search_hits(ad.search_pages(spark, base), V))


P = "WITH " + ov.PROMO_PAGES
SITE = "https://www.example.com/list.do"


PAGES = P + ", " + pv.elements(()).strip()
GO = "regexp_extract(" + pv.attribute("href", "a.t") + ", 'goDetail\\(''(\\d+)''', 1)"
PLAIN_RANGE = "(\\d{4})\\.(\\d{1,2})\\.(\\d{1,2})(?:\\([^)]*\\))?\\s*~\\s*(\\d{4})\\.(\\d{1,2})\\.(\\d{1,2})"
FOUND_RANGE = "CASE WHEN regexp_matches(raw_text, '" + PLAIN_RANGE + "') THEN printf('%04d.%02d.%02d~%04d.%02d.%02d', " + ", ".join(
    f"regexp_extract(raw_text, '{PLAIN_RANGE}', {i})::INT" for i in range(1, 7)) + ") ELSE '' END"


@query("page_call_links", PAGES + f""", links AS (SELECT a.page_id, a.n, a.e, a.spaced AS raw_text, {GO} AS event_no FROM el a
    WHERE a.tag = 'a' AND {GO} <> '' AND EXISTS (SELECT 1 FROM el s WHERE s.page_id = a.page_id AND a.n BETWEEN s.n + 1 AND s.e
      AND (list_contains(s.cls, 'eventList') OR regexp_matches(s.t, 'id=["'']main_contents["'']')))),
  titled AS (SELECT l.page_id, l.n, l.raw_text, l.event_no, first(t.spaced ORDER BY t.n) AS title FROM links l JOIN el t
    ON t.page_id = l.page_id AND t.n > l.n AND t.e < l.e AND list_has_any(t.cls, ['tit', 'title']) GROUP BY ALL)
  SELECT page_id, '{SITE}?eventNum=' || event_no || '&mainCC=a' AS url, title, {FOUND_RANGE} AS period,
    {ov.first_rule('title', CATEGORY_RULES, CATEGORY_DEFAULT)} AS category, {ov.first_rule('title', THREAT_RULES, THREAT_DEFAULT)} AS threat_level, raw_text FROM titled""")
def page_call_links(spark, base):
    staged = pages.call_links(ad.promo_pages(spark, base), "P", SITE, V)
    return records.accepted(records.build_records(staged, V)).select(
        "page_id", "url", "title", "period", "category", "threat_level", "raw_text"
    )


HARVEST = "/pconts/html/benefit/event/|/evt/|MOBEVENTN|MOBFM829R02"


@query("page_block_links", PAGES + f""", links AS (SELECT a.page_id, a.n, {pv.attribute('href', 'a.t')} AS href, first(c.spaced ORDER BY c.n DESC) AS raw_text
    FROM el a JOIN el c ON c.page_id = a.page_id AND c.n < a.n AND c.e > a.e AND c.tag IN ('li', 'div', 'article', 'section')
    WHERE a.tag = 'a' AND regexp_matches({pv.attribute('href', 'a.t')}, '{HARVEST}') GROUP BY a.page_id, a.n, a.t),
  pieces AS (SELECT *, list_filter(list_transform(string_split(replace(raw_text, '·', '|'), '|'), lambda x: trim(x)),
      lambda x: length(x) >= 4 AND (contains(x, '이벤트') OR contains(x, '혜택'))) AS named FROM links)
  SELECT page_id, 'https://www.example.com' || regexp_replace(href, '&utm_[a-z]+=[^&]*', '') AS url, named[1] AS title, {FOUND_RANGE} AS period, raw_text FROM pieces""")
def page_block_links(spark, base):
    staged = pages.block_links(ad.promo_pages(spark, base), "P", SITE, V)
    return records.accepted(records.build_records(staged, V)).select("page_id", "url", "title", "period", "raw_text")


@query("page_details", PAGES + f""", body AS (SELECT page_id, string_agg(s, ' ' ORDER BY n) AS body FROM blk GROUP BY page_id),
  scopes AS (SELECT page_id, n, e, CASE WHEN tag = 'main' THEN 1 WHEN {pv.has('content')} THEN 2 WHEN {pv.has('event-detail')} THEN 3
      WHEN list_bool_or([contains(x, 'event') FOR x IN cls]) THEN 4 WHEN tag = 'article' THEN 5 END AS place FROM el),
  first_scopes AS (SELECT * FROM scopes WHERE place IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id, place ORDER BY n) = 1),
  heads AS (SELECT h.page_id, h.joined AS title FROM first_scopes s JOIN el h ON h.page_id = s.page_id AND h.n > s.n AND h.e < s.e AND h.tag = 'h1'
    WHERE length(h.joined) >= 4 QUALIFY row_number() OVER (PARTITION BY h.page_id ORDER BY s.place, h.n) = 1),
  titled AS (SELECT p.page_id, p.url, body, coalesce(title, '') AS title FROM promo_pages p JOIN body USING (page_id) LEFT JOIN heads USING (page_id))
  SELECT page_id, url, title, coalesce({ov.canonical_period("nullif(regexp_extract(body, '" + periods.STORED_RANGE + "'), '')")}, '') AS period,
    {ov.first_rule('title', CATEGORY_RULES, CATEGORY_DEFAULT)} AS category, body AS raw_text,
    CASE WHEN length(title) < 3 THEN 'short' ELSE 'hit' END AS outcome FROM titled""")
def page_details(spark, base):
    return pages.detail_records(ad.promo_pages(spark, base), "P").drop("company")


LINK_HREF = "regexp_extract(a, '(?is)^<a\\b[^>]*>')"
HREF = ov.unescape(f"""regexp_extract({LINK_HREF}, '(?is)\\bhref="([^"]*)"', 1)""")
ONCLICK = ov.unescape(f"""regexp_extract({LINK_HREF}, '(?is)\\bonclick="([^"]*)"', 1)""")
ORIGIN = "regexp_extract(url, '^[a-z]+://[^/?#]*')"


@query("promotion_links", P + f""", links AS (
    SELECT page_id, url, generate_subscripts(anchors, 1) AS n, unnest(anchors) AS a FROM (
      SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*>.*?</a>') AS anchors FROM promo_pages)),
  parsed AS (SELECT *, {HREF} AS href, {ONCLICK} AS onclick, {ov.inline_text('a', ' ')} AS txt FROM links),
  targets AS (SELECT page_id, n, CASE WHEN starts_with(href, '/') THEN {ORIGIN} || href WHEN starts_with(href, 'http') THEN href
      WHEN (starts_with(href, 'javascript:') OR starts_with(href, '#')) AND contains(lower(onclick), 'event')
        THEN url || '?id=' || nullif(regexp_extract(onclick, '[''"]([^''"]+)[''"]', 1), '') END AS target
    FROM parsed WHERE href <> '' AND ({ov.any_of('href', V.link_href_words)} OR {ov.any_of('txt', V.link_text_words)})),
  firsts AS (SELECT page_id, target, min(n) AS n FROM targets
    WHERE target IS NOT NULL AND (NOT contains(lower(target), 'list') OR contains(lower(target), 'detail')) GROUP BY page_id, target)
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS position, target FROM firsts""")
def promotion_links(spark, base):
    return pages.promotion_links(ad.promo_pages(spark, base), V)


@query("page_containers", PAGES + f""", items AS (SELECT page_id, n, e, joined AS raw_text FROM el
    WHERE tag = 'li' OR {pv.has('list-item', 'event-box', 'event-item', 'card-item')} OR (tag = 'article' AND {pv.has('event')}) OR (tag = 'div' AND {pv.has('event-card', 'item')})),
  titled AS (SELECT i.page_id, i.n, i.e, i.raw_text, first(t.joined ORDER BY t.n) AS title FROM items i JOIN el t ON t.page_id = i.page_id AND t.n > i.n AND t.e < i.e
    AND (t.tag IN ('h3', 'h4', 'strong') OR list_has_any(t.cls, ['title', 'event-title'])) GROUP BY ALL),
  dated AS (SELECT x.page_id, x.n, x.raw_text, x.title, first(d.joined ORDER BY d.n) AS period FROM titled x LEFT JOIN el d ON d.page_id = x.page_id AND d.n > x.n AND d.e < x.e
    AND list_has_any(d.cls, ['period', 'date', 'event-date']) GROUP BY ALL)
  SELECT page_id, '{SITE}' AS url, title, coalesce(nullif(period, ''), '정보 없음') AS period, {ov.first_rule('title', LEGACY_CATEGORY_RULES, CATEGORY_DEFAULT)} AS category,
    {ov.first_rule('title', LEGACY_THREAT_RULES, THREAT_DEFAULT)} AS threat_level, raw_text FROM dated
  WHERE length(title) >= 3 AND (contains(title, '이벤트') OR contains(title, '혜택'))""")
def page_containers(spark, base):
    found = pages.container_records(
        ad.promo_pages(spark, base), "P", SITE, required_words=("이벤트", "혜택")
    )
    return found.select("page_id", "url", "title", "period", "category", "threat_level", "raw_text")


# ---- scalar normalisation over whole tables -----------------------------------------------

@query("normalised_urls", """SELECT page_id, regexp_extract(u, '^[^?]*') ||
    CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS normal_url FROM (
  SELECT page_id, u, list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_')) AS kept
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages))""")
def normalised_urls(spark, base):
    return ad.table(spark, base, "pages").select(
        "page_id", urls.normalise_url(F.col("url"), F.lit(SITE), V).alias("normal_url")
    )


@query("url_domains", """SELECT query, url, CASE WHEN contains(lower(url), 'samsungcard.com') THEN 'samsungcard.com'
  WHEN contains(lower(url), 'shinhancard.com') THEN 'shinhancard.com' WHEN contains(lower(url), 'kbcard.com') THEN 'kbcard.com' ELSE '' END AS domain,
  try_cast(nullif(regexp_extract(url, '/event/(\\d+)', 1), '') AS BIGINT) AS url_id FROM (
  SELECT c_custkey AS query, 'https://www.kbcard.com/event/' || c_custkey AS url FROM customer
  UNION ALL SELECT c_custkey, 'https://www.samsungcard.com/benefit/' || c_nationkey FROM customer
  UNION ALL SELECT c_custkey, 'https://m.shinhancard.com/event?s=' || c_mktsegment FROM customer)""")
def url_domains(spark, base):
    hits = captures.search_hits(ad.search_pages(spark, base), V)
    return hits.select(
        "query", "url", urls.site_domain(F.col("url"), V).alias("domain"),
        urls.id_in_url(F.col("url"), r"/event/(\d+)").alias("url_id"),
    )


@query("parsed_periods", T + f"""SELECT id, period, strftime({ov.period_start('period')}, '%Y-%m-%d') AS period_start,
  strftime({ov.period_end('period')}, '%Y-%m-%d') AS period_end,
  CASE WHEN {ov.period_end('period')} IS NULL THEN 'unknown' WHEN {ov.period_end('period')} >= {DAY} THEN 'active' ELSE 'ended' END AS status,
  coalesce({ov.canonical_period('period')}, '') AS canonical,
  strftime({ov.loose_date(f"CASE WHEN contains(period, '~') THEN {ov.after_tilde()} ELSE {ov.group('period', periods.TRAILING_DATE, 1)} END")}, '%Y-%m-%d') AS loose_end
  FROM campaign_texts""")
def parsed_periods(spark, base):
    d = ad.campaign_texts(spark, base).select("id", "period", periods.period_dates(F.col("period")).alias("d"))
    return d.select(
        "id", "period", F.col("d.start").alias("period_start"), F.col("d.end").alias("period_end"),
        periods.status_at(F.col("d.end"), AS_OF).alias("status"), periods.canonical_period(F.col("period")).alias("canonical"),
        periods.lenient_end_date(F.lit(None).cast("date"), F.col("period")).alias("loose_end"),
    )


@query("period_lengths", C + f"""SELECT id, CASE WHEN period_start IS NULL OR period_end IS NULL THEN 0 ELSE greatest(period_end - period_start + 1, 0) END::BIGINT AS days,
  {ov.week('period_start')} AS start_week, (period_end - {DAY})::BIGINT AS days_left FROM campaigns""")
def period_lengths(spark, base):
    start, end = F.col("period_start"), F.col("period_end")
    return ad.campaigns(spark, base).select(
        "id", periods.duration_days(start, end).alias("days"), periods.week_label(start).alias("start_week"),
        periods.days_left(end, AS_OF).alias("days_left"),
    )


@query("strict_periods", T + """SELECT id, coalesce(nullif(regexp_extract(period, '20\\d{2}\\.\\d{2}\\.\\d{2}~20\\d{2}\\.\\d{2}\\.\\d{2}'), ''), '정보 없음') AS strict_period
  FROM campaign_texts""")
def strict_periods(spark, base):
    return ad.campaign_texts(spark, base).select("id", periods.strict_period(F.col("period")).alias("strict_period"))


@query("compact_periods", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y.%m.%d')
  WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y.%m.%d') || '~' || strftime(o_orderdate, '%Y.%m.%d') ELSE '' END AS period FROM orders""")
def compact_periods(spark, base):
    d = F.date_format("o_orderdate", "yyyyMMdd")
    dashed = F.date_format("o_orderdate", "yyyy-MM-dd")
    key = F.col("o_orderkey") % 3
    start = F.when(key == 0, F.lit("x")).when(key == 1, d)
    end = F.when(key == 2, F.lit("2026")).otherwise(dashed)
    return ad.table(spark, base, "orders").select(
        F.col("o_orderkey").alias("id"), periods.period_from_compact(start, end).alias("period")
    )


@query("parsed_amounts", T + f"""SELECT id, benefit_value, {ov.amount('benefit_value')} AS won, {ov.pct('benefit_value')} AS pct FROM campaign_texts""")
def parsed_amounts(spark, base):
    b = F.col("benefit_value")
    return ad.campaign_texts(spark, base).select(
        "id", "benefit_value", amounts.benefit_amount(b).alias("won"), amounts.benefit_pct(b).alias("pct")
    )


ALL_WON = """list_transform(regexp_extract_all(t, '(\\d[\\d,]{0,8})\\s*(만|천)?\\s*원'), lambda x: regexp_replace(x, '\\s', '', 'g'))"""
WON_OF = "try_cast(regexp_replace(x, '[^\\d]', '', 'g') AS BIGINT) * CASE WHEN contains(x, '만') THEN 10000 WHEN contains(x, '천') THEN 1000 ELSE 1 END"


def distinct_in_order(lst: str) -> str:
    return f"list_filter({lst}, lambda x, i: list_position({lst}, x) = i)"


@query("text_figures", C + f""", t AS (SELECT id, coalesce(raw_text, '') || ' ' || coalesce(benefit_value, '') || ' 5 만 원 12.5％ 3퍼센트' AS t FROM campaigns),
  f AS (SELECT id, {ALL_WON} AS w, regexp_extract_all(t, '(\\d{{1,3}}(?:\\.\\d+)?)\\s*(?:%|％|퍼센트)', 1) AS p FROM t)
  SELECT id, array_to_string({distinct_in_order('w')}, ' | ') AS amounts, array_to_string(list_transform({distinct_in_order('p')}, lambda x: x || '%'), ' | ') AS percentages,
    list_max(list_transform(w, lambda x: {WON_OF})) AS max_won, list_max(list_transform(p, lambda x: x::DOUBLE)) AS max_pct FROM f""")
def text_figures(spark, base):
    blob = F.concat(
        F.coalesce("raw_text", F.lit("")), F.lit(" "), F.coalesce("benefit_value", F.lit("")), F.lit(" 5 만 원 12.5％ 3퍼센트")
    )
    d = ad.campaigns(spark, base).select("id", blob.alias("t")).select(
        "id", amounts.all_amounts(F.col("t")).alias("amounts"), amounts.all_percentages(F.col("t")).alias("percentages")
    )
    return d.withColumns(
        {"max_won": amounts.max_amount(F.col("amounts")), "max_pct": amounts.max_percentage(F.col("percentages"))}
    )


@query("classified_titles", T + f"""SELECT id, {ov.first_rule('title', CATEGORY_RULES, CATEGORY_DEFAULT)} AS category,
  {ov.first_rule('title', LEGACY_CATEGORY_RULES, LEGACY_CATEGORY_DEFAULT)} AS legacy_category,
  {ov.first_rule("(title || coalesce(conditions, ''))", THREAT_RULES, THREAT_DEFAULT)} AS threat,
  {ov.first_rule('lower(title)', V.benefit_type_rules, V.benefit_type_default)} AS benefit_type,
  {ov.meaningful()} AS meaningful, {ov.empty_value('benefit_value')} AS no_benefit,
  coalesce(nullif({ov.strip("regexp_replace(coalesce(benefit_value, ''), '상세 페이지 참조|정보 없음', '', 'g')")}, ''), '—') AS shown_benefit
  FROM campaign_texts""")
def classified_titles(spark, base):
    t = F.col("title")
    return ad.campaign_texts(spark, base).select(
        "id",
        text.first_rule(t, CATEGORY_RULES, CATEGORY_DEFAULT).alias("category"),
        text.first_rule(t, LEGACY_CATEGORY_RULES, LEGACY_CATEGORY_DEFAULT).alias("legacy_category"),
        text.first_rule(F.concat(t, F.coalesce("conditions", F.lit(""))), THREAT_RULES, THREAT_DEFAULT).alias("threat"),
        text.benefit_type_of(t, V).alias("benefit_type"), records.visible(PARAMS).alias("meaningful"),
        text.is_empty_value(F.col("benefit_value"), V).alias("no_benefit"),
        text.display_benefit(F.col("benefit_value")).alias("shown_benefit"),
    )


@query("dedupe_keys", S + """SELECT arrival, CASE WHEN url <> '' THEN 'url::' || lower(url) END AS url_key,
  'title::' || lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) || '::' || lower(trim(regexp_replace(coalesce(period, ''), '\\s+', ' ', 'g'))) AS title_key
  FROM submissions""")
def dedupe_keys(spark, base):
    built = records.build_records(ad.submissions(spark, base), V)
    raw = ad.submissions(spark, base).select(
        "arrival", text.dedupe_key(F.lit(""), F.col("title"), F.col("period")).alias("title_key")
    )
    return built.select("arrival", text.dedupe_key(F.col("url"), F.col("title"), F.col("period")).alias("url_key")).join(raw, "arrival")


@query("search_blobs", C + """SELECT id, sha256(title || ' ' || coalesce(category, '') || ' ' || coalesce(benefit_value, '') || ' ' || coalesce(conditions, '') || ' ' ||
  target_segment || ' ' || one_line_summary || ' ' || coalesce(raw_text, '')) AS digest FROM campaigns""")
def search_blobs(spark, base):
    return ad.campaigns(spark, base).select("id", F.sha2(records.search_blob(), 256).alias("digest"))


@query("payload_fields", C + """SELECT id, has_content, has_insight, level AS benefit_level, array_to_string(points, ' | ') AS points,
  array_to_string(strategies, ' | ') AS strategies, coalesce(array_to_string(list_filter([level] || points || strategies, lambda x: x IS NOT NULL), ' / '), '') AS summary,
  CASE WHEN has_content THEN round_even((2 + (id % 2 = 0)::INT) / 7.0, 2) ELSE 0.0 END::DOUBLE AS coverage FROM campaigns""")
def payload_fields(spark, base):
    d = ad.campaigns(spark, base).select(
        "id", records.has_json_content(F.col("marketing_content")).alias("has_content"),
        records.has_json_content(F.col("marketing_insights")).alias("has_insight"),
        records.insight_struct(F.col("marketing_insights")).alias("i"), records.content_map(F.col("marketing_content")).alias("m"),
    )
    return d.select(
        "id", "has_content", "has_insight", "i.benefit_level", F.col("i.competitive_points").alias("points"),
        F.col("i.promo_strategies").alias("strategies"), records.insight_summary(F.col("i")).alias("summary"),
        amounts.section_coverage(F.col("m"), V.section_names).alias("coverage"),
    )


# ---- ingest -----------------------------------------------------------------------------

FIRSTS = ", firsts AS (SELECT * FROM submissions QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival) = 1)"


def _submitted(spark, base):
    return records.accepted(records.build_records(ad.submissions(spark, base), V))


def _stored(spark, base):
    return _submitted(spark, base).where(F.col("order_status") == "F").select("url")


VALID = " title NOT IN ('진행중 이벤트', '이벤트', '혜택', '상세', '본문 바로가기') "
DATES = f"""strftime({ov.period_start('canon')}, '%Y-%m-%d') AS period_start, strftime({ov.period_end('canon')}, '%Y-%m-%d') AS period_end,
  {ov.amount('benefit_value')} AS benefit_amount_won, {ov.pct('benefit_value')} AS benefit_pct,
  CASE WHEN {ov.period_end('canon')} IS NULL THEN 'unknown' WHEN {ov.period_end('canon')} >= {DAY} THEN 'active' ELSE 'ended' END AS status"""
CANON = f"SELECT *, coalesce({ov.canonical_period('period')}, '') AS canon FROM"


@query("deduped_submissions", S + FIRSTS + "SELECT arrival, url, company FROM firsts")
def deduped_submissions(spark, base):
    return ing.dedupe_first(_submitted(spark, base), [F.asc("arrival")]).select("arrival", "url", "company")


@query("insert_if_new", S + FIRSTS + f""", fresh AS ({CANON} firsts f WHERE NOT EXISTS (
    SELECT 1 FROM submissions s WHERE s.order_status = 'F' AND s.url = f.url))
  SELECT arrival, url, company, {DATES} FROM fresh""")
def insert_if_new(spark, base):
    new = ing.insert_if_new(_submitted(spark, base), _stored(spark, base), [F.asc("arrival")], PARAMS)
    return new.select(
        "arrival", "url", "company", "period_start", "period_end", "benefit_amount_won", "benefit_pct", "status"
    )


RUN = """, taken AS (SELECT * FROM submissions),
  fresh AS (SELECT * FROM taken t WHERE NOT EXISTS (SELECT 1 FROM submissions s WHERE s.order_status = 'F' AND s.url = t.url)
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival) = 1)
"""


@query("ingest_run", S + RUN + "SELECT arrival, url, company FROM fresh")
def ingest_run(spark, base):
    return ing.ingest_run(_submitted(spark, base), _stored(spark, base), [F.asc("arrival")], PARAMS).select("arrival", "url", "company")


@query("ingest_summary", S + RUN + """SELECT s.company, s.n AS collected, coalesce(f.n, 0) AS ingested, s.n - coalesce(f.n, 0) AS skipped
  FROM (SELECT company, count(*) AS n FROM submissions GROUP BY company) s
  LEFT JOIN (SELECT company, count(*) AS n FROM fresh GROUP BY company) f USING (company)""")
def ingest_summary(spark, base):
    batch = _submitted(spark, base)
    return ing.ingest_summary(batch, ing.ingest_run(batch, _stored(spark, base), [F.asc("arrival")], PARAMS))


@query("merged_passes", S + """, one AS (SELECT *, 0 AS p FROM submissions WHERE order_status = 'F' QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival) = 1),
  two AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT *, 1 FROM submissions WHERE order_status = 'O')
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY p, arrival) = 1),
  three AS (SELECT * FROM (SELECT * FROM two UNION ALL SELECT *, 2 FROM submissions WHERE order_status = 'P'
      AND company NOT IN (SELECT company FROM two GROUP BY company HAVING count(*) >= (SELECT count(*) FROM region) * 250))
    QUALIFY row_number() OVER (PARTITION BY url ORDER BY p, arrival) = 1)
  SELECT arrival, url, company, p::BIGINT AS source_pass FROM three""")
def merged_passes(spark, base):
    s = _submitted(spark, base)
    parts = [s.where(F.col("order_status") == x) for x in ("F", "O", "P")]
    return ing.merge_passes(parts, [None, None, 1250]).select("arrival", "url", "company", "source_pass")


@query("pending_extraction", C + """SELECT id, url FROM campaigns WHERE url <> '' AND lower(url) NOT LIKE '%/event/detail/%' AND id % 5 IN (0, 1, 2)""")
def pending_extraction(spark, base):
    return ing.pending_extraction(ad.campaigns(spark, base)).select("id", "url")


LOCKED = """, lock_last AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
  plan AS (SELECT c.id, CASE WHEN NOT starts_with(url, 'http') THEN 'failed' WHEN l.o_orderstatus = 'F' THEN 'skipped' ELSE 'extract' END AS action
    FROM campaigns c LEFT JOIN lock_last l ON l.o_custkey = c.id WHERE url <> '' AND lower(url) NOT LIKE '%/event/detail/%' AND c.id % 5 IN (0, 1, 2))
"""


def _plan(spark, base):
    from promolens.operators.history import lock_state

    return ing.extraction_plan(ing.pending_extraction(ad.campaigns(spark, base)), lock_state(ad.locks(spark, base)))


@query("extraction_plan", C + LOCKED + "SELECT id, action FROM plan")
def extraction_plan(spark, base):
    return _plan(spark, base).select("id", "action")


@query("extraction_summary", C + LOCKED + """SELECT count(*) AS processed,
  count(*) FILTER (action = 'skipped' OR (action = 'extract' AND NOT id % 13 = 0)) AS succeeded,
  count(*) FILTER (action = 'failed' OR (action = 'extract' AND id % 13 = 0)) AS failed,
  count(*) FILTER (action = 'extract' AND id % 13 <> 0 AND id % 2 = 0) AS enriched FROM plan""")
def extraction_summary(spark, base):
    outcome = _plan(spark, base).withColumns(
        {"error": F.when(F.col("id") % 13 == 0, "timeout"), "source": F.when(F.col("id") % 2 == 0, "gemini").otherwise("rule")}
    )
    return ing.extraction_summary(outcome)


@query("ledger_new_items", """SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def ledger_new_items(spark, base):
    ledger = ad.table(spark, base, "labels").select(F.col("doc_id").alias("item_id"))
    return ing.new_items(ad.table(spark, base, "documents").select("doc_id"), ledger, "doc_id")


@query("ledger_extended", """SELECT doc_id AS item_id FROM documents UNION SELECT doc_id FROM labels""")
def ledger_extended(spark, base):
    ledger = ad.table(spark, base, "labels").select(F.col("doc_id").alias("item_id"))
    return ing.extend_ledger(ledger, ad.table(spark, base, "documents"), "doc_id")


# ---- mutations -----------------------------------------------------------------------------

def _customer_updates(spark, base):
    """One update per customer key, used as a promotion id."""
    return ad.table(spark, base, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("title"),
        F.when(F.col("c_nationkey") % 3 == 0, "2001.07.01~2001.08.31").when(F.col("c_nationkey") % 3 == 1, "broken").alias("period"),
        F.lit("1만원").alias("benefit_value"),
    )


@query("partial_update", C + f"""SELECT c.id, coalesce(CASE WHEN u.c_nationkey % 2 = 0 THEN u.c_name END, c.title) AS title,
  coalesce(u.p, c.period) AS period, strftime(CASE WHEN u.c_nationkey % 3 = 0 THEN DATE '2001-07-01' ELSE period_start END, '%Y-%m-%d') AS period_start,
  strftime(CASE WHEN u.c_nationkey % 3 = 0 THEN DATE '2001-08-31' ELSE period_end END, '%Y-%m-%d') AS period_end,
  CASE WHEN u.c_custkey IS NOT NULL THEN '1만원' ELSE benefit_value END AS benefit_value, benefit_amount_won,
  CASE WHEN u.c_nationkey % 3 = 0 THEN 'active' ELSE status END AS status
  FROM campaigns c LEFT JOIN (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN '2001.07.01~2001.08.31' WHEN 1 THEN 'broken' END AS p FROM customer) u ON u.c_custkey = c.id""")
def partial_update(spark, base):
    new = mu.apply_updates(ad.campaigns(spark, base), _customer_updates(spark, base), PARAMS)
    return new.select("id", "title", "period", "period_start", "period_end", "benefit_value", "benefit_amount_won", "status")


@query("merged_extraction", C + f"""SELECT u.c_custkey AS id, coalesce(CASE WHEN c_nationkey % 2 = 0 THEN c_name END, nullif(title, ''), '') AS title,
  '1만원' AS benefit_value, 10000::BIGINT AS benefit_amount_won, coalesce(u.p, nullif(period, ''), '') AS period,
  strftime(CASE WHEN u.p IS NULL THEN period_start WHEN u.p = 'broken' THEN NULL ELSE DATE '2001-07-01' END, '%Y-%m-%d') AS period_start, c.conditions
  FROM (SELECT *, CASE c_nationkey % 3 WHEN 0 THEN '2001.07.01~2001.08.31' WHEN 1 THEN 'broken' END AS p FROM customer) u LEFT JOIN campaigns c ON u.c_custkey = c.id""")
def merged_extraction(spark, base):
    none = F.lit("")
    extracted = _customer_updates(spark, base).withColumns(
        {k: none for k in ("benefit_type", "conditions", "target_segment", "one_line_summary", "raw_text")}
        | {"marketing_content": F.create_map().cast("map<string,array<string>>")}
    )
    merged = records.merge_extracted(extracted, ad.campaigns(spark, base), PARAMS)
    return merged.select("id", "title", "benefit_value", "benefit_amount_won", "period", "period_start", "conditions")


@query("delete_events", C + "SELECT id FROM campaigns WHERE id NOT IN (SELECT c_custkey FROM customer)")
def delete_events(spark, base):
    gone = ad.table(spark, base, "customer").select(F.col("c_custkey").alias("id"))
    return mu.delete_events(ad.campaigns(spark, base), gone).select("id")


@query("delete_children", "SELECT conv_id AS event_id, count(*) AS n FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1")
def delete_children(spark, base):
    gone = ad.table(spark, base, "labels").select(F.col("doc_id").alias("id"))
    return mu.delete_children(ad.snapshots(spark, base), gone).groupBy("event_id").agg(F.count("*").alias("n"))


@query("delete_keeps_jobs", "SELECT event_id AS id, CASE WHEN user_id NOT IN (SELECT doc_id FROM labels) THEN user_id END AS event_id FROM events")
def delete_keeps_jobs(spark, base):
    gone = ad.table(spark, base, "labels").select(F.col("doc_id").alias("id"))
    return mu.delete_children(ad.jobs(spark, base), gone, set_null=True).select("id", "event_id")


@query("backfill", C + f"""SELECT id, strftime(period_start, '%Y-%m-%d') AS period_start, strftime(period_end, '%Y-%m-%d') AS period_end,
  coalesce(nullif(benefit_amount_won, 0), won0) AS benefit_amount_won,
  nullif(benefit_pct, 0) AS benefit_pct,
  CASE WHEN period_end IS NOT NULL THEN CASE WHEN period_end >= {DAY} THEN 'active' ELSE 'ended' END ELSE coalesce(status, 'unknown') END AS status
  FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 0 END::BIGINT AS won0 FROM campaigns)""")
def backfill(spark, base):
    old = ad.campaigns(spark, base).withColumns(
        {
            "period_start": F.lit(None).cast("date"), "period_end": F.lit(None).cast("date"),
            "benefit_amount_won": F.when(F.col("id") % 2 == 0, 0).cast("bigint"), "benefit_pct": F.lit(None).cast("double"),
        }
    )
    return mu.backfill(old, PARAMS).select("id", "period_start", "period_end", "benefit_amount_won", "benefit_pct", "status")


@query("missing_children", C + "SELECT id FROM campaigns WHERE has_content AND id NOT IN (SELECT conv_id FROM conversations)")
def missing_children(spark, base):
    events = ad.campaigns(spark, base).where(records.has_json_content(F.col("marketing_content")))
    return mu.missing_children(events, ad.snapshots(spark, base)).select("id")


@query("rewritten_urls", """SELECT o_orderkey AS id, CASE WHEN c.c_custkey IS NOT NULL AND o_orderkey % 2 = 0 THEN 'https://www.example.com/new?cms_id=' || c_nationkey
  ELSE 'https://www.example.com/old?' || CASE WHEN o_orderkey % 2 = 0 THEN 'evtId=C' ELSE 'x=C' END || o_custkey || '&z=1' END AS url
  FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_nationkey <> 7""")
def rewritten_urls(spark, base):
    old = F.concat(
        F.lit("https://www.example.com/old?"), F.when(F.col("o_orderkey") % 2 == 0, "evtId=C").otherwise("x=C"),
        F.col("o_custkey").cast("string"), F.lit("&z=1"),
    )
    events = ad.table(spark, base, "orders").select(F.col("o_orderkey").alias("id"), old.alias("url"))
    mapping = ad.table(spark, base, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("old_id"),
        F.when(F.col("c_nationkey") == 7, "").otherwise(F.col("c_nationkey").cast("string")).alias("new_id"),
    )
    return mu.rewrite_urls(events, mapping, r"evtId=([^&]+)", "https://www.example.com/new?cms_id=")


BAD = """(length(title) < 10 OR contains(title, '이벤트에 응모되었습니다') OR (contains(title, '마이홈 앱의') AND contains(title, '자산 연결')))"""


@query("repaired_titles", C + f"""SELECT id, CASE WHEN {BAD} AND n.c_name IS NOT NULL THEN n.c_name ELSE title END AS title,
  CASE WHEN {BAD} AND n.c_name IS NOT NULL THEN n.c_name ELSE one_line_summary END AS one_line_summary, {BAD} AS was_bad
  FROM campaigns LEFT JOIN customer n ON n.c_custkey = id""")
def repaired_titles(spark, base):
    events = ad.campaigns(spark, base).select("id", "title", "one_line_summary").withColumn(
        "was_bad", mu.is_bad_title(F.col("title"), V)
    )
    found = ad.table(spark, base, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return mu.repair_titles(events, found, V)


@query("refreshed_details", C + """SELECT id, CASE WHEN u AND n.c_custkey IS NOT NULL THEN '5,000원' ELSE benefit_value END AS benefit_value,
  CASE WHEN u AND n.c_custkey IS NOT NULL THEN n.c_mktsegment ELSE target_segment END AS target_segment
  FROM (SELECT *, coalesce(benefit_value, '') IN ('', '정보 없음', '상세 페이지 참조') AS u FROM campaigns) c LEFT JOIN customer n ON n.c_custkey = c.id""")
def refreshed_details(spark, base):
    details = ad.table(spark, base, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("할인").alias("benefit_type"), F.lit("5,000원").alias("benefit_value"),
        F.lit("x").alias("conditions"), F.col("c_mktsegment").alias("target_segment"), F.lit("raw").alias("raw_text"),
    )
    return mu.refresh_details(ad.campaigns(spark, base), details).select("id", "benefit_value", "target_segment")


@query("export_rows", C + f"""SELECT company, title, coalesce(benefit_value, '') AS benefit, coalesce(conditions, '') AS conditions, coalesce(period, '') AS period,
  CASE WHEN has_insight THEN '완료' ELSE '미완료' END AS extracted, CASE WHEN {ov.lenient_active(str(AS_OF))} THEN '진행중' ELSE '종료' END AS status,
  coalesce(category, '') AS category, CASE WHEN has_insight THEN array_to_string([level] || points || strategies, ' / ') ELSE '' END AS insight_summary, url
  FROM campaigns""")
def export_rows(spark, base):
    return mu.export_rows(ad.campaigns(spark, base), PARAMS)


# ---- lists and filters --------------------------------------------------------------------

NEWEST = "ORDER BY created_at DESC NULLS LAST, id"


@query("event_list", C + "SELECT id, title, period FROM campaigns WHERE visible AND company = 'ASIA' AND threat_level = 'High'")
def event_list(spark, base):
    return fl.event_list(ad.campaigns(spark, base), PARAMS, company="ASIA", threat_level="High").select("id", "title", "period")


@query("event_page", C + f"SELECT id, title FROM (SELECT * FROM campaigns WHERE visible {NEWEST} LIMIT 50 OFFSET 100)")
def event_page(spark, base):
    rows = fl.event_list(ad.campaigns(spark, base), PARAMS)
    return fl.page(rows, fl.newest_first(), number=3, size=50).select("id", "title")


ACT = ov.lenient_active(str(AS_OF))


@query("explore_active", C + f"""SELECT id FROM campaigns WHERE {ACT} AND company = 'EUROPE' AND benefit_type = 'SMALL' AND has_insight
  AND contains(lower(concat_ws(' ', title, coalesce(benefit_value, ''), company, coalesce(category, ''))), 'brand#1')""")
def explore_active(spark, base):
    return fl.explore(
        ad.campaigns(spark, base), PARAMS, company="EUROPE", status="active", benefit_type="SMALL", extracted="done", keyword=" Brand#1 "
    ).select("id")


@query("explore_ended_tag", C + f"SELECT id FROM campaigns WHERE NOT {ACT} AND id % 6 IN (1, 5) AND segment = 'BUILDING'")
def explore_ended_tag(spark, base):
    return fl.explore(ad.campaigns(spark, base), PARAMS, status="ended", tag="BUILDING").select("id")


@query("explore_pending_raw", C + "SELECT id FROM campaigns WHERE NOT has_insight AND NOT length(coalesce(raw_text, '')) > 20 AND category = 'Brand#7'")
def explore_pending_raw(spark, base):
    return fl.explore(ad.campaigns(spark, base), PARAMS, category="Brand#7", extracted="pending", by_raw_text=True).select("id")


@query("month_filter", C + "SELECT id FROM campaigns WHERE contains(period, '2001.07')")
def month_filter(spark, base):
    return fl.in_month(ad.campaigns(spark, base), 2001, 7).select("id")


@query("text_active", C + f"""SELECT id FROM campaigns WHERE CASE WHEN coalesce(period, '') IN ('', '정보 없음') OR NOT contains(period, '~') THEN true
  ELSE coalesce({ov.loose_date(ov.after_tilde())} >= {DAY}, false) END""")
def text_active(spark, base):
    return fl.text_active(ad.campaigns(spark, base), PARAMS).select("id")


@query("facets", C + """SELECT DISTINCT facet, value FROM (SELECT 'company' AS facet, company AS value FROM campaigns UNION ALL SELECT 'category', category FROM campaigns
  UNION ALL SELECT 'benefit_type', benefit_type FROM campaigns UNION ALL SELECT 'tag', segment FROM campaigns WHERE id % 6 IN (1, 5)) WHERE value <> ''""")
def facets(spark, base):
    return fl.facets(ad.campaigns(spark, base))


@query("point_lookup", C + "SELECT id, title, status FROM campaigns WHERE id IN (SELECT max(id) FROM campaigns GROUP BY company)")
def point_lookup(spark, base):
    events = ad.campaigns(spark, base)
    wanted = events.groupBy("company").agg(F.max("id").alias("id"))
    return fl.by_id(events, wanted).select("id", "title", "status")


@query("strongest_benefits", C + "SELECT id, benefit_amount_won, benefit_pct FROM campaigns WHERE visible ORDER BY benefit_amount_won DESC NULLS LAST, benefit_pct DESC NULLS LAST, id LIMIT 30")
def strongest_benefits(spark, base):
    rows = fl.event_list(ad.campaigns(spark, base), PARAMS)
    return rows.orderBy(*fl.strongest_benefit()).limit(30).select("id", "benefit_amount_won", "benefit_pct")


@query("ending_soon", C + f"""SELECT id, period FROM campaigns WHERE visible
  ORDER BY CASE WHEN {ov.lenient_end()} >= {DAY} THEN {ov.lenient_end()} - {DAY} END ASC NULLS LAST, id LIMIT 30""")
def ending_soon(spark, base):
    rows = fl.event_list(ad.campaigns(spark, base), PARAMS)
    return rows.orderBy(*fl.ending_soon(PARAMS)).limit(30).select("id", "period")
