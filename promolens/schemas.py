"""Table schemas."""

from __future__ import annotations

RAW_FIELDS = (
    "url", "company", "title", "period", "category", "benefit_type", "benefit_value",
    "conditions", "target_segment", "threat_level", "one_line_summary", "raw_text",
)

EVENTS = """
    id BIGINT, url STRING, company STRING, category STRING, title STRING, period STRING,
    period_start DATE, period_end DATE, benefit_type STRING, benefit_value STRING,
    benefit_amount_won BIGINT, benefit_pct DOUBLE, conditions STRING, target_segment STRING,
    threat_level STRING, one_line_summary STRING, raw_text STRING, marketing_content STRING,
    marketing_insights STRING, status STRING, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ
"""
SNAPSHOTS = """
    event_id BIGINT, raw_html STRING, raw_text STRING, extracted_json STRING,
    extraction_latency_ms INT, noise_ratio DOUBLE, captured_at TIMESTAMP_NTZ
"""
SECTIONS = "event_id BIGINT, section_type STRING, content STRING, sort_order INT"
INSIGHTS = """
    event_id BIGINT, benefit_level STRING, benefit_score DOUBLE, target_clarity STRING,
    objective_tags ARRAY<STRING>, target_tags ARRAY<STRING>, channel_tags ARRAY<STRING>,
    competitive_points ARRAY<STRING>, promo_strategies ARRAY<STRING>, evidence ARRAY<STRING>,
    threat_level STRING, threat_reason STRING, marketing_takeaway STRING,
    insight_confidence DOUBLE, section_coverage DOUBLE, source STRING, generated_at TIMESTAMP_NTZ
"""
EDITS = """
    event_id BIGINT, field_name STRING, old_value STRING, new_value STRING,
    editor STRING, edited_at TIMESTAMP_NTZ, reason STRING
"""
LOCKS = """
    event_id BIGINT, is_locked BOOLEAN, locked_by STRING, locked_at TIMESTAMP_NTZ, lock_reason STRING
"""
JOBS = """
    id BIGINT, job_type STRING, event_id BIGINT, company STRING, status STRING, retry_count INT,
    last_error STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ
"""
LEDGER = "item_id BIGINT"

INSIGHT_EXTRA_KEYS = (
    "benefit_detail", "target_profile", "conditions_summary", "event_duration_type",
    "weaknesses", "shinhan_response",
)

# fixed values: keys of stored insight JSON, new names first, then the legacy ones
INSIGHT_JSON = """
    benefit_level STRING, competitive_points ARRAY<STRING>, promo_strategies ARRAY<STRING>,
    objective_tags ARRAY<STRING>, benefit_detail STRING, target_profile STRING,
    conditions_summary STRING, event_duration_type STRING, weaknesses ARRAY<STRING>,
    shinhan_response STRING,
    `혜택_수준` STRING, `경쟁력_포인트` ARRAY<STRING>, `프로모션_전략` ARRAY<STRING>
"""

# fixed values: the keys of an analysis response
RESPONSE_JSON = """
    one_line_summary STRING, category STRING, threat_level STRING, threat_reason STRING,
    benefit_level STRING, benefit_detail STRING, target_clarity STRING, target_profile STRING,
    conditions_summary STRING, event_duration_type STRING, competitive_points ARRAY<STRING>,
    weaknesses ARRAY<STRING>, promo_strategies ARRAY<STRING>, objective_tags ARRAY<STRING>,
    target_tags ARRAY<STRING>, channel_tags ARRAY<STRING>, shinhan_response STRING,
    marketing_takeaway STRING, evidence ARRAY<STRING>
"""

# fixed values: keys of feed documents
FEED_A_LISTS = ("root.evnlist", "mbw_json.dpEvtList", "mbw_json.ingEvtList",
                "mbw_json.zipEvtList", "mbw_json.evtList")
FEED_A_DOCUMENT = """
    root STRUCT<evnlist: ARRAY<STRING>>,
    mbw_json STRUCT<dpEvtList: ARRAY<STRING>, ingEvtList: ARRAY<STRING>,
                    zipEvtList: ARRAY<STRING>, evtList: ARRAY<STRING>>
"""
FEED_A_ITEM = """
    mobWbEvtNm STRING, evtImgSlTilNm STRING, evtImgRplNm STRING, hpgEvtDlPgeUrlAr STRING,
    evtDtlUrl STRING, evtUrlAr STRING, mobWbEvtStd STRING, mobWbEvtEdd STRING,
    evtTermTxt STRING, eventPeriod STRING, hpgEvtSmrTt STRING
"""
FEED_B_DOCUMENT = "bdy STRUCT<eventList: ARRAY<STRING>>"
FEED_B_ITEM = """
    bnftWebEvntCd STRING, bnftEvntNm STRING, srtDttm STRING, endDttm STRING, bnftEvntSmrCn STRING
"""
DUMP_DOCUMENT = "listPeiHPPPrgEvnInqrDVO ARRAY<STRING>"
DUMP_ITEM = "cmpTitNm STRING, cmsCmpStrtdt STRING, cmsCmpEnddt STRING, cmpId STRING, cmsId STRING"
VISION_JSON = """
    `이벤트명` STRING, `혜택금액내용` STRING, `참여방법` STRING, `전월실적조건` STRING,
    `대상카드` STRING, `제외대상` STRING, `이벤트종료일` STRING
"""
EXTRACTION_JSON = """
    title STRING, period STRING, benefit_type STRING, benefit_value STRING, conditions STRING,
    target_segment STRING, threat_level STRING, one_line_summary STRING, category STRING,
    company STRING
"""
