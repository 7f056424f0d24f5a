import datetime as dt
import json
import tempfile

import pytest
from pyspark.sql import functions as F

from promolens import Params, schemas
from promolens.operators import extract_job as ej
from promolens.operators import history, ingest, scoring, structure
from promolens.sources import feeds

P = Params(as_of=dt.date(2026, 2, 15), focal="A")
LOCKS = "event_id BIGINT, is_locked BOOLEAN"
PAGE = """<html><body><article><h1>{0} 할인 이벤트 안내</h1><p>이벤트 기간 2026.02.01 ~ 2026.03.31</p><p>결제 시 {1}만원 캐시백 혜택을 드립니다</p>
<p>전월 실적 30만원 이상 조건 충족 고객</p></article></body></html>"""


def moment(day):
    return F.lit(f"2026-02-{day:02d} 06:00:00").cast("timestamp_ntz")


def promotions(spark):
    rows = [
        {"id": 1, "url": "https://x/1", "company": "A", "title": "오퍼", "period": "", "benefit_value": "", "category": "쇼핑"},
        {"id": 2, "url": "https://x/2", "company": "A", "title": "둘", "category": "여행"},
        {"id": 3, "url": "ftp://x/3", "company": "B", "title": "셋"},
        {"id": 4, "url": "https://x/4", "company": "B", "title": "넷"},
        {"id": 5, "url": "https://x/5", "company": "B", "title": "다섯", "marketing_content": '{"혜택_상세":["있음"]}'},
        {"id": 6, "url": "", "company": "B", "title": "여섯"},
        {"id": 7, "url": "https://x/7", "company": None, "title": None},
    ]
    return spark.createDataFrame([{"marketing_content": None, **r} for r in rows], schemas.EVENTS)


def landed(spark, n):
    rows = [("https://x/1", PAGE.format("커피", 1), dt.datetime(2026, 2, 1)), ("https://x/1", PAGE.format("새 커피", 3), dt.datetime(2026, 2, 9)),
            ("https://x/2", PAGE.format("항공", 5), None), ("https://x/7", PAGE.format("영화", 2), None), ("https://else", "<p>x</p>", None)]
    return spark.createDataFrame(rows[:n], "url STRING, html STRING, captured_at TIMESTAMP_NTZ")


@pytest.fixture(scope="module")
def ran(spark):
    """Three runs over the table: one page, then more pages and no lock, then nothing new."""
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    events = promotions(spark)
    answer = spark.createDataFrame(
        [(2, {"one_line_summary": "요약", "category": "교통", "threat_level": "High", "benefit_level": "중상"})], f"id BIGINT, answer STRUCT<{schemas.RESPONSE_JSON}>")
    seen = []
    for batch, n, held in ((0, 2, True), (1, 5, False), (2, 5, False)):
        locks = spark.createDataFrame([(2, held)], LOCKS)
        rows = ej.run_batch(events, landed(spark, n), locks, P, root, batch, moment(batch + 10), answer)
        seen.append({r.id: (r.action, r.error, r.source) for r in rows.collect()})
        events = ej.events_after(promotions(spark), ej.read_results(spark, root, "updates"), P)
    return root, seen, events


def test_failed_and_locked_rows_return_without_new_rows(ran):
    _, seen, _ = ran
    assert seen[0] == {1: ("extract", None, "rule"), 2: ("skipped", None, None), 3: ("failed", None, None), 4: ("extract", "no page", None), 7: ("extract", "no page", None)}
    assert seen[1] == {2: ("extract", None, "gemini"), 3: ("failed", None, None), 4: ("extract", "no page", None), 7: ("extract", None, "rule")}
    assert seen[2] == {3: ("failed", None, None), 4: ("extract", "no page", None)}


def test_all_tables_of_a_batch_equal_the_batch_operators(spark, ran):
    root, _, events = ran
    got = {r.id: r for r in events.collect()}
    assert len(got) == 7 and got[1].title == "새 커피 할인 이벤트 안내" and got[1].category == "쇼핑"
    assert (str(got[1].period_start), str(got[1].period_end), got[1].status) == ("2026-02-01", "2026-03-31", "active")
    assert (got[2].category, got[2].threat_level, got[2].one_line_summary) == ("교통", "High", "요약")
    assert got[4].marketing_content is None and got[5].marketing_content == '{"혜택_상세":["있음"]}'
    page = structure.extract_pages(landed(spark, 2).where("captured_at = '2026-02-09'").withColumn("id", F.lit(1)).drop("captured_at"), P.vocab)
    want = page.first()
    shot = ej.read_results(spark, root, "snapshots").where("event_id = 1").collect()
    assert len(shot) == 1 and shot[0].raw_text == want.raw_text and shot[0].captured_at == dt.datetime(2026, 2, 10, 6)
    assert json.loads(shot[0].extracted_json)["marketing_content"] == {k: v for k, v in want.marketing_content.items()}
    rows = history.section_rows(page.select(F.col("id").alias("event_id"), "marketing_content"), F.col("marketing_content"), P.vocab.section_names)
    key = lambda df: sorted((r.event_id, r.section_type, r.content, r.sort_order) for r in df.collect())
    sections = ej.read_results(spark, root, "sections")
    assert key(sections.where("event_id = 1")) == key(rows) != []
    rated = scoring.rule_insights(page, P.vocab).first()
    insight = ej.read_results(spark, root, "insights").where("event_id = 1").first()
    for c in ("benefit_level", "benefit_score", "target_clarity", "competitive_points", "promo_strategies", "objective_tags", "section_coverage"):
        assert insight[c] == rated[c], c
    assert [r.source for r in ej.read_results(spark, root, "insights").orderBy("event_id").collect()] == ["rule", "gemini", "rule"]
    jobs = {(r.job_id, r.status, r.retry_count, r.last_error) for r in history.job_state(ej.read_results(spark, root, "jobs")).collect()}
    assert jobs == {
        ("0:1", "success", 0, None), ("0:2", "success", 0, "skipped (locked)"), ("0:4", "failed", 1, "no page"), ("0:7", "failed", 1, "no page"),
        ("1:2", "success", 0, None), ("1:4", "failed", 1, "no page"), ("1:7", "success", 0, None), ("2:4", "failed", 1, "no page")}


def test_children_after_batches(spark, ran):
    root, _, _ = ran
    old = spark.createDataFrame([(1, "x", "alt", 0), (5, "x", "bleibt", 0)], schemas.SECTIONS)
    after = ej.sections_after(old, ej.read_results(spark, root, "sections"), ej.read_results(spark, root, "updates")).collect()
    assert {r.content for r in after if r.event_id == 5} == {"bleibt"} and "alt" not in {r.content for r in after if r.event_id == 1}
    stored = spark.createDataFrame([(1, "rule", "낮음"), (1, "gemini", "높음"), (9, "rule", "보통")], "event_id BIGINT, source STRING, benefit_level STRING")
    kept = {(r.event_id, r.source): r.benefit_level for r in ej.insights_after(stored, ej.read_results(spark, root, "insights")).collect()}
    assert set(kept) == {(1, "rule"), (1, "gemini"), (2, "gemini"), (7, "rule"), (9, "rule")} and kept[1, "gemini"] == "높음"


def test_a_repeated_batch_writes_the_same(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    none = spark.createDataFrame([], LOCKS)
    tables = ("updates", "sections", "insights", "snapshots", "jobs")
    read = lambda: {t: sorted(map(str, ej.read_results(spark, root, t).collect())) for t in tables}
    ej.run_batch(promotions(spark), landed(spark, 2), none, P, root, 0, moment(1))
    first = read()
    # the run is repeated later, over other pages: its staged rows decide
    ej.run_batch(promotions(spark), landed(spark, 5), none, P, root, 0, moment(20))
    assert read() == first and first["snapshots"]


def test_empty_tables(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    ej.run_batch(promotions(spark).where("false"), landed(spark, 0), spark.createDataFrame([], LOCKS), P, root, 0, moment(1))
    assert ej.read_results(spark, root, "jobs").count() == 0


def test_backfilled_children(spark):
    rows = [(1, '{"혜택_상세":["a",""],"x":"b"}', '{"benefit_level":"높음"}'), (2, "{}", "broken"), (3, None, None), (4, '{"혜택_상세":["c"]}', '{"혜택_수준":"보통"}')]
    events = spark.createDataFrame(rows, "id BIGINT, marketing_content STRING, marketing_insights STRING")
    have = spark.createDataFrame([(4,)], "event_id BIGINT")
    got = sorted((r.event_id, r.section_type, r.content, r.sort_order) for r in ej.backfilled_sections(events, have, P).collect())
    assert got == [(1, "x", "b", 1), (1, "혜택_상세", "a", 0)]
    assert [(r.event_id, r.benefit_level, r.source) for r in ej.backfilled_insights(events, have).collect()] == [(1, "높음", "rule")]


def test_direct_entries_take_the_path_of_collected_ones(spark):
    rows = [{"url": u, "company": "A", "title": t, "period": "2026.2.1 ~ 2026.3.31", "benefit_value": "1만원", "conditions": ""}
            for u, t in (("https://x/1", "하나"), ("https://x/1?utm_source=z", "또 하나"), ("https://x/2", " 둘 "), ("", "셋"), ("https://x/4", ""))]
    entries = feeds.direct_entries(spark, [{**dict.fromkeys(schemas.RAW_FIELDS), **r} for r in rows]).withColumns(
        {"base_url": F.lit(""), "arrival": F.monotonically_increasing_id()})
    stored = spark.createDataFrame([("https://x/1",)], "url STRING")
    got = ingest.direct_entry(entries, stored, [F.asc("arrival")], P).collect()
    assert [(r.url, r.title, r.period, r.benefit_amount_won, r.conditions, r.status) for r in got] == [
        ("https://x/2", "둘", "2026.02.01~2026.03.31", 10000, None, "active")]


def test_only_promotions_with_a_page_are_read_whole(spark):
    events, none = promotions(spark), spark.createDataFrame([], LOCKS)
    texts = spark.createDataFrame([(2, '{"benefit_level":"중상"}'), (4, '{"benefit_level":"높음"}'), (7, "no answer")], "id BIGINT, response STRING")
    asked = []

    def lookup(ids):
        asked.append(sorted(r.id for r in ids.collect()))
        return events.join(ids, "id", "left_semi")

    rows = ej.staged(events.union(events.where("id = 4")), landed(spark, 5), none, P, moment(1), texts, events.select("id", "url"), lookup)
    got = sorted((r.id, r.action, r.error, r.source, r.result is not None) for r in rows.collect())
    assert asked == [[1, 2, 7]]
    # two equal promotions without a page: one row for each pair of them and its stored rows, as where there is one
    assert got == [(1, "extract", None, "rule", True), (2, "extract", None, "gemini", True), (3, "failed", None, None, False)] + [
        (4, "extract", "no page", None, False)] * 8 + [(7, "extract", None, "rule", True)]
