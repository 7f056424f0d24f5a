import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

import seed
from promolens import Params, Vocabulary
from promolens.functions import records
from promolens.operators import analytics as an
from promolens.operators import filters, history, ingest, mutations, responses, scoring, structure
from promolens.operators.ranking import miss_run_cutoff, with_previous
from promolens.sources import feeds, pages

P = Params(as_of=dt.date(2026, 2, 15), focal="신한카드")
V = Vocabulary()


def seeded(spark):
    df = spark.createDataFrame(seed.ROWS, seed.FIELDS)
    extra = {c: F.lit(None).cast("string") for c in ("marketing_content", "marketing_insights", "benefit_type", "conditions", "target_segment", "raw_text")}
    full = df.withColumns(extra | {"one_line_summary": F.col("title"), "created_at": F.lit(dt.datetime(2026, 2, 14)).cast("timestamp_ntz")})
    return records.derive_fields(full, P.as_of)


def as_dict(rows, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in rows}


def test_statistics_on_seed(spark):
    rows = an.statistics(seeded(spark), P).collect()
    got = {(r.kind, r.key): r.n for r in rows}
    assert [got["company", c] for c in ("신한카드", "삼성카드", "현대카드", "KB국민카드")] == [3, 3, 2, 2]
    assert [got["threat", t] for t in ("High", "Mid", "Low")] == [5, 4, 1]
    assert got["category", "식음료"] == 3 and got["category", "쇼핑"] == 2 and got["total", ""] == 10


def test_category_gap_on_seed(spark):
    events = seeded(spark)
    assert as_dict(an.category_gap(events, P).collect(), "category", "competitor_count") == {
        "쇼핑": 2, "여행": 1, "교통": 1, "통신": 1, "문화": 1, "생활": 1
    }
    total = an.gap_totals(events, P).first()
    assert (total.total_active, total.focal_active) == (9, 2)


def test_benchmark_on_seed(spark):
    got = as_dict(an.benefit_benchmark(seeded(spark)).collect(), "company", "count", "avg_amount", "max_amount", "avg_pct", "max_pct")
    assert got == {
        "신한카드": (3, 10000, 20000, 0.0, 0.0), "삼성카드": (3, 103367, 300000, 50.0, 50.0),
        "현대카드": (1, 10000, 10000, 10.0, 10.0), "KB국민카드": (2, 16500, 30000, 7.0, 7.0),
    }


def test_demo_addresses_are_never_pending(spark):
    events = seeded(spark)
    assert ingest.pending_extraction(events).count() == 0
    assert ingest.pending_extraction(events.withColumn("url", F.upper("url"))).count() == 0


def test_gap_trend_opens_all_in_the_first_week(spark):
    rows = an.gap_trend(seeded(spark), P).orderBy("week_no").collect()
    assert len(rows) == 8 and rows[-1].gap_count == 6
    first = next(r for r in rows if r.gap_count)
    assert first.new_gap_count == first.gap_count


def test_rule_insight_shape_and_tags(spark):
    df = spark.createDataFrame(
        [(1, "신규 가입 시 5만원 캐시백", "5만원", "앱에서 응모", "신규 회원", "앱에서 가입", {"혜택_상세": ["5만원"]})],
        "id BIGINT, title STRING, benefit_value STRING, conditions STRING, target_segment STRING, raw_text STRING, marketing_content MAP<STRING, ARRAY<STRING>>",
    )
    r = scoring.rule_insights(df, V).first()
    assert r.benefit_level == "중상" and r.benefit_score == 3.0 and r.source == "rule"
    assert {"신규유치", "디지털전환"} <= set(r.objective_tags) and r.target_tags == ["신규"] and r.channel_tags == ["앱"]
    assert "고액 혜택" in r.competitive_points and r.section_coverage == 0.14


def test_section_coverage_bounds(spark):
    from promolens.functions.amounts import section_coverage

    full = {n: ["x"] for n in V.section_names}
    df = spark.createDataFrame([(full,), ({},), (None,)], "m MAP<STRING, ARRAY<STRING>>")
    assert [r[0] for r in df.select(section_coverage(F.col("m"), V.section_names)).collect()] == [1.0, 0.0, 0.0]


def test_feed_a_flattens_all_lists_and_drops_odd_items(spark):
    doc = '{"root":{"evnlist":[{"mobWbEvtNm":"여름 혜택전","hpgEvtDlPgeUrlAr":"/evt/1"},"x",3]},"mbw_json":{"ingEvtList":[{"evtImgSlTilNm":"둘째","evtDtlUrl":"/evt/2"}],"evtList":"no"}}'
    docs = spark.createDataFrame([(doc,), ("broken",), ("{}",)], "payload STRING")
    staged = feeds.feed_a_records(feeds.feed_a_items(docs), "A", "https://www.example.com/list", V)
    got = records.accepted(records.build_records(staged, V)).collect()
    assert sorted((r.url, r.title) for r in got) == [("https://www.example.com/evt/1", "여름 혜택전"), ("https://www.example.com/evt/2", "둘째")]


def test_list_page_with_call_links(spark):
    html = """<div id="main_contents"><a href="javascript:goDetail('1000096', 'x')"><div class="evtlist-desc"><span class="tit">봄 이벤트 할인</span></div><em>2026.1.9(금) ~ 2.8(일)</em></a></div>"""
    df = spark.createDataFrame([(1, "u", html)], "page_id BIGINT, url STRING, html STRING")
    r = records.accepted(records.build_records(pages.call_links(df, "B", "https://card.example.com/list", V), V)).collect()
    # The end borrows the start year and its own first part reads as the month, as in the source feed.
    assert len(r) == 1 and "eventNum=1000096" in r[0].url and r[0].title == "봄 이벤트 할인" and r[0].period == ""


def test_dedupe_and_insert_first_wins(spark):
    batch = spark.createDataFrame([(2, "b", "t", "p", "1원"), (1, "a", "t", "p", "2원"), (3, "a", "t", "p", "3원")], "arrival BIGINT, url STRING, title STRING, period STRING, benefit_value STRING")
    stored = spark.createDataFrame([("b",)], "url STRING")
    new = ingest.insert_if_new(batch, stored, [F.asc("arrival")], P).collect()
    assert [(r.arrival, r.url, r.benefit_amount_won) for r in new] == [(1, "a", 2)]


def test_update_rules(spark):
    base = seeded(spark)
    upd = spark.createDataFrame([(1, None, "2026.03.01~2026.03.02", "9만원"), (2, "new", "bad", None)], "id BIGINT, title STRING, period STRING, benefit_value STRING")
    got = {r.id: r for r in mutations.apply_updates(base, upd, P).where("id <= 3").collect()}
    assert got[1].title == "커피 할인" and got[1].period_end == dt.date(2026, 3, 2) and got[1].benefit_amount_won == 5000
    assert got[2].title == "new" and got[2].period == "bad" and got[2].period_end == dt.date(2026, 4, 30)
    assert got[3].title == "쇼핑 할인"


def test_lock_toggle(spark):
    stored = spark.createDataFrame([(1, True)], "event_id BIGINT, is_locked BOOLEAN")
    ts = dt.datetime(2026, 1, 1)
    req = spark.createDataFrame([(1, 1, "a", ts), (2, 2, "b", ts), (3, 3, "c", ts), (3, 4, "d", ts)], "event_id BIGINT, seq BIGINT, locked_by STRING, locked_at TIMESTAMP_NTZ")
    assert as_dict(history.toggle_locks(stored, req).collect(), "event_id", "is_locked") == {1: False, 2: True, 3: False}


def reference_cutoff(outcomes, limit):
    """Plain scan, for comparison."""
    run = 0
    for i, o in outcomes:
        if o == "miss":
            run += 1
        elif o == "junk":
            run = 1
        else:
            run = 0
        if o in ("miss", "junk") and run >= limit:
            return i
    return None


def test_miss_run_cutoff_against_a_scan(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for s in range(12):
        ids = sorted(rng.sample(range(400), 150))
        seq = [(i, rng.choices(["miss", "hit", "short", "junk"], [8, 1, 1, 0.5])[0]) for i in ids]
        rows += [(f"s{s}", i, o) for i, o in seq]
        want[f"s{s}"] = reference_cutoff(seq, 12)
    df = spark.createDataFrame(rows, "source STRING, id BIGINT, outcome STRING")
    for width in (7, 50, 1000):
        got = miss_run_cutoff(df, "source", "id", F.col("outcome").isin("miss", "junk"), F.col("outcome") != "miss", 12, width)
        assert as_dict(got.collect(), "source", "stop_id") == {k: v for k, v in want.items() if v is not None}


def test_with_previous_across_buckets(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["x", "y", None])) for k in range(3) for i in sorted(rng.sample(range(100), 40))]
    got = with_previous(spark.createDataFrame(rows, "k INT, i INT, v STRING"), ["k"], F.floor(F.col("i") / 9), ["i"], "v", "p").collect()
    want = {}
    for k, grp in itertools.groupby(rows, key=lambda r: r[0]):
        before, known = None, False
        for _, i, v in grp:
            want[k, i] = (before, known)
            before, known = v, True
    assert {(r.k, r.i): (r.p, r["_has_previous"]) for r in got} == want


def test_json_part_of_answers(spark):
    rows = ['```json\n{"benefit_level":"높음"}\n```', 'text {"benefit_level":"보통"} end', "none", "", None, '```json\n{"benefit_level":', "[1]"]
    df = spark.createDataFrame(list(enumerate(rows)), "id BIGINT, response STRING")
    got = as_dict(responses.parse_responses(df).select("id", "answer.benefit_level").collect(), "id", "benefit_level")
    assert got == {0: "높음", 1: "보통", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_page_extraction(spark):
    html = (
        "<html><head><title>x</title></head><body><nav>메뉴 이벤트 목록 바로가기</nav><article><h1>여름 여행 할인 혜택</h1>"
        "<p>이벤트 기간 2026.02.11(수) ~ 02.28</p><p>전 고객 5만원 캐시백 혜택 제공</p><p>앱에서 응모 후 결제하면 참여 완료됩니다</p>"
        "<p>대상카드: 신용카드 전체 회원</p><p>개인정보 수집 동의 안내 문구입니다</p></article><footer>대표전화 안내</footer></body></html>"
    )
    df = spark.createDataFrame([(1, "u", html)], "page_id BIGINT, url STRING, html STRING")
    r = structure.extract_pages(df, V).first()
    assert r.title == "여름 여행 할인 혜택" and r.period == "2026.02.11~2026.02.28" and r.benefit_type == "할인"
    assert "5만원 캐시백" in r.benefit_value and "앱에서 응모" in r.conditions and r.target_segment.startswith("대상카드")
    assert r.marketing_content["혜택_금액"] == ["5만원"] and "개인정보" not in r.raw_text
    assert any("앱에서 응모" in t for t in r.marketing_content["참여방법"])


def test_digest_drops_repeats_and_reads_tables(spark):
    html = "<body><h1>제목입니다</h1><article><p>같은 줄</p><p>같은 줄</p></article><table><tr><th>구분</th><td>혜택</td></tr></table><ul><li>목록 항목 하나</li></ul></body>"
    df = spark.createDataFrame([(1, "u", html)], "page_id BIGINT, url STRING, html STRING")
    lines = structure.page_digest(df).first().lines
    assert lines.count("같은 줄") == 1 and "구분 | 혜택" in lines and "- 목록 항목 하나" in lines and lines[0] == "[제목] 제목입니다"


def test_digest_of_a_long_page_is_whole(spark):
    tables = "".join(f"<table><tr><th>표 {i}</th><td>혜택 {i}</td></tr></table>" for i in range(6))
    lists = "".join(f"<ul><li>목록 항목 번호 {i}</li></ul>" for i in range(8))
    long = "<ol>" + "".join(f"<li>긴 목록 항목 {i}</li>" for i in range(40)) + "</ol>"
    images = "".join(f'<img alt="행사 안내 그림 {i}">' for i in range(20))
    html = f"<body><article><p>{'가' * 9000}</p></article>{tables}{lists}{long}{images}</body>"
    df = spark.createDataFrame([(1, "u", html)], "page_id BIGINT, url STRING, html STRING")
    r = structure.page_digest(df).first()
    for line in ("표 5 | 혜택 5", "- 목록 항목 번호 7", "- 긴 목록 항목 39", "- 행사 안내 그림 19", "가" * 9000):
        assert line in r.lines
    assert r.digest == "\n".join(r.lines)
    short = structure.page_digest(df, max_chars=100).first()
    assert short.lines == r.lines and short.digest == r.digest[:100] + "\n...(내용 생략)"


def test_focal_contains_variant(spark):
    loose = Params(as_of=P.as_of, focal="신한", focal_match="contains")
    assert an.category_gap(seeded(spark), loose).count() == 6
    assert filters.event_list(seeded(spark), P, company="신한카드").count() == 3


def test_long_values_stay_whole(spark):
    start = "카드 이용 조건 안내 " * 20
    long = "이벤트 기간 중 결제 시 캐시백 " * 700
    lines = [start + "국내 가맹점", start + "해외 가맹점", long.strip()]
    df = spark.createDataFrame([("\n".join(lines),)], "t STRING")
    got = df.select(structure.candidate_lines(F.col("t"), V)).first()[0]
    assert set(got) >= set(lines)
    staged = spark.createDataFrame([("A", "https://www.example.com/l", f"/e/{i}", f"오퍼 {i}", "2026.02.01~2026.03.31", long) for i in range(300)],
                                   "company STRING, base_url STRING, url STRING, title STRING, period STRING, raw_text STRING")
    rows = records.build_records(staged, V).withColumn("arrival", F.col("title"))
    assert rows.where(F.length("raw_text") == len(long.strip())).count() == 300
    assert ingest.ingest_run(rows, spark.createDataFrame([], "url STRING"), [F.asc("arrival")], P).count() == 300
    two = Params(as_of=P.as_of, focal=P.focal, ingest_limit_per_company=2)
    assert ingest.ingest_run(rows, spark.createDataFrame([], "url STRING"), [F.asc("arrival")], two).count() == 2


def test_prompts_keep_everything(spark):
    from promolens.operators import responses

    long = "x" * 5000
    row = (1, "A", "t", "", long, long, None, long, {"other": ["o"], "benefit": [str(i) * 300 for i in range(9)], "none": []})
    df = spark.createDataFrame([row, (2, None, None, None, None, None, None, None, None)], """id long, company string, title string, period string,
        target_segment string, benefit_value string, conditions string, raw_text string, marketing_content map<string,array<string>>""")
    got = as_dict(responses.request_table(df, ["benefit", "absent"]).collect(), "id", "prompt")
    assert got[1].count(long) == 3 and "[benefit] " + " / ".join(str(i) * 300 for i in range(9)) + "\n[other] o\n" in got[1]
    assert "섹션 데이터 없음" in got[2]


def test_hybrid_insights_keep_the_answer(spark):
    from promolens.operators import responses, scoring

    empty = "array<string>"
    rules = spark.createDataFrame([(1, "낮음", 1.0, "낮음", [], [], [], [], [], None, 0.5, "rule"), (2, "낮음", 1.0, "낮음", ["p"], [], [], [], [], None, 0.5, "rule")], f"""
        id long, benefit_level string, benefit_score double, target_clarity string, competitive_points {empty}, promo_strategies {empty},
        objective_tags {empty}, target_tags {empty}, channel_tags {empty}, insight_threat string, insight_confidence double, source string""")
    answer = '{"benefit_level":"높음","threat_reason":"r","evidence":["e"],"weaknesses":["w"],"shinhan_response":"s"}'
    parsed = responses.parse_responses(spark.createDataFrame([(1, answer), (2, "broken")], "id long, response string"))
    got = {r.id: r for r in scoring.hybrid_insights(rules, parsed).collect()}
    assert (got[1].threat_reason, got[1].evidence, got[1].weaknesses, got[1].shinhan_response, got[1].benefit_score) == ("r", ["e"], ["w"], "s", 4.0)
    assert (got[2].threat_reason, got[2].evidence, got[2].source, got[2].competitive_points) == (None, [], "rule", ["p"])


def test_page_lists_are_whole(spark):
    from promolens.sources import captures, pages
    from promolens.vocabulary import Vocabulary

    items = "".join(f"<li><h3>이벤트 {i} 안내</h3><a href='view.do?id={i}'>x</a></li>" for i in range(80)) + "<li><h3>이벤트 script</h3><a href='javascript:go(1)'>x</a></li>"
    df = spark.createDataFrame([(1, "https://a.example/x/list.do", items)], "page_id long, url string, html string")
    got = pages.container_records(df, "A", "https://a.example/x/list.do").orderBy("position").collect()
    assert len(got) == 81 and got[3].url == "https://a.example/x/view.do?id=3" and got[80].url == "https://a.example/x/list.do"
    assert pages.container_records(df, "A", "https://a.example/x/list.do", per_page=5).count() == 5
    html = "".join(f'<a href="/url?q=https://www.kbcard.com/event/{i}&x">y</a>' for i in range(30))
    assert captures.search_hits(spark.createDataFrame([("q", html)], "query string, html string"), Vocabulary()).count() == 30


def test_normalised_addresses(spark):
    from promolens.functions import urls
    from promolens.vocabulary import Vocabulary
    from pyspark.sql import functions as F

    cases = {
        "HTTPS://A.example/p?b=2&a=1&utm_source=x#frag?no": "https://A.example/p?a=1&b=2", "https://a.example?": "https://a.example",
        "https://a.example/p?x=a:b/c?d": "https://a.example/p?x=a%3Ab%2Fc%3Fd", "view.do?id=3": "https://h.example/d/view.do?id=3",
        "/x:y?utm_source=1": "https://h.example/x:y", "javascript:go(1)": "", "https:///p": "", "": "", "//o.example/q#f": "https://o.example/q",
        "#top": "https://h.example/d/list.do", "ftp:x": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    got = df.select("u", urls.normalise_url(F.col("u"), F.lit("https://h.example/d/list.do"), Vocabulary()).alias("n")).collect()
    assert as_dict(got, "u", "n") == cases
