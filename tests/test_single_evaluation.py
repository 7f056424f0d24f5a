"""Costly texts and patterns are computed once per row and in forms that are cheap per character."""

import re
from datetime import date

from pyspark.sql import functions as F

from promolens import Params, Vocabulary
from promolens.functions import dom, rows, text, urls
from promolens.operators import analytics, scoring
from promolens.plans import text_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_comparison_key_is_as_before_in_listed_characters(spark):
    odd = ["", None, "A-b 1", "가힣ᄀ나", "é٣Ⅷ", "ＫK", "😀x\U0001d400", "İ", *(chr(c) + "z" for c in range(256))]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    got = [r[0] for r in df.select(text.comparison_key(F.col("v"))).collect()]
    assert got == [re.sub("[^0-9A-Za-z가-힣]+", "", v or "").lower() for v in odd]
    assert "0-9" not in plan(df.select(text.comparison_key(F.col("v"))))


def test_keyword_blocks_reads_the_lines_once(spark, tmp_path):
    text_rows = [(1, "Nothing said, the motion and the station are for all. Short."), (2, None), (3, "zzz zzz zzz")]
    spark.createDataFrame(text_rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = text_queries.QUERIES["keyword_blocks"](spark, str(tmp_path))
    assert plan(df).count("가-힣]+") == 2  # the key of the lines and the key of the blocks
    assert [r.doc_id for r in df.collect()] == [1]


def test_pages_are_parsed_in_small_slices(spark):
    """A batch of 40 pages of 16 k characters comes back in several record batches, whole and in order."""
    rows = [(i, f"<p>{i}</p>" + "<b>x</b>" * 2048) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    got = dom.parsed(pages).select("page_id", F.col("dom.blocks")[0]["text"].alias("t"), F.size("dom.nodes").alias("n"))
    assert [tuple(r) for r in got.collect()] == [(i, str(i), 2 + 2 * 2048) for i in range(40)]
    parts = dom.parsed(pages).mapInArrow(lambda batches: batches, dom.parsed(pages).schema)
    assert parts.count() == 40 and dom.SLICE_CHARS <= 1 << 17


def test_rule_pools_are_joined_once(spark):
    fields = "id long, title string, benefit_value string, conditions string, target_segment string, raw_text string"
    rows = [
        (1, "신규 여행", "10% 할인", "앱 응모", "VIP 카드 회원", "온라인 Pay"), (2, None, None, None, None, None),
        (3, "a", "1만원", "b", "전체 고객 신한카드", "매장 기존"),
    ]
    df = spark.createDataFrame(rows, fields).withColumn("marketing_content", F.lit(None).cast("map<string,array<string>>"))
    got = {r.id: r for r in scoring.rule_insights(df, Vocabulary()).collect()}
    assert got[1].objective_tags == ["신규유치", "디지털전환"] and got[1].channel_tags == ["앱", "웹", "간편결제"]
    assert got[1].target_tags == ["VIP"]
    assert got[2].objective_tags == [] and got[2].target_tags == ["전연령"] and got[2].promo_strategies == ["기본 혜택 유지형"]
    assert got[3].channel_tags == ["오프라인"]
    text_plan = plan(scoring.rule_insights(df, Vocabulary()).select("objective_tags", "channel_tags", "target_tags"))
    assert text_plan.count("concat_ws") <= 6


def test_computed_once_evaluates_outside_the_generator(spark):
    df = spark.createDataFrame([(1, " a  b "), (2, None), (3, "")], "id long, v string")
    once = rows.computed_once(df, {"v": text.clean_text(F.col("v")), "n": F.length("v")}).where(F.col("v") != "")
    generator = next(line for line in plan(once).splitlines() if "Generate" in line)
    assert "regexp_replace" not in generator and plan(once).count("regexp_replace") == 1
    assert [tuple(r) for r in once.collect()] == [(1, "a b", 6)] and once.columns == ["id", "v", "n"]


def test_searched_text_of_a_profile_is_joined_once(spark):
    names = "company title category period benefit_value conditions target_segment one_line_summary raw_text threat_level status marketing_content marketing_insights"
    schema = "id long, " + ", ".join(f"{n} string" for n in names.split()) + (
        ", period_start date, period_end date, benefit_amount_won long, benefit_pct double, created_at timestamp")
    row = (1, "A", "여행 할인", "c", "2026.01.01~2026.02.01", "1만원", "매월", "VIP", "s", "정기", "High", "active", None, None)
    events = spark.createDataFrame([(*row, None, None, 10000, 0.0, None)], schema)
    found = analytics.company_snapshot(events, Params(as_of=date(2026, 2, 1), focal="A"))
    text_plan = plan(found)
    assert text_plan.count("concat_ws") == 1
    got = found.first()
    assert (got.high_value_hits, got.recurring_hits, got.repeat_hits, got.high_threat_count) == (1, 1, 1, 1)


def test_column_strip_is_ustrip(spark):
    ends = ["", *text.EDGE_CHARS, "x", "가", "\x7f", "\x80", "​", "、", "😀", "!"]
    df = spark.createDataFrame([(a + m + b,) for a in ends for b in ends for m in ("", "k k")] + [(None,)], "v string")
    assert df.where(~text.column_strip(F.col("v")).eqNullSafe(text.ustrip(F.col("v")))).count() == 0


def test_addresses_by_short_ways(spark):
    base = "https://www.example.com/mob/list/main.shc?src=R01#x"
    cases = {
        "/a/./b/../c?b=2&a=1&utm_source=x#f": "https://www.example.com/a/c?a=1&b=2", "../e?id= 7 ": "https://www.example.com/mob/e?id=7",
        "/p.q?k=%20a+b%21~&=1&&z": "https://www.example.com/p.q?k=a+b%21~&z=", "https://h?x=*&y=a=b#": "https://h?x=%2A&y=a%3Db",
        "HTTP://H/p": "http://H/p", "http:///p": "", "https://": "", "https://?a": "", "javascript:x": "", "JavaScript:x": "", "": "",
        "?q=1": "https://www.example.com/mob/list/main.shc?q=1", "#t": "https://www.example.com/mob/list/main.shc?src=R01", "//o.org/?": "https://o.org/",
        "x": "https://www.example.com/mob/list/x", "/a?u=/../b": "https://www.example.com/a?u=%2F..%2Fb", "/a?b=%zz": "https://www.example.com/a?b=%25zz",
    }
    df = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r[0]: r[1] for r in df.select("v", urls.normalise_url(F.col("v"), F.lit(base), Vocabulary())).collect()}
    assert got == cases
