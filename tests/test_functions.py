import datetime as dt

import pytest
from pyspark.sql import functions as F

from promolens import Vocabulary
from promolens.functions import amounts, markup, periods, records, text, urls

V = Vocabulary()
D = dt.date


def values(spark, rows, expr, schema="t STRING"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expr.alias("x")).collect()]


def test_period_dates(spark):
    cases = {
        "2026.02.01~2026.03.31": (D(2026, 2, 1), D(2026, 3, 31)),
        "26.02.01~26.03.31": (D(2026, 2, 1), D(2026, 3, 31)),
        "2026-02-01~2026-12-31": (D(2026, 2, 1), D(2026, 12, 31)),
        "2026.02.05~2026.02.29": (None, None),
        "2026. 2. 1~2026. 2. 28": (None, None),
        "~2026.02.28": (None, None),
        "정보 없음": (None, None),
        "": (None, None),
        None: (None, None),
    }
    got = values(spark, list(cases), periods.period_dates(F.col("t")))
    assert [tuple(g) for g in got] == list(cases.values())


def test_benefit_amount_and_pct(spark):
    cases = {
        "5,000원": (5000, None), "30만원": (300000, None), "10%": (None, 10.0), "10% (최대 1만원)": (10000, 10.0),
        "리터당 100원 (월 최대 5,000원)": (100, None), "2.5만원": (50000, None), "3만5천원": (5000, None),
        "5천만원": (None, None), "5 천 원": (5000, None), "": (None, None), None: (None, None),
    }
    got = values(spark, list(cases), F.struct(amounts.benefit_amount(F.col("t")), amounts.benefit_pct(F.col("t"))))
    assert [tuple(g) for g in got] == list(cases.values())


def test_status(spark):
    today = D(2026, 3, 1)
    got = values(spark, [D(2099, 12, 31), D(2026, 3, 1), D(2020, 1, 1), None], periods.status_at(F.col("t"), today), "t DATE")
    assert got == ["active", "active", "ended", "unknown"]


def test_amount_regex_takes_at_most_nine_characters(spark):
    assert values(spark, ["1,000,000,000원"], amounts.max_amount(amounts.all_amounts(F.col("t")))) == [0]


def test_all_figures(spark):
    got = values(spark, ["10 만 원 또는 3,000원, 10 만 원; 5％ 12.5퍼센트 5%"], F.struct(amounts.all_amounts(F.col("t")), amounts.all_percentages(F.col("t"))))
    assert [list(x) for x in got[0]] == [["10만원", "3,000원"], ["5%", "12.5%"]]


def test_normalise_url(spark):
    base = F.lit("https://www.example.com/dir/list.do?p=1")
    cases = {
        "https://example.com/detail?utm_source=x&b=2&a=1&searchWord=": "https://example.com/detail?a=1&b=2",
        "../x/./y?q=1 2&UTM_SOURCE=z#f": "https://www.example.com/x/y?q=1+2",
        "/a/b": "https://www.example.com/a/b", "?z=1": "https://www.example.com/dir/list.do?z=1",
        "//h.com/p": "https://h.com/p", "page.html": "https://www.example.com/dir/page.html",
        "javascript:go()": "", "MAILTO:a@b.c": "", "": "", None: "",
        "https://x.com/a?k=*~%20&flag": "https://x.com/a?flag=&k=%2A~",
        "HTTPS://X.com/a?b=2&b=1": "https://X.com/a?b=1&b=2",
    }
    assert values(spark, list(cases), urls.normalise_url(F.col("t"), base, V)) == list(cases.values())


def test_compact_period(spark):
    rows = [("20260201", "20260331"), ("20260201", None), (None, "2026-03-31"), ("x", "1")]
    got = values(spark, rows, periods.period_from_compact(F.col("a"), F.col("b")), "a STRING, b STRING")
    assert got == ["2026.02.01~2026.03.31", "2026.02.01", "2026.03.31", ""]


def test_three_period_dialects_differ(spark):
    rows = ["2026. 2. 1~2026. 2. 28", "2026.1.9(금) ~ 2.8(일)", "26.2.1∼126.3.1", "2026년 2월 11일 ~ 2026년 5월 31일"]
    c = F.col("t")
    got = values(spark, rows, F.struct(periods.canonical_period(c), periods.page_date_range(c)))
    assert [tuple(g) for g in got] == [
        ("2026. 2. 1~2026. 2. 28", "2026.02.01~2026.02.28"),
        ("2026.1.9(금) ~ 2.8(일)", "2026.01.09~2026.02.08"),
        ("2026.02.01~2026.03.01", "2026.02.01~0126.03.01"),
        ("2026년 2월 11일 ~ 2026년 5월 31일", "2026.02.11~2026.05.31"),
    ]


def test_week_label_matches_the_calendar(spark):
    days = [D(2019, 1, 1) + dt.timedelta(days=i) for i in range(0, 2920, 3)]
    assert values(spark, days, periods.week_label(F.col("t")), "t DATE") == [d.strftime("%Y-W%W") for d in days]


def test_unicode_space_is_stripped(spark):
    got = values(spark, ["　a  b  ", None], F.struct(text.ustrip(F.col("t")), text.clean_text(F.col("t"))))
    assert tuple(got[0]) == ("a  b", "a b") and tuple(got[1]) == (None, "")


def test_meaningful_needs_a_period(spark):
    rows = [("커피", "2026.02.01~2026.03.31"), ("커피", ""), ("커피", "정보 없음"), ("제목 없음", "x"), (None, "x"),
            ("이벤트에 응모되었습니다!", "x"), ("마이홈 앱의 자산 연결", "x"), ("커피", "~2026.03.31")]
    got = values(spark, rows, text.is_meaningful(F.col("a"), F.col("b"), V), "a STRING, b STRING")
    assert got == [True, False, False, False, False, False, False, True]


def test_start_less_period_keeps_two_readings(spark):
    c = F.col("t")
    got = values(spark, ["~2026.03.31"], F.struct(periods.period_dates(c)["end"], periods.lenient_end_date(F.lit(None).cast("date"), c)))
    assert tuple(got[0]) == (None, D(2026, 3, 31))


def test_tags_only_from_json_arrays(spark):
    rows = ['["a","b"]', '"abc"', "oops", "", None, "[]", '{"a":1}']
    assert values(spark, rows, records.tag_array(F.col("t"))) == [["a", "b"], [], [], [], [], [], []]


def test_insight_keys_new_and_legacy(spark):
    rows = ['{"benefit_level":"높음","competitive_points":["p"]}', '{"혜택_수준":"보통","경쟁력_포인트":["q"]}', "broken"]
    c = records.insight_struct(F.col("t"))
    got = values(spark, rows, F.struct(c["benefit_level"], c["competitive_points"]))
    assert [tuple(g) for g in got] == [("높음", ["p"]), ("보통", ["q"]), (None, [])]


@pytest.mark.parametrize("n,d,want", [(1, 8, 12), (3, 8, 38), (1, 0, 0), (2, 3, 67)])
def test_rate_rounds_half_even(spark, n, d, want):
    assert values(spark, [(n, d)], amounts.rate(F.col("a"), F.col("b")), "a INT, b INT") == [want]


def test_header_notification_noise(spark):
    rows = ["신한카드 혜택 안내문", "이벤트에 응모되었습니다 감사", "개인정보 수집 동의 할인", "고유식별정보 처리 할인 혜택", "법령에 따른 안내 문구"]
    c = F.col("t")
    got = values(spark, rows, F.struct(text.is_header_like(c, V), text.is_notification(c, V), text.is_noise(c, V)))
    assert [tuple(g) for g in got] == [
        (True, False, False), (False, True, False), (False, False, True), (False, False, False), (False, False, True)
    ]


def test_distinct_by_key_keeps_first(spark):
    got = values(spark, [(["abc def", "ABC-DEF", "x y z", "", "q"],)], text.distinct_by_key(F.col("t"), text.comparison_key), "t ARRAY<STRING>")
    assert got == [["abc def", "x y z", "q"]]


def test_text_blocks(spark):
    html = "<html><body><!-- x --><script>a<b</script><div>A <b>b</b>&amp;c<p>two<br>three</p></div></body></html>"
    bare = markup.drop_elements(F.col("t"), ("script",))
    assert values(spark, [html], markup.text_blocks(bare)) == [["A b&c", "two", "three"]]


def test_long_page_does_not_overflow(spark):
    html = "<article><p>" + "word " * 200_000 + "</p><script>" + "x" * 300_000 + "</script></article>"
    bare = markup.drop_elements(F.col("t"), ("script", "style"))
    got = values(spark, [html], F.length(F.array_join(markup.text_blocks(bare), "")))
    assert got == [999_999]


def test_any_white_space_in_periods_and_amounts(spark):
    for b in (" ", "　", " ", "\x0b", "\x85"):
        got = values(spark, [f"2026.02.01{b}~{b}2026.03.31"], periods.period_dates(F.col("t")))
        assert tuple(got[0]) == (D(2026, 2, 1), D(2026, 3, 31))
        assert values(spark, [f"2026년{b}2월 1일{b}~ 2026년 3월{b}31일"], periods.page_date_range(F.col("t"))) == values(
            spark, ["2026년 2월 1일 ~ 2026년 3월 31일"], periods.page_date_range(F.col("t")))
        assert values(spark, [f"5{b}만{b}원"], amounts.all_amounts(F.col("t"))) == [["5만원"]]
        assert values(spark, [f"10{b}%"], amounts.all_percentages(F.col("t"))) == [["10%"]]


def test_attributes_in_any_quotes_and_order(spark):
    tags = ['<a href="/e/1">', "<a class=x href='/e/1'>", "<a data-href='/no' href=/e/1>", "<a HREF = \"/e/1\">"]
    assert values(spark, tags, markup.attribute(F.col("t"), "href")) == ["/e/1"] * 4
    assert values(spark, ["<a>"], markup.attribute(F.col("t"), "href")) == [""]
    heads = ['<meta property="og:title" content="T">', "<meta content='T' property='og:title'/>", "<meta name=x content=y><meta property=og:title content=T>"]
    assert values(spark, heads, markup.meta_content(F.col("t"), "og:title")) == ["T"] * 3
    assert values(spark, ["<meta name=x content=y>"], markup.meta_content(F.col("t"), "og:title")) == [None]


def test_content_map_with_single_values(spark):
    got = values(spark, ['{"a": ["x", "y"], "b": "one", "c": 5, "d": null, "e": []}', "{broken", "", None], records.content_map(F.col("t")))
    assert got == [{"a": ["x", "y"], "b": ["one"], "c": ["5"], "d": None, "e": []}, None, None, None]
