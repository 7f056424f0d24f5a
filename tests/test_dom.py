"""Pages as element arrays, and the page operators on nested markup."""

import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from promolens.functions import dom
from promolens.operators import structure
from promolens.sources import pages
from promolens.vocabulary import Vocabulary

V = Vocabulary()
SITE = "https://card.example.com/list"


def page(spark, *htmls):
    return spark.createDataFrame([(i, f"https://x.example/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def tree(spark, html, drop=""):
    return dom.parsed(page(spark, html), drop).first().dom


def value(spark, html, column, drop="script style"):
    return dom.parsed(page(spark, html), drop).select(column.alias("v")).first().v


def test_nested_elements_end_where_they_end(spark):
    got = tree(spark, "<div id=a><div class='x y'>in<div>deep</div>after</div>tail</div>end")
    inner = next(n for n in got.nodes if n.classes == ["x", "y"])
    assert [n.text for n in got.nodes[inner.i + 1: inner.last + 1] if n.tag == "#text"] == ["in", "deep", "after"]
    assert got.nodes[inner.up].id == "a" and got.nodes[-1].up == -1
    assert [b.text for b in got.blocks] == ["in", "deep", "after", "tail", "end"]


def test_tags_that_close_by_themselves(spark):
    d = F.col("dom")
    html = "<ul><li>one<li>two<ul><li>in</ul><li>three</ul><p>a<p>b<table><tr><td>1<td>2<tr><td>3</table></section><p>c"
    assert value(spark, html, dom.texts_of(d, dom.select(d, "li"), " ")) == ["one", "two in", "in", "three"]
    assert value(spark, html, dom.texts_of(d, dom.select(d, "tr"), "|")) == ["1|2", "3"]
    assert value(spark, html, dom.texts_of(d, dom.select(d, "p"))) == ["a", "b", "c"]


def test_attributes_references_and_hidden_parts(spark):
    html = """<a HREF='/x?a=1&amp;b="q"' data-n=5 hidden>&#44032;&#xAC01;&hellip;&nbsp;&middot;</a><script>if (a<b) "</p><i>no"</script>
    <!-- <b>no</b> --><style>p{}</style><div id="gnb"><p>menu</p></div><p class="siteList">menu</p><p>yes</p>"""
    got = tree(spark, html, structure.HIDDEN)
    assert got.nodes[0].attrs == {"href": '/x?a=1&b="q"', "data-n": "5", "hidden": ""}
    assert [b.text for b in got.blocks] == ["가각… ·", "yes"]


def test_empty_and_broken_pages(spark):
    rows = dom.parsed(page(spark, None, "", "<", "plain", "</p></div>", "<p", "<div><span>open")).orderBy("page_id").collect()
    assert [[b.text for b in r.dom.blocks] for r in rows] == [[], [], ["<"], ["plain"], [], rows[5].dom.blocks and ["<p"] or [], ["open"]]
    assert dom.parsed(page(spark, "x").limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_arrays_describe_a_tree(spark, seed):
    rng = random.Random(seed)
    html = "".join(rng.choice(["<div>", "</div>", "<li class=a>", "</ul>", "<ul>", "<b>", "</b>", "<p>", "t", " ", "<br>", "<table><tr><td>"]) for _ in range(400))
    nodes = tree(spark, html).nodes
    for n in nodes:
        assert n.i <= n.last < len(nodes) and -1 <= n.up < n.i
        if n.up >= 0:
            assert nodes[n.up].last >= n.last and nodes[n.up].tag != "#text"

    class Texts(HTMLParser):
        got: list = []

        def handle_data(self, data):
            self.got += [data] if data.strip() else []

    plain = Texts()
    plain.got = []
    plain.feed(html)
    plain.close()
    assert [n.text for n in nodes if n.tag == "#text"] == plain.got


def test_selectors(spark):
    d = F.col("dom")
    html = "<div class=event-list><ul><li>a</li></ul></div><li>b</li><div class='event-box big'><h4 data-x=eventual>c</h4></div><a href=go(1)>d</a>"
    for selector, want in ((".event-list li", ["a"]), ("li, .big h4", ["a", "b", "c"]), ("[class*='event']", ["a", "c"]),
                           ("[data-x]", ["c"]), ("a[href^='go']", ["d"]), ("h4[data-x^='event'], div.big", ["c", "c"]), ("section", [])):
        assert value(spark, html, dom.texts_of(d, dom.select(d, selector))) == want, selector
    assert value(spark, html, dom.text_of(d, dom.enclosing(d, dom.first(dom.select(d, "h4")), ("div",)))) == "c"


def test_call_links_of_the_list_area_only(spark):
    link = "<a href=\"javascript:goDetail('{0}', 'x')\"><div class='evtlist-desc'><div><span class='tit'>봄 {0} <b>이벤트</b> 할인</span></div></div><em>2026.1.9(금) ~ 2026.2.8(일)</em></a>"
    html = link.format(1) + "<div id=main_contents><div><div>" + link.format(2) + "</div></div></div><ul class='eventList x'><li>" + link.format(3) + "</li></ul>"
    html += "<div id='main_contents'><a href=\"javascript:goDetail('4')\"><img alt='그림 제목 넷'></a><a href='javascript:other()'>no</a></div>"
    got = pages.call_links(page(spark, html), "B", SITE, V).orderBy("link_no").collect()
    assert [(r.url.rpartition("=")[2], r.title, r.period) for r in got] == [
        ("2", "봄 2 이벤트 할인", "2026.01.09~2026.02.08"), ("3", "봄 3 이벤트 할인", "2026.01.09~2026.02.08"), ("4", "그림 제목 넷", "")]


def test_block_links_take_the_nearest_block(spark):
    html = "<li>outer<div><p>여름 이벤트 혜택 | 2026.03.01 ~ 2026.04.01</p><a href='/evt/1'></a><div>inner</div></div></li><a href=/evt/2>바깥 이벤트</a>"
    got = pages.block_links(page(spark, html), "B", SITE, V).orderBy("link_no").collect()
    assert [(r.url, r.title, r.period, r.raw_text) for r in got] == [
        ("/evt/1", "여름 이벤트 혜택", "2026.03.01~2026.04.01", "여름 이벤트 혜택 | 2026.03.01 ~ 2026.04.01 inner"),
        ("/evt/2", "바깥 이벤트", "", "바깥 이벤트")]


def test_detail_titles_come_from_the_scopes_in_order(spark):
    first = "<article><h1>기사 제목입니다</h1></article><div class='my-event-x'><div><h3>행사 제목입니다</h3></div></div>"
    rows = [first, "<div class=content><h2>로그인</h2></div>" + first, first + "<main><p>x</p></main>", "<main><h2>메인 제목</h2></main>" + first,
            "<h1>범위 밖 제목</h1><meta content='공유 제목 | 삼성카드' property='og:title'>"]
    got = pages.detail_records(page(spark, *rows), "S").orderBy("page_id").collect()
    assert [r.title for r in got] == ["행사 제목입니다", "행사 제목입니다", "행사 제목입니다", "메인 제목", "공유 제목"]


def test_containers_by_class_and_nested(spark):
    html = "<div class='event-box'><div><h3>상자 이벤트</h3><div><p class=date>2026.1.1</p></div></div>뒤</div><div class=other><h3>아님 이벤트</h3></div>"
    html += "<div class='event-list'><ul><li><strong>목록 혜택</strong><ul><li><strong>안쪽 혜택</strong></li></ul>끝</li></ul></div>"
    got = pages.container_records(page(spark, html), "A", SITE).orderBy("position").collect()
    assert [(r.title, r.period, r.raw_text) for r in got] == [
        ("상자 이벤트", "2026.1.1", "상자 이벤트2026.1.1뒤"), ("목록 혜택", "정보 없음", "목록 혜택안쪽 혜택끝"), ("안쪽 혜택", "정보 없음", "안쪽 혜택")]
    only = pages.container_records(page(spark, html), "A", SITE, containers=".event-box")
    assert [r.title for r in only.collect()] == ["상자 이벤트"]


def test_extraction_of_nested_areas(spark):
    long = "전 회원 대상 " + "아주 긴 안내 " * 40
    html = f"""<body><div id=gnb><ul><li>할인 혜택 모음 전체 보기</li></ul></div><main><div class="event-detail"><h2>가을 여행 할인 혜택</h2>
      <div>기간 안내 <div><span>결제 금액의 <b>10%</b></span> <span>캐시백 혜택</span></div></div><ul><li>앱에서 응모 후 참여<ul><li>월 1회 한도 제한</li></ul></li></ul>
      <p>대상카드 {long}</p></div></main><footer>할인 문의</footer></body>"""
    t = structure.page_texts(page(spark, html), V).first()
    assert "결제 금액의 10% 캐시백 혜택" in t.containers and "앱에서 응모 후 참여 월 1회 한도 제한" in t.containers
    r = structure.extract_pages(page(spark, html), V).first()
    assert r.title == "가을 여행 할인 혜택" and "할인 혜택 모음" not in r.raw_text and "문의" not in r.raw_text
    assert "결제 금액의 10% 캐시백 혜택" in r.benefit_value and "앱에서 응모 후 참여 월 1회 한도 제한" in r.conditions
    assert r.target_segment == ("대상카드 " + long).strip() and len(r.target_segment) > 150
    assert r.marketing_content["혜택_비율"] == ["10%"]


def test_rendered_text_leads_and_markup_follows(spark):
    df = page(spark, "<main><p>본문 할인 혜택 안내입니다</p></main>").withColumn("shown", F.lit("화면에 보이는 긴 문장 하나입니다 " * 5))
    lines = structure.page_texts(df, V, "shown").first().page_lines
    assert len(lines) == 2 and lines[1] == "본문 할인 혜택 안내입니다"
    assert len(structure.page_texts(df, V, "shown", supplement_below=0.5).first().page_lines) == 1


def test_digest_of_nested_tables_and_lists(spark):
    html = "<h1>요약 제목</h1><div class=content><p>글</p></div><table><tr><td>a<table><tr><td>b</td></tr></table></td><td>c</td></tr></table><ul><li>x<ol><li>yy</li></ol></li></ul><img alt='작음'><img alt=\"로고 x\"><meta name=description content='설명'>"
    lines = structure.page_digest(page(spark, html)).first().lines
    assert lines == ["[제목] 요약 제목", "[본문]", "글", "[표 1]", "ab | b | c", "b", "[표 2]", "b", "[목록 1]", "- xyy", "- yy", "[목록 2]", "- yy", "[이미지 설명]", "- 작음", "[메타 설명] 설명"]
    short = structure.page_digest(page(spark, html), item_chars=3, list_items=1).first().lines
    assert "- yy" not in short and "[이미지 설명]" not in short
