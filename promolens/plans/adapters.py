"""Views that present TPC-H-like and text tables as promotion data.

Each view reads whole tables and lets Catalyst prune what a job does not use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.functions import amounts, periods, records
from promolens.functions.rows import computed_once

P1 = "1-URGENT"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give heavy per-row work enough tasks when the input has few splits.

    A large table has more splits than cores and is left alone, so no extra
    shuffle happens at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def pick(key: Column, *options) -> Column:
    """``options[key]`` as a chain of conditions; the last option is the default."""
    chain = None
    for i, option in enumerate(options[:-1]):
        value = option if isinstance(option, Column) else F.lit(option)
        chain = F.when(key == i, value) if chain is None else chain.when(key == i, value)
    last = options[-1]
    return chain.otherwise(last if isinstance(last, Column) else F.lit(last))


def first_lines(spark: SparkSession, base: str) -> DataFrame:
    """One line item per order: the smallest by line number, part and supplier."""
    return (
        table(spark, base, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_discount")).alias("line"))
        .select("l_orderkey", "line.l_partkey", "line.l_discount")
    )


def placed_orders(spark: SparkSession, base: str, ids: DataFrame | None = None) -> DataFrame:
    """Orders, all or those of ``ids``, with their customer's segment, nation and region."""
    orders = spread(table(spark, base, "orders"))
    if ids is not None:
        orders = orders.join(ids.select(F.col("id").alias("o_orderkey")), "o_orderkey", "left_semi")
    customer = table(spark, base, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, base, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, base, "region").select("r_regionkey", "r_name")
    places = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey
    )
    return orders.join(places, orders.o_custkey == places.c_custkey)


def campaign_address() -> Column:
    """Address of a placed order's promotion."""
    key = F.col("o_orderkey")
    path = pick(key % 6, "event/detail/", "Event/Detail/", "promo/")
    return (
        F.when(key % 37 == 0, "")
        .when(key % 53 == 0, F.concat(F.lit("ftp://files.example.com/"), key.cast("string")))
        .otherwise(
            F.concat(
                F.lit("https://"), F.lower("r_name"), F.lit(".example.com/"), path, key.cast("string")
            )
        )
    )


def campaign_addresses(spark: SparkSession, base: str) -> DataFrame:
    """Ids and addresses of ``campaign_texts``, without the joins that the other fields need."""
    return placed_orders(spark, base).select(F.col("o_orderkey").alias("id"), campaign_address().alias("url"))


def campaign_texts(spark: SparkSession, base: str, ids: DataFrame | None = None) -> DataFrame:
    """Orders, all or those of ``ids``, as promotion records with text fields only."""
    part = table(spark, base, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    lines, placed = first_lines(spark, base), placed_orders(spark, base, ids)
    joined = (
        placed.join(lines, placed.o_orderkey == lines.l_orderkey, "left")
        .join(part, lines.l_partkey == part.p_partkey, "left")
    )
    key = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, 30)
    won = F.floor("o_totalprice").cast("bigint")
    won_10k = F.expr("cast(floor(o_totalprice) as bigint) div 10000").cast("string")
    won_1k = F.expr("cast(floor(o_totalprice) as bigint) div 1000").cast("string")
    pct = F.coalesce(F.round(F.col("l_discount") * 100).cast("int"), F.lit(0)).cast("string")
    dots, dashes, short = "yyyy.MM.dd", "yyyy-MM-dd", "yy.MM.dd"

    def span(fmt: str, sep: str) -> Column:
        return F.concat(F.date_format(start, fmt), F.lit(sep), F.date_format(end, fmt))

    # the most frequent form is written once: a generated method beyond 8000 bytes is never compiled by the JVM
    turn = key % 23
    period = (
        F.when(turn == 0, "정보 없음")
        .when((turn == 1) & (start >= "2000-01-01"), span(short, "~"))
        .when(turn == 2, F.concat(F.date_format(start, dots), F.lit("~"), F.date_format(end, "yyyy"), F.lit(".02.30")))
        .when(turn == 3, F.lit(None).cast("string"))
        .when(turn == 4, span(dashes, " ~ "))
        .when(turn == 5, F.concat(F.lit("~"), F.date_format(end, dots)))
        .when(turn == 6, F.concat(F.date_format(start, dots), F.lit("부터")))
        .when(turn == 7, " ")
        .otherwise(span(dots, "~"))
    )
    benefit = pick(
        key % 7,
        F.concat(F.format_number(won, 0), F.lit("원")),
        F.concat(won_10k, F.lit("만원")),
        F.concat(pct, F.lit("% (최대 "), won_10k, F.lit("만원)")),
        F.concat(pct, F.lit("% 할인")),
        "정보 없음",
        F.concat(won_1k, F.lit("천원 캐시백")),
        F.lit(None).cast("string"),
    )
    urgency = F.substring("o_orderpriority", 1, 1)
    conditions = (
        F.when(urgency == "1", "앱에서 응모 후 결제 시 최대 1회")
        .when(urgency == "2", "기존 고객 전월 실적 충족")
        .when(urgency == "3", "온라인 결제 월 한도 적용")
        .when(urgency == "5", " / ")
    )
    target = F.concat(
        F.col("c_mktsegment"),
        F.when(F.col("o_orderstatus") == "F", " 신규 고객")
        .when(F.col("o_orderstatus") == "O", " VIP 회원")
        .otherwise(" 전체"),
    )
    title = (
        F.when(key % 41 == 0, "제목 없음")
        .when(key % 43 == 0, "이벤트에 응모되었습니다")
        .when(key % 47 == 0, "마이홈 앱의 자산 연결 안내")
        .otherwise(
            F.concat(
                F.coalesce("p_name", F.lit("promo")),
                F.lit(" "),
                F.col("n_name"),
                pick(key % 5, " 할인", " 무이자 할부", " 프리미엄 여행", " 자동차 정기", " 매월 적립"),
            )
        )
    )
    return joined.select(
        key.alias("id"),
        campaign_address().alias("url"),
        F.col("r_name").alias("company"),
        F.col("p_brand").alias("category"),
        title.alias("title"),
        period.alias("period"),
        F.col("p_type").alias("benefit_type"),
        benefit.alias("benefit_value"),
        conditions.alias("conditions"),
        target.alias("target_segment"),
        F.when(urgency.isin("1", "2"), "High").when(urgency == "3", "Mid").otherwise("Low").alias("threat_level"),
        F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "ended").alias("status"),
        (F.col("o_orderdate") + F.make_dt_interval((key % 7).cast("int"))).alias("created_at"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        start.alias("start_date"),
        end.alias("end_date"),
    )


def _json_list(*cols) -> Column:
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in cols]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))


def campaigns(spark: SparkSession, base: str, ids: DataFrame | None = None) -> DataFrame:
    """The full promotion table, or its rows of ``ids``: texts, parsed fields and JSON payloads."""
    texts = campaign_texts(spark, base, ids)
    key = F.col("id")
    points = _json_list(F.col("segment"), F.col("priority"))
    strategies = _json_list(F.col("nation"))
    level = pick(key % 4, "높음", "중상", "보통", "낮음")
    new_keys = F.concat(
        F.lit('{"benefit_level":"'), level, F.lit('","competitive_points":'), points,
        F.lit(',"promo_strategies":'), strategies,
        F.lit(',"objective_tags":'), _json_list(F.col("segment")), F.lit("}"),
    )
    old_keys = F.concat(
        F.lit('{"혜택_수준":"'), level, F.lit('","경쟁력_포인트":'), points,
        F.lit(',"프로모션_전략":'), strategies, F.lit("}"),
    )
    content = F.concat(
        F.lit('{"혜택_상세":["'), F.col("title"), F.lit(' 혜택",""],"참여방법":["앱 응모","'),
        F.col("segment"), F.lit('"],"파트너십":'),
        F.when(key % 2 == 0, '["스타벅스"]').otherwise("[]"), F.lit("}"),
    )
    raw = F.when(
        key % 11 != 0, F.concat_ws(" ", "title", "benefit_value", "conditions", "target_segment")
    )
    none = F.lit(None).cast("string")
    return computed_once(
        texts,
        {
            "one_line_summary": F.col("title"),
            "raw_text": raw,
            "marketing_content": pick(key % 5, none, "", "{}", content, "broken {"),
            "marketing_insights": pick(key % 6, none, new_keys, old_keys, "not json", "{}", new_keys),
            "updated_at": F.col("created_at"),
            "_dates": periods.period_dates(F.col("period")),
            "benefit_amount_won": amounts.benefit_amount(F.col("benefit_value")),
            "benefit_pct": amounts.benefit_pct(F.col("benefit_value")),
        },
    ).withColumns(
        {"period_start": F.col("_dates.start"), "period_end": F.col("_dates.end")}
    ).drop("_dates")


def submissions(spark: SparkSession, base: str) -> DataFrame:
    """Promotion records as they arrive: repeated addresses, arrival order = order key."""
    texts = campaign_texts(spark, base)
    url = F.concat(
        F.lit("https://"), F.lower("company"), F.lit(".example.com/offer?id="),
        F.col("customer_id").cast("string"), F.lit("&utm_source=feed&rank="),
        F.substring("priority", 1, 1), F.lit("#top"),
    )
    return texts.select(
        F.col("id").alias("arrival"),
        "company", "title", "period", "benefit_value", "conditions", "target_segment",
        url.alias("url"),
        F.lit("https://list.example.com/events").alias("base_url"),
        F.concat_ws(" ", "title", "benefit_value", "conditions").alias("raw_text"),
        "order_status",
    )


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def insights(spark: SparkSession, base: str) -> DataFrame:
    """Behaviour events as stored insight rows; three rows share one promotion."""
    ev = table(spark, base, "events")
    k = props_k()
    kind = F.col("event_type")
    objective = pick(
        k % 10, F.lit(None).cast("string"), '"신규유치"', "oops", "[]", '["신규유치",""]',
        '["리텐션","객단가증대"]', '["디지털전환"]', '["제휴확장","브랜드강화","신규유치"]',
        '["리텐션"]', '["브랜드강화","디지털전환"]',
    )
    target = pick(k % 4, '["VIP"]', '["신규","기존"]', '["전연령"]', F.lit(None).cast("string"))
    level = pick(k % 4, "높음", "중상", "보통", "낮음")
    return ev.select(
        F.col("event_id").alias("id"),
        ((F.col("event_id") - F.col("event_id") % 3) * 2).alias("event_id"),
        F.when(kind == "view", "gemini").when(kind == "click", "hybrid")
        .when(kind.isin("purchase", "signup"), "rule").otherwise("legacy").alias("source"),
        level.alias("benefit_level"),
        F.col("value").alias("benefit_score"),
        records.tag_array(objective).alias("objective_tags"),
        records.tag_array(target).alias("target_tags"),
        F.array(F.concat(F.lit("k"), k.cast("string"))).alias("competitive_points"),
        F.array(kind).alias("promo_strategies"),
        F.concat(F.lit("takeaway "), k.cast("string")).alias("marketing_takeaway"),
        pick(k % 3, "높음", "보통", F.lit(None).cast("string")).alias("target_clarity"),
        pick(k % 2, "High", "Low").alias("threat_level"),
        F.array(F.concat(F.lit("e"), k.cast("string"))).alias("evidence"),
        F.col("ts").alias("generated_at"),
    )


def jobs(spark: SparkSession, base: str) -> DataFrame:
    ev = table(spark, base, "events")
    kind = F.col("event_type")
    status = (
        F.when(F.col("value") < 20, "success").when(F.col("value") < 60, "failed")
        .when(F.col("value") < 120, "running").otherwise("pending")
    )
    return ev.select(
        F.col("event_id").alias("id"),
        F.when(kind.isin("view", "click"), "ingest")
        .when(kind.isin("purchase", "signup"), "extract").otherwise("insight").alias("job_type"),
        F.col("user_id").alias("event_id"),
        status.alias("status"),
        F.when(status == "failed", F.concat(F.lit("error "), props_k().cast("string"))).alias("last_error"),
        F.col("ts").alias("started_at"),
    )


def locks(spark: SparkSession, base: str) -> DataFrame:
    """Lock commands over time: one row per order, keyed by customer as promotion id."""
    return table(spark, base, "orders").select(
        F.col("o_custkey").alias("event_id"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderstatus") == "F").alias("is_locked"),
        F.col("o_orderpriority").alias("locked_by"),
        F.col("o_orderdate").alias("locked_at"),
    )


def snapshots(spark: SparkSession, base: str) -> DataFrame:
    """Conversation turns as page captures of one promotion over time."""
    return table(spark, base, "conversations").select(
        F.col("conv_id").alias("event_id"),
        F.col("text").alias("raw_text"),
        (F.col("turn") * 10).cast("int").alias("extraction_latency_ms"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 + F.col("turn") * 60)
        .cast("timestamp_ntz").alias("captured_at"),
    )


def edits(spark: SparkSession, base: str) -> DataFrame:
    """Conversation turns as manual edits; each turn replaces the one before."""
    turns = table(spark, base, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("old_value"))
    field = pick(
        F.col("turn") % 7, "title", "period", "benefit_value", "benefit_type", "conditions",
        "target_segment", "category",
    )
    return turns.join(before, ["conv_id", "turn"], "left").select(
        F.col("conv_id").alias("event_id"),
        field.alias("field_name"),
        F.col("old_value"),
        F.col("text").alias("new_value"),
        F.col("role").alias("editor"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 86400 + F.col("turn") * 60)
        .cast("timestamp_ntz").alias("edited_at"),
    )


def probes(spark: SparkSession, base: str) -> DataFrame:
    """Documents as an id scan; a labelled good document is a hit."""
    docs = table(spark, base, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, base, "labels").select("doc_id", "quality", "toxic")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source"),
        F.col("doc_id").alias("probe_id"),
        F.when(F.col("quality").isNull(), "miss").when(F.col("toxic") == 1, "junk")
        .when(F.col("quality") == 0, "short").otherwise("hit").alias("outcome"),
    )


def promo_pages(spark: SparkSession, base: str) -> DataFrame:
    """Raw pages with a period line, a promotion list and a nested detail area put into the article."""
    pid = F.col("page_id").cast("string")
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    period = pick(
        F.col("page_id") % 4,
        F.concat(F.lit("이벤트 기간 2026.02."), day, F.lit("(월) ~ 2026.03."), day),
        F.concat(F.lit("진행기간 26.02."), day, F.lit(" ~ 03."), day),
        F.concat(F.lit("2026년 2월 "), day, F.lit("일 ~ 2026년 3월 "), day, F.lit("일")),
        F.lit("기간 별도 안내"),
    )
    block = F.concat(
        F.lit('<article><p class="period">'), period, F.lit("</p><p>대상카드 제휴 고객 캐시백 1"), day,
        F.lit(",000원 혜택</p>"),
        F.lit('<ul class="eventList"><li><a href="javascript:goDetail(\''), pid,
        F.lit('\', \'A\')"><strong class="tit">오퍼 '), pid, F.lit(" 할인 혜택</strong><span>2026.1."), day,
        F.lit(" ~ 2026.2."), day, F.lit("</span></a></li>"),
        F.lit('<li><a href="/evt/view.do?id='), pid, F.lit('&amp;utm_source=list">이벤트</a>추가 이벤트 '), pid,
        F.lit(" 안내 · 2026.03."), day, F.lit(" ~ 2026.04."), day, F.lit("</li>"),
        F.lit('<li><a href="#" onclick="openEvent(\''), pid, F.lit('\')">더보기 이벤트</a></li></ul>'),
        F.lit("<div class='event-detail wide'><div><span>전월 실적 1"), day, F.lit("만원 이상 결제 &#49888;용카드 회원</span>"),
        F.lit('<div id="gnb"><span>메뉴 혜택 모음</span></div></div><table><tr><th>구분</th><td><ul><li>즉시할인 혜택 '), day,
        F.lit("%</li></ul></td></tr></table><img alt='행사 그림 "), pid, F.lit("' src=\"/i.png\"></div>"),
    )
    return spread(table(spark, base, "pages")).select(
        "page_id", "url", F.replace(F.col("html"), F.lit("<article>"), block).alias("html")
    )


def response_texts(spark: SparkSession, base: str) -> DataFrame:
    """Analysis answers as text: fenced, wrapped in prose, bare or broken."""
    ev = spread(table(spark, base, "events"))
    k = props_k()
    level = pick(k % 5, "높음", "중상", "보통", "낮음", "")
    body = F.concat(
        F.lit('{"benefit_level":"'), level, F.lit('","threat_level":"'), pick(k % 3, "High", "Mid", "Low"),
        F.lit('","category":"'), F.col("event_type"), F.lit('","competitive_points":["k'), k.cast("string"),
        F.lit('"],"one_line_summary":"summary '), k.cast("string"), F.lit('","threat_reason":"reason '), k.cast("string"),
        F.lit('","marketing_takeaway":"takeaway '), k.cast("string"), F.lit('","evidence":["e'), k.cast("string"),
        F.lit('"],"weaknesses":["w","'), k.cast("string"), F.lit('"]}'),
    )
    wrapped = pick(
        F.col("event_id") % 6,
        F.concat(F.lit("```json\n"), body, F.lit("\n```")),
        F.concat(F.lit("```\n"), body, F.lit("```")),
        F.concat(F.lit("Here it is: "), body, F.lit(" done")),
        body,
        F.concat(F.lit("```json\n"), F.substring(body, 1, 30)),
        F.lit("no answer"),
    )
    return ev.select(F.col("event_id").alias("id"), F.col("event_type"), wrapped.alias("response"))


# ---- feeds, dumps, captures and search pages ---------------------------------------------

def feed_a_documents(spark: SparkSession, base: str) -> DataFrame:
    """One feed A document per order with filled, blank, noisy and unusable items."""
    t = campaign_texts(spark, base)
    key = F.col("id").cast("string")
    compact = lambda c: F.date_format(c, "yyyyMMdd")
    term = F.concat(F.date_format("start_date", "yyyy.M.d"), F.lit(" ~ "), F.date_format("end_date", "yyyy.M.d"))
    item = pick(
        F.col("id") % 4,
        F.to_json(F.struct(
            F.col("title").alias("mobWbEvtNm"), F.concat(F.lit("/evt/view?id="), key, F.lit("&utm_source=x")).alias("hpgEvtDlPgeUrlAr"),
            compact("start_date").alias("mobWbEvtStd"), compact("end_date").alias("mobWbEvtEdd"),
            F.col("conditions").alias("hpgEvtSmrTt"))),
        F.to_json(F.struct(
            F.lit("").alias("mobWbEvtNm"), F.col("title").alias("evtImgSlTilNm"),
            F.concat(F.lit("https://www.example.com/a?b=2&a="), key, F.lit("#x")).alias("evtDtlUrl"), term.alias("evtTermTxt"))),
        F.to_json(F.struct(F.col("title").alias("evtImgRplNm"), F.lit("javascript:void(0)").alias("evtUrlAr"))),
        F.to_json(F.struct(F.lit("이벤트").alias("mobWbEvtNm"), F.lit("/evt/noise").alias("evtDtlUrl"))),
    )
    extra = F.when(
        F.col("id") % 2 == 0,
        F.to_json(F.struct(
            F.concat(F.lit("상시 "), F.col("nation")).alias("mobWbEvtNm"),
            F.concat(F.lit("../evt/always?id="), key).alias("evtDtlUrl"), compact("start_date").alias("mobWbEvtStd"))),
    ).otherwise("")
    payload = F.concat(
        F.lit('{"root":{"evnlist":['), item, F.lit(',"text",17]},"mbw_json":{"dpEvtList":['), extra,
        F.lit('],"ingEvtList":null,"evtList":[null]}}'),
    )
    return t.select("id", "company", payload.alias("payload"))


def feed_b_documents(spark: SparkSession, base: str) -> DataFrame:
    t = campaign_texts(spark, base)
    spaced = lambda c: F.date_format(c, "yyyy. M. d")
    code = F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit("EV"), F.col("id").cast("string")))
    item = F.to_json(F.struct(
        code.alias("bnftWebEvntCd"), F.col("title").alias("bnftEvntNm"), spaced("start_date").alias("srtDttm"),
        spaced("end_date").alias("endDttm"), F.col("conditions").alias("bnftEvntSmrCn")))
    return t.select("id", "company", F.concat(F.lit('{"bdy":{"eventList":['), item, F.lit(']}}')).alias("payload"))


def list_rows(spark: SparkSession, base: str) -> DataFrame:
    t = campaign_texts(spark, base)
    return t.select(
        "id", "company", F.concat(F.lit("/cpb/view.hc?code="), F.col("id").cast("string")).alias("href"),
        F.when(F.col("id") % 9 == 0, "").otherwise(F.concat(F.lit("  "), F.col("title"), F.lit(" \n"))).alias("title"),
        F.concat(F.date_format("start_date", "yyyy.MM.dd"), F.lit(" ~ "), F.date_format("end_date", "yyyy.MM.dd")).alias("period"),
        F.concat_ws("\n", "title", "benefit_value").alias("raw_text"),
    )


def dump_documents(spark: SparkSession, base: str) -> DataFrame:
    t = campaign_texts(spark, base)
    key = F.col("id").cast("string")
    item = F.to_json(F.struct(
        F.when(F.col("id") % 8 == 0, " ").otherwise(F.col("title")).alias("cmpTitNm"),
        F.date_format("start_date", "yyyyMMdd").alias("cmsCmpStrtdt"),
        F.when(F.col("id") % 5 == 0, "").otherwise(F.date_format("end_date", "yyyyMMdd")).alias("cmsCmpEnddt"),
        F.concat(F.lit("C"), key).alias("cmpId"),
        F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("9"), key)).alias("cmsId")))
    return t.select("id", "company", F.concat(F.lit('{"listPeiHPPPrgEvnInqrDVO":['), item, F.lit("]}")).alias("payload"))


def capture_log(spark: SparkSession, base: str) -> DataFrame:
    ev = table(spark, base, "events")
    k = props_k()
    path = (
        F.when(F.col("event_type") == "view", "/Event/list").when(F.col("event_type") == "click", "/tracking/event")
        .when(F.col("event_type") == "purchase", "/benefit/data").when(F.col("event_type") == "signup", "/user")
        .otherwise("/log/list")
    )
    host = F.when(k % 3 == 1, "other.org").otherwise("example.com")
    name = F.when(k % 5 == 0, "zz").otherwise("title")
    body = F.concat(
        F.lit('{"'), name, F.lit('":"'), F.repeat(F.lit("x"), k), F.lit('","u":'), F.col("user_id").cast("string"),
        F.lit(',"pad":"'), F.repeat(F.lit("y"), 60), F.when(k % 7 == 0, "").otherwise('"}'),
    )
    return ev.select(
        F.col("event_id").alias("id"), F.lit("example.com").alias("domain"),
        F.concat(F.lit("https://api."), host, path, F.lit("?k="), k.cast("string")).alias("url"),
        F.when(k % 4 == 0, "text/html").otherwise("application/json; charset=utf-8").alias("content_type"),
        body.alias("body"),
    )


def search_pages(spark: SparkSession, base: str) -> DataFrame:
    """One result page per customer with seven result links."""
    c = table(spark, base, "customer")
    key = F.col("c_custkey").cast("string")

    def link(target) -> Column:
        return F.concat(F.lit('<a href="/url?q='), target, F.lit('&sa=U">r</a>'))

    links = [
        link(F.concat(F.lit("https://www.kbcard.com/event/"), key)),
        link(F.concat(F.lit("https://www.kbcard.com/event/"), key)),
        link(F.concat(F.lit("https://blog.example.com/event/"), key)),
        link(F.concat(F.lit("https://www.samsungcard.com/benefit/"), F.col("c_nationkey").cast("string"))),
        link(F.concat(F.lit("https://www.samsungcard.com/main/"), key)),
        link(F.concat(F.lit("https://m.shinhancard.com/event?s="), F.col("c_mktsegment"))),
        '<a href="https://www.hyundaicard.com/event/direct">r</a>',
    ]
    return c.select(
        F.col("c_custkey").alias("query"),
        F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in links]).alias("html"),
    )
