"""Request and response tables for offline model analysis.

No model is called here: requests are a table of prompts, responses a table of
answer texts. Parsing, validation and overlay are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens import schemas
from promolens.functions import text
from promolens.functions.text import let
from promolens.vocabulary import (
    CATEGORY_DEFAULT, FIVE_LEVELS, FIVE_LEVEL_LOWEST, SEE_DETAIL, Vocabulary,
)

MISSING = "미추출"


# ---- requests ---------------------------------------------------------------------

def section_lines(content: Column, order) -> Column:
    """One line per filled section, its items whole: sections of ``order`` first, then the other keys of the map."""

    none = F.array().cast("array<string>")

    def line(name: Column) -> Column:
        items = F.filter(F.coalesce(F.try_element_at(content, name), none), lambda v: v.isNotNull())
        return F.when(F.size(items) > 0, F.concat(F.lit("["), name, F.lit("] "), F.array_join(items, " / ")))

    named = F.array(*[F.lit(n) for n in order])
    names = F.concat(named, F.coalesce(F.array_except(F.map_keys(content), named), none))
    return F.array_compact(F.transform(names, line))


def request_table(events: DataFrame, order) -> DataFrame:
    """Prompt text per promotion: a structured summary, section lines, raw text; all of them whole."""

    def shown(name: str, missing: str = MISSING) -> Column:
        return F.coalesce(text.blank_to_null(F.col(name)), F.lit(missing))

    lines = F.array_join(section_lines(F.col("marketing_content"), order), "\n")
    prompt = F.concat_ws(
        "\n",
        F.concat(F.lit("company: "), F.coalesce("company", F.lit(""))),
        F.concat(F.lit("title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("period: "), shown("period")),
        F.concat(F.lit("target: "), shown("target_segment", "미추출 (전체 고객 가능성)")),
        F.concat(F.lit("benefit: "), shown("benefit_value")),
        F.concat(F.lit("conditions: "), shown("conditions")),
        F.lit("sections:"),
        F.coalesce(text.blank_to_null(lines), F.lit("(섹션 데이터 없음)")),
        F.lit("page:"),
        F.coalesce("raw_text", F.lit("")),
    )
    return events.select("id", prompt.alias("prompt"))


# ---- responses -----------------------------------------------------------------------

def json_part(c: Column) -> Column:
    """The JSON object inside an answer: fenced block first, then first to last brace."""
    trimmed = F.coalesce(text.ustrip(c), F.lit(""))
    fence = r"(?s)```(?:json)?\s*\n?(.*?)```"

    def braces(t: Column) -> Column:
        return F.coalesce(text.blank_to_null(F.regexp_extract(t, r"(?s)\{.*\}", 0)), t)

    def unfenced(t: Column) -> Column:
        inside = F.when(t.rlike(fence), text.ustrip(F.regexp_extract(t, fence, 1)))
        open_only = F.when(
            t.startswith("```"), text.ustrip(F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), "^json", ""))
        )
        return F.coalesce(inside, open_only, t)

    return text.ustrip(let(let(trimmed, unfenced), braces))


def is_json_object(c: Column) -> Column:
    return c.startswith("{") & F.try_parse_json(c).isNotNull()


def parse_responses(responses: DataFrame, schema: str = schemas.RESPONSE_JSON) -> DataFrame:
    """Add ``answer``: the parsed struct, or null when the text holds no valid object."""
    cut = responses.withColumn("_json", json_part(F.col("response")))
    return cut.withColumn(
        "answer", F.when(is_json_object(F.col("_json")), F.from_json("_json", schema))
    ).drop("_json")


def overlay(rules: DataFrame, responses: DataFrame) -> DataFrame:
    """Response values win where they are filled, for seven keys."""
    joined = rules.join(responses.select("id", "answer"), "id", "left")
    texts = ("benefit_level", "target_clarity", "threat_level", "threat_reason", "marketing_takeaway")
    lists = ("competitive_points", "promo_strategies")
    filled = lambda c: F.when(F.size(c) > 0, c)
    new = {k: F.coalesce(text.blank_to_null(F.col(f"answer.{k}")), F.col(k)) for k in texts}
    new |= {k: F.coalesce(filled(F.col(f"answer.{k}")), F.col(k)) for k in lists}
    return joined.withColumns(new).drop("answer")


def _text(c: Column) -> Column:
    return F.coalesce(text.ustrip(c), F.lit(""))


BRIEF_JSON = """
    overview STRING, key_strategy STRING, strongest_categories ARRAY<STRING>, avg_benefit_assessment STRING,
    target_focus STRING, shinhan_threat STRING, recommended_counter STRING
"""


def _up_to(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def valid_briefs(responses: DataFrame, categories_max: int | None = None) -> DataFrame:
    """Company briefs with an overview; categories are trimmed, all or as many as given."""
    parsed = parse_responses(responses, BRIEF_JSON).where(_text(F.col("answer.overview")) != "")
    a = lambda k: _text(F.col(f"answer.{k}"))
    categories = F.filter(F.transform("answer.strongest_categories", _text), lambda v: v != "")
    return parsed.select(
        "id", a("overview").alias("overview"), a("key_strategy").alias("key_strategy"),
        _up_to(F.coalesce(categories, F.array().cast("array<string>")), categories_max).alias("strongest_categories"),
        a("avg_benefit_assessment").alias("avg_benefit_assessment"), a("target_focus").alias("target_focus"),
        a("shinhan_threat").alias("rival_threat"), a("recommended_counter").alias("recommended_counter"),
    )


COMPARISON_JSON = """
    title STRING, summary ARRAY<STRING>,
    rows ARRAY<STRUCT<metric: STRING, values: MAP<STRING, STRING>, reason: STRING>>
"""
ALLOWED_LEVELS = tuple(name for _, name in FIVE_LEVELS) + (FIVE_LEVEL_LOWEST,)


def valid_comparisons(responses: DataFrame, rows_max: int | None = None, summary_max: int | None = None) -> DataFrame:
    """Level tables with four usable rows or more, whole or as many rows and sentences as given; cells outside the five
    levels are dropped."""
    parsed = parse_responses(responses, COMPARISON_JSON).where(F.size("answer.rows") >= 4)

    def clean_row(r: Column) -> Column:
        cells = F.transform_values(
            F.transform_keys(F.coalesce(r["values"], F.create_map().cast("map<string,string>")), lambda k, v: _text(k)),
            lambda k, v: _text(v),
        )
        return F.struct(
            _text(r["metric"]).alias("metric"),
            F.map_filter(cells, lambda k, v: (k != "") & v.isin(*ALLOWED_LEVELS)).alias("values"),
            _text(r["reason"]).alias("reason"),
        )

    rows = F.filter(
        F.transform(_up_to(F.col("answer.rows"), rows_max), clean_row),
        lambda r: (r["metric"] != "") & (F.size(F.map_keys(r["values"])) > 0),
    )
    kept = parsed.withColumn("rows", rows).where(F.size("rows") >= 4)
    summary = _up_to(F.filter(F.transform("answer.summary", _text), lambda v: v != ""), summary_max)
    return kept.select(
        "id", text.first_filled(_text(F.col("answer.title")), F.lit("카드 4사 비교 요약")).alias("title"), "rows",
        F.coalesce(summary, F.array().cast("array<string>")).alias("summary"),
    )


TEXT_COMPARISON_JSON = """
    common_patterns ARRAY<STRING>, differentiators MAP<STRING, ARRAY<STRING>>, condition_patterns ARRAY<STRING>
"""


def valid_text_comparisons(responses: DataFrame) -> DataFrame:
    """Text comparisons; a part of the wrong type becomes empty."""
    parsed = parse_responses(responses, TEXT_COMPARISON_JSON).where(F.col("answer").isNotNull())
    none = F.array().cast("array<string>")
    return parsed.select(
        "id", F.coalesce("answer.common_patterns", none).alias("common_patterns"),
        F.coalesce("answer.differentiators", F.create_map().cast("map<string,array<string>>")).alias("differentiators"),
        F.coalesce("answer.condition_patterns", none).alias("condition_patterns"),
    )


# ---- extraction answers to records -------------------------------------------------------

def extraction_records(responses: DataFrame) -> DataFrame:
    """Extraction answers (``url, source_text, response``) to records with their source."""
    parsed = parse_responses(responses, schemas.EXTRACTION_JSON).where(F.col("answer").isNotNull())
    return parsed.select(
        "id", "url", *[F.col(f"answer.{k}").alias(k) for k in ("company", "title", "period", "benefit_type",
        "benefit_value", "conditions", "target_segment", "threat_level", "one_line_summary", "category")],
        F.col("source_text").alias("raw_text"),
    )


def vision_records(responses: DataFrame, company: str, vocab: Vocabulary, category_rules) -> DataFrame:
    """Vision answers with seven keys to records, or a reject reason.

    Records carry only an end date, so their period starts with a tilde.
    """
    parsed = parse_responses(responses, schemas.VISION_JSON)
    a = lambda k: F.col(f"answer.`{k}`")
    title, benefit, end, how = (_text(a(k)) for k in ("이벤트명", "혜택금액내용", "이벤트종료일", "참여방법"))
    markers = ("", "정보 없음", "정보없음", "제목 없음", SEE_DETAIL, "-")
    reason = (
        F.when(F.col("answer").isNull(), "json")
        .when(title.isin(*markers), "title")
        .when((benefit == "") & (end == "") & how.isin(*markers), "empty")
    )
    return parsed.select(
        "id", "url", F.lit(company).alias("company"),
        text.first_rule(a("이벤트명"), category_rules, CATEGORY_DEFAULT).alias("category"),
        F.coalesce(a("이벤트명"), F.lit("제목 없음")).alias("title"),
        F.concat(F.lit("~"), F.coalesce(a("이벤트종료일"), F.lit("정보 없음"))).alias("period"),
        F.lit("혜택").alias("benefit_type"),
        F.coalesce(a("혜택금액내용"), F.lit(SEE_DETAIL)).alias("benefit_value"),
        F.concat(F.coalesce(a("참여방법"), F.lit("")), F.lit(" / "), F.coalesce(a("전월실적조건"), F.lit(""))).alias("conditions"),
        F.coalesce(a("대상카드"), F.lit("일반")).alias("target_segment"),
        F.lit("Mid").alias("threat_level"),
        reason.alias("reject_reason"),
    )
