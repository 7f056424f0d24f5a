"""Rule scoring and tagging of extracted promotions.

Input columns: ``title, benefit_value, conditions, target_segment, raw_text``
(strings) and ``marketing_content`` (map of section name to texts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import amounts, text
from promolens.vocabulary import (
    BENEFIT_SCORES, BROAD_TARGET_WORDS, CHANNEL_RULES, LEVEL_KEEP_WORDS, OBJECTIVE_RULES, STRATEGY_RULES,
    TARGET_SIGNALS, TARGET_TAG_DEFAULT, VIP_WORDS, Vocabulary,
)

RULE_CONFIDENCE, RESPONSE_CONFIDENCE = 0.5, 0.85
# fixed values: text fields that only a model answer gives
ANSWER_TEXTS = (
    "threat_reason", "benefit_detail", "target_profile", "conditions_summary", "event_duration_type",
    "shinhan_response", "marketing_takeaway",
)


def _joined(*cols: Column) -> Column:
    return F.concat_ws(" ", *[text.blank_to_null(c) for c in cols])


def _section(name: str) -> Column:
    return F.array_join(F.try_element_at(F.col("marketing_content"), F.lit(name)), " ")


def with_pools(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Text pools and the strongest amount and percentage, each computed once."""
    names = [n for n in vocab.section_names if n != vocab.target_section]
    pooled = df.withColumns(
        {
            "_benefits": _joined(F.col("benefit_value"), F.col("conditions"), *[_section(n) for n in names]),
            "_targets": _joined(F.col("target_segment"), _section(vocab.target_section)),
            "_has_partner": F.coalesce(
                F.size(F.try_element_at(F.col("marketing_content"), F.lit(vocab.partner_section))) > 0, F.lit(False)
            ),
        }
    ).withColumns(
        {
            "_pool": _joined(F.col("title"), F.col("target_segment"), F.col("raw_text"), F.col("_benefits")),
            "_objectives": _joined(*[F.col(c) for c in ("title", "benefit_value", "conditions", "raw_text")]),
            "_segments": _joined(F.col("target_segment"), F.col("conditions")),
            "_channels": _joined(F.col("conditions"), F.col("raw_text")),
        }
    )
    first = pooled.withColumns(
        {"_amounts": amounts.all_amounts(F.col("_benefits")), "_pcts": amounts.all_percentages(F.col("_benefits"))}
    ).withColumn("_bare", (F.size("_amounts") == 0) & (F.size("_pcts") == 0))
    # The whole pool is searched only where the benefit texts name no figure at all.
    return first.withColumns(
        {
            "_max_won": amounts.max_amount(
                F.when(F.col("_bare"), amounts.all_amounts(F.col("_pool"))).otherwise(F.col("_amounts"))
            ),
            "_max_pct": amounts.max_percentage(
                F.when(F.col("_bare"), amounts.all_percentages(F.col("_pool"))).otherwise(F.col("_pcts"))
            ),
        }
    )


POOLS = (
    "_benefits", "_targets", "_has_partner", "_pool", "_objectives", "_segments", "_channels", "_amounts", "_pcts", "_bare",
    "_max_won", "_max_pct", "_strategies", "_tags",
)


def benefit_level() -> Column:
    won, pct, pool = F.col("_max_won"), F.col("_max_pct"), F.col("_pool")
    return (
        F.when((won >= 100000) | (pct >= 30), "높음")
        .when((won >= 50000) | (pct >= 20), "중상")
        .when((won >= 10000) | (pct >= 10) | text.contains_any(pool, LEVEL_KEEP_WORDS), "보통")
        .otherwise("낮음")
    )


def _labels(*rules: tuple[Column, str]) -> Column:
    """The distinct labels whose condition holds, in order."""
    return text.without_nulls(F.array(*[F.when(cond, F.lit(label)) for cond, label in rules]))


def competitive_points() -> Column:
    won, pct, pool = F.col("_max_won"), F.col("_max_pct"), F.col("_pool")
    return _labels(
        (text.contains_any(pool, ("무이자", "할부")), "무이자/할부 혜택"),
        (pct >= 20, "높은 할인율"),
        (won >= 50000, "고액 혜택"),
        (pool.contains("캐시백"), "즉시 체감형 캐시백"),
        (text.contains_any(pool, ("포인트", "적립")), "포인트 적립형 혜택"),
        (F.col("_has_partner"), "제휴 파트너 연계"),
        (text.contains_any(pool, VIP_WORDS), "프리미엄 고객 혜택"),
    )


def target_clarity() -> Column:
    target = F.col("_targets")
    hits = text.hit_count(target, TARGET_SIGNALS)
    named_card = target.contains("카드") & target.rlike(rf"(?U)[{text.ASCII_WORD}가-힣\s]{{2,25}}카드")
    return (
        F.when(text.ustrip(target) == "", "낮음")
        .when(text.contains_any(target, BROAD_TARGET_WORDS) & (hits <= 2), "낮음")
        .when((hits >= 3) | named_card, "높음")
        .otherwise("보통")
    )


def strategy_labels() -> Column:
    won, pct, pool = F.col("_max_won"), F.col("_max_pct"), F.col("_pool")
    return _labels(
        *[(text.contains_any(pool, words), label) for label, words in STRATEGY_RULES],
        (F.col("_has_partner") | pool.contains("제휴"), "브랜드 제휴 확장"),
        ((won >= 50000) | (pct >= 20), "공격적 가격 프로모션"),
    )


def promo_strategies(found: Column, level: Column) -> Column:
    default = F.when(level.isin("높음", "중상"), "혜택 중심 인지도 강화").otherwise("기본 혜택 유지형")
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def objective_tags(rules=OBJECTIVE_RULES) -> Column:
    return text.matching_rules(F.col("_objectives"), rules)


def tag_labels(tags) -> Column:
    return _labels(*[(F.col("_segments").contains(t), t) for t in tags])


def target_tags(found: Column) -> Column:
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(TARGET_TAG_DEFAULT)))


def channel_tags(rules=CHANNEL_RULES) -> Column:
    return text.matching_rules(F.col("_channels"), rules)


def rule_insights(df: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The standard insight record of each row, from rules only."""
    pooled = with_pools(df, vocab).withColumns(
        {"benefit_level": benefit_level(), "_strategies": strategy_labels(), "_tags": tag_labels(vocab.target_tags)})
    none = F.lit(None).cast("string")
    return pooled.withColumns(
        {
            "benefit_score": amounts.map_score(F.col("benefit_level"), BENEFIT_SCORES, 2.0),
            "target_clarity": target_clarity(),
            "competitive_points": competitive_points(),
            "promo_strategies": promo_strategies(F.col("_strategies"), F.col("benefit_level")),
            "objective_tags": objective_tags(vocab.objective_rules),
            "target_tags": target_tags(F.col("_tags")),
            "channel_tags": channel_tags(vocab.channel_rules),
            "insight_threat": none,
            "evidence": F.array().cast("array<string>"),
            "insight_confidence": F.lit(RULE_CONFIDENCE),
            "section_coverage": amounts.section_coverage(F.col("marketing_content"), vocab.section_names),
            "source": F.lit("rule"),
        }
    ).drop(*POOLS)


def hybrid_insights(rules: DataFrame, responses: DataFrame) -> DataFrame:
    """Valid response where there is one, else the rule record.

    ``responses`` has ``id`` and the parsed ``answer`` struct; null answers do not
    count. With a response, the summary, category and threat of the record change, and
    the fields that only an answer has are filled; they are null or empty without one.
    """
    valid = responses.where(F.col("answer").isNotNull()).select("id", "answer")
    joined = rules.join(valid, "id", "left").withColumn("_llm", F.col("answer").isNotNull())
    a = lambda k: F.col(f"answer.{k}")
    none = F.array().cast("array<string>")

    def pick(name: str, answer: Column) -> Column:
        return F.when(F.col("_llm"), answer).otherwise(F.col(name))

    level = F.coalesce(a("benefit_level"), F.lit("보통"))
    new = {
        "benefit_level": pick("benefit_level", level),
        "benefit_score": pick("benefit_score", amounts.map_score(level, BENEFIT_SCORES, 2.0)),
        "target_clarity": pick("target_clarity", F.coalesce(a("target_clarity"), F.lit("보통"))),
        **{
            k: pick(k, F.coalesce(a(k), none))
            for k in ("competitive_points", "promo_strategies", "objective_tags", "target_tags", "channel_tags")
        },
        **{k: F.when(F.col("_llm"), a(k)) for k in ANSWER_TEXTS},
        **{k: F.when(F.col("_llm"), F.coalesce(a(k), none)).otherwise(none) for k in ("weaknesses", "evidence")},
        "insight_threat": pick("insight_threat", a("threat_level")),
        "insight_confidence": pick("insight_confidence", F.lit(RESPONSE_CONFIDENCE)),
        "source": F.when(F.col("_llm"), "gemini").otherwise("rule"),
    }
    for col, key in (("one_line_summary", "one_line_summary"), ("category", "category"), ("threat_level", "threat_level")):
        if col in rules.columns:
            new[col] = text.first_filled(F.when(F.col("_llm"), a(key)), F.col(col))
    return joined.withColumns(new).drop("answer", "_llm")
