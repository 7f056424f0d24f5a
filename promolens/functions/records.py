"""Record-level projections shared by ingest, extraction and analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens import schemas
from promolens.functions import amounts, periods, text, urls
from promolens.functions.rows import computed_once
from promolens.params import Params
from promolens.vocabulary import Vocabulary


def build_records(staged: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Raw connector rows to normalised promotion records, with a ``reject_reason``.

    ``staged`` carries ``company, base_url, url, title, period, raw_text`` and the
    optional descriptive fields. Extra columns (arrival order, source) pass through.
    """
    have = set(staged.columns)

    def given(name: str) -> Column:
        return F.col(name) if name in have else F.lit("")

    cleaned = computed_once(
        staged,
        {
            "url": urls.normalise_url(F.col("url"), F.col("base_url"), vocab),
            "title": text.clean_title(F.col("title"), vocab),
            "period": periods.canonical_period(given("period")),
            "raw_text": text.clean_text(given("raw_text")),
            **{
                name: text.clean_text(given(name))
                for name in ("benefit_type", "benefit_value", "conditions", "target_segment")
            },
        },
    )
    category_source = F.concat_ws(" ", "title", "raw_text")
    threat_source = F.concat_ws(" ", "title", "period", "raw_text")
    return cleaned.withColumns(
        {
            "category": text.first_rule(category_source, vocab.category_rules, vocab.category_default),
            "threat_level": text.first_rule(threat_source, vocab.threat_rules, vocab.threat_default),
            "one_line_summary": F.col("title"),
            "reject_reason": F.when(F.col("url") == "", "url")
            .when(F.col("title") == "", "title")
            .otherwise(F.lit(None).cast("string")),
        }
    )


def accepted(records: DataFrame) -> DataFrame:
    return records.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(records: DataFrame) -> DataFrame:
    return records.where(F.col("reject_reason").isNotNull())


def drop_empty(records: DataFrame, columns=schemas.RAW_FIELDS) -> DataFrame:
    """Empty strings to null, so that absent and empty mean the same downstream."""
    return records.withColumns({c: text.blank_to_null(F.col(c)) for c in columns if c in records.columns})


def derive_fields(records: DataFrame, as_of) -> DataFrame:
    """Dates, amount, percentage and status for fields that are still null."""
    have = set(records.columns)

    def keep(name: str, fresh: Column, kind: str) -> Column:
        return F.coalesce(F.col(name), fresh).cast(kind) if name in have else fresh.cast(kind)

    dated = records.withColumn("_dates", periods.period_dates(F.col("period")))
    return dated.withColumns(
        {
            "period_start": keep("period_start", F.col("_dates.start"), "date"),
            "period_end": keep("period_end", F.col("_dates.end"), "date"),
            "benefit_amount_won": keep(
                "benefit_amount_won", amounts.benefit_amount(F.col("benefit_value")), "bigint"
            ),
            "benefit_pct": keep("benefit_pct", amounts.benefit_pct(F.col("benefit_value")), "double"),
            "status": keep("status", periods.status_at(F.col("_dates.end"), as_of), "string"),
        }
    ).drop("_dates")


def merge_extracted(extracted: DataFrame, existing: DataFrame, params: Params, carried: tuple[str, ...] = ()) -> DataFrame:
    """Extraction result laid over the stored record: filled new values win; ``carried`` columns pass through."""
    e, x = extracted.alias("e"), existing.alias("x")
    return laid_over(e.join(x, F.col("e.id") == F.col("x.id"), "left"), params, carried)


def laid_over(
    joined: DataFrame, params: Params, carried: tuple[str, ...] = (), new: str = "e.", old: str = "x.",
) -> DataFrame:
    """``merge_extracted`` of rows that hold both sides; ``new`` and ``old`` come before the names of their columns."""
    fields = (
        "title", "period", "benefit_type", "benefit_value", "conditions",
        "target_segment", "one_line_summary", "raw_text",
    )
    strict = {"title", "period", "benefit_value"}
    merged = joined.select(
        F.col(f"{new}id").alias("id"),
        *[
            (
                F.coalesce(text.first_filled(F.col(f"{new}{f}"), F.col(f"{old}{f}")), F.lit(""))
                if f in strict
                else F.coalesce(text.blank_to_null(F.col(f"{new}{f}")), F.col(f"{old}{f}"))
            ).alias(f)
            for f in fields
        ],
        F.col(f"{new}marketing_content").alias("marketing_content"),
        *[F.col(f"{new}{c}").alias(c) for c in carried],
    )
    return derive_fields(merged, params.as_of)


def search_blob() -> Column:
    names = ("title", "category", "benefit_value", "conditions", "target_segment", "one_line_summary")
    cols = [F.coalesce(F.col(n), F.lit("")) for n in names]
    return F.concat_ws(" ", *cols, F.coalesce(F.col("raw_text"), F.lit("")))


def visible(params: Params) -> Column:
    return text.is_meaningful(F.col("title"), F.col("period"), params.vocab)


def is_focal(company: Column, params: Params) -> Column:
    if params.focal_match == "contains":
        return F.coalesce(company, F.lit("")).contains(params.focal)
    return F.coalesce(company, F.lit("")) == params.focal


# ---- JSON payload columns ----------------------------------------------------

def has_json_content(c: Column) -> Column:
    """True for JSON text that holds something: not blank, broken, null or empty."""
    parsed = F.try_parse_json(text.blank_to_null(text.ustrip(c)))
    bare = F.regexp_replace(F.to_json(parsed), r"\s", "")
    return F.coalesce(~bare.isin("{}", "[]", "null", '""', "0", "0.0", "false"), F.lit(False))


def content_map(c: Column) -> Column:
    """Section JSON to ``map<string, array<string>>``; broken text gives null, a single value one item."""
    values = F.from_json(text.blank_to_null(text.ustrip(c)), "map<string,string>")

    def items(v: Column) -> Column:
        listed = F.when(F.startswith(v, F.lit("[")), F.from_json(v, "array<string>"))
        return F.when(v.isNotNull(), F.coalesce(listed, F.array(v)))

    return F.transform_values(values, lambda _, v: items(v))


def tag_array(c: Column) -> Column:
    """JSON array of strings; anything else counts as no tags."""
    trimmed = text.ustrip(c)
    return F.coalesce(
        F.from_json(F.when(trimmed.startswith("["), trimmed), "array<string>"),
        F.array().cast("array<string>"),
    )


def insight_struct(c: Column) -> Column:
    """Insight JSON with new or legacy key names, read into one struct."""
    raw = F.from_json(text.blank_to_null(text.ustrip(c)), schemas.INSIGHT_JSON)

    def filled(arr: Column) -> Column:
        return F.when(F.size(arr) > 0, arr)

    def body(r: Column) -> Column:
        none = F.array().cast("array<string>")
        return F.struct(
            text.first_filled(r["benefit_level"], r["혜택_수준"]).alias("benefit_level"),
            F.coalesce(filled(r["competitive_points"]), filled(r["경쟁력_포인트"]), none).alias(
                "competitive_points"
            ),
            F.coalesce(filled(r["promo_strategies"]), filled(r["프로모션_전략"]), none).alias(
                "promo_strategies"
            ),
            F.coalesce(r["objective_tags"], none).alias("objective_tags"),
            *[r[k].alias(k) for k in schemas.INSIGHT_EXTRA_KEYS if k != "weaknesses"],
            F.coalesce(r["weaknesses"], none).alias("weaknesses"),
        )

    return text.let(raw, body)


def extracted_flag(has_insight: Column, raw_text: Column | None = None) -> Column:
    """Extraction done: insights stored, or (variant) enough raw text."""
    if raw_text is None:
        return has_insight
    return has_insight | (F.length(F.coalesce(text.ustrip(raw_text), F.lit(""))) > 20)


def insight_summary(insight: Column) -> Column:
    """Level, two points and two strategies in one line."""
    parts = F.concat(
        F.array(text.blank_to_null(insight["benefit_level"])),
        F.slice(insight["competitive_points"], 1, 2),
        F.slice(insight["promo_strategies"], 1, 2),
    )
    return F.coalesce(
        F.array_join(F.filter(parts, lambda v: v.isNotNull() & (v != "")), " / "), F.lit("")
    )
