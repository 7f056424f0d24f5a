"""Record lists, explorer filters and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import periods, records, text
from promolens.functions.rows import exploded
from promolens.params import Params


def event_list(
    events: DataFrame, params: Params, company: str | None = None, category: str | None = None,
    threat_level: str | None = None,
) -> DataFrame:
    """Listed records by equality filters; the equalities reach the scan."""
    kept = events
    for name, value in (("company", company), ("category", category), ("threat_level", threat_level)):
        if value:
            kept = kept.where(F.col(name) == value)
    return kept.where(records.visible(params))


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.asc("id")]


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 1000) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def explore(
    events: DataFrame, params: Params, company: str | None = None, category: str | None = None,
    status: str | None = None, benefit_type: str | None = None, extracted: str | None = None,
    tag: str | None = None, keyword: str | None = None, by_raw_text: bool = False,
) -> DataFrame:
    """Dashboard filter. Ended means "not active"; the keyword ignores case."""
    kept = events
    if company:
        kept = kept.where(F.col("company") == company)
    if category:
        kept = kept.where(F.col("category") == category)
    if benefit_type:
        kept = kept.where(F.coalesce(F.col("benefit_type"), F.lit("")) == benefit_type)
    if status in ("active", "ended"):
        active = periods.lenient_active(F.col("status"), F.col("period"), params.as_of)
        kept = kept.where(active if status == "active" else ~active)
    if extracted in ("done", "pending"):
        has = records.has_json_content(F.col("marketing_insights"))
        done = records.extracted_flag(has, F.col("raw_text") if by_raw_text else None)
        kept = kept.where(done if extracted == "done" else ~done)
    if tag:
        tags = records.insight_struct(F.col("marketing_insights"))["objective_tags"]
        kept = kept.where(F.coalesce(F.array_contains(tags, tag), F.lit(False)))
    word = (keyword or "").strip().lower()
    if word:
        joined = F.concat_ws(
            " ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "benefit_value", "company", "category")]
        )
        kept = kept.where(F.lower(joined).contains(word))
    return kept


def in_month(events: DataFrame, year: int, month: int) -> DataFrame:
    """Period text mentions the month."""
    return events.where(F.col("period").contains(f"{year}.{month:02d}"))


def text_active(events: DataFrame, params: Params) -> DataFrame:
    return events.where(periods.period_text_active(F.col("period"), params.as_of))


def facets(events: DataFrame) -> DataFrame:
    """Distinct filter values: companies, categories, benefit types and objective tags."""
    tags = records.insight_struct(F.col("marketing_insights"))["objective_tags"]

    def one(kind: str, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("facet"), c.alias("value"))

    cells = F.concat(
        F.array(
            one("company", F.col("company")), one("category", F.col("category")),
            one("benefit_type", F.col("benefit_type")),
        ),
        F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: one("tag", t)),
    )
    return (
        exploded(events, [], cells, "c").select("c.*")
        .where(F.coalesce(F.col("value"), F.lit("")) != "").distinct()
    )


def by_id(events: DataFrame, ids: DataFrame) -> DataFrame:
    return events.join(ids.select("id"), "id", "left_semi")


def strongest_benefit() -> list[Column]:
    return [F.desc_nulls_last("benefit_amount_won"), F.desc_nulls_last("benefit_pct"), F.asc("id")]


def ending_soon(params: Params) -> list[Column]:
    left = periods.days_left(
        periods.lenient_end_date(F.col("period_end"), F.col("period")), params.as_of
    )
    return [F.asc_nulls_last(F.when(left >= 0, left)), F.asc("id")]


def display_rows(events: DataFrame) -> DataFrame:
    return events.select("id", text.display_benefit(F.col("benefit_value")).alias("benefit"))
