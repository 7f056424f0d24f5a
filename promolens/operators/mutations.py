"""Table mutations as transformations: update, delete, backfill and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import amounts, periods, records, text
from promolens.params import Params
from promolens.vocabulary import BAD_TITLE_PREFIXES, BAD_TITLE_WORDS, NO_INFO, SEE_DETAIL, Vocabulary

UPDATABLE = (
    "title", "period", "period_start", "period_end", "benefit_type", "benefit_value", "benefit_amount_won",
    "benefit_pct", "conditions", "target_segment", "one_line_summary", "raw_text", "marketing_content",
    "marketing_insights", "category", "threat_level", "status",
)


def apply_updates(events: DataFrame, updates: DataFrame, params: Params) -> DataFrame:
    """Non-null allowed fields overwrite; a given period refreshes dates it can parse.

    A null never clears a field, and a changed benefit text leaves amounts alone.
    """
    given = [c for c in UPDATABLE if c in updates.columns and c in events.columns]
    fresh = updates.select("id", *[F.col(c).alias(f"_u_{c}") for c in given])
    joined = events.join(fresh, "id", "left")
    new = {c: F.coalesce(F.col(f"_u_{c}"), F.col(c)) for c in given}
    if "period" in given:
        dates = periods.period_dates(F.col("_u_period"))
        joined = joined.withColumn("_d", dates)
        new["period_start"] = F.coalesce("_d.start", new.get("period_start", F.col("period_start")))
        new["period_end"] = F.coalesce("_d.end", new.get("period_end", F.col("period_end")))
        new["status"] = F.when(
            F.col("_d.end").isNotNull(), periods.status_at(F.col("_d.end"), params.as_of)
        ).otherwise(new.get("status", F.col("status")))
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in events.columns])


def delete_events(events: DataFrame, gone: DataFrame) -> DataFrame:
    return events.join(gone.select("id"), "id", "left_anti")


def delete_children(children: DataFrame, gone: DataFrame, set_null: bool = False) -> DataFrame:
    """Children of deleted promotions go too; job rows only lose their reference."""
    ids = gone.select(F.col("id").alias("event_id")).distinct()
    if not set_null:
        return children.join(ids, "event_id", "left_anti")
    marked = children.join(ids.withColumn("_gone", F.lit(True)), "event_id", "left")
    return marked.withColumn(
        "event_id", F.when(F.col("_gone").isNull(), F.col("event_id"))
    ).drop("_gone")


def backfill(events: DataFrame, params: Params) -> DataFrame:
    """Fill missing dates, amounts and status of older rows from their texts.

    Zero amounts and percentages count as missing, and are not written either.
    """
    d = events.withColumn("_d", periods.period_dates(F.col("period")))
    no_start = F.col("period_start").isNull()
    no_amount = F.coalesce(F.col("benefit_amount_won"), F.lit(0)) == 0
    fresh_amount = F.nullif(amounts.benefit_amount(F.col("benefit_value")), F.lit(0).cast("bigint"))
    fresh_pct = F.nullif(amounts.benefit_pct(F.col("benefit_value")), F.lit(0.0))
    start = F.when(no_start, F.coalesce("_d.start", "period_start")).otherwise(F.col("period_start"))
    end = F.when(no_start, F.coalesce("_d.end", "period_end")).otherwise(F.col("period_end"))
    status = (
        F.when(no_start & F.col("_d.end").isNotNull(), periods.status_at(F.col("_d.end"), params.as_of))
        .otherwise(F.col("status"))
    )
    filled = d.withColumns(
        {
            "period_start": start,
            "period_end": end,
            "benefit_amount_won": F.when(no_amount, F.coalesce(fresh_amount, F.col("benefit_amount_won")))
            .otherwise(F.col("benefit_amount_won")),
            "benefit_pct": F.when(no_amount, F.coalesce(fresh_pct, F.col("benefit_pct"))).otherwise(F.col("benefit_pct")),
            "_status": status,
        }
    )
    unknown = F.coalesce(F.col("_status"), F.lit("")).isin("", "unknown")
    return filled.withColumn(
        "status",
        F.when(unknown, periods.status_at(F.col("period_end"), params.as_of)).otherwise(F.col("_status")),
    ).drop("_d", "_status")


def missing_children(events: DataFrame, children: DataFrame) -> DataFrame:
    """Promotions that have no child row yet."""
    return events.join(children.select(F.col("event_id").alias("id")), "id", "left_anti")


# ---- repairs ---------------------------------------------------------------------------

def rewrite_urls(events: DataFrame, mapping: DataFrame, old_id_pattern: str, prefix: str) -> DataFrame:
    """Replace addresses whose id text has a successor in ``mapping`` (old_id, new_id)."""
    pairs = mapping.where(
        (F.coalesce(F.col("old_id"), F.lit("")) != "") & (F.coalesce(F.col("new_id"), F.lit("")) != "")
    ).select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    keyed = events.withColumn("_old", text.blank_to_null(F.regexp_extract("url", old_id_pattern, 1)))
    joined = keyed.join(pairs, "_old", "left")
    return joined.withColumn(
        "url", F.coalesce(F.concat(F.lit(prefix), F.col("_new")), F.col("url"))
    ).drop("_old", "_new")


def is_bad_title(title: Column, vocab: Vocabulary) -> Column:
    t = F.coalesce(text.ustrip(title), F.lit(""))
    first, second = vocab.hidden_title_pair
    return (
        (F.coalesce(F.length(title), F.lit(0)) < 10)
        | text.contains_any(t, BAD_TITLE_WORDS)
        | text.starts_with_any(t, BAD_TITLE_PREFIXES)
        | (t.contains(first) & t.contains(second))
    )


def repair_titles(events: DataFrame, found: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Bad titles are replaced, with the summary, by a different non-empty new title."""
    fresh = found.select("id", F.col("title").alias("_new"))
    joined = events.join(fresh, "id", "left")
    use = (
        is_bad_title(F.col("title"), vocab)
        & (F.coalesce(F.col("_new"), F.lit("")) != "")
        & ~F.col("_new").eqNullSafe(F.col("title"))
    )
    return joined.withColumns(
        {
            "one_line_summary": F.when(use, F.col("_new")).otherwise(F.col("one_line_summary")),
            "title": F.when(use, F.col("_new")).otherwise(F.col("title")),
        }
    ).drop("_new")


def needs_detail(benefit_value: Column) -> Column:
    return F.coalesce(benefit_value, F.lit("")).isin("", NO_INFO, SEE_DETAIL)


def refresh_details(events: DataFrame, details: DataFrame) -> DataFrame:
    """Detail fields are taken over only where the stored benefit says nothing."""
    fields = ("benefit_type", "benefit_value", "conditions", "target_segment", "raw_text")
    fresh = details.select("id", F.lit(True).alias("_found"), *[F.col(f).alias(f"_n_{f}") for f in fields])
    joined = events.join(fresh, "id", "left").withColumn(
        "_use", needs_detail(F.col("benefit_value")) & F.col("_found").isNotNull()
    )
    merged = {
        f: F.when(F.col("_use"), F.coalesce(F.col(f"_n_{f}"), F.col(f))).otherwise(F.col(f)) for f in fields
    }
    return joined.select(*[merged.get(c, F.col(c)).alias(c) for c in events.columns])


# ---- export ------------------------------------------------------------------------------

def export_rows(events: DataFrame, params: Params) -> DataFrame:
    """The ten columns of the tabular export."""
    ins = records.insight_struct(F.col("marketing_insights"))
    has = records.has_json_content(F.col("marketing_insights"))
    active = periods.lenient_active(F.col("status"), F.col("period"), params.as_of)
    rows = events.withColumns({"_ins": ins, "_has": has})
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        F.col("company").alias("company"), F.col("title").alias("title"),
        blank("benefit_value").alias("benefit"), blank("conditions").alias("conditions"),
        blank("period").alias("period"),
        F.when(F.col("_has"), "완료").otherwise("미완료").alias("extracted"),
        F.when(active, "진행중").otherwise("종료").alias("status"),
        blank("category").alias("category"),
        F.when(F.col("_has"), records.insight_summary(F.col("_ins"))).otherwise("").alias("insight_summary"),
        F.col("url").alias("url"),
    )


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
