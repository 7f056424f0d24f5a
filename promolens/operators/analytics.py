"""Competitive analytics over the promotion table.

Every operator is one scan of its input followed by map-side aggregation; group
sizes (companies, categories, weeks) never decide how much one task must hold.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions import amounts, periods, records, text
from promolens.functions.rows import computed_once, exploded
from promolens.operators.ranking import first_per_group, ranked_list
from promolens.params import Params
from promolens.vocabulary import (
    BENEFIT_LEVELS,
    BENEFIT_SCORES,
    COMMON_PHRASES,
    DIMENSION_METRICS,
    FIVE_LEVEL_DEFAULT,
    HIGH_VALUE_WORDS,
    RECURRING_HINT_WORDS,
    RECURRING_WORDS,
    REPEAT_HINT_WORDS,
    REPEAT_WORDS,
    THREAT_LEVELS,
    UNKNOWN_COMPANY,
)

COUNTS = ("collected", "visible", "active", "ended", "extracted", "insight")


def company_name(c: Column | None = None) -> Column:
    c = F.col("company") if c is None else c
    return text.ustrip(text.first_filled(c, F.lit(UNKNOWN_COMPANY)))


def _flag(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False)).cast("bigint")


def _filled(c: Column) -> Column:
    return F.coalesce(text.ustrip(c), F.lit("")) != ""


# ---- overview, totals, statistics -------------------------------------------

def _company_values(events: DataFrame, params: Params, profile: bool = False) -> DataFrame:
    """Per company, kind and value: how often and where first, with the sums of the rows' own figures.

    Rows and list values travel through one aggregation: each event emits one marker row (kind ``row``) plus its points
    and strategies; with ``profile`` also its category, and figures of the visible rows. Values are ranked per kind.
    """
    shown = records.visible(params)
    own = {
        "_visible": shown, "period_end": F.col("period_end"),
        "_extracted": records.has_json_content(F.col("marketing_content")),
        "_has_insight": records.has_json_content(F.col("marketing_insights")),
    }
    if profile:
        own["_figures"] = F.when(shown, F.array(*_profile_figures().values()))
        own["_category"] = F.when(shown, text.blank_to_null(text.ustrip(F.col("category"))))
    own["_insight"] = records.insight_struct(F.col("marketing_insights"))
    rated = computed_once(
        events.withColumn("_blob", records.search_blob()) if profile else events, own | {"company": company_name()}
    )
    # the insight's fields become columns, so no nested field is pruned through the generator below
    flagged = rated.select("id", "company", *[name for name in own if name != "_insight"], F.inline_outer(F.array("_insight")))

    def tagged(kind: str, values: Column) -> Column:
        kept = F.filter(values, lambda v: v.isNotNull() & (v != ""))
        return F.transform(
            kept,
            lambda v: F.struct(
                F.lit(kind).alias("kind"), text.ustrip(v).alias("value"), F.array_position(values, v).alias("pos")
            ),
        )

    def single(kind: str, value: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(0).cast("bigint").alias("pos")))

    none = F.array().cast("array<struct<kind:string,value:string,pos:bigint>>")
    values = F.when(
        F.col("_has_insight"),
        F.concat(
            tagged("point", F.col("competitive_points")), tagged("strategy", F.col("promo_strategies"))
        ),
    ).otherwise(none)
    everything = [single("row", F.lit("")), values]
    if profile:
        everything.append(F.when(F.col("_category").isNotNull(), single("category", F.col("_category"))).otherwise(none))
    keep = [
        "id", "company", "_visible", "period_end", "_extracted", "_has_insight",
        F.when(F.col("_has_insight"), F.col("benefit_level")).alias("_level"),
        *(["_figures"] if profile else []),
    ]
    items = flagged.select(*keep, F.inline_outer(F.concat(*everything))).where(F.col("kind").isNotNull())

    is_row = F.col("kind") == "row"
    live = is_row & F.col("_visible")
    as_of = F.lit(params.as_of)
    flags = {
        "collected": is_row,
        "visible": live,
        "active": live & (F.col("period_end") >= as_of),
        "ended": live & (F.col("period_end") < as_of),
        "extracted": is_row & F.col("_extracted"),
        "insight": is_row & F.col("_has_insight"),
    }
    levels = {name: is_row & (F.col("_level") == level) for name, level in zip(LEVEL_COLUMNS, BENEFIT_LEVELS)}
    sums = {f"{name}_count": _flag(c) for name, c in flags.items()} | {name: _flag(c) for name, c in levels.items()}
    sums["_score_sum"] = F.when(is_row, amounts.map_score(F.col("_level"), BENEFIT_SCORES, None))
    if profile:
        for i, name in enumerate(_profile_figures()):
            sums[name] = F.when(is_row, F.get("_figures", F.lit(i)))
    grouped = items.groupBy("company", "kind", "value").agg(
        F.count("*").alias("n"),
        F.min("id").alias("first_id"),
        F.min_by("pos", "id").alias("first_pos"),
        *[F.sum(c).alias(name) for name, c in sums.items()],
    )
    order = [F.desc("n"), F.asc("first_id"), F.asc("first_pos"), F.asc("value")]
    return grouped.withColumn("rank", F.row_number().over(Window.partitionBy("company", "kind").orderBy(*order)))


LEVEL_COLUMNS = tuple(f"level_{i + 1}" for i in range(len(BENEFIT_LEVELS)))
OVERVIEW_COUNTS = ("collected", "visible", "active", "ended", "extracted", "insight")


def _overview_sums() -> list[Column]:
    sums = [F.sum(f"{name}_count").alias(f"{name}_count") for name in OVERVIEW_COUNTS]
    sums += [F.sum(name).alias(name) for name in (*LEVEL_COLUMNS, "_score_sum")]
    top = F.col("rank") <= 3
    return [
        *sums,
        ranked_list("value", when=(F.col("kind") == "point") & top).alias("top_competitive_points"),
        ranked_list("value", when=(F.col("kind") == "strategy") & top).alias("top_promo_strategies"),
    ]


def _with_rates(rows: DataFrame) -> DataFrame:
    scored = sum((F.col(name) for name in LEVEL_COLUMNS), F.lit(0))
    return rows.withColumns(
        {
            "extraction_rate": amounts.rate(F.col("extracted_count"), F.col("collected_count")),
            "insight_rate": amounts.rate(F.col("insight_count"), F.col("collected_count")),
            "avg_benefit_score": F.coalesce(
                F.bround(F.col("_score_sum") / F.nullif(scored, F.lit(0)), 2), F.lit(0.0)
            ),
        }
    ).drop("_score_sum")


def company_overview(events: DataFrame, params: Params) -> DataFrame:
    """Coverage, activity, extraction, levels and leading points of each company."""
    ranked = _company_values(events, params).where(F.col("rank") <= 3)
    return _with_rates(ranked.groupBy("company").agg(*_overview_sums()))


def overview_order() -> list[Column]:
    return [F.desc("collected_count"), F.asc("company")]


def overview_totals(overview: DataFrame) -> DataFrame:
    """Sums of the company rows; rates come from the sums, not from the row rates."""
    sums = overview.agg(
        *[F.coalesce(F.sum(f"{c}_count"), F.lit(0)).alias(f"{c}_total") for c in COUNTS]
    )
    return sums.withColumns(
        {
            "extraction_rate": amounts.rate(F.col("extracted_total"), F.col("collected_total")),
            "insight_rate": amounts.rate(F.col("insight_total"), F.col("collected_total")),
        }
    )


def statistics(events: DataFrame, params: Params) -> DataFrame:
    """Counts per company, threat level and category over the visible records.

    Threat levels are zero-filled; ``last_updated`` is set on the total row.
    """
    shown = events.where(records.visible(params))

    def cell(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    cells = shown.select(
        "created_at",
        F.explode(
            F.array(
                cell("company", F.col("company")),
                cell("threat", F.when(F.col("threat_level").isin(*THREAT_LEVELS), F.col("threat_level"))),
                cell("category", text.blank_to_null(F.col("category"))),
                cell("total", F.lit("")),
            )
        ).alias("c"),
    ).select("c.*", "created_at").where(F.col("key").isNotNull())
    counted = cells.groupBy("kind", "key").agg(
        F.count("*").alias("n"), F.max("created_at").alias("last_updated")
    )
    zeros = events.sparkSession.range(1).select(
        F.explode(
            F.array(*[cell("threat", F.lit(v)) for v in THREAT_LEVELS], cell("total", F.lit("")))
        ).alias("c")
    ).select("c.kind", "c.key", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("timestamp_ntz").alias("last_updated"))
    return (
        counted.unionByName(zeros)
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"), F.max("last_updated").alias("last_updated"))
        .withColumn("last_updated", F.when(F.col("kind") == "total", F.col("last_updated")))
    )


def header_kpis(events: DataFrame, params: Params) -> DataFrame:
    """Dashboard head line in one pass, by way of the companies; activity is the lenient one."""
    active = periods.lenient_active(F.col("status"), F.col("period"), params.as_of)
    flags = events.select(
        "company", records.visible(params).alias("_shown"), active.alias("_active"),
        F.try_parse_json(F.col("marketing_insights")).isNotNull().alias("_insight"),
        records.has_json_content(F.col("marketing_content")).alias("_extracted"),
    )
    shown = F.col("_shown")
    counted = {
        "total": shown, "active": shown & F.col("_active"), "ended": shown & ~F.col("_active"),
        "insights": shown & F.col("_insight"), "_extracted": F.col("_extracted"),
    }
    per_company = flags.groupBy(company_name().alias("company")).agg(
        F.count("*").alias("_n"), *[F.sum(_flag(c)).alias(name) for name, c in counted.items()]
    )
    sums = per_company.agg(
        F.count("*").alias("companies"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("_n", *counted)]
    )
    return sums.select(
        "total", "active", "ended", "insights",
        amounts.rate(F.col("_extracted"), F.col("_n")).alias("extraction_rate"), "companies",
    )


# ---- trends, maps, matrices, benchmark ----------------------------------------

def weekly_trend(events: DataFrame, since: dt.date, until: dt.date) -> DataFrame:
    """Starts and ends per week. Rows without a start date do not take part."""
    dated = computed_once(events, {c: F.col(c) for c in ("period_start", "period_end")})
    marks = dated.where(F.col("period_start").isNotNull()).select(
        F.explode(
            F.array(
                F.struct(F.lit("s").alias("kind"), F.col("period_start").alias("day")),
                F.struct(F.lit("e").alias("kind"), F.col("period_end").alias("day")),
            )
        ).alias("m")
    ).select("m.*").where(F.col("day").between(F.lit(since), F.lit(until)))
    # Days are few: fold to days first so that labels are formatted once per day.
    days = marks.groupBy("day").agg(
        F.sum(_flag(F.col("kind") == "s")).alias("started"),
        F.sum(_flag(F.col("kind") == "e")).alias("ended"),
    )
    return days.groupBy(periods.week_label(F.col("day")).alias("week")).agg(
        F.sum("started").alias("started"), F.sum("ended").alias("ended")
    )


def tag_matrix(insights: DataFrame, events: DataFrame, tags: str, drop_blank: bool) -> DataFrame:
    """Company by tag counts over all insight rows; rows without a record vanish.

    Tags are counted per promotion before the join, so a promotion with very many
    insight rows reaches the join as one row per tag.
    """
    tagged = insights.select("event_id", F.explode(tags).alias("tag"))
    if drop_blank:
        tagged = tagged.where(F.coalesce(F.col("tag"), F.lit("")) != "")
    per_event = tagged.groupBy("event_id", "tag").agg(F.count("*").alias("n"))
    names = events.select(F.col("id").alias("event_id"), company_name().alias("company"))
    return per_event.join(names, "event_id").groupBy("company", "tag").agg(F.sum("n").alias("n"))


def strategy_map(insights: DataFrame, events: DataFrame) -> DataFrame:
    return tag_matrix(insights, events, "objective_tags", drop_blank=False)


def compare_matrix(events: DataFrame, insights: DataFrame, axis: str, params: Params) -> DataFrame:
    """Company by axis value counts; axis is category, benefit_type, target or strategy."""
    if axis in ("category", "benefit_type"):
        value = F.coalesce(text.ustrip(F.col(axis)), F.lit(""))
        return (
            events.where(records.visible(params))
            .select(company_name().alias("company"), value.alias("value"))
            .where(F.col("value") != "")
            .groupBy("company", "value")
            .agg(F.count("*").alias("n"))
        )
    tags = {"target": "target_tags", "strategy": "objective_tags"}[axis]
    return tag_matrix(insights, events, tags, drop_blank=True).withColumnRenamed("tag", "value")


def widen(matrix: DataFrame, rows: str, columns: str, names: list[str], value: str = "n") -> DataFrame:
    """Long cells to one column per name; the names are given, so no extra scan."""
    return matrix.groupBy(rows).pivot(columns, names).agg(F.sum(value)).na.fill(0, names)


def with_heat(matrix: DataFrame, value: str = "n") -> DataFrame:
    return matrix.withColumn("heat", amounts.heat_bucket(F.col(value)))


def benefit_benchmark(events: DataFrame) -> DataFrame:
    """Amount and percentage level per company over records that have an amount."""
    won, pct = F.col("benefit_amount_won"), F.col("benefit_pct")
    some_won, some_pct = F.nullif(won, F.lit(0)), F.nullif(pct, F.lit(0.0))
    zero = F.lit(0).cast("bigint")
    return (
        events.where(won.isNotNull())
        .groupBy(company_name().alias("company"))
        .agg(
            F.count("*").alias("count"),
            F.coalesce(F.bround(F.sum(some_won) / F.count(some_won), 0).cast("bigint"), zero).alias("avg_amount"),
            F.coalesce(F.max(some_won), zero).alias("max_amount"),
            F.coalesce(F.bround(F.sum(some_pct) / F.count(some_pct), 1), F.lit(0.0)).alias("avg_pct"),
            F.coalesce(F.max(some_pct), F.lit(0.0)).alias("max_pct"),
        )
    )


def benchmark_items(events: DataFrame, params: Params) -> DataFrame:
    """First items per company behind the benchmark, by id."""
    rows = events.where(F.col("benefit_amount_won").isNotNull()).select(
        company_name().alias("company"), "id", "title", "category", "benefit_amount_won", "benefit_pct"
    )
    return first_per_group(rows, ["company"], [F.asc("id")], params.benchmark_items)


# ---- gaps ----------------------------------------------------------------------

def _gap_base(events: DataFrame, params: Params) -> DataFrame:
    rows = events.where(records.visible(params)).select(
        "id", "title", "benefit_value", "period", "period_start", "period_end",
        F.coalesce(text.ustrip(F.col("category")), F.lit("")).alias("category"),
        F.coalesce(text.ustrip(F.col("company")), F.lit("")).alias("company"),
    )
    return rows.withColumn("_focal", records.is_focal(F.col("company"), params))


def _active_now(rows: DataFrame, params: Params) -> DataFrame:
    return rows.where(F.col("period_end") >= F.lit(params.as_of))


def _categorised(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("category") != "") & (F.col("company") != ""))


def category_gap(events: DataFrame, params: Params) -> DataFrame:
    """Categories with active rival promotions and none of the focal company."""
    return (
        _categorised(_active_now(_gap_base(events, params), params))
        .groupBy("category")
        .agg(
            F.sum(_flag(~F.col("_focal"))).alias("competitor_count"),
            F.sum(_flag(F.col("_focal"))).alias("_own"),
        )
        .where((F.col("_own") == 0) & (F.col("competitor_count") > 0))
        .drop("_own")
    )


def gap_order() -> list[Column]:
    return [F.desc("competitor_count"), F.asc("category")]


def gap_rivals(events: DataFrame, params: Params) -> DataFrame:
    """Up to ten rival promotions of each gap category, by id."""
    active = _categorised(_active_now(_gap_base(events, params), params))
    rivals = first_per_group(
        active.where(~F.col("_focal")), ["category"], [F.asc("id")], params.gap_rival_items
    )
    return rivals.join(category_gap(events, params), "category", "left_semi").select(
        "category", "rank", "id", "company", "title", "benefit_value", "period"
    )


def gap_totals(events: DataFrame, params: Params) -> DataFrame:
    return _active_now(_gap_base(events, params), params).agg(
        F.count("*").alias("total_active"),
        F.coalesce(F.sum(_flag(F.col("_focal"))), F.lit(0)).alias("focal_active"),
    )


def week_grid(events: DataFrame, params: Params) -> DataFrame:
    """One row per reference week: ``week_no`` counts up to the week of ``as_of``."""
    ref = F.date_sub(F.lit(params.as_of), (F.lit(params.gap_weeks - 1) - F.col("week_no")).cast("int") * 7)
    return events.sparkSession.range(params.gap_weeks).select(
        F.col("id").cast("int").alias("week_no")
    ).withColumn("ref_date", ref).withColumn("week", periods.week_label(F.col("ref_date")))


def running_by_week(rows: DataFrame, groups: list[str], measures: dict[str, Column], params: Params) -> DataFrame:
    """Sums of ``measures`` over the rows that run in each reference week: groups, week_no and the sums.

    A row counts +1 in its first covered week and -1 after its last one, both of which follow from its two dates. The
    marks are summed per group and week first, so what is shuffled depends neither on the number of weeks nor, beyond
    one row per task, group and week, on the number of rows; running sums over the marks give the weeks.
    """
    last = params.gap_weeks - 1
    as_of = F.lit(params.as_of)
    back_to_start = F.floor(F.date_diff(as_of, F.col("period_start")) / 7)
    back_to_end = F.ceil(F.date_diff(as_of, F.col("period_end")) / 7)
    low = F.greatest(F.lit(last) - back_to_start, F.lit(0)).cast("int")
    high = F.least(F.lit(last) - back_to_end, F.lit(last)).cast("int")
    rows = computed_once(rows, {c: F.col(c) for c in ("period_start", "period_end")})
    spans = (
        rows.where(F.col("period_start").isNotNull() & F.col("period_end").isNotNull())
        .select(*groups, low.alias("_low"), high.alias("_high"), *[c.cast("bigint").alias(m) for m, c in measures.items()])
        .where(F.col("_low") <= F.col("_high"))
    )

    def mark(week: Column, sign: int) -> Column:
        return F.struct(week.alias("_week"), *[(F.col(m) * sign).alias(m) for m in measures])

    marks = spans.select(*groups, F.explode(F.array(mark(F.col("_low"), 1), mark(F.col("_high") + 1, -1))).alias("_m"))
    marks = marks.groupBy(*groups, "_m._week").agg(*[F.sum(f"_m.{m}").alias(m) for m in measures])
    in_order = Window.partitionBy(*groups).orderBy("_week")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.lead("_week").over(in_order) - 1, F.lit(last))
    levels = marks.select(*groups, "_week", F.least(until, F.lit(last)).alias("_until"), *[F.sum(m).over(so_far).alias(m) for m in measures])
    return levels.where(F.col("_week") <= last).withColumn("week_no", F.explode(F.sequence("_week", "_until"))).drop("_week", "_until")


def weekly_active(events: DataFrame, params: Params) -> DataFrame:
    """Running promotions per reference week and company."""
    rows = events.where(records.visible(params)).select(
        company_name().alias("company"), "period_start", "period_end"
    )
    counted = running_by_week(rows, ["company"], {"n": F.lit(1)}, params).where("n > 0")
    return counted.join(week_grid(events, params), "week_no").select("week", "ref_date", "company", "n")


def weekly_gaps(events: DataFrame, params: Params) -> DataFrame:
    """Gap categories of each reference week."""
    rows = _categorised(_gap_base(events, params)).select("category", "_focal", "period_start", "period_end")
    sides = {"own": F.col("_focal"), "rival": ~F.col("_focal")}
    return running_by_week(rows, ["category"], sides, params).where("rival > 0 AND own = 0").select("week_no", "category")


def gap_trend(events: DataFrame, params: Params) -> DataFrame:
    """Gap size per week with new and resolved categories and the change of size."""
    per_category = Window.partitionBy("category").orderBy("week_no")
    gaps = weekly_gaps(events, params).withColumns(
        {"_prev": F.lag("week_no").over(per_category), "_next": F.lead("week_no").over(per_category)}
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    opened = F.when(F.col("_prev") == F.col("week_no") - 1, zero).otherwise(one)
    closes = F.coalesce(F.col("_next") != F.col("week_no") + 1, F.lit(True))
    marks = gaps.select(
        F.explode(
            F.array(
                F.struct(F.col("week_no").alias("w"), one.alias("gap"), opened.alias("new"), zero.alias("resolved")),
                F.struct(
                    (F.col("week_no") + 1).alias("w"), zero.alias("gap"), zero.alias("new"),
                    F.when(closes, one).otherwise(zero).alias("resolved"),
                ),
            )
        ).alias("m")
    ).select("m.*")
    sums = marks.groupBy(F.col("w").alias("week_no")).agg(
        F.sum("gap").alias("gap_count"), F.sum("new").alias("new_gap_count"),
        F.sum("resolved").alias("resolved_gap_count"),
    )
    # The grid has at most gap_weeks rows, so ordering it in one window is bounded.
    return (
        week_grid(events, params)
        .join(sums, "week_no", "left")
        .na.fill(0, ["gap_count", "new_gap_count", "resolved_gap_count"])
        .withColumn(
            "gap_delta",
            F.coalesce(F.col("gap_count") - F.lag("gap_count").over(Window.orderBy("week_no")), zero),
        )
    )


def current_gaps(events: DataFrame, params: Params) -> DataFrame:
    return weekly_gaps(events, params).where(F.col("week_no") == params.gap_weeks - 1).select("category")


def lenient_gaps(events: DataFrame, params: Params) -> DataFrame:
    """Dashboard variant of the gap list: lenient activity over the listed records."""
    rows = events.where(
        records.visible(params) & periods.lenient_active(F.col("status"), F.col("period"), params.as_of)
    ).select(
        F.coalesce(text.ustrip(F.col("category")), F.lit("")).alias("category"),
        records.is_focal(F.col("company"), params).alias("_focal"),
    )
    return (
        rows.where(F.col("category") != "")
        .groupBy("category")
        .agg(F.sum(_flag(~F.col("_focal"))).alias("competitor_count"), F.sum(_flag(F.col("_focal"))).alias("_own"))
        .where((F.col("_own") == 0) & (F.col("competitor_count") > 0))
        .drop("_own")
    )


# ---- company snapshot, briefing, dimensions --------------------------------------

def _profile_figures() -> dict[str, Column]:
    """Figures of a row that a company's profile sums up, as doubles; whole ones are exact up to 2**53.

    ``_blob`` is the row's ``search_blob`` as a column; an expression would be joined anew for each word.
    """
    threat = F.lower(F.coalesce(text.ustrip(F.col("threat_level")), F.lit("")))
    status = text.first_filled(F.col("status"), F.lit("unknown"))
    days = periods.duration_days(F.col("period_start"), F.col("period_end"))
    blob = F.col("_blob")
    figures = {
        "high_threat_count": _flag(threat == "high"),
        "status_active": _flag(status == "active"),
        "status_ended": _flag(status == "ended"),
        "status_unknown": _flag(~status.isin("active", "ended")),
        "_won_sum": F.nullif(F.col("benefit_amount_won"), F.lit(0)),
        "_won_rows": _flag(F.col("benefit_amount_won") != 0),
        "_pct_sum": F.nullif(F.col("benefit_pct"), F.lit(0.0)),
        "_pct_rows": _flag(F.col("benefit_pct") != 0),
        "high_value_hits": _flag(text.contains_any(blob, HIGH_VALUE_WORDS)),
        "recurring_hits": _flag(text.contains_any(blob, RECURRING_WORDS)),
        "repeat_hits": _flag(text.contains_any(blob, REPEAT_WORDS)),
        "long_period_hits": _flag(days >= 60),
    }
    return {name: c.cast("double") for name, c in figures.items()}


def status_counts(events: DataFrame, params: Params) -> DataFrame:
    """Visible records per company and status, each status as it is stored."""
    status = text.first_filled(F.col("status"), F.lit("unknown")).alias("status")
    shown = events.where(records.visible(params))
    return shown.groupBy(company_name().alias("company"), status).agg(F.count("*").alias("n"))


def company_snapshot(events: DataFrame, params: Params) -> DataFrame:
    """Overview of each company with the profile and the category mix of its visible records, in one read.

    The mix: leading categories, number of categories and what the entropy of their shares is made of; shares are
    taken over all visible events, including those without a category.
    """
    zero = F.lit(0).cast("bigint")
    category = F.col("kind") == "category"
    sums = [F.sum(name).cast("double" if name.startswith("_") else "bigint").alias(name) for name in _profile_figures()]
    rows = _company_values(events, params, profile=True).groupBy("company").agg(
        *_overview_sums(), *sums,
        ranked_list("value", when=category & (F.col("rank") <= 3)).alias("top_categories"),
        F.count_if(category).alias("categories"),
        F.sum(F.when(category, F.col("n") * F.ln("n"))).alias("_nlogn"),
        F.sum(F.when(category, F.col("n"))).alias("_n"),
    )
    fill = [n for n in _profile_figures() if not n.startswith("_")]
    return (
        _with_rates(rows)
        .withColumns({
            "events": F.col("visible_count"),
            "avg_benefit_amount_won": F.coalesce(F.bround(F.col("_won_sum") / F.nullif(F.col("_won_rows"), F.lit(0)), 0).cast("bigint"), zero),
            "avg_benefit_pct": F.coalesce(F.bround(F.col("_pct_sum") / F.nullif(F.col("_pct_rows"), F.lit(0)), 1), F.lit(0.0)),
        })
        .na.fill(0, fill)
        .drop("_won_sum", "_won_rows", "_pct_sum", "_pct_rows")
    )


def recent_events(events: DataFrame, params: Params, k: int = 5) -> DataFrame:
    rows = events.where(records.visible(params)).select(
        company_name().alias("company"), "id", "title", "category", "benefit_value", "period",
        "status", "threat_level", "created_at",
    )
    return first_per_group(rows, ["company"], [F.desc_nulls_last("created_at"), F.asc("id")], k)


def company_briefing(snapshot: DataFrame) -> DataFrame:
    """Template sentences from the snapshot figures."""
    named = snapshot.withColumns(
        {
            "_cats": text.first_filled(
                F.array_join(F.slice("top_categories", 1, 2), ", "), F.lit("다양한 카테고리")
            ),
            "_strats": text.first_filled(F.array_join(F.slice("top_promo_strategies", 1, 2), ", "), F.lit("일반 프로모션")),
            "_points": F.array_join(F.slice("top_competitive_points", 1, 2), ", "),
            "_won": F.when(
                F.col("avg_benefit_amount_won") != 0,
                F.concat(F.lit("평균 "), F.format_number("avg_benefit_amount_won", 0), F.lit("원")),
            ),
            "_pct": F.when(
                F.col("avg_benefit_pct") != 0,
                F.concat(F.lit("평균 "), F.format_string("%.1f", "avg_benefit_pct"), F.lit("%")),
            ),
        }
    )
    overview = F.concat(
        F.col("company"), F.lit("은 현재 "), F.col("active_count").cast("string"),
        F.lit("건의 이벤트를 진행 중이며, "), F.col("_cats"), F.lit(" 카테고리에 집중하고 있습니다. 주요 전략은 "),
        F.col("_strats"), F.lit(" 중심입니다."),
    )
    benefit = text.blank_to_null(F.concat_ws(" / ", "_won", "_pct"))
    return named.select(
        "company",
        overview.alias("overview"),
        F.col("_strats").alias("key_strategy"),
        F.slice("top_categories", 1, 3).alias("strongest_categories"),
        F.coalesce(F.concat(benefit, F.lit(" 수준")), F.lit("혜택 데이터 부족")).alias("avg_benefit_assessment"),
        F.lit("전반적 고객층 대상").alias("target_focus"),
        text.first_filled(F.col("_points"), F.concat(F.col("_cats"), F.lit(" 영역에서 경쟁 심화"))).alias("rival_threat"),
        F.concat(F.col("_cats"), F.lit(" 카테고리에서 차별화된 혜택 구조 설계가 필요합니다.")).alias("recommended_counter"),
    )


def dimension_scores(snapshot: DataFrame) -> DataFrame:
    """Four 0 to 100 scores per company."""
    total = F.greatest(F.col("events"), F.lit(1)).cast("double")
    n = F.col("events").cast("double")
    words = F.concat_ws(
        " ", F.array_join("top_categories", " "),
        F.array_join("top_competitive_points", " "), F.array_join("top_promo_strategies", " "),
    )
    hint = {
        "_recurring_hint": text.contains_any(words, RECURRING_HINT_WORDS).cast("int"),
        "_repeat_hint": text.contains_any(words, REPEAT_HINT_WORDS).cast("int"),
    }
    # -sum(p ln p) with p = c/N over the categorised counts c, N = all visible events
    raw_entropy = -(F.col("_nlogn") - F.col("_n") * F.ln(n)) / n
    entropy = F.when(F.col("categories") > 1, raw_entropy / F.ln(F.col("categories").cast("double"))).otherwise(0.0)
    active_ratio = F.coalesce(
        F.col("active_count") / F.nullif(F.col("visible_count").cast("double"), F.lit(0.0)), F.lit(0.0)
    )
    cap = lambda score: F.least(F.lit(100.0), score)
    return snapshot.withColumns(hint).select(
        "company",
        cap(
            F.col("high_value_hits") / total * 65
            + F.least(F.lit(22.0), F.col("avg_benefit_amount_won") / 18000.0)
            + F.least(F.lit(13.0), F.col("avg_benefit_pct") * 0.9)
            + F.least(F.lit(8.0), F.col("avg_benefit_score") * 2.0)
        ).alias("high_value_score"),
        cap(
            F.col("recurring_hits") / total * 80
            + F.col("long_period_hits") / total * 20
            + F.col("_recurring_hint") * 18
        ).alias("recurring_score"),
        cap(
            F.col("categories") * 10 + entropy * 45 + F.least(F.lit(15.0), n * 0.8)
        ).alias("diversity_score"),
        cap(
            F.col("repeat_hits") / total * 70
            + F.col("long_period_hits") / total * 30
            + F.col("_repeat_hint") * 15
            + F.least(F.lit(10.0), active_ratio * 12.0)
        ).alias("repeatability_score"),
    )


SCORE_COLUMNS = ("high_value_score", "recurring_score", "diversity_score", "repeatability_score")


def dimension_levels(scores: DataFrame) -> DataFrame:
    """Long comparison table: company, metric number, metric, five-step level."""
    cells = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("metric_no"), F.lit(name).alias("metric"),
                F.coalesce(amounts.five_level(F.col(col)), F.lit(FIVE_LEVEL_DEFAULT)).alias("level"),
            )
            for i, (name, col) in enumerate(zip(DIMENSION_METRICS, SCORE_COLUMNS))
        ]
    )
    return scores.select("company", F.explode(cells).alias("c")).select("company", "c.*")


def comparison_table(levels: DataFrame, companies: list[str]) -> DataFrame:
    """Metrics by company for a given list of companies; missing ones read as medium."""
    wide = levels.groupBy("metric_no", "metric").pivot("company", companies).agg(F.first("level"))
    return wide.na.fill(FIVE_LEVEL_DEFAULT, companies)


def corpus_texts(events: DataFrame, params: Params) -> DataFrame:
    """The visible texts of named companies that are long enough to compare."""
    return events.where(records.visible(params)).select(
        F.coalesce(text.ustrip(F.col("company")), F.lit("")).alias("company"), "id", "created_at", "raw_text"
    ).where((F.col("company") != "") & (F.length(text.ustrip(F.col("raw_text"))) > 30))


def company_corpus(events: DataFrame, params: Params) -> DataFrame:
    """The ``corpus_rows`` newest texts of each company, whole and joined: the input of a text comparison.

    The join is one value per company, so without a number (``None``) a company's texts must fit in one row;
    ``corpus_texts`` gives them row by row.
    """
    texts, order = corpus_texts(events, params), [F.desc_nulls_last("created_at"), F.asc("id")]
    if params.corpus_rows is None:
        lines = F.sort_array(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id", "raw_text")))
        known = F.filter(lines, lambda x: x["t"].isNotNull())
        unknown = F.filter(lines, lambda x: x["t"].isNull())
        return texts.groupBy("company").agg(F.array_join(F.transform(F.concat(known, unknown), lambda x: x["raw_text"]), "\n").alias("corpus"))
    newest = first_per_group(texts, ["company"], order, params.corpus_rows)
    return newest.groupBy("company").agg(F.array_join(ranked_list("raw_text"), "\n").alias("corpus"))


def phrase_presence(texts: DataFrame, phrases=COMMON_PHRASES) -> DataFrame:
    """Which common phrases occur anywhere in the ``raw_text`` of the rows."""
    hits = texts.agg(
        *[F.coalesce(F.max(F.col("raw_text").contains(p)), F.lit(False)).alias(f"p{i}") for i, p in enumerate(phrases)]
    )
    cells = F.array(
        *[
            F.struct(F.lit(i + 1).alias("phrase_no"), F.lit(p).alias("phrase"), F.col(f"p{i}").alias("found"))
            for i, p in enumerate(phrases)
        ]
    )
    return hits.select(F.explode(cells).alias("c")).select("c.*").where("found").drop("found")


# ---- boards ------------------------------------------------------------------------

def _listed(events: DataFrame, params: Params) -> DataFrame:
    """The records a dashboard holds, with lenient activity, focal and extraction flags."""
    return events.where(records.visible(params)).withColumns(
        {
            "_active": periods.lenient_active(F.col("status"), F.col("period"), params.as_of),
            "_focal": records.is_focal(F.col("company"), params),
            "_end": periods.lenient_end_date(F.col("period_end"), F.col("period")),
            "_extracted": records.extracted_flag(records.has_json_content(F.col("marketing_insights"))),
        }
    )


def marketing_board(events: DataFrame, params: Params) -> DataFrame:
    """Counters over the active rival promotions."""
    rivals = _listed(events, params).where(F.col("_active") & ~F.col("_focal"))
    left = periods.days_left(F.col("_end"), params.as_of)
    since = F.date_sub(F.lit(params.as_of), params.recent_days)
    return rivals.agg(
        F.count("*").alias("active_rivals"),
        F.sum(_flag(left.between(0, params.ending_days))).alias("ending_soon"),
        F.sum(_flag(~F.col("_extracted"))).alias("pending"),
        F.sum(_flag(F.col("created_at") >= since)).alias("new_rivals"),
    ).na.fill(0)


def top_rival_benefits(events: DataFrame, params: Params, k: int = 6) -> DataFrame:
    rivals = _listed(events, params).where(F.col("_active") & ~F.col("_focal"))
    return rivals.select(
        "id", "company", "title",
        F.coalesce("benefit_amount_won", F.lit(0)).alias("amount"),
        F.coalesce("benefit_pct", F.lit(0.0)).alias("pct"), "created_at",
    ).orderBy(F.desc("amount"), F.desc("pct"), F.desc_nulls_last("created_at"), F.asc("id")).limit(k)


def pending_by_company(events: DataFrame, params: Params, k: int = 3) -> DataFrame:
    pending = _listed(events, params).where(F.col("_active") & ~F.col("_focal") & ~F.col("_extracted"))
    return (
        pending.groupBy(text.first_filled(F.col("company"), F.lit(UNKNOWN_COMPANY)).alias("company"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), F.asc("company"))
        .limit(k)
    )


def urgent_rivals(events: DataFrame, params: Params, k: int = 5) -> DataFrame:
    """New active rival promotions, strongest benefit level first."""
    since = F.date_sub(F.lit(params.as_of), params.recent_days)
    level = F.col("_ins.benefit_level")
    rows = _listed(events, params).where(
        F.col("_active") & ~F.col("_focal") & (F.coalesce(F.col("company"), F.lit("")) != "")
        & F.coalesce(F.col("created_at") >= since, F.lit(True))
    ).withColumn("_ins", records.insight_struct(F.col("marketing_insights")))
    return rows.select(
        "id", "company", "title", amounts.map_score(level, BENEFIT_SCORES, 0.0).alias("score")
    ).orderBy(F.desc("score"), F.asc("id")).limit(k)


def rival_feed(events: DataFrame, params: Params, k: int = 5) -> DataFrame:
    rows = _listed(events, params).where(~F.col("_focal"))
    return rows.select("id", "company", "title", F.col("_active").alias("active"), "created_at").orderBy(
        F.desc("active"), F.desc_nulls_last("created_at"), F.asc("id")
    ).limit(k)


def risk_cells(events: DataFrame, params: Params) -> DataFrame:
    """Active promotions per category and company."""
    return (
        _listed(events, params)
        .where(F.col("_active"))
        .select(
            F.coalesce(text.ustrip(F.col("category")), F.lit("")).alias("category"),
            F.coalesce(text.ustrip(F.col("company")), F.lit("")).alias("company"),
        )
        .where((F.col("category") != "") & (F.col("company") != ""))
        .groupBy("category", "company")
        .agg(F.count("*").alias("n"))
    )


def risk_categories(cells: DataFrame) -> DataFrame:
    """Category totals with the hot (contested) and exclusive (one company) marks."""
    return cells.groupBy("category").agg(
        F.sum("n").alias("total"), F.count("*").alias("companies"), F.min("company").alias("_owner")
    ).select(
        "category", "total", "companies",
        ((F.col("companies") >= 2) & (F.col("total") >= 3)).alias("hot"),
        ((F.col("companies") == 1) & (F.col("total") >= 2)).alias("exclusive"),
        F.when(F.col("companies") == 1, F.col("_owner")).alias("owner"),
    )


def risk_lists(categories: DataFrame) -> DataFrame:
    """The three short lists of the risk map: 5 hot, 4 exclusive, 12 largest."""
    cells = F.array_compact(
        F.array(
            F.when(F.col("hot"), F.lit("hot")), F.when(F.col("exclusive"), F.lit("exclusive")), F.lit("table")
        )
    )
    marked = categories.withColumn("list", F.explode(cells))
    ranked = first_per_group(marked, ["list"], [F.desc("total"), F.asc("category")], 12)
    size = F.when(F.col("list") == "hot", 5).when(F.col("list") == "exclusive", 4).otherwise(12)
    return ranked.where(F.col("rank") <= size).select("list", "rank", "category", "total", "companies")


def _week_bounds(as_of: dt.date) -> tuple[dt.date, dt.date]:
    monday = as_of - dt.timedelta(days=as_of.weekday())
    return monday, monday + dt.timedelta(days=6)


def _weekly_marks(events: DataFrame, params: Params) -> DataFrame:
    monday, sunday = _week_bounds(params.as_of)
    end = periods.lenient_end_date(
        F.lit(None).cast("date"), F.when(F.col("period").contains("~"), F.col("period"))
    )
    inside = lambda d: F.coalesce(d.between(F.lit(monday), F.lit(sunday)), F.lit(False))
    kinds = F.array_compact(
        F.array(
            F.when(inside(F.col("created_at").cast("date")), F.lit("new")),
            F.when(inside(end), F.lit("ending")),
        )
    )
    shown = events.where(records.visible(params))
    company = text.first_filled(F.col("company"), F.lit(UNKNOWN_COMPANY)).alias("company")
    return exploded(shown, ["id", company, "title"], kinds, "kind")


def weekly_changes(events: DataFrame, params: Params) -> DataFrame:
    """Promotions that start or end in the week of ``as_of``, counted per company."""
    return _weekly_marks(events, params).groupBy("kind", "company").agg(F.count("*").alias("n"))


def weekly_change_items(events: DataFrame, params: Params, k: int = 3) -> DataFrame:
    return first_per_group(_weekly_marks(events, params), ["kind", "company"], [F.asc("id")], k)


def company_order(df: DataFrame, order) -> DataFrame:
    """Preferred companies first, the rest by name."""
    return df.orderBy(text.company_rank(F.col("company"), order), F.asc("company"))
