"""History tables: snapshots, sections, insights, edits, locks and jobs.

A table "update" is a transformation from the stored version and a batch of
changes to the next version; ``storage.write_version`` puts it under a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens import schemas
from promolens.functions import records, text
from promolens.functions.rows import posexploded
from promolens.operators.ranking import first_seen, with_previous

# fixed values: order of sources, fields open to edits
SOURCE_PRIORITY = ("gemini", "hybrid", "rule")
EDITABLE = ("title", "period", "benefit_value", "benefit_type", "conditions", "target_segment", "category")


# ---- insights ---------------------------------------------------------------------

def source_rank(source: Column) -> Column:
    chain = None
    for i, name in enumerate(SOURCE_PRIORITY):
        chain = F.when(source == name, i) if chain is None else chain.when(source == name, i)
    return chain.otherwise(len(SOURCE_PRIORITY))


def latest_insight(insights: DataFrame) -> DataFrame:
    """One insight per promotion: best source first, newest within the source."""
    return first_seen(
        insights, ["event_id"],
        [source_rank(F.col("source")), F.desc("generated_at"), F.desc("id")],
    )


def replace_insights(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """New insight rows take the place of stored ones with the same promotion and source.

    Of several new rows for one promotion and source the newest stays.
    """
    age = [F.desc(c) for c in ("generated_at", "id") if c in fresh.columns]
    fresh = first_seen(fresh, ["event_id", "source"], age) if age else fresh
    known = [c for c in fresh.columns if c in stored.columns]
    kept = stored.join(fresh.select("event_id", "source").distinct(), ["event_id", "source"], "left_anti")
    return kept.unionByName(fresh.select(*known), allowMissingColumns=True)


# ---- sections ----------------------------------------------------------------------

def section_rows(contents: DataFrame, sections: Column, order) -> DataFrame:
    """Section map to rows with a running ``sort_order`` inside each promotion.

    Sections of ``order`` come first, the other keys as the map has them; blank items
    are skipped before numbering. The numbering is a position in one row's array, so
    no shuffle is involved.
    """
    def rows_of(name: Column) -> Column:
        texts = F.coalesce(F.try_element_at(sections, name), F.array().cast("array<string>"))
        return F.transform(
            F.filter(texts, lambda v: v.isNotNull() & (v != "")),
            lambda v: F.struct(
                name.alias("section_type"), v.alias("content")
            ),
        )

    named = F.array(*[F.lit(name) for name in order])
    names = F.concat(named, F.array_except(F.map_keys(sections), named))
    items = F.flatten(F.transform(names, rows_of))
    return posexploded(contents, ["event_id"], items, "sort_order", "item").select(
        "event_id", "item.section_type", "item.content", "sort_order"
    )


def replace_sections(stored: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """All rows of the touched promotions are replaced, also by nothing."""
    kept = stored.join(touched.select("event_id").distinct(), "event_id", "left_anti")
    return kept.unionByName(fresh)


# ---- snapshots ---------------------------------------------------------------------

def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """Captures per promotion with their text length, newest first."""
    return snapshots.select(
        "event_id", "captured_at", "extraction_latency_ms",
        F.coalesce(F.length("raw_text"), F.lit(0)).alias("raw_text_len"),
    )


def newest_first() -> list[Column]:
    return [F.asc("event_id"), F.desc("captured_at")]


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """Whether each capture differs from the one before it (by text fingerprint)."""
    marked = snapshots.select(
        "event_id", "captured_at",
        F.sha2(F.coalesce("raw_text", F.lit("")), 256).alias("digest"),
    )
    paired = with_previous(
        marked, ["event_id"], F.col("captured_at").cast("date"), ["captured_at"], "digest", "previous"
    )
    return paired.select(
        "event_id", "captured_at",
        F.when(~F.col("_has_previous"), "first")
        .when(F.col("digest") == F.col("previous"), "unchanged")
        .otherwise("changed").alias("change"),
    )


# ---- manual edits --------------------------------------------------------------------

def manual_edits(events: DataFrame, edits: DataFrame) -> DataFrame:
    """Audit rows of an edit batch: only allowed fields whose text really changes.

    ``edits`` has one row per (event_id, field_name, new_value, editor, reason,
    edited_at) and may have ``seq``, which orders edits of one moment (without it, or if
    it is equal too, their values do). Each edit is compared with
    the value that the edits before it left; a null never clears a field. Null and empty text count as equal.
    """
    order = [c for c in ("edited_at", "seq") if c in edits.columns]
    before = Window.partitionBy("event_id", "field_name").orderBy(*order, "new_value").rowsBetween(Window.unboundedPreceding, -1)
    edits = edits.where(F.col("field_name").isin(*EDITABLE))
    edits = edits.withColumn("_left", F.last("new_value", ignorenulls=True).over(before))
    touched = edits.select(F.col("event_id").alias("id")).distinct()
    current = events.join(touched, "id", "left_semi").select(
        F.col("id").alias("event_id"),
        F.explode(
            F.array(
                *[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("old_value")) for f in EDITABLE]
            )
        ).alias("f"),
    ).select("event_id", "f.field_name", "f.old_value")
    joined = edits.join(current, ["event_id", "field_name"])
    old, new = F.coalesce("_left", "old_value"), F.col("new_value")
    changed = F.coalesce(old, F.lit("")) != F.coalesce(new, F.lit(""))
    return joined.where(changed).select(
        "event_id", "field_name", old.alias("old_value"), new.alias("new_value"), "editor", "reason", *order,
    )


def edit_updates(audit: DataFrame) -> DataFrame:
    """Audit rows to one update row per promotion; the last edit of a field that gives a value wins.

    Each field reduces to one value with ``max_by``, which merges map-side.
    """
    order = F.struct(*[c for c in ("edited_at", "seq") if c in audit.columns], "new_value")
    return audit.groupBy("event_id").agg(
        *[
            F.max_by(
                F.when(F.col("field_name") == f, F.col("new_value")),
                F.when((F.col("field_name") == f) & F.col("new_value").isNotNull(), order),
            ).alias(f)
            for f in EDITABLE
        ]
    ).withColumnRenamed("event_id", "id")


def edit_history(edits: DataFrame) -> DataFrame:
    return edits.orderBy(F.asc("event_id"), F.desc("edited_at"))


def audit_log(
    edits: DataFrame, event_id: int | None = None, editor: str | None = None, since=None, until=None
) -> DataFrame:
    """Edits that pass the given filters; absent filters do not restrict."""
    kept = edits
    if event_id:
        kept = kept.where(F.col("event_id") == event_id)
    if editor:
        kept = kept.where(F.col("editor") == editor)
    if since is not None:
        kept = kept.where(F.col("edited_at") >= F.lit(since))
    if until is not None:
        kept = kept.where(F.col("edited_at") <= F.lit(until))
    return kept


def audit_page(edits: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    return edits.orderBy(F.desc("edited_at"), F.asc("event_id")).offset((page - 1) * size).limit(size)


# ---- locks -----------------------------------------------------------------------------

def lock_state(commands: DataFrame) -> DataFrame:
    """Current lock per promotion from lock and unlock commands; the last one wins."""
    last = first_seen(commands, ["event_id"], [F.desc("locked_at"), F.desc("seq")])
    held = F.col("is_locked")
    kept = [c for c in ("locked_by", "locked_at", "lock_reason") if c in commands.columns]
    return last.select("event_id", "is_locked", *[F.when(held, F.col(c)).alias(c) for c in kept])


def apply_locks(stored: DataFrame, commands: DataFrame) -> DataFrame:
    """Next lock table: promotions with a command take its outcome."""
    fresh = lock_state(commands)
    kept = stored.join(fresh.select("event_id"), "event_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def toggle_locks(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request flips the lock; an even number of requests leaves it as it was.

    A promotion without a lock row counts as unlocked.
    """
    last = F.struct("locked_at", "seq")
    reason = F.max_by("lock_reason", last) if "lock_reason" in requests.columns else F.lit(None).cast("string")
    asked = requests.groupBy("event_id").agg(
        F.count("*").alias("_n"), F.max_by("locked_by", last).alias("_by"),
        F.max("locked_at").alias("_at"), reason.alias("_reason"),
    )
    joined = asked.join(stored.select("event_id", F.col("is_locked").alias("_was")), "event_id", "left")
    now = F.coalesce("_was", F.lit(False)) != (F.col("_n") % 2 == 1)
    return joined.select(
        "event_id", now.alias("is_locked"), F.when(now, F.col("_by")).alias("locked_by"),
        F.when(now, F.col("_at")).alias("locked_at"), F.when(now, F.col("_reason")).alias("lock_reason"),
    )


# ---- jobs --------------------------------------------------------------------------------

def job_state(transitions: DataFrame) -> DataFrame:
    """Current job rows from an append-only transition log.

    The last transition gives the status; failures are counted, the last error
    text is kept, and the end time is that of the last final status.
    """
    order = F.struct("at", "seq")
    final = F.col("status").isin("success", "failed")
    return transitions.groupBy("job_id").agg(
        F.max_by("status", order).alias("status"),
        F.count_if(F.col("status") == "failed").alias("retry_count"),
        F.max_by(
            F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.col("error")),
            F.when(F.coalesce(F.col("error"), F.lit("")) != "", order),
        ).alias("last_error"),
        F.min("at").alias("started_at"),
        F.max(F.when(final, F.col("at"))).alias("finished_at"),
    )


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Failed jobs become pending; all others stay."""
    return jobs.withColumn(
        "status", F.when(F.col("status") == "failed", "pending").otherwise(F.col("status"))
    )


def job_log(jobs: DataFrame, job_type: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    kept = jobs
    if job_type:
        kept = kept.where(F.col("job_type") == job_type)
    if status:
        kept = kept.where(F.col("status") == status)
    return kept.orderBy(F.desc("id")).limit(limit)


def job_stats(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("job_type", "status").agg(F.count("*").alias("n"))


# ---- joined views ---------------------------------------------------------------------------

# fixed values: fields of an insight, and attributes of the comparison below
INSIGHT_FIELDS = (
    "benefit_level", "benefit_score", "target_clarity", "threat_reason", "marketing_takeaway", "objective_tags",
    "target_tags", "channel_tags", "competitive_points", "promo_strategies", "evidence", "insight_confidence",
    "section_coverage",
)


def intelligence(
    events: DataFrame, insights: DataFrame, sections: DataFrame, snapshots: DataFrame, locks: DataFrame
) -> DataFrame:
    """Promotion with its best insight, its sections, section and snapshot counts and lock flag.

    Of the insight fields those that the insight table has are taken; its threat level is
    ``insight_threat``. The keys that only the stored insight JSON has come as ``insight_extra``, for
    promotions with an insight. Children are reduced to one row per promotion before they are joined.
    """
    best = latest_insight(insights).select(
        F.col("event_id").alias("id"), *[c for c in INSIGHT_FIELDS if c in insights.columns],
        *[F.col("threat_level").alias("insight_threat") for c in insights.columns if c == "threat_level"],
        F.col("source").alias("insight_source"),
    )
    part = F.struct("sort_order", "section_type", "content")
    parts = sections.groupBy(F.col("event_id").alias("id")).agg(
        F.count("*").alias("section_count"), F.sort_array(F.collect_list(part)).alias("sections"))
    shots = snapshots.groupBy(F.col("event_id").alias("id")).agg(F.count("*").alias("snapshot_count"))
    held = locks.select(F.col("event_id").alias("id"), F.col("is_locked").alias("locked"))
    view = (
        events.join(best, "id", "left").join(parts, "id", "left").join(shots, "id", "left")
        .join(held, "id", "left")
        .na.fill(0, ["section_count", "snapshot_count"]).na.fill(False, ["locked"])
        .withColumn("sections", F.coalesce("sections", F.array()))
    )
    if "marketing_insights" not in events.columns:
        return view
    stored = records.insight_struct(F.col("marketing_insights"))
    extra = F.struct(*[stored[k].alias(k) for k in schemas.INSIGHT_EXTRA_KEYS])
    return view.withColumn("insight_extra", F.when(F.col("insight_source").isNotNull(), extra))


def with_insight(insights: DataFrame, events: DataFrame) -> DataFrame:
    """Insight rows with their promotion; rows without one are dropped."""
    names = events.select(F.col("id").alias("event_id"), "company", "title")
    return insights.join(names, "event_id")


COMPARE_ATTRIBUTES = (
    "company", "title", "period", "benefit_value", "benefit_type", "conditions", "target_segment", "category",
    "benefit_level", "target_clarity", "competitive_points", "promo_strategies", "marketing_takeaway",
)


def side_by_side(view: DataFrame, chosen: DataFrame) -> DataFrame:
    """Thirteen attributes of the chosen promotions as (attribute, id, value) cells."""
    picked = view.join(chosen, "id", "left_semi")

    def shown(name: str) -> Column:
        if name not in view.columns:
            return F.lit("-")
        c = F.col(name)
        if name in ("competitive_points", "promo_strategies"):
            c = F.array_join(c, ", ")
        if name == "marketing_takeaway":
            return F.coalesce(c, F.lit(""))
        if name in ("company", "title"):
            return F.coalesce(c, F.lit(""))
        return F.coalesce(text.blank_to_null(c.cast("string")), F.lit("-"))

    cells = F.array(
        *[
            F.struct(F.lit(i + 1).alias("attribute_no"), F.lit(n).alias("attribute"), shown(n).alias("value"))
            for i, n in enumerate(COMPARE_ATTRIBUTES)
        ]
    )
    return picked.select("id", F.explode(cells).alias("c")).select("id", "c.*")

