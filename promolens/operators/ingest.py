"""Ingest: dedupe, insert-if-new, run limits and run summaries."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions import records, text
from promolens.operators.ranking import first_per_group, first_seen
from promolens.params import Params


def dedupe_first(batch: DataFrame, order: list[Column]) -> DataFrame:
    """First record per address (or per title and period when it has none)."""
    keyed = batch.withColumn("_key", text.dedupe_key(F.col("url"), F.col("title"), F.col("period")))
    return first_seen(keyed, ["_key"], order).drop("_key")


def merge_passes(passes: list[DataFrame], thresholds: list[int | None] | None = None, arrival: str = "arrival") -> DataFrame:
    """Union of collection passes in priority order, first seen wins; every pass takes part unless it has a threshold.

    With ``thresholds``, pass ``i`` takes part for a company only while fewer than ``thresholds[i]``
    records were collected by the earlier passes (``None`` = always). Without any, all passes meet in one exchange.
    """
    if thresholds is None or all(t is None for t in thresholds):
        rows = [part.withColumn("_pass", F.lit(rank)) for rank, part in enumerate(passes)]
        every = functools.reduce(DataFrame.unionByName, rows)
        return dedupe_first(every, [F.asc("_pass"), F.asc(arrival)]).withColumnRenamed("_pass", "source_pass")
    collected = None
    for rank, (part, threshold) in enumerate(zip(passes, thresholds)):
        rows = part.withColumn("_pass", F.lit(rank))
        if collected is None:
            collected = dedupe_first(rows, [F.asc(arrival)])
            continue
        if threshold is not None:
            full = (
                collected.groupBy("company").agg(F.count("*").alias("_n"))
                .where(F.col("_n") >= threshold).select("company")
            )
            rows = rows.join(full, "company", "left_anti")
        collected = dedupe_first(collected.unionByName(rows), [F.asc("_pass"), F.asc(arrival)])
    return collected.withColumnRenamed("_pass", "source_pass")


def not_stored(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Records whose address is not in the target table."""
    return batch.join(stored.select("url"), "url", "left_anti")


def insert_if_new(batch: DataFrame, stored: DataFrame, order: list[Column], params: Params) -> DataFrame:
    """New rows for the target: first per exact address, absent from it, derived fields filled."""
    firsts = first_seen(batch, ["url"], order)
    return records.derive_fields(not_stored(firsts, stored), params.as_of)


def direct_entry(entries: DataFrame, stored: DataFrame, order: list[Column], params: Params) -> DataFrame:
    """Hand-entered records on the path of collected ones: normalised, empty texts null, new addresses only."""
    built = records.drop_empty(records.accepted(records.build_records(entries, params.vocab)))
    return insert_if_new(built, stored, order, params)


def limit_per_company(batch: DataFrame, order: list[Column], params: Params) -> DataFrame:
    """The first records of each company in arrival order, if the run has a limit; all of them otherwise."""
    if params.ingest_limit_per_company is None:
        return batch
    return first_per_group(batch, ["company"], order, params.ingest_limit_per_company, "_rn").drop("_rn")


def ingest_run(batch: DataFrame, stored: DataFrame, order: list[Column], params: Params) -> DataFrame:
    return insert_if_new(limit_per_company(batch, order, params), stored, order, params)


def ingest_summary(batch: DataFrame, inserted: DataFrame) -> DataFrame:
    """Inserted and skipped per company; rows beyond the run limit count as skipped."""
    seen = batch.groupBy("company").agg(F.count("*").alias("collected"))
    new = inserted.groupBy("company").agg(F.count("*").alias("ingested"))
    joined = seen.join(new, "company", "left").na.fill(0, ["ingested"])
    return joined.withColumn("skipped", F.col("collected") - F.col("ingested"))


# ---- extraction queue ----------------------------------------------------------------

def pending_extraction(events: DataFrame) -> DataFrame:
    """Records without content: real address, no demo address, newest first."""
    content = F.col("marketing_content")
    return events.where(
        (F.coalesce(F.col("url"), F.lit("")) != "")
        & ~F.lower("url").like("%/event/detail/%")
        & (content.isNull() | content.isin("", "{}"))
    )


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("created_at"), F.asc("id")]


def extraction_plan(pending: DataFrame, locks: DataFrame) -> DataFrame:
    """What a run does with each pending record.

    Addresses that are not http fail, locked records are skipped and count as
    succeeded, the rest is extracted.
    """
    held = locks.where("is_locked").select(F.col("event_id").alias("id")).distinct().withColumn("_held", F.lit(True))
    action = (
        F.when(~F.col("url").startswith("http"), "failed")
        .when(F.col("_held"), "skipped")
        .otherwise("extract")
    )
    return pending.join(held, "id", "left").withColumn("action", action).drop("_held")


def extraction_summary(outcomes: DataFrame) -> DataFrame:
    """Run counters from the per-record outcome (``action``, ``error``, ``source``)."""
    ok = (F.col("action") == "skipped") | ((F.col("action") == "extract") & F.col("error").isNull())
    return outcomes.agg(
        F.count("*").alias("processed"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.count_if((F.col("action") == "extract") & F.col("error").isNull() & (F.col("source") == "gemini"))
        .alias("enriched"),
    )


def new_items(batch: DataFrame, ledger: DataFrame, ident: str) -> DataFrame:
    """Items that the ledger does not list yet."""
    return batch.join(ledger.select(F.col("item_id").alias(ident)), ident, "left_anti")


def extend_ledger(ledger: DataFrame, done: DataFrame, ident: str) -> DataFrame:
    return ledger.select("item_id").union(done.select(F.col(ident).alias("item_id"))).distinct()
