"""Ordered and ranked operators that stay distributed under skew.

``first_per_group`` filters ``row_number`` directly, so Spark plans a partial
group limit before the shuffle: every map task sends at most ``k`` rows per
group, however large one group is. The scan helpers cut a long ordered group
into buckets and carry only a small summary from bucket to bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.functions.rows import exploded


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key."""
    return first_per_group(df, keys, order, 1, "_rn").drop("_rn")


def value_counts(df: DataFrame, keys: Sequence[str], values: Column, ident: str = "id") -> DataFrame:
    """Occurrences of array values per group, with the place where each was first seen.

    The place is (smallest row id, first position in that row), which fixes the
    order of equally frequent values. Counting happens map-side first.
    """
    rows = df.select(*keys, F.col(ident).alias("_id"), values.alias("_vals"))
    items = exploded(rows, [*keys, "_id", "_vals"], F.col("_vals"), "value")
    places = items.withColumn("_pos", F.array_position("_vals", F.col("value"))).drop("_vals")
    return places.groupBy(*keys, "value").agg(
        F.count("*").alias("n"),
        F.min("_id").alias("first_id"),
        F.min_by("_pos", "_id").alias("first_pos"),
    )


def top_values(df: DataFrame, keys: Sequence[str], values: Column, k: int, ident: str = "id") -> DataFrame:
    counted = value_counts(df, keys, values, ident)
    order = [F.desc("n"), F.asc("first_id"), F.asc("first_pos"), F.asc("value")]
    return first_per_group(counted, keys, order, k)


def ranked_list(value: str | Column, rank: str = "rank", when: Column | None = None) -> Column:
    """Aggregate: values of a few ranked rows as an array in rank order."""
    value = F.col(value) if isinstance(value, str) else value
    pair = F.struct(F.col(rank).alias("r"), value.alias("v"))
    picked = F.collect_list(pair if when is None else F.when(when, pair))
    return F.transform(F.sort_array(picked), lambda e: e["v"])


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    value: str,
    previous: str,
) -> DataFrame:
    """Value of the preceding row of the group, for groups of any length.

    Rows are windowed per (group, bucket); ``bucket`` must grow with ``order``
    (for example the day of a timestamp). The last value of each bucket is handed
    to the next bucket through a table with one row per bucket.
    """
    cut = df.withColumn("_bucket", bucket)
    last = cut.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last")
    )
    over_buckets = Window.partitionBy(*keys).orderBy("_bucket")
    carried = last.select(
        *keys, "_bucket", F.lag("_last").over(over_buckets).alias("_carry")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    own = cut.withColumn("_rn", F.row_number().over(inside)).withColumn(
        "_own", F.lag(F.struct(F.col(value).alias("v"))).over(inside)
    )
    return (
        own.join(carried, [*keys, "_bucket"], "left")
        .withColumn(previous, F.when(F.col("_rn") == 1, F.col("_carry.v")).otherwise(F.col("_own.v")))
        .withColumn("_has_previous", F.when(F.col("_rn") == 1, F.col("_carry").isNotNull()).otherwise(True))
        .drop("_bucket", "_rn", "_own", "_carry")
    )


def miss_run_cutoff(
    probes: DataFrame, key: str, ident: str, miss: Column, hit: Column, limit: int, bucket_width: int = 100_000
) -> DataFrame:
    """Id per source at which an ordered scan meets its ``limit``-th miss in a row.

    ``hit`` rows reset the run; a row may reset it and count as a miss itself. The run length of a row is counted inside its id
    bucket and extended by the misses that earlier buckets end with. Sources
    whose scan never stops have no row in the result.
    """
    rows = probes.select(
        key,
        F.col(ident).alias("_id"),
        (F.floor(F.col(ident) / bucket_width)).alias("_b"),
        miss.alias("_miss"),
        hit.alias("_hit"),
    )
    inside = Window.partitionBy(key, "_b").orderBy("_id")
    counted = rows.withColumn("_misses", F.sum(F.col("_miss").cast("long")).over(inside)).withColumn(
        "_at_hit", F.max(F.when(F.col("_hit"), F.col("_misses") - F.col("_miss").cast("long"))).over(inside)
    )
    # The running miss count just before the last reset is the base line of the current run.
    summary = counted.groupBy(key, "_b").agg(
        F.max("_misses").alias("_total"), F.max("_at_hit").alias("_base")
    )
    over_buckets = Window.partitionBy(key).orderBy("_b")
    before = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    ends = summary.withColumn(
        "_tail", F.col("_total") - F.coalesce("_base", F.lit(0))
    ).withColumn("_sum_before", F.coalesce(F.sum("_tail").over(before), F.lit(0)))
    carried = ends.withColumn(
        "_carry",
        F.col("_sum_before")
        - F.coalesce(F.max(F.when(F.col("_base").isNotNull(), F.col("_sum_before"))).over(before), F.lit(0)),
    ).select(key, "_b", "_carry")
    runs = counted.join(carried, [key, "_b"]).withColumn(
        "_run",
        F.when(F.col("_at_hit").isNull(), F.col("_carry") + F.col("_misses")).otherwise(
            F.col("_misses") - F.col("_at_hit")
        ),
    )
    return (
        runs.where(F.col("_miss") & (F.col("_run") >= limit))
        .groupBy(key)
        .agg(F.min("_id").alias("stop_id"))
    )
