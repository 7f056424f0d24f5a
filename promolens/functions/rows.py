"""One row per array item.

A plain ``explode`` makes Catalyst infer a "not empty" filter and push it below
the projection that computes the array, so an expensive array is computed twice
or more. The outer form has no such filter; empty arrays are dropped afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, values: Column, name: str) -> DataFrame:
    """Columns ``keep`` and one row per item; items must not be null."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def posexploded(df: DataFrame, keep: list, values: Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(values).alias(pos, name)).where(F.col(pos).isNotNull())


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Like ``withColumns`` for costly expressions that later filters and joins use.

    A filter on a projected column is pushed below the projection with the whole
    expression copied into it. A one-item ``inline`` stops that, so the columns
    are evaluated once per row. They are evaluated in a projection below it:
    what stands inside a generator is interpreted. The projection holds a
    higher-order function (``_one``), as Spark then generates it on its own in
    small methods; as part of a whole stage, its one method would be beyond the
    8000 bytes up to which the JVM compiles.
    """
    keep = [c for c in df.columns if c not in columns]
    one = F.transform(F.array(F.col(df.columns[0]).isNull()), lambda v: v)
    valued = df.select(*keep, *[c.alias(f"_once_{name}") for name, c in columns.items()], one.alias("_one"))
    row = F.struct(*[F.col(f"_once_{name}").alias(name) for name in columns])
    return valued.select(*keep, F.inline_outer(F.transform("_one", lambda _: row)))
