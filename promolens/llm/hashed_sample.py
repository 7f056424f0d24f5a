"""Bounded samples of rows for fitting, and per-row predictions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.words import sliced

HELD_OUT = 2


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def first_by_hash(ids: DataFrame, n: int) -> DataFrame:
    """``n`` rows in an order that depends on doc_id only."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def scored(docs: DataFrame, fields: str, work: Callable[[], Callable], *extra: Column) -> DataFrame:
    """All columns of ``docs`` and ``fields``, from ``work()(slice) -> list of arrays``; ``extra`` columns reach it too.

    Columns of ``docs`` named like a field are replaced.
    """
    new = T._parse_datatype_string(fields)
    names = [c for c in docs.columns if c not in new.names]
    packed = docs.select(F.col("text").alias("text"), *extra, F.struct(*[F.col(f"`{c}`") for c in names]).alias("rest"))
    schema = T.StructType([T.StructField("rest", T.StructType([docs.schema[c] for c in names])), *new.fields])

    def run(batches):
        do = work()
        for batch in batches:
            for a, b in sliced(batch):
                part = batch.slice(a, b - a)
                yield pa.record_batch([part.column("rest"), *do(part)], names=schema.names)

    return packed.mapInArrow(run, schema).select(*[F.col(f"rest.`{c}`").alias(c) for c in names], *new.names)
