"""Counting hashes over a whole corpus without a row per hash.

Documents are dealt into text groups of a few MB. Each group sends its distinct hashes once per hash bucket, as
one array; a bucket meets the arrays of all groups, applies a rule and answers each group with those of its own
hashes that the rule keeps. A bucket is a range of the hash's upper half, so ``residual`` needs the lower half
only, and the number of buckets grows with the corpus: the size of a task and the rate of chance matches stay
the same. A frequent hash costs one entry per group.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm.words import U

GROUP_BYTES = 4 << 20
BUCKET_ENTRIES = 1_000_000
REQUEST = "g long, bucket int, res binary, extra binary"
ANSWER = "g long, bucket int, res binary, val binary"


def dealt(docs: DataFrame, groups: int) -> DataFrame:
    """Columns g, text and ``rest`` (struct of all other columns). Equal rows share a group."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).alias("g"), "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest"))


def undealt(df: DataFrame, names: list[str], results: list[str]) -> DataFrame:
    """The columns of the input, then ``results``; a result replaces an input column of its name."""
    return df.select(*[F.col(f"rest.`{c}`").alias(c) for c in names if c != "text" and c not in results], *results)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) * U(buckets)) >> U(32)


def low_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half in one number."""
    return (bucket_of(h, buckets) << U(32)) | (h & U(0xFFFFFFFF))


def request(g: int, h: np.ndarray, residual: np.ndarray, extra: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of one group, for the buckets that it has hashes in; ``h`` sorted."""
    used, start = np.unique(bucket_of(h, buckets), return_index=True)
    cuts = list(zip(start, [*start[1:], len(h)]))
    return pa.record_batch([
        pa.array([g] * len(used), pa.int64()), pa.array(used, pa.int32()),
        pa.array([residual[a:b].tobytes() for a, b in cuts], pa.binary()),
        pa.array([extra[a:b].tobytes() for a, b in cuts], pa.binary()),
    ], names=["g", "bucket", "res", "extra"])


def answered(requests: DataFrame, kind: str, rule: Callable) -> DataFrame:
    """``rule(inverse, extra, n) -> (keep, value)`` per distinct residual of a bucket, from all entries of it."""

    def bucket(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, kind) for x in rows.column("res").to_pylist()]
        extra = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("extra").to_pylist()])
        distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        inverse = inverse.astype(np.int32)
        keep, value = rule(inverse, extra, len(distinct))
        res, val, at = [], [], 0
        for p in parts:
            i = inverse[at: at + len(p)]
            at += len(p)
            i = i[keep[i]]
            res.append(distinct[i].tobytes())
            val.append(value[i].tobytes())
        out = pa.table({"g": rows.column("g"), "bucket": rows.column("bucket"), "res": pa.array(res, pa.binary()), "val": pa.array(val, pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x in res], pa.bool_()))

    return requests.groupBy("bucket").applyInArrow(bucket, ANSWER)


def answers(rows: pa.Table, kind: str, value: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, residual and value of each kept entry of a group."""
    if not rows.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, kind), np.zeros(0, value)
    parts = [np.frombuffer(x, kind) for x in rows.column("res").to_pylist()]
    bucket = np.repeat(np.asarray(rows.column("bucket")).astype(np.uint64), [len(p) for p in parts])
    return bucket, np.concatenate(parts), np.concatenate([np.frombuffer(x, value) for x in rows.column("val").to_pylist()])


def looked_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, default) -> np.ndarray:
    """``values`` at ``keys`` in the sorted ``table``."""
    out = np.full(len(keys), default, values.dtype if len(values) else np.asarray(default).dtype)
    if len(table):
        i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        hit = table[i] == keys
        out[hit] = values[i[hit]]
    return out
