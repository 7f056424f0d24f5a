"""Removal of long word sequences that occur more than once in the corpus.

Fixed-block anchors: with windows of ``length`` words and blocks of ``block = (length + 1) // 2``, each window
holds one whole block of its own document (blocks start at multiples of ``block``). The blocks are the index,
every rolling run of ``block`` words is a probe. A block whose content is probed from a second place is hit; hits
are extended to all windows around the block. An extension is compared by class (equal window content) and not
pair by pair, so a passage of n places costs n entries; what its windows cover is the maximal repeat. Contents are
compared by hashes of 64 bits within a hash bucket whose size doesn't grow with the corpus.

Input: columns doc_id and text, and any others. Null text: no words; nothing is removed from texts under ``length``
words. Repeated rows are repeats of each other. No rows: no rows. Input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm import exchange as X
from promolens.llm.staging import groups_for, table, total_bytes
from promolens.llm.words import U, Words, sliced, window_hash

RESULTS = ["text", "kept", "n_words", "n_removed", "removed"]


def _next_block(w: Words, at: np.ndarray, block: int) -> np.ndarray:
    """First word of the first own block at or after each window start."""
    row = np.searchsorted(w.first, at, "right") - 1
    base = w.first[row]
    return base + (at - base + block - 1) // block * block


def _flags(h: np.ndarray, block_flag: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes; bit 0: more than one place, bit 1: a block."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(s)])
    extra = (count > 1).astype(np.uint8)
    if block_flag is not None and len(s):
        extra |= np.maximum.reduceat(block_flag[order].astype(np.uint8), first) << 1
    return s[first], extra


def _repeated(inverse, extra, n):
    places = np.bincount(inverse, weights=1 + (extra & 1), minlength=n)
    block = np.bincount(inverse, weights=extra >> 1, minlength=n)
    return (places >= 2) & (block > 0), np.zeros(n, np.uint8)


def _repeated_windows(inverse, extra, n):
    return np.bincount(inverse, weights=1 + (extra & 1), minlength=n) >= 2, np.zeros(n, np.uint8)


def remove_repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut (removed words go, other blanks stay where nothing was cut),
    ``kept`` (kept words joined by one space), ``n_words``, ``n_removed`` and ``removed`` (word spans first, last).
    """
    block = (length + 1) // 2
    _, size = total_bytes(docs)
    buckets = groups_for(size // 6, X.BUCKET_ENTRIES)
    base = X.dealt(docs, groups_for(size, X.GROUP_BYTES))

    def parts(rows: pa.Table):
        for a, b in sliced(rows):
            piece = rows.slice(a, b - a)
            w = Words(piece.column("text"))
            yield piece, w, w.hashes()

    def probe(rows: pa.Table) -> pa.Table:
        hs, bs = [], []
        for _, w, h in parts(rows):
            at, run = w.windows(h, block)
            hs.append(run)
            bs.append(_next_block(w, at, block) == at)
        h, extra = _flags(np.concatenate(hs), np.concatenate(bs))
        low = (h & U(0xFFFFFFFF)).astype(np.uint32)
        return pa.Table.from_batches([X.request(rows.column("g")[0].as_py(), h, low, extra, buckets)])

    def windows_of(w: Words, h: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Starts of windows whose own block is hit."""
        at = w.window_starts(length)
        own = _next_block(w, at, block)
        anchors, which = np.unique(own, return_inverse=True)
        key = X.low_key(window_hash(h, anchors, block), buckets)
        return at[X.looked_up(key, hit, np.ones(len(hit), bool), False)[which]]

    def hits(rows: pa.Table) -> np.ndarray:
        bucket, res, _ = X.answers(rows, "u4", np.uint8)
        return np.sort((bucket << U(32)) | res.astype(np.uint64))

    def extend(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows or not found.num_rows:
            return pa.Table.from_batches([X.request(0, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), buckets)])
        hit, one, two = hits(found), [], []
        for _, w, h in parts(rows):
            at = windows_of(w, h, hit)
            one.append(window_hash(h, at, length))
            two.append(window_hash(w.hashes(1), at, length, 1))
        h, h2 = np.concatenate(one), np.concatenate(two)
        distinct, first, count = np.unique(h, return_index=True, return_counts=True)
        extra = (count > 1).astype(np.uint8)
        return pa.Table.from_batches([X.request(rows.column("g")[0].as_py(), distinct, h2[first], extra, buckets)])

    rest_type = base.schema["rest"].dataType
    span = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])
    out = T.StructType([
        T.StructField("rest", rest_type), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()),
        T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)),
    ])

    def cut(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return EMPTY
        again = np.unique(X.answers(found, "u8", np.uint8)[1])
        text, kept, total, gone, spans = [], [], [], [], []
        for piece, w, h in parts(rows):
            cover = np.zeros(len(w) + 1, np.int64)
            if len(again):
                at = w.window_starts(length)
                at = at[X.looked_up(window_hash(w.hashes(1), at, length, 1), again, np.ones(len(again), bool), False)]
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
            bad = np.cumsum(cover)[:-1] > 0
            data = w.data.tobytes()
            nulls = piece.column("text").combine_chunks().is_null().to_pylist()
            for i in range(piece.num_rows):
                a, b = int(w.first[i]), int(w.first[i + 1])
                lo, hi = int(w.off[i]), int(w.off[i + 1])
                raw = data[lo:hi]
                mask = bad[a:b]
                n = int(mask.sum())
                total.append(b - a)
                gone.append(n)
                if not n:
                    text.append(None if nulls[i] else raw)
                    kept.append(b" ".join(raw.split()))
                    spans.append([])
                    continue
                edge = np.flatnonzero(np.diff(np.r_[True, mask, True]))
                runs = [(a + int(x), a + int(y) - 1) for x, y in zip(edge[::2], edge[1::2])]
                pieces = [data[w.start[x]: w.end[y]] for x, y in runs]
                text.append(b" ".join(pieces))
                kept.append(b" ".join(b" ".join(p.split()) for p in pieces))
                edge = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                spans.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edge[::2], edge[1::2])])
        return pa.table([
            rows.column("rest"), pa.array(text, pa.binary()).cast(pa.string()), pa.array(kept, pa.binary()).cast(pa.string()),
            pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ], names=["rest", *RESULTS])

    EMPTY = pa.table({"rest": pa.array([], pa.null())}).slice(0, 0)
    grouped = base.groupBy("g")
    anchored = X.answered(grouped.applyInArrow(probe, X.REQUEST), "u4", _repeated)
    windows = grouped.cogroup(anchored.groupBy("g")).applyInArrow(extend, X.REQUEST)
    repeats = X.answered(windows, "u8", _repeated_windows)
    done = grouped.cogroup(repeats.groupBy("g")).applyInArrow(cut, out)
    return X.undealt(done, docs.columns, RESULTS)


def op6_substring_dedup(spark, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    return remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("removed").alias("n_spans"))
