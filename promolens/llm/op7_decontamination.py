"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

The containment of an item is the share of its distinct word ``n``-grams that occur in the document. Items are
partitioned by set size (powers of two). A partition keeps of each item the MinHash sketch of its smallest
``k`` hashes, with k set by the partition's upper size: at containment ``t`` at most ``n - ceil(t * n)`` of an
item's hashes are missing, so a document that contains it shows at least ``k`` less that many of the sketch, and
no such pair is missed whatever the document's length. The largest sketch hash of a partition bounds the
document hashes that need a look. Candidates are verified on the whole sets.

Documents are never shuffled: the benchmark goes to them in blocks of at most ``BLOCK`` bytes of sets by hashed id,
one pass over the documents per block. Words are compared without ASCII case; hashes have 64 bits.

Input: doc_id, text; item_id, text. An item under ``n`` words is one gram of its own length. Null texts and texts
without words give no pair, documents under ``n`` words only with such short items. Repeated
rows give repeated pairs for documents and one pair for items. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm import hashed_sample as S
from promolens.llm.staging import table
from promolens.llm.words import U, Words, mix, sliced

BLOCK = 32 << 20
SPARE = 4


def gram_sets(column, n: int, lower: bool = True):
    """(n-gram hashes of all rows, first one of each row); places in order, not distinct."""
    w = Words(column, lower=lower)
    at, h = w.windows(w.hashes(), n)
    return mix(h), np.searchsorted(at, w.first)


def missing(size: int, percent: int) -> int:
    return size + (-size * percent // 100)


class Index:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.percent = percent
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        self.parts = []
        size = np.array([len(s) for s in self.sets], np.int64)
        level = np.floor(np.log2(np.maximum(size, 1))).astype(int)
        self.needed = np.zeros(len(items), np.int64)
        for c in np.unique(level):
            upper = 2 ** (int(c) + 1) - 1
            width = missing(upper, percent) + SPARE
            keys, owner = [], []
            for i in np.flatnonzero(level == c):
                sketch = self.sets[i][:width]
                self.needed[i] = max(1, len(sketch) - missing(len(self.sets[i]), percent))
                keys.append(sketch)
                owner.append(np.full(len(sketch), i))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            distinct, first = np.unique(keys[order], return_index=True)
            self.parts.append((distinct, np.r_[first, len(keys)], owner[order]))

    def found(self, h: np.ndarray, row: np.ndarray):
        """(row, item, shared) of verified pairs; h with its rows."""
        hits = []
        for distinct, first, owner in self.parts:
            low = h <= distinct[-1]
            x, r = h[low], row[low]
            i = np.minimum(np.searchsorted(distinct, x), len(distinct) - 1)
            ok = distinct[i] == x
            pairs = np.unique(np.stack([r[ok], i[ok]], 1), axis=0) if ok.any() else np.zeros((0, 2), np.int64)
            count = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
            place = np.repeat(first[pairs[:, 1]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            both = np.stack([np.repeat(pairs[:, 0], count), owner[place]], 1)
            if len(both):
                both, n = np.unique(both, axis=0, return_counts=True)
                hits.append(both[n >= self.needed[both[:, 1]]])
        out = []
        last, have = -1, None
        for r, i in sorted(map(tuple, np.concatenate(hits).tolist())) if hits else []:
            if r != last:
                last, have = r, np.unique(h[row == r])
            s = self.sets[i]
            shared = int((have[np.minimum(np.searchsorted(have, s), len(have) - 1)] == s).sum())
            if shared * 100 >= len(s) * self.percent:
                out.append((r, i, shared))
        return out


def marked(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with ``leaks``: array of (item_id, n_item, n_shared, containment) at ``percent`` or more."""

    def sets(batches):
        for batch in batches:
            for a, b in sliced(batch):
                part = batch.slice(a, b - a)
                length = np.minimum(np.diff(Words(part.column("text")).first), n)
                own: list[bytes] = [b""] * part.num_rows
                for k in np.unique(length[length > 0]).tolist():
                    h, first = gram_sets(part.column("text"), k)
                    for i in np.flatnonzero(length == k).tolist():
                        own[i] = np.unique(h[first[i]: first[i + 1]]).tobytes()
                yield pa.record_batch([part.column("item_id"), pa.array(length, pa.int32()), pa.array(own, pa.binary())], names=["item_id", "words", "grams"])

    items = benchmark.where("item_id is not null").select("item_id", "text").distinct().mapInArrow(sets, "item_id long, words int, grams binary").where("length(grams) > 0")
    total = items.agg(F.sum(F.length("grams"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK))
    sc, names = docs.sparkSession.sparkContext, []
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("n_item", pa.int64()), ("n_shared", pa.int64()), ("containment", pa.float64())]))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        by_length: dict[int, list] = {}
        for r in sorted(rows, key=lambda r: (r["item_id"], bytes(r["grams"]))):
            by_length.setdefault(r["words"], []).append((r["item_id"], np.frombuffer(r["grams"], np.uint64)))
        index = sc.broadcast({words: Index(own, percent) for words, own in by_length.items()})

        def work(index=index):
            def do(part):
                found: list[list] = [[] for _ in range(part.num_rows)]
                for words, own in index.value.items():
                    h, first = gram_sets(part.column("text"), words)
                    for row, i, shared in own.found(h, np.repeat(np.arange(part.num_rows), np.diff(first))):
                        size = len(own.sets[i])
                        found[row].append({"item_id": own.ids[i], "n_item": size, "n_shared": shared, "containment": shared / size})
                return [pa.array(found, kind)]

            return do

        names.append(f"leaks_{k}" if blocks > 1 else "leaks")
        docs = S.scored(docs, f"{names[-1]} array<struct<item_id:bigint,n_item:bigint,n_shared:bigint,containment:double>>", work)
    if blocks > 1:
        docs = docs.withColumn("leaks", F.concat(*names)).drop(*names)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of every pair."""
    return marked(docs.select("doc_id", "text"), benchmark, n, percent).select("doc_id", F.inline("leaks"))


def op7_decontamination(spark, base: str) -> DataFrame:
    return leaks(table(spark, base, "documents"), table(spark, base, "benchmark"))
