"""Exact ranked lexical search with hashed max-sketches as upper bounds.

A term is a run of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A first pass counts the
documents with terms, all terms, and the documents that hold each term of the items. In the second pass every document
folds the impacts of its terms into ``HASHES`` rows of ``COORDS`` coordinates, each the maximum of what hashes there.
An item's bound on a document is the sum over its terms of weight times the least of the term's coordinates; the bounds
of a block of documents are looked up item by item in one gather. Documents are rescored exactly by falling bound until
the next bound is below the item's k-th score so far, which a task carries from block to block. A chance match of
hashes only raises a bound; exact scores compare bytes. The k best of each task meet in a window.

Items are the query set. They are dealt into blocks of ``ITEM_BLOCK`` bytes, and each block goes over the documents
once, as a broadcast of bounded size. Equal items count once; items of one item_id with different texts are ranked each
for itself. Null text, empty text and text without terms have none: such items and documents have no rows. Repeated
documents count and are ranked as often as they occur; equal scores go by ascending doc_id, a null one first. Empty
tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.keys import WIDTH, KeyTable, keys_of, spans
from promolens.llm.staging import table
from promolens.llm.words import U, Words, sliced

ITEM_BLOCK, DOC_BLOCK = 4 << 20, 1024
HASHES, COORDS, STEP, FIRST_LOOK = 2, 2048, 16, 24
NULL_ID = np.iinfo(np.int64).min
#: All ASCII but letters and digits.
NO_TERM = np.zeros(256, bool)
NO_TERM[:48] = NO_TERM[58:65] = NO_TERM[91:97] = NO_TERM[123:128] = True


def coordinates(h: np.ndarray) -> list[np.ndarray]:
    return [((h >> U(20 * j)) & U(COORDS - 1)).astype(np.int64) for j in range(HASHES)]


def words_of(column) -> Words:
    return Words(column, lower=True, blank=NO_TERM)


class Items:
    """Items of a block: their terms (``flat[at[i]:at[i + 1]]``, each once, with ``times``) and the vocabulary of all."""

    def __init__(self, ids: list, texts: list):
        words = words_of(pa.array(texts, pa.string()))
        body, h = words.data.tobytes(), words.hashes()
        known: dict[bytes, int] = {}
        terms = [known.setdefault(body[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist())]
        hashes = np.zeros(len(known), np.uint64)
        hashes[terms] = h
        self.ids, self.flat, self.times, self.at = [], [], [], [0]
        for i, a, b in zip(ids, words.first[:-1].tolist(), words.first[1:].tolist()):
            if a < b:
                term, times = np.unique(terms[a:b], return_counts=True)
                self.ids.append(i)
                self.flat.append(term)
                self.times.append(times)
                self.at.append(self.at[-1] + len(term))
        self.size = len(known)
        short = [(t, i) for t, i in known.items() if len(t) <= WIDTH]
        self.short = KeyTable(*keys_of(*spans([t for t, _ in short])), np.array([i for _, i in short], np.int32))
        self.long = {t: i for t, i in known.items() if len(t) > WIDTH}
        self.long_hashes = np.sort(hashes[[*self.long.values()]]) if self.long else np.zeros(0, np.uint64)
        self.coords = coordinates(hashes)

    def weigh(self, n: int, df: np.ndarray) -> None:
        w = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        self.weight = [w[t] * c for t, c in zip(self.flat, self.times)]

    def found(self, words: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that are terms of the items, and which."""
        width = words.end - words.start
        at = np.flatnonzero(width <= WIDTH)
        slot = self.short.find(*keys_of(words.data, words.start[at], words.end[at]))
        at, term = at[slot >= 0], self.short.value[slot[slot >= 0]].astype(np.int64)
        if self.long:
            maybe = np.flatnonzero(width > WIDTH)
            maybe = maybe[np.isin(h[maybe], self.long_hashes)]
            exact = [self.long.get(words.data[words.start[i]: words.end[i]].tobytes(), -1) for i in maybe.tolist()]
            more = np.array(exact, np.int64)
            at, term = np.r_[at, maybe[more >= 0]], np.r_[term, more[more >= 0]]
        return at, term


class Best:
    """The k best documents of each item so far."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.zeros((items, k), np.int64)
        self.doc = np.zeros((items, k), np.int64)

    def add(self, i: int, score: np.ndarray, doc: np.ndarray) -> None:
        s, d = np.r_[self.score[i], score], np.r_[self.doc[i], doc]
        order = np.lexsort((d, -s))[: self.k]
        self.score[i], self.doc[i] = s[order], d[order]


class Block:
    """Documents of one slice: sketches, and the entries that exact scores need."""

    def __init__(self, column, items: Items, n: int, length: int):
        words = words_of(column)
        h, count = words.hashes(), np.diff(words.first)
        row = np.repeat(np.arange(len(count)), count)
        self.m = 75 + (25 * count * n) // length
        order = np.lexsort((h, row))
        hs, rs = h[order], row[order]
        new = np.flatnonzero(np.r_[True, (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])]) if len(hs) else np.zeros(0, np.int64)
        tf = np.diff(np.r_[new, len(hs)])
        impact = -(-self.impact(tf, rs[new]) // STEP)
        self.sketch = []
        for c in coordinates(hs[new]):
            s = np.zeros((COORDS, len(count)), np.uint16)
            np.maximum.at(s, (c, rs[new]), impact.astype(np.uint16))
            self.sketch.append(s)
        at, term = items.found(words, h)
        self.size = items.size
        self.entry, self.tf = np.unique(row[at] * self.size + term, return_counts=True)

    def impact(self, tf: np.ndarray, row: np.ndarray) -> np.ndarray:
        return (1_000_000_000 * tf) // (1000 * tf + 12 * self.m[row])

    def bounds(self, terms: np.ndarray, weight: np.ndarray, coords: list[np.ndarray]) -> np.ndarray:
        least = self.sketch[0][coords[0][terms]]
        for s, c in zip(self.sketch[1:], coords[1:]):
            least = np.minimum(least, s[c[terms]])
        return (weight.astype(np.float64) @ least.astype(np.float64)) * STEP

    def exact(self, rows: np.ndarray, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        if not len(self.entry):
            return np.zeros(len(rows), np.int64)
        key = rows[:, None] * self.size + terms[None, :]
        i = np.minimum(np.searchsorted(self.entry, key), len(self.entry) - 1)
        tf = np.where(self.entry[i] == key, self.tf[i], 0)
        return (self.impact(tf, rows[:, None]) * weight).sum(1)

    def search(self, items: Items, ids: np.ndarray, best: Best) -> None:
        for i, (terms, weight) in enumerate(zip(items.flat, items.weight)):
            bound = self.bounds(terms, weight, items.coords)
            rows = np.flatnonzero(bound >= max(1, best.score[i, -1]))
            rows = rows[np.argsort(-bound[rows], kind="stable")]
            a, step = 0, FIRST_LOOK
            while a < len(rows) and bound[rows[a]] >= best.score[i, -1]:
                look = rows[a: a + step]
                score = self.exact(look, terms, weight)
                hit = score > 0
                if hit.any():
                    best.add(i, score[hit], ids[look[hit]])
                a, step = a + step, 2 * step


def blocks_of(batch):
    for a, b in sliced(batch):
        for x in range(a, b, DOC_BLOCK):
            yield batch.slice(x, min(DOC_BLOCK, b - x))


def statistics(docs: DataFrame, items) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all terms, and the documents holding each term of the items."""

    def count(batches):
        vocabulary = items.value
        df, n, length = np.zeros(vocabulary.size, np.int64), 0, 0
        for batch in batches:
            for part in blocks_of(batch):
                words = words_of(part.column("text"))
                per = np.diff(words.first)
                n, length = n + int((per > 0).sum()), length + len(words)
                at, term = vocabulary.found(words, words.hashes())
                row = np.searchsorted(words.first, at, "right") - 1
                df += np.bincount(np.unique(row * vocabulary.size + term) % max(vocabulary.size, 1), minlength=vocabulary.size)
        held = np.flatnonzero(df)
        yield pa.record_batch([pa.array([-2, -1, *held.tolist()], pa.int32()), pa.array([n, length, *df[held].tolist()], pa.int64())], names=["term", "n"])

    rows = docs.select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = {r["term"]: r["n"] for r in rows}
    return total.get(-2, 0), total.get(-1, 0), np.array([total.get(i, 0) for i in range(items.value.size)], np.int64)


def item_blocks(items: DataFrame):
    """The distinct items in blocks of ``ITEM_BLOCK`` bytes or so."""
    items = items.select("item_id", "text").where(F.length("text") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / ITEM_BLOCK))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for b in range(parts):
        rows = items.where(block == b).orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in rows], [r["text"] for r in rows])


def best_documents(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item with a score above 0."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id").cast("long"), "text")
    out = spark.createDataFrame([], "q int, item_id long, doc_id long, score long")
    total, first = None, 0
    for block in item_blocks(items):
        if not block.ids:
            continue
        n, length, df = statistics(docs, spark.sparkContext.broadcast(block))
        if not length:
            break
        block.weigh(n, df)
        total = ranked_by_task(docs, spark.sparkContext.broadcast(block), n, length, k, first)
        first += len(block.ids)
        out = out.unionByName(total)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_by_task(docs: DataFrame, items, n: int, length: int, k: int, first: int) -> DataFrame:
    def search(batches):
        query = items.value
        best = Best(len(query.ids), k)
        for batch in batches:
            for part in blocks_of(batch):
                ids = part.column("doc_id")
                ids = np.asarray(ids.fill_null(int(NULL_ID)))
                Block(part.column("text"), query, n, length).search(query, ids, best)
        i, j = np.nonzero(best.score)
        doc = best.doc[i, j]
        yield pa.record_batch([
            pa.array(i + first, pa.int32()), pa.array([query.ids[x] for x in i.tolist()], pa.int64()),
            pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(best.score[i, j], pa.int64()),
        ], names=["q", "item_id", "doc_id", "score"])

    return docs.mapInArrow(search, "q int, item_id long, doc_id long, score long")


def op12_lexical_search(spark, base: str) -> DataFrame:
    return best_documents(table(spark, base, "documents"), table(spark, base, "benchmark"))


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
t AS (SELECT r, doc_id, unnest(ts) AS term FROM d),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
c AS (SELECT r, count(*) AS n FROM t GROUP BY r),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS l FROM c),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY term, nn),
x AS (SELECT q.item_id, f.doc_id, f.r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // l)))) AS BIGINT) AS score
  FROM q JOIN f USING (term) JOIN w USING (term) JOIN c USING (r), s GROUP BY q.item_id, f.doc_id, f.r),
y AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 20
"""
