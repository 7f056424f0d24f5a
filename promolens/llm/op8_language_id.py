"""Language of whole texts by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to its character n-grams, from
``LONGEST`` characters down: the first length of which any n-gram is known scores, by the mean over the known ones.
A text's score per language is the sum over its words; ``score`` is the probability of the best one, from the sums
divided by the root of the number of words.

Words and n-grams are learned from a bounded sample outside the held-out fold: at most ``PER_LANG`` texts of a
language and ``SAMPLE`` in all, in an order of hashed ids. Null text and text without a letter: ``und`` with
score 0. A text with letters but no known word or n-gram gets the first language in order, at an even score.
Without a row to learn from everything is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm import hashed_sample as S
from promolens.llm.staging import table
from promolens.llm.words import NO_LETTERS, U, Words, mix, sliced

PER_LANG, SAMPLE, LONGEST, MIN_COUNT, SMOOTH = 800, 8000, 5, 2, 0.5


def grams(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of blank-edged words, and the word of each."""
    text = b" ".join([b"", *words, b""]).decode("utf-8", "replace")
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = c == 32
    word = np.cumsum(blank) - 1
    h = np.zeros(max(len(c) - n + 1, 0), np.uint64)
    inside = np.ones(len(h), bool)
    for k in range(n):
        h = h * U(0x9E3779B97F4A7C15) + c[k: k + len(h)] + U(1)
        if 0 < k < n - 1:
            inside &= ~blank[k: k + len(h)]
    if n == 1:
        inside &= ~blank
    else:
        inside &= ~(blank[: len(h)] & blank[n - 1: n - 1 + len(h)]) if n == 2 else True
    return mix(h + U(n))[inside], word[: len(h)][inside]


def table_of(keys: np.ndarray, lang: np.ndarray, weight: np.ndarray, langs: int, least: int):
    """Sorted keys seen ``least`` times and their log frequency per language."""
    distinct, slot = np.unique(keys, return_inverse=True)
    count = np.bincount(slot * langs + lang, weights=weight, minlength=len(distinct) * langs).reshape(-1, langs)
    total = count.sum(0)
    keep = count.sum(1) >= least
    return distinct[keep], np.log((count[keep] + SMOOTH) / (total + SMOOTH * max(len(distinct), 1))).astype(np.float32)


class Model:
    def __init__(self, langs, words, ladder):
        self.langs, self.words, self.ladder = langs, words, ladder

    def of_unseen(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)), np.float32)
        todo = np.arange(len(words))
        for n, (known, logs) in self.ladder:
            if not len(todo):
                break
            h, word = grams([words[i] for i in todo], n)
            i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
            hit = known[i] == h if len(known) else np.zeros(len(h), bool)
            count = np.bincount(word[hit], minlength=len(todo))
            found = count > 0
            for k in range(len(self.langs)):
                mean = np.bincount(word[hit], weights=logs[i[hit], k], minlength=len(todo))[found] / count[found]
                out[todo[found], k] = mean
            todo = todo[~found]
        return out

    def predict(self, column, letters: np.ndarray):
        """Best language and its probability per row."""
        w = Words(pc.utf8_lower(column), blank=NO_LETTERS)
        n, langs = len(column), len(self.langs)
        if not langs:
            return ["und"] * n, np.zeros(n)
        h = w.hashes()
        known, logs = self.words
        i = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[i] == h if len(known) else np.zeros(len(h), bool)
        row = np.repeat(np.arange(n), np.diff(w.first))
        sums = np.stack([np.bincount(row[hit], weights=logs[i[hit], k], minlength=n) for k in range(langs)], 1)
        miss = np.flatnonzero(~hit)
        if len(miss):
            distinct, first, slot = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            raw = w.data.tobytes()
            own = self.of_unseen([raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist())])
            for k in range(langs):
                sums[:, k] += np.bincount(row[miss], weights=own[slot, k], minlength=n)
        z = sums / np.sqrt(np.maximum(np.diff(w.first), 1))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, p.max(1), 0.0)


def learned(docs: DataFrame) -> Model:
    ids = docs.where("lang is not null and doc_id is not null and text is not null").where(~S.held_out(F.col("doc_id"))).select("doc_id", "lang")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = ids.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_LANG).orderBy("r", "lang", "doc_id").limit(SAMPLE)
    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(sample.drop("r")), ["doc_id", "lang"])

    def run(batches):
        for batch in batches:
            for a, b in sliced(batch):
                part = batch.slice(a, b - a)
                w = Words(pc.utf8_lower(part.column("text")), blank=NO_LETTERS)
                h, raw = w.hashes(), w.data.tobytes()
                for i in range(part.num_rows):
                    x, y = w.first[i], w.first[i + 1]
                    _, first, count = np.unique(h[x:y], return_index=True, return_counts=True)
                    at = first + x
                    names = b" ".join(raw[p:q] for p, q in zip(w.start[at].tolist(), w.end[at].tolist()))
                    yield pa.record_batch([
                        part.column("doc_id").slice(i, 1), part.column("lang").slice(i, 1),
                        pa.array([names], pa.binary()), pa.array([count.astype(np.int32).tobytes()], pa.binary())], names=["doc_id", "lang", "words", "count"])

    bags = rows.mapInArrow(run, "doc_id long, lang string, words binary, count binary")
    got = bags.groupBy("doc_id", "lang").agg(F.max(F.struct("words", "count")).alias("bag")).select("lang", "bag.*").collect()
    langs = sorted({r[0] for r in got})
    if not langs:
        return Model([], (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)), [])
    total: dict[tuple[int, bytes], int] = {}
    for lang, words, count in got:
        k = langs.index(lang)
        for w, c in zip(words.split(b" "), np.frombuffer(count, np.int32).tolist()):
            total[k, w] = total.get((k, w), 0) + c
    names = [w for _, w in total]
    lang = np.array([k for k, _ in total], np.int64)
    weight = np.array(list(total.values()), float)
    w = Words(pa.array([b" ".join(names).decode("utf-8", "replace")]), blank=NO_LETTERS)
    words = table_of(w.hashes(), lang, weight, len(langs), MIN_COUNT) if names else (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    ladder = []
    for n in range(LONGEST, 0, -1):
        h, at = grams(names, n) if names else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ladder.append((n, table_of(h, lang[at], np.ones(len(h)), len(langs), MIN_COUNT)))
    return Model(langs, words, ladder)


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score; ``lang`` is used for fitting only."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs))

    def work():
        def do(part):
            letters = np.asarray(part.column("letters").to_numpy(zero_copy_only=False)).astype(bool)
            lang, score = model.value.predict(part.column("text"), letters)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

        return do

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return S.scored(docs, "lang_pred string, score double", work, letters)


def op8_language_id(spark, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text", "lang")
    return identified(docs).select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
