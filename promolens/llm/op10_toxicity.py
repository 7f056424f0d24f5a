"""Toxicity of whole texts by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct known terms of a text: the pairwise part
lets two terms weigh together what neither does alone. Terms are words without case, ASCII punctuation and digits,
and the first 4, 5 and 6 bytes of longer ones (inflected forms share them), hashed to 40 bits. Of those in at least
``MIN_DOCS`` sample texts two kinds are known: terms whose shares among the two labels differ by ``LEAST_Z`` standard
errors, and both terms of every pair whose texts hold more or less toxic ones than a first model of the former terms
expects (Chernoff bound over all pairs looked at). Terms that say something only together are of the second kind.

The model is fitted on a bounded sample of labelled rows outside the held-out fold: at most ``POSITIVES`` and
``NEGATIVES`` documents in an order of hashed ids. The sample's terms meet in one task; only the model
reaches the driver and the other tasks. Null or empty text: the score of no term. Labels that are null are left out, of several per doc_id the
highest counts. Without a labelled row to learn from all scores are (almost) 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm import hashed_sample as S
from promolens.llm.staging import table
from promolens.llm.words import NO_LETTERS, U, Words, sliced

POSITIVES, NEGATIVES, MIN_DOCS = 3000, 6000, 4
FACTORS, EPOCHS, RATE, DECAY, BATCH = 6, 12, 0.08, 2e-4, 128
THRESHOLD = 0.3
HEADS = (4, 5, 6)
LEAST_Z = 4.0
#: Of the pairs: log of the odds against any found by chance, and block sizes of the count.
MARGIN, COLUMNS, TEXTS = 3.0, 256, 1024
STEPS = 300


def terms(column) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed terms of all words, by kind, and the first word of each row."""
    w = Words(pc.utf8_lower(column), blank=NO_LETTERS)
    return [h >> U(24) for h in w.hashes(heads=HEADS)], w.first


class Model:
    def __init__(self, known, bias, weight, factor):
        self.known, self.bias, self.weight, self.factor = known, bias, weight, factor

    def logits(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Rows and their distinct features."""
        out = self.bias + np.bincount(row, weights=self.weight[feature], minlength=n)
        for f in range(self.factor.shape[1]):
            v = self.factor[feature, f]
            s = np.bincount(row, weights=v, minlength=n)
            out = out + 0.5 * (s * s - np.bincount(row, weights=v * v, minlength=n))
        return out

    def scores(self, column) -> np.ndarray:
        h, first = terms(column)
        n = len(first) - 1
        if not len(self.known):
            return np.full(n, sigmoid(self.bias))
        row, found = np.repeat(np.arange(n), np.diff(first)), []
        for kind in h:
            i = np.minimum(np.searchsorted(self.known, kind), len(self.known) - 1)
            hit = self.known[i] == kind
            found.append(row[hit] * len(self.known) + i[hit])
        pair = np.unique(np.concatenate(found))
        row, feature = np.divmod(pair, len(self.known))
        return sigmoid(self.logits(row, feature, n))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(texts: list[np.ndarray], label: np.ndarray) -> Model:
    """AdaGrad on the logistic loss; ``texts``: distinct terms of each sample row."""
    every, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *texts]), return_counts=True)
    own, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *(t for t, y in zip(texts, label) if y)]), return_counts=True)
    bad = np.zeros(len(every), np.int64)
    bad[np.searchsorted(every, own)] = times
    n, n1 = max(len(label), 1), label.sum()
    p = count / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / max(n1, 1) + 1 / max(n - n1, 1)))
    z = (bad / max(n1, 1) - (count - bad) / max(n - n1, 1)) / spread
    often = every[count >= MIN_DOCS]
    known = every[(count >= MIN_DOCS) & (np.abs(z) >= LEAST_Z)]
    del every, count, own, times, bad, p, spread, z
    if not len(label):
        return Model(np.zeros(0, np.uint64), -35.0, np.zeros(0), np.zeros((0, FACTORS)))
    m, expected = trained(known, texts, label)
    more = np.setdiff1d(together(often, texts, label, expected), known)
    if len(more):
        m, _ = trained(np.union1d(known, more), texts, label, pairs=True)
    return m if len(m.known) else Model(m.known, -35.0, m.weight, m.factor)


def together(often: np.ndarray, texts: list[np.ndarray], label: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Terms of the pairs (a term with itself is one) whose joint texts differ in label from ``expected``.

    ``n`` joint texts with a mean label of q and a mean expectation of e are less likely than exp(-n KL(q, e)).
    """
    expected = np.clip(expected, 1e-3, 1 - 1e-3)
    there = [np.searchsorted(often, t[np.isin(t, often, assume_unique=True)]) for t in texts]
    feature = np.concatenate(there)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in there])
    # heads with the texts of their word are one column
    code = np.random.default_rng(8).integers(0, 2**63, len(texts), dtype=np.uint64)
    same = np.zeros(len(often), np.uint64)
    np.add.at(same, feature, code[row])
    one = np.zeros(len(often), bool)
    one[np.unique(same, return_index=True)[1]] = True
    # what all texts of one label with the term could show at most; pairs have no more texts than their terms
    least = 2 * np.log(max(2, one.sum())) + MARGIN
    most = np.maximum(
        np.bincount(feature, weights=np.where(label[row] > 0, -np.log(expected[row]), 0), minlength=len(often)),
        np.bincount(feature, weights=np.where(label[row] > 0, 0, -np.log(1 - expected[row])), minlength=len(often)))
    kept = np.flatnonzero(one & (most >= least))
    if not len(kept):
        return often[:0]
    place = np.full(len(often), -1)
    place[kept] = np.arange(len(kept))
    on = place[feature] >= 0
    feature, row = place[feature[on]], row[on]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    hit = np.zeros(len(kept), bool)
    for a in range(0, len(kept), COLUMNS):
        left, width = min(COLUMNS, len(kept) - a), len(kept) - a
        n, k, e = (np.zeros((left, width), np.float32) for _ in range(3))
        for d in range(0, len(texts), TEXTS):
            f, r = feature[first[d]: first[min(d + TEXTS, len(texts))]], row[first[d]: first[min(d + TEXTS, len(texts))]] - d
            x = np.zeros((min(TEXTS, len(texts) - d), width), np.float32)
            x[r[f >= a], f[f >= a] - a] = 1
            y = x[:, :left].T
            n += y @ x
            e += (y * expected[d: d + TEXTS].astype(np.float32)) @ x
            bad = np.flatnonzero(label[d: d + TEXTS])
            k += y[:, bad] @ x[bad]
        i, j = np.nonzero(n >= MIN_DOCS)
        n, k, e = n[i, j].astype(float), k[i, j].astype(float), e[i, j].astype(float)
        q, e = k / n, e / n
        shown = n * (q * np.log(np.maximum(q, 1e-12) / e) + (1 - q) * np.log(np.maximum(1 - q, 1e-12) / (1 - e)))
        hit[a + i[shown >= least]] = hit[a + j[shown >= least]] = True
    return often[kept[hit]]


def trained(known: np.ndarray, texts: list[np.ndarray], label: np.ndarray, pairs: bool = False) -> tuple[Model, np.ndarray]:
    """The model over ``known``, and its scores of the sample. ``pairs``: some terms start with no slope in their
    weights, factors take full and at least ``STEPS`` steps."""
    there = [np.searchsorted(known, t[np.isin(t, known, assume_unique=True)]) for t in texts]
    feature = np.concatenate(there)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in there])
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    rng = np.random.default_rng(7)
    rate = np.clip(label.mean(), 1e-3, 1 - 1e-3)
    m = Model(known, float(np.log(rate / (1 - rate))), np.zeros(len(known)), rng.normal(0, 0.01, (len(known), FACTORS)))
    seen_b, seen_w, seen_v = 1e-6, np.full(len(known), 1e-6), np.full((len(known), FACTORS), 1e-6)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(texts))) if pairs else EPOCHS
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            docs = order[at: at + BATCH]
            lens = first[docs + 1] - first[docs]
            pick = np.repeat(first[docs] - np.r_[0, np.cumsum(lens)[:-1]], lens) + np.arange(lens.sum())
            x, r = feature[pick], np.repeat(np.arange(len(docs)), lens)
            error = sigmoid(m.logits(r, x, len(docs))) - label[docs]
            used, slot = np.unique(x, return_inverse=True)
            g = np.bincount(slot, weights=error[r]) / len(docs) + DECAY * m.weight[used]
            gb = error.mean()
            gv = np.empty((len(used), FACTORS))
            for f in range(FACTORS):
                v = m.factor[x, f]
                s = np.bincount(r, weights=v, minlength=len(docs))
                gv[:, f] = np.bincount(slot, weights=error[r] * (s[r] - v)) / len(docs) + DECAY * m.factor[used, f]
            seen_b += gb * gb
            seen_w[used] += g * g
            seen_v[used] += gv * gv
            m.bias -= RATE * gb / np.sqrt(seen_b)
            m.weight[used] -= RATE * g / np.sqrt(seen_w[used])
            m.factor[used] -= (1 if pairs else 0.2) * RATE * gv / np.sqrt(seen_v[used])
    return m, sigmoid(m.logits(row, feature, len(texts)))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    one = labels.where(~S.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    one = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # rows are drawn among labelled documents that are there
    there = one.join(docs.select("doc_id").where("text is not null").distinct(), "doc_id", "left_semi")
    sample = S.first_by_hash(there.where("toxic = 1"), POSITIVES).unionByName(S.first_by_hash(there.where("toxic = 0"), NEGATIVES))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def run(batches):
        for batch in batches:
            for a, b in sliced(batch):
                part = batch.slice(a, b - a)
                h, first = terms(part.column("text"))
                bags = [np.unique(np.concatenate([k[x:y] for k in h])).tobytes() for x, y in zip(first[:-1], first[1:])]
                yield pa.record_batch([part.column("doc_id"), part.column("toxic"), pa.array(bags, pa.binary())], names=["doc_id", "toxic", "bag"])

    bags = rows.mapInArrow(run, "doc_id long, toxic int, bag binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("bag").alias("bag"))

    def train(t: pa.Table) -> pa.Table:
        t = t.sort_by("doc_id")
        m = fit([np.frombuffer(b.as_buffer(), np.uint64) for b in t.column("bag")], np.asarray(t.column("toxic")).astype(float))
        return pa.table({"bias": [m.bias], "parts": pa.array([[x.tobytes() for x in (m.known, m.weight, m.factor)]], pa.list_(pa.binary()))})

    # the bounded sample is one task; the driver gets the model only
    got = bags.groupBy(F.lit(0).alias("all")).applyInArrow(train, "bias double, parts array<binary>").collect()
    if not got:
        return fit([], np.zeros(0))
    known, weight, factor = (np.frombuffer(x, kind) for x, kind in zip(got[0][1], (np.uint64, float, float)))
    return Model(known, got[0][0], weight, factor.reshape(-1, FACTORS))


def rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at ``THRESHOLD`` and above)."""
    model = docs.sparkSession.sparkContext.broadcast(learned(docs, labels))
    work = lambda: lambda part: [pa.array(model.value.scores(part.column("text")), pa.float64())]
    return S.scored(docs, "score double", work).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_toxicity(spark, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text")
    return rated(docs, table(spark, base, "labels")).select(
        "doc_id", S.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
