"""Exact highest inner products by a dual-tree search over cover trees.

Queries and data are indexed together: each task takes a block of queries and a block of data and builds a cover
tree of either (children cover a fraction of their parent's radius, their centres are apart by more than it). Node
pairs are visited by falling bound ``q.c + |q| R + |c| r + r R`` on the inner product; a pair is pruned when its
bound is below the worst k-th score of the query node's group. Leaves are compared exactly. The k best of all
blocks meet in a window per query.

Vectors are quantised to ``floor(64 * x)`` with x as double; scores are integers. Left out: null vectors, vectors
with null or non-finite components, rows with a null vec_id. Vectors of other lengths than the query's aren't
compared with it. Equal rows count once; a query is never its own candidate (same vec_id). Vectors whose products
could leave the range of exact doubles go through plain integers, pair by pair with the others. A score beyond 64 bits
is shown, and ranked, as the nearest long.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.staging import table

QUERY_BLOCK, DATA_BLOCK = 2048, 8192
LEAF, CHILDREN, SHRINK = 128, 48, 0.7


class Tree:
    """Cover tree over the rows of X: nodes (centre, radius, rows, children)."""

    def __init__(self, x: np.ndarray):
        self.x, self.nodes = x, []
        self.root = self._node(np.arange(len(x)), 0)

    def _node(self, rows: np.ndarray, centre: int) -> int:
        c = self.x[centre]
        far = np.sqrt(((self.x[rows] - c) ** 2).sum(1))
        radius = float(far.max())
        me = len(self.nodes)
        self.nodes.append([c, float(np.sqrt(c @ c)), radius, rows, []])
        if len(rows) <= LEAF or radius == 0:
            return me
        reach, left, pooled, parts = radius * SHRINK, rows, [], []
        near = far <= reach
        pick = centre
        for _ in range(CHILDREN):
            (parts if near.sum() > LEAF // 4 else pooled).append((pick, left[near]))
            left = left[~near]
            if not len(left):
                break
            pick = int(left[0])
            near = np.sqrt(((self.x[left] - self.x[pick]) ** 2).sum(1)) <= reach
        rest = np.concatenate([left, *(r for _, r in pooled)])
        if not parts or (len(parts) == 1 and not len(rest)):
            return me
        self.nodes[me][4] = [self._node(r, p) for p, r in parts]
        if len(rest):
            far = np.sqrt(((self.x[rest] - c) ** 2).sum(1))
            self.nodes.append([c, self.nodes[me][1], float(far.max()), rest, []])
            self.nodes[me][4].append(len(self.nodes) - 1)
        return me


def best_of(q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int):
    """Scores and ids (queries x k) of the highest products; missing places have score -inf."""
    order = np.argsort(d_ids, kind="stable")
    d, d_ids = d[order], d_ids[order]
    qt, dt = Tree(q), Tree(d)
    score = np.full((len(q), k), -np.inf)
    ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def bound(a, b):
        x, y = qt.nodes[a], dt.nodes[b]
        exact = x[0] @ y[0] + x[1] * y[2] + y[1] * x[2] + x[2] * y[2]
        return exact + 1e-9 * (abs(exact) + 1) + 1e-6

    heap, tie = [(-bound(qt.root, dt.root), 0, qt.root, dt.root)], 0
    while heap:
        neg, _, a, b = heapq.heappop(heap)
        x, y = qt.nodes[a], dt.nodes[b]
        if -neg < score[x[3], -1].min():
            continue
        if not x[4] and not y[4]:
            compare(q, q_ids, d, d_ids, x[3], np.sort(y[3]), score, ids)
            continue
        for i in x[4] if x[4] and (not y[4] or x[2] > y[2]) else [a]:
            for j in y[4] if i == a else [b]:
                up = bound(i, j)
                if up >= score[qt.nodes[i][3], -1].min():
                    tie += 1
                    heapq.heappush(heap, (-up, tie, i, j))
    return score, ids


def compare(q, q_ids, d, d_ids, rows, cols, score, ids) -> None:
    s = q[rows] @ d[cols].T
    s[q_ids[rows][:, None] == d_ids[cols][None, :]] = -np.inf
    better = (s >= score[rows, -1:]).any(1)
    if better.any():
        rows, s = rows[better], s[better]
        both = np.concatenate([score[rows], s], 1)
        names = np.concatenate([ids[rows], np.broadcast_to(d_ids[cols], s.shape)], 1)
        order = np.lexsort((names, -both), axis=-1)[:, : score.shape[1]]
        score[rows] = np.take_along_axis(both, order, 1)
        ids[rows] = np.take_along_axis(names, order, 1)


def integers(q, q_ids, d, d_ids, k: int, out: dict) -> None:
    """Adds the k best of each query by integers of any size."""
    d = np.array([[int(e) for e in row] for row in d], object).reshape(d.shape)
    for name, x in zip(q_ids.tolist(), q):
        s = d @ np.array([int(e) for e in x], object)
        s = [min(max(a, -(2**63)), 2**63 - 1) for a in s]
        best = heapq.nsmallest(k, ((-a, i) for a, i in zip(s, d_ids.tolist()) if i != name))
        out["query_id"] += [name] * len(best)
        out["vec_id"] += [i for _, i in best]
        out["score"] += [-a for a, _ in best]


def quantised(vectors: DataFrame, vec: str, scale: int) -> DataFrame:
    """vec_id, v (array of double holding integers), dim; without the rows that take no part."""
    def whole(e):
        y = F.lit(scale) * e.cast("double")
        return F.when(F.abs(y) < 2.0**53, F.floor(y).cast("double")).otherwise(y)  # from there on all are whole

    x = F.transform(F.col(f"`{vec}`"), whole)
    usable = F.forall(F.col(f"`{vec}`"), lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(F.lit(scale) * e.cast("double")) < math.inf))
    return vectors.where(F.col("vec_id").isNotNull() & F.col(f"`{vec}`").isNotNull() & usable).select("vec_id", x.alias("v")).distinct().withColumn("dim", F.size("v"))


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, vec: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each query, ties to the smaller vec_id."""
    rows = quantised(vectors, vec, scale)
    n, n_query = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    qb, db = max(1, math.ceil(n_query / QUERY_BLOCK)), max(1, math.ceil(n / DATA_BLOCK))
    block = lambda count, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    data = rows.select("dim", every(qb).alias("x"), block(db, 1).alias("y"), F.lit(False).alias("query"), "vec_id", "v")
    queries = rows.where(is_query).select("dim", block(qb, 2).alias("x"), every(db).alias("y"), F.lit(True).alias("query"), "vec_id", "v")

    def search(t: pa.Table) -> pa.Table:
        query = np.asarray(t.column("query").combine_chunks().to_numpy(zero_copy_only=False)).astype(bool)
        names = np.asarray(t.column("vec_id")).astype(np.int64)
        dim = t.column("dim")[0].as_py()
        v = np.asarray(t.column("v").combine_chunks().flatten()).reshape(-1, dim) if dim else np.zeros((len(names), 1))
        out = {"query_id": [], "vec_id": [], "score": []}
        plain = np.abs(v).max(1, initial=0) ** 2 * max(dim, 1) < 2.0**52
        q, d = query & plain, ~query & plain
        if q.any() and d.any():
            score, ids = best_of(v[q], names[q], v[d], names[d], k)
            good = np.isfinite(score)
            out = {"query_id": np.repeat(names[q], k).reshape(-1, k)[good].tolist(), "vec_id": ids[good].tolist(), "score": score[good].astype(np.int64).tolist()}
        for some, others in ((query & plain, ~query & ~plain), (query & ~plain, ~query)):
            if some.any() and others.any():
                integers(v[some], names[some], v[others], names[others], k, out)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    found = data.unionByName(queries).groupBy("dim", "x", "y").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_exact_topk(spark, base: str) -> DataFrame:
    return top_products(table(spark, base, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
