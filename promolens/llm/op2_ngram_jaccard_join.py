"""Documents whose sets of word n-grams have a Jaccard similarity of at least ``percent`` / 100.

Multiple-global-order filtering: under any global order of all tokens (n-grams), two sets that similar share a
token among the first ``n - ceil(t * n) + 1`` of each. Three orders are used: rare tokens first with two
different tie orders, and a random one. A pair is verified only if it shares prefix tokens under every order.
Corpus counts come from ``exchange``; a token of one document only can't be shared and is left out of prefixes, so
most documents end here.

Documents that share first-order prefix tokens, directly or through others, form a cluster (components of star
edges, not pairs). Within a cluster, blocks of bounded size meet block by block; a task intersects the three
filters and verifies by exact set intersection, and returns a spanning forest and link counts, never the pairs.
Equal sets are one node with a multiplicity.

Input: doc_id and text. Null or blank text: an empty set, linked with nothing. Fewer words than ``n``: the whole
sequence is the one n-gram. A null doc_id links with nothing and gets a null component. Rows that repeat a doc_id
count as one document of the graph. Tokens are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.llm import exchange as X
from promolens.llm.staging import components, groups_for, stage, table, total_bytes
from promolens.llm.words import U, Words, mix, sliced, window_hash

BLOCK_DOCS = 384
BLOCK_TOKENS = 400_000
ORDERS = (U(0x243F6A8885A308D3), U(0x13198A2E03707344), U(0xA4093822299F31D0))


def need(n, percent: int):
    return -(-n * percent // 100)


def token_sets(rows, n: int):
    """The sorted distinct n-gram hashes of each row."""
    for a, b in sliced(rows):
        w = Words(rows.slice(a, b - a).column("text"), lower=True)
        h = w.hashes()
        at, run = w.windows(h, n)
        cut = np.searchsorted(at, w.first)
        for i in range(b - a):
            x, y = w.first[i], w.first[i + 1]
            if y - x >= n or y == x:
                yield np.unique(run[cut[i]: cut[i + 1]])
            else:
                yield window_hash(h, np.array([x]), int(y - x))


def spanning(ids, mult, sets, prefixes, side, percent: int):
    """Links among ``ids`` (across the two sides if both occur): a forest as (a, b) and links per node."""
    m = len(ids)
    size = np.array([len(s) for s in sets])
    across = side.any() and not side.all()
    able = np.minimum.outer(size, size) * 100 >= np.maximum.outer(size, size) * percent
    able &= (side[:, None] != side[None, :]) if across else np.ones((m, m), bool)
    able &= ids[:, None] != ids[None, :]
    able = np.triu(able, 1)
    for prefix in prefixes:
        if not able.any():
            break
        able &= overlap(prefix, m) > 0
    a, b = np.nonzero(able)
    if len(a) > 4 * m + 64:
        used = np.unique(np.r_[a, b])
        place = np.zeros(m, np.int64)
        place[used] = np.arange(len(used))
        common = overlap([sets[i] for i in used], len(used))[place[a], place[b]]
    else:
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    good = common * 100 >= (size[a] + size[b] - common) * percent
    a, b = a[good], b[good]
    links = np.zeros(m, np.int64)
    np.add.at(links, a, mult[b])
    np.add.at(links, b, mult[a])
    root = list(range(m))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for i, j in zip(a.tolist(), b.tolist()):
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            forest.append((int(ids[i]), int(ids[j])))
    return forest, links


def overlap(sets, m: int) -> np.ndarray:
    """Sizes of all pairwise intersections, as products of 0/1 matrices over the shared tokens."""
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    s, row = flat[order], row[order]
    new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(s) else np.zeros(0, bool)
    keep = shared[column]
    number = (np.cumsum(shared) - 1)[column[keep]]
    row = row[keep]
    out = np.zeros((m, m), np.float32)
    width = 4096
    cuts = np.searchsorted(number, np.arange(0, (number[-1] + 1 if len(number) else 0) + width, width))
    for k in range(len(cuts) - 1):
        part = np.zeros((m, width), np.float32)
        part[row[cuts[k]: cuts[k + 1]], number[cuts[k]: cuts[k + 1]] - k * width] = 1
        out += part @ part.T
    return out.astype(np.int64)


def similar_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included) and n_links per row of ``docs``."""
    _, size = total_bytes(docs)
    buckets = groups_for(size // 6, X.BUCKET_ENTRIES)
    base = X.dealt(docs.select("doc_id", "text"), groups_for(size, X.GROUP_BYTES))

    def ask(rows: pa.Table) -> pa.Table:
        every = np.concatenate([np.zeros(0, np.uint64), *token_sets(rows, n)])
        h, count = np.unique(every, return_counts=True)
        low = (h & U(0xFFFFFFFF)).astype(np.uint32)
        return pa.Table.from_batches([X.request(rows.column("g")[0].as_py(), h, low, np.minimum(count, 255).astype(np.uint8), buckets)])

    def rule(inverse, extra, k):
        df = np.bincount(inverse, weights=extra, minlength=k).astype(np.uint32)
        return df >= 2, df

    def filtered(rows: pa.Table, found: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64())})
        bucket, res, df = X.answers(found, "u4", np.uint32)
        known = (bucket << U(32)) | res.astype(np.uint64)
        order = np.argsort(known)
        known, df = known[order], df[order]
        out = {k: [] for k in ("n", "s1", "s2", "tokens", "a", "b", "c")}
        for s in token_sets(rows, n):
            k = len(s)
            lists = None
            if k:
                count = X.looked_up(X.low_key(s, buckets), known, df, 1) if len(known) else np.ones(k, np.uint32)
                if (count > 1).any():
                    take = k - need(k, percent) + 1
                    lists = []
                    for i, salt in enumerate(ORDERS):
                        tie = mix(s ^ salt)
                        first = np.lexsort((tie, count))[:take] if i < 2 else np.argsort(tie)[:take]
                        lists.append(np.sort(s[first[count[first] > 1]]))
                    if not all(len(x) for x in lists):
                        lists = None
            out["n"].append(k)
            sums = [int(mix(s ^ salt).sum(dtype=np.uint64).astype(np.int64)) for salt in ORDERS[:2]] if lists else [None, None]
            out["s1"].append(sums[0])
            out["s2"].append(sums[1])
            out["tokens"].append(s.tobytes() if lists else None)
            out["a"].append(lists[0].view(np.int64) if lists else None)
            out["b"].append(lists[1].tobytes() if lists else None)
            out["c"].append(lists[2].tobytes() if lists else None)
        return pa.table([
            rows.column("rest").combine_chunks().field("doc_id"), pa.array(out["n"], pa.int64()), pa.array(out["s1"], pa.int64()),
            pa.array(out["s2"], pa.int64()), pa.array(out["tokens"], pa.binary()), pa.array(out["a"], pa.list_(pa.int64())),
            pa.array(out["b"], pa.binary()), pa.array(out["c"], pa.binary()),
        ], names=["doc_id", "n", "s1", "s2", "tokens", "a", "b", "c"])

    grouped = base.groupBy("g")
    counts = X.answered(grouped.applyInArrow(ask, X.REQUEST), "u4", rule)
    rows = stage(grouped.cogroup(counts.groupBy("g")).applyInArrow(
        filtered, "doc_id long, n long, s1 long, s2 long, tokens binary, a array<long>, b binary, c binary"), "sets")

    # equal sets are one node: its smallest doc_id
    cand = rows.where("tokens is not null and doc_id is not null")
    nodes = stage(cand.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.countDistinct("doc_id").alias("mult")), "nodes")
    lead = cand.withColumnRenamed("doc_id", "id").join(nodes, ["n", "s1", "s2", "id"]).dropDuplicates(["n", "s1", "s2", "id"])
    # clusters by shared first-order prefix tokens
    seen = lead.select("id", F.explode("a").alias("token"))
    least = stage(seen.groupBy("token").agg(F.min("id").alias("m"), F.max("id").alias("top")).where("m < top").drop("top"), "least")
    cluster = stage(components(seen.join(least, "token").select(F.col("id").alias("u"), F.col("m").alias("v"))), "clusters")
    placed = cluster.join(lead.select("id", "mult", F.col("n").cast("long"), "tokens", "a", "b", "c"), "id")
    sizes = placed.groupBy("root").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total"))
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("total") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = placed.join(stage(sizes, "sizes"), "root")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    meets = (
        placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).alias("side"),
                "id", "mult", "tokens", "a", "b", "c")
    )
    tasks = meets.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y")

    def verify(batches):
        key, held = None, []

        def flush():
            if len(held) < 2:
                return [], []
            ids = np.array([h[0] for h in held])
            sets = [np.frombuffer(h[3], np.uint64) for h in held]
            prefixes = [[np.array(h[4], np.int64).view(np.uint64) for h in held], *([np.frombuffer(h[k], np.uint64) for h in held] for k in (5, 6))]
            side = np.array([h[2] for h in held])
            if key[1] != key[2] and (side.all() or not side.any()):
                return [], []
            forest, links = spanning(ids, np.array([h[1] for h in held]), sets, prefixes, side, percent)
            return forest, [(int(i), int(k)) for i, k in zip(ids, links) if k]

        def out(found):
            forest, links = found
            u = [x[0] for x in forest] + [x[0] for x in links]
            v = [x[1] for x in forest] + [None] * len(links)
            k = [0] * len(forest) + [x[1] for x in links]
            return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(k, pa.int64())], names=["u", "v", "k"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = [batch.column(c)[i].as_py() for c in range(batch.num_columns)]
                now = tuple(r[:3])
                if now != key:
                    if key is not None and len(held) > 1:
                        yield out(flush())
                    key, held = now, []
                held.append((r[4], r[5], bool(r[3]), r[6], r[7], r[8], r[9]))
        if key is not None and len(held) > 1:
            yield out(flush())

    found = stage(tasks.mapInArrow(verify, "u long, v long, k long"), "links")
    groups = components(found.where("v is not null").select("u", "v"))
    links = found.where("v is null").groupBy("u").agg(F.sum("k").alias("k")).withColumnRenamed("u", "id")
    known = (
        nodes.join(groups, "id", "left").join(links, "id", "left")
        .select("n", "s1", "s2", F.coalesce("root", "id").alias("component"), (F.coalesce("k", F.lit(0)) + F.col("mult") - 1).alias("links"))
    )
    return rows.select("doc_id", "n", "s1", "s2").join(stage(known, "known"), ["n", "s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without all but the one of smallest doc_id in each group of linked rows. Rows that share a
    doc_id are linked by their texts like any others; rows without doc_id all stay."""
    named = docs.where("doc_id is not null")
    if not named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        keep = similar_groups(named, n, percent).where("doc_id = component_id").select("doc_id")
        kept = docs.join(stage(keep, "keep"), "doc_id", "left_semi")
    else:  # rows get numbers of their own, written so that they stay
        rows = stage(named.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
        groups = similar_groups(rows.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text")), n, percent)
        groups = groups.select(F.col("doc_id").alias("number"), "component_id").join(rows.select("number", F.col("row.doc_id").alias("doc_id")), "number")
        keep = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "number")).alias("first")).select("first.number")
        kept = rows.join(stage(keep, "keep"), "number", "left_semi").select("row.*")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return kept.select(*columns).unionByName(docs.where("doc_id is null"))


def op2_ngram_jaccard_join(spark, base: str) -> DataFrame:
    return similar_groups(table(spark, base, "documents"), n=4, percent=85)
