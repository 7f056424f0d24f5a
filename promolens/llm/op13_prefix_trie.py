"""Prefix trie of conversations by ROLLUP over positional turn columns.

A conversation's turns become ids (128 bits of SHA-256 over role and text, with the number of words) and lie in blocks
of ``WIDTH`` positional columns, one row per conversation and block. ``GROUP BY b, anchor, ROLLUP(p0, p1, ...)``
aggregates all prefixes of a block together; ``grouping_id`` tells their length. ``anchor`` names the node that the
earlier blocks lead to, so equal columns below different nodes stay apart. Anchors come from the same operator one level
up, where a full block is one id: conversations of t turns need log(t) levels, not t / WIDTH rounds, and no conversation
is ever gathered in one row, task or group.

A node is known by its smallest member and its depth. The nodes of one smallest member form a chain of depths without
gaps, so only the top of each chain has to look its parent up, and the sum over a subtree is the members' sums of what
their chains hold, less what the node's own chain holds above it: a second ROLLUP.

Turns are ordered by turn, null first; turns of equal number by their id. Repeated rows are turns of their own. Null
role or text counts as empty. Rows without conv_id belong to no conversation. An empty table has no nodes; if no
conversation has a turn, the root is a leaf. Very long texts are read once; afterwards only ids move. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.staging import stage, table

WIDTH, KEY_BYTES, ID_RANGE, RUN_WIDTH = 8, 16, 12, 64
P = [f"p{k}" for k in range(WIDTH)]
NODE = ["b", "anchor", "d", "path"]
TOKEN = "struct<id:binary,words:bigint>"


def digest(x: Column) -> Column:
    return F.substring(F.unhex(F.sha2(x, 256)), 1, KEY_BYTES)


def turn_ids(turns: DataFrame) -> DataFrame:
    """conv_id, turn, tok, copies: equal turns of a conversation with the same number in one row."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    tok = F.struct(
        digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("long").alias("words"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), tok.alias("tok"))
    return rows.groupBy("conv_id", "turn", "tok").agg(F.count(F.lit(1)).alias("copies"))


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), tok. Rows are dealt by ranges, so one conversation may lie in many tasks."""
    order = [F.asc_nulls_first("turn"), F.asc("tok")]
    placed = stage(
        rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy("conv_id", "part").agg(F.sum("copies").alias("held"))
    earlier = whole.withColumn("earlier", F.sum("held").over(before.partitionBy("conv_id").orderBy("part"))).where("earlier > 0")
    here = F.coalesce(F.sum("copies").over(before.partitionBy("conv_id", "part").orderBy(*order)), F.lit(0))
    rows = placed.withColumn("here", here).join(earlier.select("conv_id", "part", "earlier"), ["conv_id", "part"], "left")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    rows = rows.select("conv_id", "tok", (F.col("here") + F.coalesce("earlier", F.lit(0))).alias("here"), at)
    return rows.select("conv_id", (F.col("here") + F.col("copy")).alias("pos"), "tok")


def blocked(turns: DataFrame) -> DataFrame:
    """conv_id, b, p0 ...: one row per conversation and block of ``WIDTH`` turns."""
    k = F.col("pos") % WIDTH
    return turns.groupBy("conv_id", F.floor(F.col("pos") / WIDTH).alias("b")).agg(
        *[F.max(F.when(k == i, F.col("tok"))).alias(p) for i, p in enumerate(P)])


def path(d: Column) -> Column:
    """The first d turns of a block in one id."""
    return digest(F.concat(*[F.coalesce(F.when(d > i, F.col(f"{p}.id")), F.lit(b"")) for i, p in enumerate(P)]))


def turns_in(columns=P) -> Column:
    return sum((F.col(p).isNotNull().cast("int") for p in columns), F.lit(0))


def rolled(blocks: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes of at least one turn: b, anchor, d, path, words (of the last turn), depth and the aggregates."""
    every = blocks.sparkSession.sql(f"""
        SELECT b, anchor, {', '.join(P)}, {WIDTH} - bit_count(grouping_id()) AS d, {aggregates}
        FROM {{blocks}} GROUP BY b, anchor, ROLLUP({', '.join(P)})""", blocks=blocks)
    every = every.where((F.col("d") > 0) & (turns_in() == F.col("d")))  # else a conversation ended before
    return every.withColumns({
        "path": path(F.col("d")), "depth": F.col("b") * WIDTH + F.col("d"),
        "words": F.get(F.array(*[F.col(f"{p}.words") for p in P]), F.col("d") - 1),
    }).drop(*P)


def anchored(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the node that their earlier blocks lead to, the same for all that share these; 0 at the root."""
    if not blocks.agg(F.max("b")).first()[0]:
        return blocks.withColumn("anchor", F.lit(0).cast("long"))
    last = blocks.groupBy("conv_id").agg(F.max("b").alias("last")).where("last > 0")
    whole = F.struct(path(F.lit(WIDTH)).alias("id"), F.lit(0).cast("long").alias("words"))
    upper = blocks.join(last, "conv_id").where("b < last").select("conv_id", F.col("b").alias("pos"), whole.alias("tok"))
    upper = anchored(stage(blocked(upper), "blocks"))
    each = upper.withColumn("d", F.explode(F.sequence(F.lit(1), turns_in())))
    each = each.select("conv_id", "b", "anchor", "d", path(F.col("d")).alias("path"))
    names = rolled(upper, "min(conv_id) AS name").select(*NODE, "name")
    named = each.join(names, NODE).select("conv_id", (F.col("b") * WIDTH + F.col("d")).alias("b"), F.col("name").alias("anchor"))
    out = blocks.join(named, ["conv_id", "b"], "left")
    return stage(out.withColumn("anchor", F.coalesce("anchor", F.lit(0).cast("long"))), "anchored")


def running(values: DataFrame, most: int) -> DataFrame:
    """conv, at, before: the sum of the values at smaller ``at`` (up to ``most``), summed by buckets first."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    bucket = values.withColumn("bucket", F.floor(F.col("at") / RUN_WIDTH))
    here = F.coalesce(F.sum("value").over(before.partitionBy("conv", "bucket").orderBy("at")), F.lit(0))
    out = bucket.withColumn("before", here)
    if most >= RUN_WIDTH:
        upper = bucket.groupBy("conv", F.col("bucket").alias("at")).agg(F.sum("value").alias("value"))
        upper = running(upper, most // RUN_WIDTH).select("conv", F.col("at").alias("bucket"), F.col("before").alias("earlier"))
        out = out.join(upper, ["conv", "bucket"]).withColumn("before", F.col("before") + F.col("earlier"))
    return out.select("conv", "at", "before")


def at_depth(depth: Column) -> tuple[Column, Column]:
    """Block and length within it of the prefix of that depth (from 1)."""
    return F.floor((depth - 1) / WIDTH), ((depth - 1) % WIDTH + 1).cast("int")


def hashed_ends(ends: DataFrame) -> DataFrame:
    """NODE, ends_sha256: the ids (column conv_id) of each node, streamed through the hash in ascending order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*NODE, F.shiftright("conv_id", ID_RANGE).alias("range")).agg(ids.alias("ids"))
    chunks = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "range")

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for row in batch.select([*NODE, "ids"]).to_pylist():
                key = tuple(row[c] for c in NODE)
                if key == node:
                    state.update(b",")
                else:
                    done += [(node, state.hexdigest())] if node else []
                    node, state = key, hashlib.sha256()
                state.update(row["ids"].encode())
            yield packed(done)
        yield packed([(node, state.hexdigest())] if node else [])

    def packed(done):
        columns = [pa.array([n[i] for n, _ in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary()))]
        return pa.record_batch([*columns, pa.array([h for _, h in done], pa.string())], names=[*NODE, "ends_sha256"])

    return chunks.mapInArrow(run, "b long, anchor long, d int, path binary, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes over ``turns`` (conv_id, pos, tok) of ``convs`` (conv_id, length; turnless ones too)."""
    root = convs.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id"), F.max("length")).first()
    spark = convs.sparkSession
    blocks = anchored(stage(blocked(turns), "blocks"))
    nodes = stage(rolled(blocks, "min(conv_id) AS conv, count(1) AS n_convs"), "nodes")
    chains = nodes.groupBy("conv").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"))

    # parents of the chains' tops
    b, d = at_depth(F.col("top") - 1)
    tops = chains.where("top > 1").select("conv", "top", b.alias("b"), d.alias("d"))
    tops = tops.join(blocks.withColumnRenamed("conv_id", "conv"), ["conv", "b"]).select("conv", "top", "b", "anchor", "d", path(F.col("d")).alias("path"))
    tops = tops.join(nodes.select(*NODE, F.col("conv").alias("parent")), NODE).select("conv", "top", "parent")
    tops = stage(tops.unionByName(chains.where("top = 1").select("conv", "top", F.lit(root[1]).cast("long").alias("parent"))), "tops")
    branches = tops.groupBy(F.col("parent").alias("conv"), (F.col("top") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("branches"))

    # what each chain holds
    values = nodes.select("conv", F.col("depth").alias("at"), ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    above = running(values, int(root[2] or 0)).withColumnRenamed("at", "depth")
    leaves = chains.join(branches.withColumnRenamed("depth", "bottom"), ["conv", "bottom"], "left_anti").select("conv", F.lit(1).alias("leaf"))
    held = values.groupBy("conv").agg(F.sum("value").alias("held")).join(leaves, "conv", "left").withColumnRenamed("conv", "conv_id")
    held = stage(held.withColumn("leaf", F.coalesce("leaf", F.lit(0)).cast("long")), "chains")
    sums = rolled(blocks.join(held, "conv_id", "left"), "coalesce(sum(held), 0) AS held, coalesce(sum(leaf), 0) AS n_leaves")

    b, d = at_depth(F.col("length"))
    ends = convs.where("length > 0").select("conv_id", b.alias("b"), d.alias("d")).join(blocks, ["conv_id", "b"])
    ends = ends.select("conv_id", "b", "anchor", "d", path(F.col("d")).alias("path"))
    none = convs.where("length = 0").select(
        "conv_id", F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("anchor"), F.lit(0).alias("d"), F.lit(b"").alias("path"))
    hashes = stage(hashed_ends(ends.unionByName(none)), "ends")

    empty = F.lit(hashlib.sha256().hexdigest())
    below = (F.col("depth") < F.col("bottom")).cast("long")
    out = (
        nodes.join(sums.select(*NODE, "held", "n_leaves"), NODE).join(hashes, NODE, "left").join(above, ["conv", "depth"])
        .join(branches, ["conv", "depth"], "left").join(chains, "conv")
        .join(tops.select("conv", F.col("top").alias("depth"), "parent"), ["conv", "depth"], "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", F.coalesce("parent", "conv").alias("parent_conv_id"), "n_convs",
            (F.coalesce("branches", F.lit(0)) + below).alias("n_children"), "n_leaves",
            (F.col("held") - F.col("before")).alias("saved_tokens"), F.coalesce("ends_sha256", empty).alias("ends_sha256")))
    if not root[0]:
        return out.where(F.lit(False))
    saved, leaves = held.agg(F.sum("held"), F.sum("leaf")).first()
    ended = hashes.where("b = -1").first()
    top = spark.createDataFrame([(
        root[1], 0, None, root[0], tops.where("top = 1").count(), max(leaves or 0, 1), saved or 0,
        ended["ends_sha256"] if ended else hashlib.sha256().hexdigest())],
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    return out.unionByName(top)


def rebuilt(turns: DataFrame, heads: int = 4, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """convs and turns for ``trie``: the first h turns of a conversation come from the first one of its ``every``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    donor = F.col("conv_id") - F.col("conv_id") % every
    own = stage(numbered(turn_ids(turns)), "own")
    first = own.where((F.col("pos") < heads - 1) & (F.col("conv_id") == donor)).groupBy(F.col("conv_id").alias("donor")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("first"))
    convs = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("donor", donor).join(first, "donor", "left")
    taken = F.coalesce(F.slice("first", 1, F.col("h").cast("int")), F.array().cast(f"array<struct<pos:bigint,tok:{TOKEN}>>"))
    convs = convs.withColumn("taken", taken).withColumn("g", F.size("taken"))
    convs = stage(convs.select("conv_id", "taken", "g", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    lent = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.pos", "t.tok")
    rest = own.where(F.col("pos") >= h).join(convs.select("conv_id", "g"), "conv_id").select("conv_id", (F.col("pos") - h + F.col("g")).alias("pos"), "tok")
    return convs.select("conv_id", "length"), lent.unionByName(rest)


def op13_prefix_trie(spark, base: str) -> DataFrame:
    return trie(*rebuilt(table(spark, base, "conversations")))


ORACLE_SQL = """
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i,
  {'r': coalesce(role, ''), 't': coalesce(text, '')} AS tok FROM conversations WHERE conv_id IS NOT NULL),
c0 AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS donor FROM o),
c AS (SELECT conv_id, donor, xor(list_reduce(
    list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, x: list_reduce(list_concat([xor(a, x)], [CAST(0 AS BIGINT) FOR z IN range(8)]),
      lambda s, z: CASE WHEN s & 1 = 1 THEN xor(s >> 1, CAST(3988292384 AS BIGINT)) ELSE s >> 1 END)),
    CAST(4294967295 AS BIGINT)) % 4 AS h FROM c0),
r AS (SELECT c.conv_id, o.i AS k, 0 AS own, tok FROM c JOIN o ON o.conv_id = c.donor AND o.i < c.h
  UNION ALL SELECT c.conv_id, o.i, 1, tok FROM c JOIN o ON o.conv_id = c.conv_id AND o.i >= c.h),
l AS (SELECT c.conv_id, coalesce(list(tok ORDER BY own, k) FILTER (tok IS NOT NULL), []) AS toks FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, CAST(d AS BIGINT) AS depth, toks[1:d] AS path, len(toks) AS n FROM (SELECT conv_id, toks, unnest(range(0, len(toks) + 1)) AS d FROM l)),
v AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM m GROUP BY depth, path),
p AS (SELECT v.*, u.conv_id AS parent_conv_id,
  CASE WHEN v.depth = 0 THEN 0 ELSE (v.n_convs - 1) * len(regexp_extract_all(v.path[v.depth].t, '[^\\x20\\x09-\\x0D]+')) END AS own
  FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND u.path = v.path[1:v.depth - 1]),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY ALL),
q AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM p LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT a.conv_id, a.depth, sum(b.own) AS saved, count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM q a JOIN q b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM q JOIN s USING (conv_id, depth)
"""
