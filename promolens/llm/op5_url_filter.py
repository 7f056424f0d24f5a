"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule (host, path prefix) fits its host, all subdomains, and paths that start with its own. Canonical key of a
host and path: the host's labels reversed, then the path (``example.org/en/1`` -> ``org.example/en/1``). Within one
rule host the keys that start with a rule's key are an interval that begins there; intervals are nested or disjoint. A url has one key per host
suffix that is a rule host. Rules and url keys are sorted together; the sweep carries the stack of rules open at
the latest rule start, and the top entry whose interval still holds the url's key is the longest fit there. The
longest fit over all suffixes wins, of equal lengths the longer host.

Distinct (host, path) pairs are swept, so a hot url is one key; a hot rule host is split by salts, each with a copy
of that host's rules. Host: after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased. Path: then up to
``? #`` or the end. A url that is null or has no ``://`` has an empty host and path and no rule. Without a rule
the verdict is ``default``. Rules with a null part are left out; of equal rules with different verdicts block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.llm.staging import table

KEYS_PER_SALT = 20_000
#: The rules of the registered query as (host, path, verdict).
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), upper, upper.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def with_stacks(rules: DataFrame) -> DataFrame:
    """Distinct rules with key and ``stack``: the rules of its host that enclose it, outermost first."""
    own = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    own = own.withColumn("key", F.concat(reversed_host(F.col("host")), "path"))
    entry = F.struct(F.length("path").alias("length"), "key", F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict"))
    outer = own.select("host", F.col("path").alias("prefix"), entry.alias("entry"))
    cuts = own.select("host", "key", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    cuts = cuts.select("host", "key", F.expr("substring(path, 1, n)").alias("prefix"))
    return cuts.join(outer, ["host", "prefix"]).groupBy("host", "key").agg(F.sort_array(F.collect_list("entry")).alias("stack"))


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict; input columns of these names are replaced."""
    results = ["host", "path", "rule", "verdict"]
    named = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in results]).alias("row"),
        host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    distinct = named.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    probes = distinct.where("host <> ''").select("host", "path", F.explode(suffix).alias("at"))
    starts = with_stacks(rules).withColumnRenamed("host", "at")
    # counted before they meet the rules: tasks send one row per host, however hot
    load = probes.groupBy("at").agg(F.count(F.lit(1)).alias("n")).join(starts.select("at").distinct(), "at", "left_semi")
    salts = load.select("at", F.ceil(F.col("n") / KEYS_PER_SALT).cast("int").alias("salts"))
    probes = probes.join(salts, "at").select(
        "at", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"),
        F.concat(reversed_host(F.col("at")), "path").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"), "host", "path")
    rules_there = starts.join(salts, "at").select(
        "at", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", F.lit(0).alias("kind"), "stack",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    sweep = Window.partitionBy("at", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # dealt by both: a window is content with rows dealt by ``at`` alone, which would put a hot host in one task
    swept = probes.unionByName(rules_there).repartition("at", "salt").withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    still = F.filter("open", lambda r: F.startswith(F.col("key"), r["key"]))
    top = swept.select("host", "path", F.length("at").alias("host_length"), F.element_at(F.when(F.size(still) > 0, still), -1).alias("top")).where("top is not null")
    best = top.groupBy("host", "path").agg(
        F.max(F.struct((F.col("host_length") + F.col("top.length")).alias("length"), "host_length", F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    return named.join(best, ["host", "path"], "left").select(
        "row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark, base: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judged(table(spark, base, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL = """
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts),
ruled AS (SELECT page_id, host, path, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
  END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
