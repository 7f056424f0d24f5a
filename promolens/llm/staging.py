"""Written intermediate tables, text groups and connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a local one only where all run on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="stages-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def total_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and text bytes of the whole table (one aggregate)."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return int(row[0]), int(row[1] or 0)


def groups_for(size: int, per_group: int) -> int:
    return max(8, math.ceil(size / per_group))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v long): rows (id, root) with the smallest id of each component.

    Alternating large-star and small-star rounds; a node's neighbours are only ever reduced by ``min``, so a
    hub is combined before the shuffle. Each round is a written table. Null ends and loops link nothing.
    """
    own = edges.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, mark = stage(own, "edges"), None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        count = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(count) == mark:
            break
        mark = tuple(count)
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("id"), "root").unionByName(
        roots.select(F.col("root").alias("id"), "root").distinct())
