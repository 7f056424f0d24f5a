"""Session settings that the jobs profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # texts, pages and items unfold after the shuffle, so small partitions are worth a task
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        # addresses seen by an ingest stream are kept on the executors' disks, not in their heaps
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
