"""Writing table versions without a table format.

A version is always written to a path of its own and never read from the path
it is written to. Readers take the newest complete version (``_SUCCESS``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has ended."""
    done, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(done)


def versions(spark: SparkSession, root: str) -> list[int]:
    p, fs = _path(spark, root)
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        if name.startswith("v") and name[1:].isdigit() and complete(spark, f"{root}/{name}"):
            found.append(int(name[1:]))
    return sorted(found)


def write_version(df: DataFrame, root: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write the next version of a table and return its path."""
    have = versions(df.sparkSession, root)
    target = f"{root}/v{(have[-1] if have else 0) + 1:08d}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    return target


def read_version(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Newest complete version; an empty table when there is none yet."""
    have = versions(spark, root)
    if not have:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/v{have[-1]:08d}")


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint; the folder comes from the session and survives lost executors."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    if sc.getCheckpointDir() is None:
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return df.checkpoint()
