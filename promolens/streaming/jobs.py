"""Structured Streaming jobs over landed files.

Triggers replace the scheduler: ``available_now`` drains what has landed and
stops, an interval keeps polling. Checkpoint folders are given by the caller and
belong on shared storage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from promolens.functions.records import accepted, build_records, derive_fields
from promolens.operators.ingest import extraction_plan, extraction_summary, pending_extraction
from promolens.params import Params

STAGED = (
    "arrival BIGINT, company STRING, base_url STRING, url STRING, title STRING, period STRING, "
    "benefit_type STRING, benefit_value STRING, conditions STRING, target_segment STRING, raw_text STRING"
)


def staged_stream(spark: SparkSession, folder: str, fmt: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Landed staging rows as a stream."""
    reader = spark.readStream.schema(STAGED)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(folder)


def _start(writer, checkpoint: str, interval: str | None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def first_wins(rows: DataFrame) -> DataFrame:
    """The first row of each address that the stream has ever seen, by smallest arrival within a micro-batch.

    ``rows``: url, arrival, seed (true for addresses that are stored already and only mark their key) and row (text).
    One flag per address is kept in the state store; a batch touches only the addresses it brings.
    """

    def keep(key, frames, state):
        import pandas as pd

        best, seeded = None, False
        for frame in frames:  # pieces of bounded size, however often an address comes
            seeded = seeded or bool(frame["seed"].any())
            for arrival, row in zip(frame["arrival"].tolist(), frame["row"].tolist()):
                if row is not None and (best is None or (arrival, row) < best):
                    best = (arrival, row)
        if not state.exists:
            state.update((True,))
            if best is not None and not seeded:
                yield pd.DataFrame({"url": [key[0]], "row": [best[1]]})

    return rows.groupBy("url").applyInPandasWithState(keep, "url STRING, row STRING", "seen BOOLEAN", "append", "NoTimeout")


def ingest_stream(
    staged: DataFrame, target: str, checkpoint: str, params: Params, interval: str | None = None, stored: str | None = None,
) -> StreamingQuery:
    """First-wins ingest: appends the addresses that neither the stream nor the ``stored`` table has seen.

    Seen addresses are state of the query, kept in its checkpoint, so no batch reads the target; ``stored`` (a parquet
    folder with ``url``) seeds that state with the first batch. The file sink commits each batch once, so a batch that
    is repeated after a failure adds nothing twice. Where addresses are many, choose the RocksDB state store, as
    ``session.tuned`` does.
    """
    rows = accepted(build_records(staged, params.vocab))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "base_url"])
    payload = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    late = F.lit(2**63 - 1).cast("bigint")
    keyed = rows.select("url", F.coalesce(F.col("arrival").cast("bigint"), late).alias("arrival"), F.lit(False).alias("seed"), payload.alias("row"))
    if stored is not None:
        known = staged.sparkSession.readStream.schema("url STRING").parquet(stored)
        keyed = keyed.unionByName(known.select(
            "url", F.lit(0).cast("bigint").alias("arrival"), F.lit(True).alias("seed"), F.lit(None).cast("string").alias("row")))
    found = first_wins(keyed).select(F.from_json("row", schema).alias("row")).select("row.*")
    return _start(derive_fields(found, params.as_of).writeStream.outputMode("append").format("parquet").option("path", target), checkpoint, interval)


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def extraction_stream(
    events: DataFrame, locks: Callable[[], DataFrame], extract: Callable[[DataFrame], DataFrame],
    target: str, checkpoint: str, interval: str | None = None,
) -> StreamingQuery:
    """Pending records in micro-batches: locked ones skipped, unfinished ones taken up again.

    ``extract`` turns the records to be extracted into results with ``id, error,
    source``; outcomes of the batch are stored per batch id, with the record in
    ``event``. Records that were locked, got an error or no result are ``unfinished``
    and take part in the next batch, unless it brings a newer state of them. The
    reader's files per batch bound a batch; no row is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        before = f"{target}/batch={batch_id - 1}"
        if batch_id and _exists(batch.sparkSession, before):
            left = batch.sparkSession.read.parquet(before).where("unfinished").select("event.*")
            batch = batch.unionByName(left.join(batch.select("id"), "id", "left_anti"))
        queue = pending_extraction(batch)
        event = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        plan = extraction_plan(queue, locks()).select("id", "url", "action", event.alias("event"))
        done = extract(plan.where(F.col("action") == "extract").drop("event")).select("id", "error", "source")
        open_ = (F.col("action") == "skipped") | (
            (F.col("action") == "extract") & (F.col("error").isNotNull() | F.col("_done").isNull()))
        outcome = plan.join(done.withColumn("_done", F.lit(True)), "id", "left")
        outcome = outcome.withColumn("unfinished", F.coalesce(open_, F.lit(False))).drop("_done")
        outcome.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _start(events.writeStream.foreachBatch(write), checkpoint, interval)


def log_stream(
    spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, interval: str | None = None,
    fmt: str = "json",
) -> StreamingQuery:
    """Append-only logs (snapshots, edits, job transitions) from landed files to a table."""
    rows = spark.readStream.schema(schema).format(fmt).load(folder)
    return _start(rows.writeStream.outputMode("append").format("parquet").option("path", target), checkpoint, interval)


def progress_stream(
    outcomes: DataFrame, name: str | None = None, checkpoint: str | None = None, target: str | None = None,
    interval: str | None = None,
) -> StreamingQuery:
    """Live run counters from a stream of outcomes.

    With ``target`` and ``checkpoint`` each batch writes its totals under its id; the counts are state of the query, so
    they go on after a restart, and ``read_progress`` gives the latest. With ``name`` they go to an in-memory table.
    """
    totals = extraction_summary(outcomes).writeStream.outputMode("complete")
    if target is None:
        writer = totals.format("memory").queryName(name)
        if checkpoint:
            writer = writer.option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start()
    if checkpoint is None:
        raise ValueError("durable counters need a checkpoint")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return _start(totals.foreachBatch(write), checkpoint, interval)


def read_progress(spark: SparkSession, target: str) -> DataFrame:
    """The totals of the latest batch."""
    rows = spark.read.parquet(target)
    return rows.orderBy(F.desc("batch")).limit(1).drop("batch")
