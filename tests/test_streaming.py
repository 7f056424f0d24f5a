import datetime as dt
import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from promolens import Params
from promolens.functions.records import accepted, build_records
from promolens.operators import storage
from promolens.operators.ingest import insert_if_new
from promolens.streaming import jobs

P = Params(as_of=dt.date(2026, 2, 15), focal="A")


def land(folder, name, rows):
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")


def row(i, url):
    return {"arrival": i, "company": "A", "base_url": "https://www.example.com/l", "url": url, "title": f"오퍼 {i}",
            "period": "2026.02.01~2026.03.31", "benefit_value": "1만원"}


def test_stream_equals_batch_ingest(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    rows = [row(i, f"/e/{i % 7}?utm_source=x{i}") for i in range(30)]
    for n in range(3):
        land(f"{root}/in", f"{n}.json", rows[n * 10:(n + 1) * 10])
        jobs.ingest_stream(jobs.staged_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/ck", P).awaitTermination()
    got = spark.read.parquet(f"{root}/out").select("url", "arrival").collect()
    batch = accepted(build_records(spark.createDataFrame(rows), P.vocab))
    want = insert_if_new(batch, spark.createDataFrame([], "url STRING"), [F.asc("arrival")], P).select("url", "arrival").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7


def test_ingest_remembers_over_restarts_and_never_reads_the_target(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.createDataFrame([("https://www.example.com/e/1",), ("https://www.example.com/e/5",)], "url string").write.parquet(f"{root}/stored")
    land(f"{root}/in", "0.json", [row(9, "/e/2"), row(4, "/e/2?utm_source=a"), row(1, "/e/1"), row(7, "/e/3")])

    def run():
        jobs.ingest_stream(jobs.staged_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/ck", P, stored=f"{root}/stored").awaitTermination()
        return sorted((r.url.rpartition("/")[2], r.arrival, r.title, r.status) for r in spark.read.parquet(f"{root}/out").collect())

    first = [("2", 4, "오퍼 4", "active"), ("3", 7, "오퍼 7", "active")]
    assert run() == first and run() == first
    land(f"{root}/in", "1.json", [row(2, "/e/2"), row(11, "/e/5"), row(12, "/e/6"), row(13, "/e/6")])
    assert run() == [*first, ("6", 12, "오퍼 12", "active")]
    # an ended query that starts anew from its checkpoint with nothing landed adds nothing, whatever became of the target
    before = spark.read.parquet(f"{root}/out").count()
    assert len(run()) == before


def test_progress_survives_a_restart(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "action STRING, error STRING, source STRING"
    for n, rows in enumerate(([{"action": "extract"}, {"action": "extract", "error": "x"}], [{"action": "skipped"}, {"action": "extract", "source": "gemini"}])):
        land(f"{root}/in", f"{n}.json", rows)
        jobs.progress_stream(spark.readStream.schema(schema).json(f"{root}/in"), checkpoint=f"{root}/ck", target=f"{root}/out").awaitTermination()
        got = jobs.read_progress(spark, f"{root}/out").first()
        assert (got.processed, got.succeeded, got.failed, got.enriched) == ((2, 1, 1, 0), (4, 3, 1, 1))[n]


def test_extraction_stream_takes_up_unfinished_rows(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "id BIGINT, url STRING, marketing_content STRING, created_at TIMESTAMP_NTZ"
    land(f"{root}/in", "a.json", [{"id": i, "url": f"https://x/{i}" if i != 3 else "ftp://x", "created_at": f"2026-01-0{i} 00:00:00"} for i in range(1, 7)])
    events = spark.readStream.schema(schema).json(f"{root}/in")
    locks = lambda: spark.createDataFrame([(2, True)], "event_id BIGINT, is_locked BOOLEAN")
    extract = lambda df: df.select("id", F.lit(None).cast("string").alias("error"), F.lit("rule").alias("source"))
    failing = lambda df: extract(df).withColumn("error", F.when(F.col("id") == 4, "timeout"))
    jobs.extraction_stream(events, locks, failing, f"{root}/out", f"{root}/ck").awaitTermination()
    got = {r.id: (r.action, r.unfinished) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {6: ("extract", False), 5: ("extract", False), 4: ("extract", True), 3: ("failed", False), 2: ("skipped", True), 1: ("extract", False)}
    land(f"{root}/in", "b.json", [{"id": 7, "url": "https://x/7", "created_at": "2026-01-09 00:00:00"}])
    free = lambda: locks().where("false")
    jobs.extraction_stream(events, free, extract, f"{root}/out", f"{root}/ck").awaitTermination()
    got = {r.id: (r.action, r.unfinished) for r in spark.read.parquet(f"{root}/out/batch=1").collect()}
    assert got == {i: ("extract", False) for i in (2, 4, 7)}


def test_progress_and_log_streams(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    land(f"{root}/in", "a.json", [{"action": "extract"}, {"action": "extract", "error": "x"}, {"action": "skipped"}, {"action": "failed"}, {"action": "extract", "source": "gemini"}])
    schema = "action STRING, error STRING, source STRING"
    q = jobs.progress_stream(spark.readStream.schema(schema).json(f"{root}/in"), "progress")
    q.awaitTermination()
    r = spark.table("progress").first()
    assert (r.processed, r.succeeded, r.failed, r.enriched) == (5, 3, 2, 1)
    jobs.log_stream(spark, f"{root}/in", schema, f"{root}/log", f"{root}/ck").awaitTermination()
    assert spark.read.parquet(f"{root}/log").count() == 5


def test_table_versions(spark):
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"
    assert storage.read_version(spark, root, "a INT").count() == 0
    storage.write_version(spark.range(3).select(F.col("id").cast("int").alias("a")), root)
    storage.write_version(storage.read_version(spark, root, "a INT").where("a > 0"), root)
    assert storage.versions(spark, root) == [1, 2] and storage.read_version(spark, root, "a INT").count() == 2
