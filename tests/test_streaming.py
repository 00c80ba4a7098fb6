import time

import pytest
from pyspark.sql import functions as F

from lodeline.operators.index import SnapshotStore
from lodeline.streaming import jobs


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


@pytest.fixture
def source(spark, tmp_path):
    def make(df, parts=2):
        path = str(tmp_path / f"in-{time.time_ns()}")
        df.repartition(parts).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def test_commit_once(spark, source):
    df = spark.read.parquet("/root/testdata/sf0.001/education_committed_turns.parquet").select("turn_id", "thread_id", F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    drain(jobs.commit_once(source(df)), "commits")
    assert spark.table("commits").count() == df.select("turn_id").distinct().count()


def test_windows(spark, source):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type", "value")
    drain(jobs.events_per_window(source(df, 1)), "windows", "complete")
    assert spark.table("windows").agg(F.sum("n")).first()[0] == df.count()


def test_quota(spark, source):
    df = spark.createDataFrame([("t", "search", i) for i in range(20)], "turn_id string, tool string, call_id long")
    drain(jobs.quota(source(df, 4)), "quota")
    got = spark.table("quota")
    assert got.filter("allowed").count() == 6 and got.select("call_no").distinct().count() == 20


def test_rolling_compaction(spark, source):
    df = spark.createDataFrame([("t", i, f"line {i}") for i in range(30)], "thread_id string, id long, line string")
    drain(jobs.rolling_compaction(source(df, 1), trigger=10, keep=6), "rolling")
    r = spark.table("rolling").collect()[-1]
    assert set(r.kept) | set(r.removed) == set(range(30)) and len(r.kept) < 10 and r.kept[-1] == 29


def test_refresh_on_change(spark, source, tmp_path):
    rows = spark.createDataFrame([("a", "1", "c1", "x"), ("b", "1", "c2", "y")], "source string, file_hash string, chunk_id string, text string")
    store = SnapshotStore(spark, str(tmp_path / "index"))
    q = jobs.refresh_on_change(source(rows), store, {"v": 1}, lambda df: df, lambda: rows).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and store.read().count() == 2
