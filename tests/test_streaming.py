import pytest
from pyspark.sql import functions as F

from lattice.streaming import tasks


@pytest.fixture(scope="module")
def feed(spark, sf_dir, tmp_path_factory):
    """The events as files in order of time, and the same rows as a batch."""
    path = str(tmp_path_factory.mktemp("feed"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", t.alias("t")).orderBy("ts").coalesce(1)
    rows.write.mode("overwrite").option("maxRecordsPerFile", 250).parquet(path)
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
    return stream, batch


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_tumbling_windows(spark, feed, tmp_path):
    stream, batch = feed
    got = tasks.run_to_end(tasks.tumbling(stream, "ts", "6 hours", ["event_type"], "value", "60 days"), "tumbling", str(tmp_path), "complete")
    same(got, tasks.tumbling(batch, "ts", "6 hours", ["event_type"], "value"))


def test_sessions(spark, feed, tmp_path):
    stream, batch = feed
    got = tasks.run_to_end(tasks.sessions(stream, "ts", "4 hours", ["user_id"], "60 days"), "sessions", str(tmp_path), "complete")
    same(got, tasks.sessions(batch, "ts", "4 hours", ["user_id"]))


def test_first_of_each(spark, feed, tmp_path):
    stream, batch = feed
    got = tasks.run_to_end(tasks.first_of_each(stream, "ts", ["user_id", "event_type"], "60 days").select("user_id", "event_type"), "firsts", str(tmp_path))
    same(got, batch.select("user_id", "event_type").distinct())


def test_rate_limit_as_in_batch(spark, feed, sf_dir, tmp_path):
    from lattice.plans.control import token_bucket_decisions

    stream, _ = feed
    got = tasks.run_to_end(tasks.rate_limited(stream, 1 / 120, 2), "limited", str(tmp_path))
    same(got.select("user_id", "event_id", "allowed"), token_bucket_decisions(spark, sf_dir))


def test_breaker_and_throttle_as_in_batch(spark, feed, sf_dir, tmp_path):
    from lattice.plans.control import circuit_breaker_states, throttled_events

    stream, _ = feed
    calls = stream.withColumn("ok", F.col("event_type") != "error")
    same(tasks.run_to_end(tasks.breaker(calls, 2, 86400), "breaker", str(tmp_path / "a")), circuit_breaker_states(spark, sf_dir))
    updates = stream.withColumnsRenamed({"event_type": "status", "value": "progress"})
    got = tasks.run_to_end(tasks.throttled(updates, "user_id", 20, 7200, ("error",)), "throttled", str(tmp_path / "b"))
    same(got, throttled_events(spark, sf_dir).where("written").select("user_id", "event_id"))


def test_state_changes(spark, tmp_path):
    rows = [("a", 1, 1.0, "queued"), ("a", 2, 2.0, "parsing"), ("a", 3, 3.0, "storing"), ("a", 4, 4.0, "failed"), ("b", 5, 1.0, "parsing"), ("b", 6, 2.0, "queued")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "task_id string, event_id long, t double, status string").write.parquet(source)
    stream = spark.readStream.schema("task_id string, event_id long, t double, status string").parquet(source)
    got = tasks.run_to_end(tasks.state_changes(stream), "changes", str(tmp_path / "c"))
    assert {r.event_id: r.legal for r in got.collect()} == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True}


def test_expiry(spark):
    rows = [("a", "completed", "2024-01-01 00:00:00"), ("b", "running", "2024-01-01 00:00:00"), ("c", "completed", "2024-02-01 00:00:00")]
    gone, failed = tasks.expired(spark.createDataFrame(rows, "task_id string, status string, updated_at string"), "2024-02-01 12:00:00", "7 DAYS", "24 HOURS")
    assert [r.task_id for r in gone.collect()] == ["a"] and [(r.task_id, r.status) for r in failed.collect()] == [("b", "failed")]
