from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from quillspark.operators import state as st
from quillspark.streaming import events as stream

NOW = datetime(2024, 6, 1, 12)
URLS = "canonical_url string, url string, last_status string, next_due_at timestamp, first_seen_at timestamp, last_fetched_at timestamp, last_failure_at timestamp"


def now():
    return F.lit(NOW).cast("timestamp")


def urls(spark):
    h = timedelta(hours=1)
    rows = [("a", "a", "success", NOW - h, NOW - 9 * h, NOW - 2 * h, None), ("b", "b", "failed", NOW - h, NOW - 8 * h, None, NOW - h), ("c", "c", "pending", NOW - h, NOW, None, None), ("d", "d", "success", NOW + h, NOW, NOW - h, None), ("e", "e", "failed", NOW + h, NOW, None, None)]
    return spark.createDataFrame(rows, URLS)


QUEUE = "canonical_url string, url string, enqueued_at timestamp, priority int, reason string"


def queue(spark, *rows):
    return spark.createDataFrame([(u, u, NOW + timedelta(minutes=i), p, "r") for i, (u, p) in enumerate(rows)], QUEUE)


def test_snapshot(spark):
    r = st.status_snapshot(urls(spark).filter("canonical_url < 'd'"), queue(spark, ("x", 0), ("y", 0)), now()).first()
    assert (r.total, r.success, r.failed, r.pending, r.due, r.queue_depth) == (3, 1, 1, 1, 3, 2)


def test_queue(spark):
    u, q = urls(spark), queue(spark, ("low", 0), ("high", 5))
    batch, rest = st.dequeue(q, 1)
    assert [r.url for r in batch.collect()] == ["high"] and [r.url for r in rest.collect()] == ["low"]
    new = queue(spark, ("d", 1), ("low", 3), ("z", 1))
    plain = {r.canonical_url: r.priority for r in st.enqueue(q, u, new, now()).collect()}
    assert plain == {"low": 0, "high": 5, "z": 1}  # d is a success that isn't due
    forced = {r.canonical_url: r.priority for r in st.enqueue(q, u, new, now(), force=True).collect()}
    assert forced == {"low": 3, "high": 5, "z": 1, "d": 1}
    assert [r.url for r in st.requeue_failed(u, 1).collect()] == ["b"]
    assert st.dequeue(q, 0)[0].count() == 0


def test_history_and_retention(spark):
    day = timedelta(days=1)
    e = spark.createDataFrame([(1, NOW - 90 * day, "fetch_failure", "failed"), (2, NOW - 2 * day, "fetch_success", "ok"), (3, NOW - 2 * day, "crawl_discovered", None)], "event_id int, event_at timestamp, event_type string, status string")
    r = st.event_history(e.filter("event_id > 1"), 60).first()
    assert (r.total, r.success, r.failed, r.discovered, r.fetched) == (2, 2, 0, 1, 1)
    assert [r.event_id for r in st.retained(e, now(), 30).collect()] == [2, 3]
    assert [r.event_id for r in st.retained(e, now(), 365, rows=1).collect()] == [3]


def test_prefixes(spark):
    u = spark.createDataFrame([("http://A/x",), ("http://a/y",), ("http://b/",)], "canonical_url string")
    stay, gone = st.delete_by_prefix(u, ["http://a/x", "http://a"])
    assert [r.canonical_url for r in stay.collect()] == ["http://b/"]
    assert {(r.prefix, r.deleted) for r in gone.collect()} == {("http://a/x", 1), ("http://a", 1)}


def test_frontier(spark):
    spark.sparkContext.setCheckpointDir(stream.shared_folder(spark))
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "r"), ("b", "c"), ("z", "y")], "source string, target string")
    got = st.crawl_frontier(None, spark.createDataFrame([("r",)], "url string"), links)
    assert {(r.url, r.depth) for r in got.collect()} == {("r", 0), ("a", 1), ("b", 2), ("c", 3)}


def _write(spark, folder, name, rows):
    spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.parquet(f"{folder}/{name}")


def test_state_machine(spark, tmp_path):
    h = timedelta(hours=1)
    rows = [(1, NOW, 7, "error", 0.0, ""), (2, NOW + h, 7, "error", 0.0, ""), (2, NOW + h, 7, "error", 0.0, ""), (3, NOW, 8, "view", 0.0, ""), (4, NOW, 9, "signup", 0.0, "")]
    spark.createDataFrame(rows, stream.EVENTS).write.parquet(f"file://{tmp_path}/log")
    machine = stream.url_state_machine(stream.event_stream(spark, f"file://{tmp_path}/log"))
    got = {r.canonical_url: r for r in stream.drained(machine, "update").collect()}
    assert (got[7].last_status, got[7].retry_count) == ("failed", 2)
    assert pd.Timestamp(got[7].next_due_at) == pd.Timestamp(NOW + 3 * h)
    assert (got[8].last_status, got[8].retry_count) == ("success", 0)
    assert got[9].last_status == "pending"


def test_stream_equals_batch(spark):
    folder = "/root/testdata/sf0.001"
    from quillspark.plans.state_queries import event_history_buckets, streaming_event_buckets

    a, b = (sorted(map(tuple, f(spark, folder).collect())) for f in (event_history_buckets, streaming_event_buckets))
    assert a == b and a
