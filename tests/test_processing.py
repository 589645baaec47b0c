import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from quillspark.operators import processing as pr
from quillspark.operators.parallel import spread
from quillspark.sources import files, segments

NOW = dt.datetime(2024, 6, 1)
ROW = "canonical_url string, last_status string, last_fetched_at timestamp_ntz, next_due_at timestamp_ntz, retry_count int, allowed boolean, page string, from_cache boolean, error string, failure_reason string, lastmod timestamp_ntz"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_each_outcome(spark):
    hour, day = dt.timedelta(hours=1), dt.timedelta(days=1)
    rows = [
        ("gone", "success", NOW - hour, NOW, 0, False, "p", False, None, None, None),
        ("lately", "success", NOW - hour, NOW + day, 0, True, "p", False, None, None, None),
        ("fetched", "failed", NOW - 3 * day, NOW, 4, True, "p", False, None, None, NOW - day),
        ("cached", None, None, None, None, True, "p", True, None, None, None),
        ("lost", "failed", None, NOW, 2, True, None, False, None, "http_404", None),
        ("broken", "success", NOW - 9 * day, NOW, 0, True, None, False, "TimeoutError", None, None),
    ]
    after, events = pr.process(spark.createDataFrame(rows, ROW), now())
    got = {r.canonical_url: r for r in after.collect()}
    assert set(got) == {"lately", "fetched", "cached", "lost", "broken"}
    assert got["lately"].last_fetched_at == NOW - hour and got["lately"].next_due_at == NOW + day
    assert (got["fetched"].last_status, got["fetched"].retry_count, got["fetched"].next_due_at) == ("success", 0, NOW + day)
    assert (got["cached"].last_status, got["cached"].next_due_at) == ("success", NOW + 7 * day)
    assert (got["lost"].retry_count, got["lost"].next_due_at, got["lost"].last_failure_reason) == (3, NOW + 4 * hour, "http_404")
    assert (got["broken"].retry_count, got["broken"].next_due_at, got["broken"].last_failure_reason) == (1, NOW + hour, "TimeoutError")
    told = sorted((r.canonical_url, r.event_type, r.status, r.reason) for r in events.collect())
    assert ("gone", "skip_filtered", "ok", "filtered_by_rules") in told and len(told) == 11
    assert ("lately", "skip_recent", "ok", "recently_fetched") in told and ("broken", "process_error", "failed", "TimeoutError") in told


def test_events_are_appended(spark):
    folder = f"{segments.shared_folder(spark)}/events-{uuid.uuid4().hex}"
    e = spark.createDataFrame([("a", NOW, "cache_hit")], "canonical_url string, event_at timestamp_ntz, event_type string")
    pr.append_events(e, folder)
    pr.append_events(e, folder)
    log = spark.read.parquet(folder)
    assert log.count() == 2
    r = pr.apply_events(spark.createDataFrame([], "canonical_url string, last_status string, last_event_at timestamp_ntz, cache_hit_count bigint"), log).first()
    assert (r.last_status, r.cache_hit_count) == ("pending", 2)


def test_maps_and_provenance(spark):
    one = spark.range(1)
    m = one.select(pr.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")).first().m
    assert m == {"a": 1, "b": 3}
    cases = [(" known ", "2024-01-01T00:00:00Z", None, "known", None), ("known", "soon", "2024-01-01T00:00:00Z", "partial", "scheduler_summary_unbound"), ("odd", "2024-01-01T00:00:00Z", None, "unknown", None), (None, None, None, "unknown", None)]
    rows = spark.createDataFrame([c[:3] for c in cases], "s string, u string, l string").select(pr.provenance(F.col("s"), F.col("u"), F.col("l")).alias("p")).collect()
    assert [(r.p.state, r.p.evidence) for r in rows] == [c[3:] for c in cases]


def test_bloom_bits_are_md5s(spark):
    import hashlib

    bits, hashes = pr.bloom_size(100_000, 0.01)
    assert (bits, hashes) == (958505, 6)
    got = spark.createDataFrame([("word",), ("é",)], "w string").select("w", pr.bloom_places(F.col("w"), bits, hashes).alias("b")).collect()
    for r in got:
        assert list(r.b) == [int(hashlib.md5(f"{r.w}{s}".encode()).hexdigest(), 16) % bits for s in range(hashes)]
    with pytest.raises(ValueError):
        pr.bloom_places(F.lit("x"), 1 << 40, 1)


def test_blocked_pages(spark):
    pages = [(200, "ok", False), (503, None, True), (404, "x", False), (None, "Our systems have detected UNUSUAL traffic", True), (200, "<title>Sorry</title>", False), (200, "reCAPTCHA: automated queries", True), (200, "captcha", False), (200, "x" * 9000 + "google.com/sorry", False)]
    rows = spark.createDataFrame([p[:2] for p in pages], "s int, b string").select(files.blocked(F.col("s"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [p[2] for p in pages]


def test_small_inputs_are_spread(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id")
    assert spread(small).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    old = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    assert spread(small)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 0
    spark.conf.set("spark.sql.files.openCostInBytes", old)
