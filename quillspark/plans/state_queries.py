"""Queries over the event log, crawl state, queue and schedules.

``events`` is the log (errors count as failed), and each user stands for a url.
Orders stand for a queue: customers' orders by priority and date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import ranking
from quillspark.operators import records as rec
from quillspark.operators import state as st
from quillspark.streaming import events as stream

_NOW = "2024-06-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _now():
    return F.lit(_NOW).cast("timestamp_ntz")


_TYPES = (("view", "fetch_success"), ("click", "cache_hit"), ("signup", "crawl_discovered"), ("purchase", "fetch_success"), ("error", "fetch_failure"))


def _events(spark, sf_dir):
    kind = F.lit(None).cast("string")
    for old, new in _TYPES:
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    return _read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("event_at"), F.col("user_id").alias("canonical_url"), kind.alias("event_type"), status.alias("status"), "value", "props")


def _urls(spark, sf_dir):
    """A url table from the log: each user's newest event decides."""
    e = _events(spark, sf_dir)
    s = st.latest_state(e)
    status = F.when(F.col("last_status") == "failed", "failed").when(F.col("canonical_url") % 5 == 0, "pending").otherwise("success")
    c = st.url_counters(e).select("canonical_url", "first_seen", "failure_count")
    due = st.next_due(F.col("last_at"), F.when(F.col("canonical_url") % 3 == 0, F.col("first_seen")))
    failed_at = F.when((status == "failed") & (F.col("canonical_url") % 7 != 0), F.col("last_at"))
    return s.join(c, "canonical_url").select("canonical_url", F.concat(F.lit("u"), F.col("canonical_url").cast("string")).alias("url"), status.alias("last_status"), F.col("first_seen").alias("first_seen_at"), F.col("last_at").alias("last_fetched_at"), due.alias("next_due_at"), failed_at.alias("last_failure_at"), "failure_count")


def _queue(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    return o.filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("canonical_url"), F.col("o_orderkey").cast("string").alias("url"), F.col("o_orderdate").alias("enqueued_at"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.lit("order").alias("reason"))


def event_history_buckets(spark, sf_dir):
    return st.event_history(_events(spark, sf_dir), 3600)


def event_status_counts(spark, sf_dir):
    e = _events(spark, sf_dir)
    by = [st.counts_by(e, c).select(F.lit(c).alias("by"), F.col(c).alias("value"), "events") for c in ("status", "event_type")]
    return by[0].unionAll(by[1])


def event_log(spark, sf_dir):
    return st.event_log(_events(spark, sf_dir), ["fetch_failure", "cache_hit"], None, 50).select("event_id", "event_at", "event_type", "status")


def event_detail(spark, sf_dir):
    """A number out of each event's JSON detail, where it has one."""
    e = _events(spark, sf_dir)
    return e.select("event_id", F.size(F.coalesce(F.json_object_keys("props"), F.array())).alias("keys"))


def url_counters(spark, sf_dir):
    return st.url_counters(_events(spark, sf_dir))


def event_retention(spark, sf_dir):
    e = _events(spark, sf_dir)
    newest = e.agg(F.max("event_at").alias("m"))
    kept = st.retained(e.crossJoin(newest), F.col("m"), days=7, rows=2000)  # one row
    return kept.select("event_id", "event_at")


def status_snapshot(spark, sf_dir):
    return st.status_snapshot(_urls(spark, sf_dir), _queue(spark, sf_dir), _now())


def scheduler_stats(spark, sf_dir):
    return st.scheduler_stats(_urls(spark, sf_dir).withColumn("last_failure_reason", F.lit("x")), _now(), 0).drop("failure_sample")


def due_sample(spark, sf_dir):
    return st.due_sample(_urls(spark, sf_dir), 25).select("canonical_url", "next_due_at")


def queue_dequeue(spark, sf_dir):
    batch, _ = st.dequeue(_queue(spark, sf_dir), 40)
    return batch.select("canonical_url", "priority", "enqueued_at")


def queue_rest(spark, sf_dir):
    _, rest = st.dequeue(_queue(spark, sf_dir), 40)
    return rest.groupBy("priority").agg(F.count("*").alias("waiting"))


def queue_enqueue(spark, sf_dir):
    q, u = _queue(spark, sf_dir), _urls(spark, sf_dir)
    new = q.select((F.col("canonical_url") % 400).alias("canonical_url"), F.lit("n").alias("url"), "enqueued_at", F.lit(9).alias("priority"), F.lit("new").alias("reason")).groupBy("canonical_url", "url", "priority", "reason").agg(F.min("enqueued_at").alias("enqueued_at"))
    plain = st.enqueue(q, u, new, _now()).select("canonical_url", "priority", "reason", F.lit(False).alias("force"))
    forced = st.enqueue(q, u, new, _now(), force=True).select("canonical_url", "priority", "reason", F.lit(True).alias("force"))
    return plain.unionAll(forced)


def requeue_failed(spark, sf_dir):
    return st.requeue_failed(_urls(spark, sf_dir), 30, now=_now()).select("canonical_url", "priority", "reason")


def upsert_merge(spark, sf_dir):
    c = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.filter("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"), F.lit("MERGED").alias("c_mktsegment"))
    return st.upsert(c, new, "c_custkey", keep_first=["c_mktsegment"], keep_if_null=["c_acctbal"])


def next_due(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    now = F.lit("1998-08-01 12:00:00").cast("timestamp_ntz")
    return o.select("o_orderkey", st.next_due(now, F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate"))).alias("due"))


def retry_backoff(spark, sf_dir):
    e = st.url_counters(_events(spark, sf_dir)).filter("failure_count > 0")
    return e.select("canonical_url", st.retry_at(F.col("last_event"), F.col("failure_count").cast("int")).alias("retry_at"), st.git_retry_seconds(F.col("failure_count").cast("int")).alias("git_seconds"))


def age_text(spark, sf_dir):
    e = _events(spark, sf_dir).crossJoin(_events(spark, sf_dir).agg(F.max("event_at").alias("m")))  # one row
    return e.select("event_id", st.age_text(F.col("m"), F.col("event_at")).alias("age"))


def cycle_plan(spark, sf_dir):
    u = _urls(spark, sf_dir)
    roots = spark.createDataFrame([("u1",), ("x1",), ("u2",)], "url string")
    found = u.filter("canonical_url % 4 = 0").select("url")
    return st.cycle_plan(roots, found, u, _now(), 24 * 30)


def delete_prefixes(spark, sf_dir):
    u = _urls(spark, sf_dir).withColumn("canonical_url", F.col("url"))
    _, counts = st.delete_by_prefix(u, ["U1", "u12", "u2"])
    return counts


def process_outcomes(spark, sf_dir):
    u = _urls(spark, sf_dir)
    key = F.col("canonical_url")
    rows = u.select("canonical_url", "last_status", "last_fetched_at", (key % 10 != 0).alias("allowed"), F.when(key % 6 != 0, "p").alias("page"), (key % 2 == 0).alias("from_cache"), F.when(key % 17 == 0, "e").alias("error"))
    return st.process_outcome(rows, _now(), 24 * 20).groupBy("outcome").agg(F.count("*").alias("urls"))


def freshness_state(spark, sf_dir):
    e = _events(spark, sf_dir)
    d = e.select("canonical_url", F.when(F.col("event_type") != "cache_hit", F.col("event_at")).alias("updated"), F.when(F.col("event_type") != "cache_hit", F.lit("log")).alias("evidence"))
    return rec.freshness(d, "canonical_url").select("canonical_url", "state", "updated")


def latency_histogram(spark, sf_dir):
    bounds = (5, 10, 25, 50, 100, 250, 500)  # fixed values: the buckets' upper bounds
    v = F.abs("value")
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(*(F.count_if(v <= b).alias(f"le_{b}") for b in bounds), F.count("value").alias("le_inf"))


def percentile_index(spark, sf_dir):
    v = F.collect_list("value")
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(ranking.percentile_by_index(v, 0.95).alias("p95"), ranking.percentile_by_index(v, 0.99).alias("p99"), F.max("value").alias("most"))


def source_snapshot(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.col("n_chars").alias("size"), F.col("doc_id").alias("modified"))
    return rec.snapshot(d, "source")


def streaming_event_buckets(spark, sf_dir):
    return stream.history_of_files(spark, f"{sf_dir}/events.parquet", 3600)


def streaming_url_state(spark, sf_dir):
    return stream.url_states_of_files(spark, f"{sf_dir}/events.parquet")


_KIND = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES) + " END"
_E = f"e AS (SELECT event_id, ts AS event_at, user_id AS canonical_url, {_KIND} AS event_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status, value FROM events)"
_C = "c AS (SELECT canonical_url, count(*) FILTER (event_type IN ('fetch_success', 'fetch_failure')) AS fetch_count, count(*) FILTER (event_type = 'cache_hit') AS cache_hit_count, count(*) FILTER (status = 'failed') AS failure_count, min(event_at) AS first_seen, max(event_at) AS last_event FROM e GROUP BY canonical_url)"


def _due(now, changed, default=7, most=30):
    days = f"floor((epoch({now}) - epoch({changed})) / 86400)"
    return f"({now} + to_days(CASE WHEN {changed} IS NULL THEN {default} WHEN {days} < 7 THEN 1 WHEN {days} < 30 THEN {default} ELSE {most} END))"


_FIRST3 = "(CASE WHEN canonical_url % 3 = 0 THEN first_seen END)"
_UU = f"""l AS (SELECT canonical_url, status AS newest, event_at AS last_at FROM (SELECT *, row_number() OVER (PARTITION BY canonical_url ORDER BY event_at DESC, event_id DESC) AS r FROM e) WHERE r = 1),
        u AS (SELECT canonical_url, 'u' || canonical_url AS url, CASE WHEN newest = 'failed' THEN 'failed' WHEN canonical_url % 5 = 0 THEN 'pending' ELSE 'success' END AS last_status, first_seen AS first_seen_at, last_at AS last_fetched_at, {_due('last_at', _FIRST3)} AS next_due_at, CASE WHEN newest = 'failed' AND canonical_url % 7 <> 0 THEN last_at END AS last_failure_at FROM l JOIN c USING (canonical_url))"""
_QQ = "qu AS (SELECT o_orderkey AS canonical_url, o_orderdate AS enqueued_at, o_orderpriority[1]::INTEGER AS priority FROM orders WHERE o_orderstatus = 'O')"
_TOP = "t AS (SELECT * FROM qu ORDER BY priority DESC, enqueued_at, canonical_url LIMIT 40)"
_N = f"TIMESTAMP '{_NOW}'"
_COUNTS = "count(*) AS total, count(*) FILTER (status <> 'failed') AS success, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (event_type = 'crawl_discovered') AS discovered, count(*) FILTER (event_type IN ('fetch_success', 'cache_hit')) AS fetched"
_HISTORY = f"WITH {_E} SELECT time_bucket(INTERVAL '3600 seconds', event_at) AS bucket, {_COUNTS} FROM e GROUP BY 1"

SQL = {
    "event_history_buckets": _HISTORY,
    "streaming_event_buckets": _HISTORY,
    "event_status_counts": f"WITH {_E} SELECT 'status' AS by, status AS value, count(*) AS events FROM e GROUP BY ALL UNION ALL SELECT 'event_type', event_type, count(*) FROM e GROUP BY ALL",
    "event_log": f"WITH {_E} SELECT event_id, event_at, event_type, status FROM e WHERE event_type IN ('fetch_failure', 'cache_hit') ORDER BY event_at DESC, event_id DESC LIMIT 50",
    "event_detail": "SELECT event_id, coalesce(len(json_keys(props)), 0)::INTEGER AS keys FROM events",
    "url_counters": f"WITH {_E}, {_C} SELECT * FROM c",
    "streaming_url_state": f"WITH {_E} SELECT canonical_url, count(*) AS events, count(*) FILTER (status = 'failed') AS failures, max(event_at) AS last_event FROM e GROUP BY canonical_url",
    "event_retention": f"WITH {_E} SELECT event_id, event_at FROM e WHERE event_at >= (SELECT max(event_at) FROM e) - INTERVAL 7 DAY ORDER BY event_at DESC, event_id DESC LIMIT 2000",
    "status_snapshot": f"WITH {_E}, {_C}, {_UU}, {_QQ} SELECT count(DISTINCT canonical_url) AS total, count(DISTINCT canonical_url) FILTER (last_status = 'success') AS success, count(DISTINCT canonical_url) FILTER (last_status = 'failed') AS failed, count(DISTINCT canonical_url) FILTER (last_status = 'pending') AS pending, count(*) FILTER (next_due_at <= {_N}) AS due, min(first_seen_at) AS first_seen_at, max(last_fetched_at) FILTER (last_status = 'success') AS last_success_at, (SELECT count(*) FROM qu) AS queue_depth FROM u",
    "scheduler_stats": f"WITH {_E}, {_C}, {_UU} SELECT count(*) AS total, count(*) FILTER (next_due_at <= {_N}) AS due, count(*) FILTER (last_status = 'success') AS success, count(*) FILTER (last_status = 'failed') AS failed, greatest(count(*) - count(*) FILTER (last_status = 'success'), 0) AS pending FROM u",
    "due_sample": f"WITH {_E}, {_C}, {_UU} SELECT canonical_url, next_due_at FROM u ORDER BY next_due_at, canonical_url LIMIT 25",
    "queue_dequeue": f"WITH {_QQ}, {_TOP} SELECT canonical_url, priority, enqueued_at FROM t",
    "queue_rest": f"WITH {_QQ}, {_TOP} SELECT priority, count(*) AS waiting FROM qu ANTI JOIN t USING (canonical_url) GROUP BY priority",
    "queue_enqueue": f"""WITH {_E}, {_C}, {_UU}, {_QQ}, n AS (SELECT DISTINCT canonical_url % 400 AS canonical_url FROM qu),
        busy AS (SELECT canonical_url FROM u WHERE last_status = 'success' AND next_due_at > {_N})
        SELECT canonical_url, priority, 'order' AS reason, false AS force FROM qu
        UNION ALL SELECT canonical_url, 9, 'new', false FROM n ANTI JOIN busy USING (canonical_url) ANTI JOIN qu USING (canonical_url)
        UNION ALL SELECT canonical_url, priority, 'order', true FROM qu ANTI JOIN n USING (canonical_url)
        UNION ALL SELECT n.canonical_url, greatest(9, coalesce(priority, 9)), 'new', true FROM n LEFT JOIN qu ON qu.canonical_url = n.canonical_url""",
    "requeue_failed": f"WITH {_E}, {_C}, {_UU} SELECT canonical_url, 5 AS priority, 'retry_failed' AS reason FROM u WHERE last_status = 'failed' ORDER BY last_failure_at DESC NULLS LAST, canonical_url LIMIT 30",
    "upsert_merge": "WITH c AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer), n AS (SELECT c_custkey * 2 AS c_custkey, 'new ' || c_name AS c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal FROM c WHERE c_custkey % 3 = 0) SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal, coalesce(c.c_mktsegment, 'MERGED') AS c_mktsegment FROM c FULL JOIN n ON c.c_custkey = n.c_custkey",
    "next_due": f"WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS changed, TIMESTAMP '1998-08-01 12:00:00' AS n FROM orders) SELECT o_orderkey, {_due('n', 'changed')} AS due FROM o",
    "retry_backoff": f"WITH {_E}, {_C} SELECT canonical_url, last_event + to_hours(least(pow(2, failure_count - 1), 720)::INTEGER) AS retry_at, least(60 * pow(2, failure_count - 1), 3600) AS git_seconds FROM c WHERE failure_count > 0",
    "age_text": f"WITH {_E}, a AS (SELECT event_id, floor(epoch((SELECT max(event_at) FROM e)))::BIGINT - floor(epoch(event_at))::BIGINT AS s FROM e) SELECT event_id, CASE WHEN s < 60 THEN 'now' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM a",
    "cycle_plan": f"WITH {_E}, {_C}, {_UU}, w AS (SELECT unnest(['u1', 'x1', 'u2']) AS url UNION SELECT url FROM u WHERE canonical_url % 4 = 0 UNION SELECT url FROM u WHERE next_due_at <= {_N}) SELECT url FROM w ANTI JOIN (SELECT url FROM u WHERE last_status = 'success' AND (epoch({_N}) - epoch(last_fetched_at)) / 3600 < 720) f USING (url)",
    "delete_prefixes": f"WITH {_E}, {_C}, {_UU}, m AS (SELECT CASE WHEN url LIKE 'u1%' THEN 'U1' WHEN url LIKE 'u2%' THEN 'u2' END AS prefix FROM u) SELECT prefix, count(*) AS deleted FROM m WHERE prefix IS NOT NULL GROUP BY prefix",
    "process_outcomes": f"WITH {_E}, {_C}, {_UU} SELECT CASE WHEN canonical_url % 10 = 0 THEN 'skip_filtered' WHEN last_status = 'success' AND (epoch({_N}) - epoch(last_fetched_at)) / 3600 < 480 THEN 'skip_recent' WHEN canonical_url % 17 = 0 THEN 'process_error' WHEN canonical_url % 6 = 0 THEN 'fetch_failure' WHEN canonical_url % 2 = 0 THEN 'cache_hit' ELSE 'fetch_success' END AS outcome, count(*) AS urls FROM u GROUP BY 1",
    "freshness_state": f"WITH {_E} SELECT canonical_url, CASE WHEN count(*) = count(*) FILTER (event_type <> 'cache_hit') THEN 'known' WHEN count(*) FILTER (event_type <> 'cache_hit') > 0 THEN 'partial' ELSE 'unknown' END AS state, max(event_at) FILTER (event_type <> 'cache_hit') AS updated FROM e GROUP BY canonical_url",
    "latency_histogram": "SELECT event_type, " + ", ".join(f"count(*) FILTER (abs(value) <= {b}) AS le_{b}" for b in (5, 10, 25, 50, 100, 250, 500)) + ", count(value) AS le_inf FROM events GROUP BY event_type",
    "percentile_index": "WITH s AS (SELECT event_type, list_sort(list(value)) AS v, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, v[least(floor(len(v) * 0.95)::INTEGER, len(v) - 1) + 1] AS p95, v[least(floor(len(v) * 0.99)::INTEGER, len(v) - 1) + 1] AS p99, most FROM s",
    "source_snapshot": "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS bytes, max(doc_id) AS newest, max(doc_id)::VARCHAR AS newest_path, sha256(array_to_string(list_sort(list(doc_id || chr(9) || n_chars || chr(9) || doc_id)), chr(10))) AS signature FROM documents GROUP BY source",
}

NAMES = ("event_history_buckets", "event_status_counts", "event_log", "event_detail", "url_counters", "event_retention", "status_snapshot", "scheduler_stats", "due_sample", "queue_dequeue", "queue_rest", "queue_enqueue", "requeue_failed", "upsert_merge", "next_due", "retry_backoff", "age_text", "cycle_plan", "delete_prefixes", "process_outcomes", "freshness_state", "latency_histogram", "percentile_index", "source_snapshot", "streaming_event_buckets", "streaming_url_state")
FUNCTIONS = {n: globals()[n] for n in NAMES}
