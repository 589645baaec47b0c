"""Crawl state as tables: urls, queue and the event log, and what is computed of them.

Every change is a function from tables to a new table; a time ``now`` is a parameter,
so results repeat.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days events are kept, and how many at most.
EVENT_DAYS, EVENT_ROWS = 49, 200_000
FETCHED = ("fetch_success", "cache_hit")


# --- Event log ---------------------------------------------------------------------------------


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def bucket_counts() -> list[Column]:
    """The counters of a bucket of events: anything that isn't failed is a success."""
    return [
        F.count("*").alias("total"),
        _count((F.col("status") != "failed") | F.col("status").isNull()).alias("success"),
        _count(F.col("status") == "failed").alias("failed"),
        _count(F.col("event_type") == "crawl_discovered").alias("discovered"),
        _count(F.col("event_type").isin(*FETCHED)).alias("fetched"),
    ]


def event_history(events: DataFrame, seconds: int = 60, since: Column | None = None, limit: int | None = None, time: str = "event_at") -> DataFrame:
    """(bucket, total, success, failed, discovered, fetched): tumbling windows; empty ones are left out.

    ``limit`` takes the oldest events first, as a bound on what a report looks at.
    """
    rows = events.filter(F.col(time).isNotNull())
    if since is not None:
        rows = rows.filter(F.col(time) >= since)
    if limit is not None:
        rows = rows.orderBy(time).limit(limit)
    return rows.groupBy(F.window(time, f"{seconds} seconds").alias("w")).agg(*bucket_counts()).select(F.col("w.start").alias("bucket"), "total", "success", "failed", "discovered", "fetched")


def counts_by(events: DataFrame, column: str) -> DataFrame:
    return events.groupBy(column).agg(F.count("*").alias("events"))


def event_log(events: DataFrame, types: Sequence[str] = (), status: str | None = None, limit: int = 100, time: str = "event_at") -> DataFrame:
    """The newest events of some types and status; 1 to 1000 of them."""
    rows = events
    if types:
        rows = rows.filter(F.col("event_type").isin(*types))
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc(time), F.desc("event_id")).limit(max(1, min(limit, 1000)))


def retained(events: DataFrame, now: Column, days: int = EVENT_DAYS, rows: int = EVENT_ROWS, time: str = "event_at") -> DataFrame:
    """Events of the last ``days``, and of those the newest ``rows``.

    The bound is found as a time by a top-k, so no window over all events is needed.
    """
    kept = events.filter(F.col(time) >= now - F.make_dt_interval(F.lit(days)))
    newest = kept.select(F.col(time).alias("__t"), F.col("event_id").alias("__id")).orderBy(F.desc("__t"), F.desc("__id")).limit(rows)
    bound = newest.agg(F.min(F.struct("__t", "__id")).alias("__least"))
    return kept.crossJoin(bound).filter(F.struct(F.col(time).alias("__t"), F.col("event_id").alias("__id")) >= F.col("__least")).drop("__least")  # one row


def url_counters(events: DataFrame, key: str = "canonical_url", time: str = "event_at") -> DataFrame:
    """(key, fetch_count, cache_hit_count, failure_count, first_seen, last_event)."""
    return events.groupBy(key).agg(
        _count(F.col("event_type").isin("fetch_success", "fetch_failure")).alias("fetch_count"),
        _count(F.col("event_type") == "cache_hit").alias("cache_hit_count"),
        _count(F.col("status") == "failed").alias("failure_count"),
        F.min(time).alias("first_seen"),
        F.max(time).alias("last_event"),
    )


def latest_state(events: DataFrame, key: str = "canonical_url", time: str = "event_at") -> DataFrame:
    """(key, last_status, last_at): each url's state after its newest event."""
    newest = F.max_by(F.struct("status", F.col(time).alias("at")), F.struct(time, "event_id"))
    return events.groupBy(key).agg(newest.alias("s")).select(key, F.col("s.status").alias("last_status"), F.col("s.at").alias("last_at"))


# --- Status ------------------------------------------------------------------------------------


def status_snapshot(urls: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """One row: totals by status, due urls, queue depth, first and last times.  Due counts rows, the rest urls."""
    url = F.col("canonical_url")

    def distinct(condition: Column) -> Column:
        return F.count_distinct(F.when(condition, url))

    of_urls = urls.agg(
        F.count_distinct(url).alias("total"),
        distinct(F.col("last_status") == "success").alias("success"),
        distinct(F.col("last_status") == "failed").alias("failed"),
        distinct(F.col("last_status").isin("pending", "processing")).alias("pending"),
        _count(F.col("next_due_at") <= now).alias("due"),
        F.min("first_seen_at").alias("first_seen_at"),
        F.max(F.when(F.col("last_status") == "success", F.col("last_fetched_at"))).alias("last_success_at"),
    )
    return of_urls.crossJoin(queue.agg(F.count("*").alias("queue_depth")))  # two rows of one


def scheduler_stats(urls: DataFrame, now: Column, sample: int = 5) -> DataFrame:
    """One row: the scheduler's own count, where pending is all that isn't a success."""
    counts = urls.agg(
        F.count("*").alias("total"),
        _count(F.col("next_due_at") <= now).alias("due"),
        _count(F.col("last_status") == "success").alias("success"),
        _count(F.col("last_status") == "failed").alias("failed"),
    ).withColumn("pending", F.greatest(F.col("total") - F.col("success"), F.lit(0)))
    if not sample:
        return counts.withColumn("failure_sample", F.lit(None))
    # The first few only: a top-k, whatever the number of failures.
    some = urls.filter("last_status = 'failed'").select("url", "last_failure_reason").orderBy("url", "last_failure_reason").limit(sample)
    return counts.crossJoin(some.agg(F.array_sort(F.collect_list(F.struct("url", "last_failure_reason"))).alias("failure_sample")))  # one row


def due_sample(urls: DataFrame, n: int = 5) -> DataFrame:
    return urls.orderBy(F.asc_nulls_last("next_due_at"), "canonical_url").limit(max(n, 0))


def due_urls(urls: DataFrame, now: Column) -> DataFrame:
    """Urls whose due time, as text, has come; what can't be read isn't due."""
    return urls.filter(F.try_to_timestamp(F.col("next_due_at").cast("string")) <= now)


def fresh(urls: DataFrame, now: Column, hours: Column) -> DataFrame:
    """Successes younger than ``hours``."""
    age = (F.unix_timestamp(now) - F.unix_timestamp("last_fetched_at")) / 3600
    return urls.filter((F.col("last_status") == "success") & (age < hours))


# --- Changes -----------------------------------------------------------------------------------


def upsert(old: DataFrame, new: DataFrame, key: str, keep_first: Sequence[str] = (), keep_if_null: Sequence[str] = ()) -> DataFrame:
    """Rows of both; where a key is in both, the new values.

    ``keep_first`` columns stay as they were; ``keep_if_null`` ones stay where the new
    value is null.  One full join on the key.
    """
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, came = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def merged(c: str) -> Column:
        before, after = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c == key:
            return F.coalesce(after, before).alias(c)
        if c in keep_first:
            return F.when(there, before).otherwise(after).alias(c)
        if c in keep_if_null:
            return F.coalesce(after, before).alias(c)
        return F.when(came, after).otherwise(before).alias(c)

    return joined.select(*(merged(c) for c in old.columns))


def enqueue(queue: DataFrame, urls: DataFrame, new: DataFrame, now: Column, force: bool = False) -> DataFrame:
    """The queue after ``new(canonical_url, url, enqueued_at, priority, reason)`` is added.

    Urls that are there stay as they are; forced ones are replaced with the larger
    priority.  Unless forced, successes that aren't due yet don't enter.
    """
    columns = ["canonical_url", "url", "enqueued_at", "priority", "reason"]
    order = Window.partitionBy("canonical_url").orderBy(F.desc("priority"), "url")
    new = new.withColumn("__n", F.row_number().over(order)).filter("__n = 1").select(*columns)
    if not force:
        settled = urls.filter((F.col("last_status") == "success") & (F.col("next_due_at") > now))
        new = new.join(settled, "canonical_url", "left_anti").join(queue, "canonical_url", "left_anti")
        return queue.select(*columns).unionByName(new)
    old = queue.select("canonical_url", F.col("priority").alias("__old"))
    entered = new.join(old, "canonical_url", "left").withColumn("priority", F.greatest("priority", F.coalesce("__old", "priority"))).select(*columns)
    return queue.join(new, "canonical_url", "left_anti").select(*columns).unionByName(entered)


def dequeue(queue: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(the next n, the rest): larger priority first, then older, then by url."""
    batch = queue.orderBy(F.desc("priority"), "enqueued_at", "canonical_url").limit(max(n, 0))
    return batch, queue.join(batch.select("canonical_url"), "canonical_url", "left_anti")


def requeue_failed(urls: DataFrame, n: int | None = None, priority: int = 5, reason: str = "retry_failed", now: Column | None = None) -> DataFrame:
    """Queue rows for failed urls, the newest failures first."""
    rows = urls.filter("last_status = 'failed'")
    if n is not None:
        rows = rows.orderBy(F.desc_nulls_last("last_failure_at"), "canonical_url").limit(max(n, 0))
    at = F.current_timestamp() if now is None else now
    return rows.select("canonical_url", "url", at.alias("enqueued_at"), F.lit(priority).alias("priority"), F.lit(reason).alias("reason"))


def delete_by_prefix(urls: DataFrame, prefixes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, (prefix, deleted)): a url counts for the first prefix that it begins with, in any case."""
    first = F.lit(None).cast("string")
    for p in reversed(prefixes):
        first = F.when(F.startswith(F.lower("canonical_url"), F.lit(p.lower())), p).otherwise(first)
    marked = urls.withColumn("__prefix", first)
    return marked.filter("__prefix IS NULL").drop("__prefix"), marked.filter("__prefix IS NOT NULL").groupBy(F.col("__prefix").alias("prefix")).agg(F.count("*").alias("deleted"))


# --- Times -------------------------------------------------------------------------------------


def next_due(now: Column, changed: Column, default_days: int = 7, most_days: int = 30) -> Column:
    """A day for what changed within a week, the default within a month or when unknown, else the most."""
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(changed)) / 86400)
    days = F.when(changed.isNull(), default_days).when(age < 7, 1).when(age < 30, default_days).otherwise(most_days)
    return now + F.make_dt_interval(days.cast("int"))


def retry_at(failed: Column, retries: Column, most_days: int = 30) -> Column:
    """2^(n-1) hours after the n-th failure, at most ``most_days``."""
    hours = F.least(F.pow(F.lit(2.0), F.least(retries, F.lit(40)) - 1), F.lit(float(max(1, most_days * 24))))
    return failed + F.make_dt_interval(F.lit(0), hours.cast("int"))


def git_retry_seconds(failures: Column) -> Column:
    return F.least(60 * F.pow(F.lit(2.0), F.least(failures, F.lit(30)) - 1), F.lit(3600.0))


def age_text(now: Column, then: Column) -> Column:
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    return F.when(then.isNull(), "unknown").when(s < 60, "now").when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"))).when(s < 86400, F.concat(F.floor(s / 3600).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(s / 86400).cast("string"), F.lit("d")))


# --- Planning a cycle --------------------------------------------------------------------------


def cycle_plan(roots: DataFrame, discovered: DataFrame, urls: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """(url): roots, discovered and due urls, without those fetched lately."""
    due = urls.filter(F.col("next_due_at") <= now).select("url")
    wanted = roots.select("url").unionAll(discovered.select("url")).unionAll(due).distinct()
    return wanted.join(fresh(urls, now, F.lit(hours)).select("url"), "url", "left_anti")


def process_outcome(rows: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows with ``outcome``: what processing each url comes to.

    Columns: allowed, last_status, last_fetched_at, page (null: none came), from_cache, error.
    """
    lately = (F.col("last_status") == "success") & ((F.unix_timestamp(now) - F.unix_timestamp("last_fetched_at")) / 3600 < hours)
    outcome = F.when(~F.col("allowed"), "skip_filtered").when(F.coalesce(lately, F.lit(False)), "skip_recent").when(F.col("error").isNotNull(), "process_error").when(F.col("page").isNull(), "fetch_failure").when(F.col("from_cache"), "cache_hit").otherwise("fetch_success")
    return rows.withColumn("outcome", outcome)


def crawl_needed(entry_mode: Column, enabled: Column, force: Column, tracked: Column, cached: Column, filtered: Column) -> Column:
    return ~entry_mode & enabled & (force | (tracked == 0) | (cached <= filtered))


def crawl_frontier(pages: DataFrame, roots: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(url, depth): what is reached from the roots over ``links(source, target)``, breadth first.

    Each round joins the frontier to the links and takes away what was visited; its new
    urls alone are written out.  It ends when a round finds none, or after ``most`` rounds.
    """
    rounds = [roots.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()]
    while most is None or len(rounds) <= most:
        seen = reduce(DataFrame.unionAll, rounds)
        after = rounds[-1].join(links, F.col("url") == F.col("source")).select(F.col("target").alias("url")).distinct()
        after = after.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(len(rounds))).checkpoint()
        if after.isEmpty():
            break
        rounds.append(after)
    found = reduce(DataFrame.unionAll, rounds)
    return found.join(pages.select("url").distinct(), "url", "left_semi") if pages is not None else found
