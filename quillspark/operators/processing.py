"""What a crawl's steps do to the tables of urls, events, documents and stored values.

Every step takes tables and gives new ones; the time ``now`` is a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import urls as url_functions
from quillspark.operators.state import next_due, process_outcome, retry_at

EVENT = "canonical_url, event_at, event_type, status, reason"


def process(rows: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(urls, events) after each url of a cycle is processed.

    ``rows``: a url's state (canonical_url, last_status, last_fetched_at, next_due_at, retry_count)
    beside what came of it (allowed, page, from_cache, error, failure_reason, lastmod).
    What isn't allowed goes; what was fetched lately stays as it is; a page resets
    retries and is due by its age; a failure doubles the wait.
    """
    done = process_outcome(rows, now, hours)
    came = F.col("outcome").isin("cache_hit", "fetch_success")
    failed = F.col("outcome").isin("fetch_failure", "process_error")
    retries = F.when(came, 0).when(failed, F.coalesce("retry_count", F.lit(0)) + 1).otherwise(F.col("retry_count")).cast("int")
    due = F.when(came, next_due(now, F.col("lastmod"))).when(failed, retry_at(now, retries)).otherwise(F.col("next_due_at"))
    why = F.when(F.col("outcome") == "process_error", F.col("error")).when(F.col("outcome") == "fetch_failure", F.coalesce("failure_reason", F.lit("PageFetchFailed")))
    after = done.filter("outcome <> 'skip_filtered'").select(
        "canonical_url",
        F.when(came, "success").when(failed, "failed").otherwise(F.col("last_status")).alias("last_status"),
        F.when(came, now).otherwise(F.col("last_fetched_at")).alias("last_fetched_at"),
        due.alias("next_due_at"),
        retries.alias("retry_count"),
        why.alias("last_failure_reason"),
    )

    def event(kind, status, reason):
        return F.struct(kind.alias("event_type"), status.alias("status"), reason.alias("reason"))

    start = event(F.lit("process_start"), F.lit("ok"), F.lit(None).cast("string"))
    reason = F.when(F.col("outcome") == "skip_filtered", "filtered_by_rules").when(F.col("outcome") == "skip_recent", "recently_fetched").otherwise(why)
    end = event(F.col("outcome"), F.when(failed, "failed").otherwise("ok"), reason)
    every = F.explode(F.when(F.col("outcome") == "skip_filtered", F.array(end)).otherwise(F.array(start, end)))
    events = done.select("canonical_url", now.alias("event_at"), every.alias("e")).select("canonical_url", "event_at", "e.*")
    return after, events


def append_events(events: DataFrame, folder: str) -> None:
    """Events are added as they come, repeats too: a log of what happened."""
    events.write.mode("append").parquet(folder)


def apply_events(urls: DataFrame, events: DataFrame) -> DataFrame:
    """(canonical_url, last_status, last_event_at, cache_hit_count): urls after events; unknown ones enter as pending."""
    counts = events.filter("canonical_url IS NOT NULL").groupBy("canonical_url").agg(F.max("event_at").alias("at"), F.count_if(F.col("event_type") == "cache_hit").alias("hits"))
    joined = urls.select("canonical_url", "last_status", "last_event_at", "cache_hit_count").join(counts, "canonical_url", "full")
    return joined.select(
        "canonical_url",
        F.coalesce("last_status", F.lit("pending")).alias("last_status"),
        F.coalesce("at", "last_event_at").alias("last_event_at"),
        (F.coalesce("cache_hit_count", F.lit(0)) + F.coalesce("hits", F.lit(0))).alias("cache_hit_count"),
    )


def mark_failed(urls: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """``urls`` with those of ``failed(canonical_url, reason)`` as failed, due after a doubled wait."""
    each = failed.groupBy("canonical_url").agg(F.min("reason").alias("reason"), F.lit(True).alias("hit"))
    retries = F.coalesce("retry_count", F.lit(0)) + 1
    joined = urls.join(each, "canonical_url", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    changed = {"last_status": F.lit("failed"), "retry_count": retries.cast("int"), "next_due_at": retry_at(now, retries), "last_failure_reason": F.col("reason")}
    return joined.select(*(F.when(F.col("hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in urls.columns))


def sweep(rows: DataFrame, allowed: Column) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes): documents, metadata or urls that the rules no longer allow."""
    ok = F.coalesce(allowed, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def swept_folders(files: DataFrame, prefixes: Sequence[str], path: str = "path") -> DataFrame:
    """Files below the folder of a blacklisted url prefix: the path where its documents are stored."""
    if not prefixes:
        return files.limit(0)
    asked = files.sparkSession.createDataFrame([(p,) for p in prefixes], "prefix string")  # the rules, a row each
    folder = F.regexp_replace(url_functions.markdown_path(F.col("prefix")), r"(/index)?\.md$", "")
    rules = asked.select(F.concat(folder, F.lit("/")).alias("__folder"))
    return files.join(F.broadcast(rules), F.startswith(F.col(path), F.col("__folder")), "left_semi")


def resolve_entries(entries: DataFrame, probes: DataFrame, allowed) -> DataFrame:
    """(url): where entry urls lead.  ``probes(url, final_url, blocked)``: what asking for each gave.

    A url that wasn't reached, or whose probe was turned away, stands for itself.  Only
    urls that ``allowed(column)`` lets pass remain.
    """
    reached = probes.filter(~F.coalesce("blocked", F.lit(False)) & F.col("final_url").isNotNull()).groupBy("url").agg(F.min("final_url").alias("final_url"))
    found = entries.select("url").join(reached, "url", "left").select(F.coalesce("final_url", "url").alias("url"))
    return found.filter(allowed(F.col("url"))).distinct()


def put_values(store: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, key, value, at): stored values after newer ones; the last of a key wins, ties by value."""
    every = store.select("kind", "key", "value", "at").unionByName(new.select("kind", "key", "value", "at"))
    last = every.groupBy("kind", "key").agg(F.max_by(F.struct("value", "at"), F.struct("at", "value")).alias("v"))
    return last.select("kind", "key", "v.value", "v.at")


def unchanged(now: DataFrame, before: DataFrame, group: str) -> DataFrame:
    """(group, status): snapshots against earlier ones by signature: unchanged, changed, new or gone."""
    both = now.select(group, F.col("signature").alias("a")).join(before.select(group, F.col("signature").alias("b")), group, "full")
    status = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return both.select(group, status.alias("status"))


def with_lastmod(queue: DataFrame, entries: DataFrame) -> DataFrame:
    """``queue`` with ``lastmod`` of its url in a sitemap's ``entries(url, lastmod, nth)``; a url's last entry wins."""
    last = entries.groupBy("url").agg(F.max_by("lastmod", "nth").alias("lastmod"))
    return queue.join(last, "url", "left")


def cleanup_summary(files: DataFrame, gone: Column) -> DataFrame:
    """One row: files and bytes that go, and that stay."""
    size = F.coalesce("size", F.lit(0))
    return files.agg(
        F.count_if(gone).alias("deleted_files"),
        F.coalesce(F.sum(F.when(gone, size)), F.lit(0)).alias("deleted_bytes"),
        F.count_if(~gone).alias("kept_files"),
        F.coalesce(F.sum(F.when(~gone, size)), F.lit(0)).alias("kept_bytes"),
    )


def schedule_gap(runs: DataFrame, group: str, now: Column, at: str = "at", default: float = 24.0) -> DataFrame:
    """(group, hours): between the next run after ``now`` and the one behind it; an hour at least, a day where there are none."""
    later = F.when(F.col(at) > now, F.unix_timestamp(F.col(at)))
    first = runs.groupBy(group).agg(F.min(later).alias("first"))
    second = runs.join(first, group).groupBy(group, "first").agg(F.min(F.when(F.unix_timestamp(F.col(at)) > F.col("first"), F.unix_timestamp(F.col(at)))).alias("second"))
    return second.select(group, F.coalesce(F.greatest((F.col("second") - F.col("first")) / 3600, F.lit(1.0)), F.lit(default)).alias("hours"))


def newest_first(tenants: DataFrame, last_event: Column) -> DataFrame:
    """Tenants without any event first, then by their last event, the newest first."""
    return tenants.orderBy(last_event.isNotNull(), last_event.desc(), "codename")


def search_metrics(searches: DataFrame, group: str, window: int = 1000, slow_ms: float = 10.0) -> DataFrame:
    """Per group over its last ``window`` searches (latency_ms, results, at, id): mean, p95 and p99 by
    index, the most; and over all of them the rates of slow and of empty ones."""
    totals = searches.groupBy(group).agg(F.count("*").alias("searches"), F.avg((F.col("latency_ms") > slow_ms).cast("double")).alias("slow_rate"), F.avg((F.col("results") == 0).cast("double")).alias("empty_rate"))
    newest = Window.partitionBy(group).orderBy(F.desc("at"), F.desc("id"))
    held = searches.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= window)
    # At most ``window`` values a group.
    values = F.array_sort(F.collect_list("latency_ms"))

    def at(share):
        return F.get(F.col("v"), F.floor(F.size("v") * share).cast("int"))

    found = held.groupBy(group).agg(values.alias("v"), F.avg("latency_ms").alias("mean"))
    return found.select(group, F.size("v").alias("held"), "mean", at(0.95).alias("p95"), at(0.99).alias("p99"), F.array_max("v").alias("most")).join(totals, group)


def bloom_size(items: int, rate: float) -> tuple[int, int]:
    """Bits of a Bloom filter, and hashes of an item."""
    bits = int(-items * math.log(rate) / math.log(2) ** 2)
    return bits, int(bits / items * math.log(2))


def bloom_places(item: Column, bits: int, hashes: int) -> Column:
    """The bits of an item: MD5 of the item and a seed, as one number, modulo ``bits`` (below 2^30)."""
    if not 0 < bits < 1 << 30:
        raise ValueError("a filter has 1 to 2^30 - 1 bits")

    def place(seed: Column) -> Column:
        digest = F.md5(F.encode(F.concat(item, seed.cast("string")), "utf-8"))
        parts = F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(8)), lambda i: F.conv(F.substring(digest, i, F.lit(8)), 16, 10).cast("bigint"))
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda rest, part: (rest * (1 << 32) + part) % bits)

    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), place)


def merged(first: Column, second: Column) -> Column:
    """Both maps in one; the second's value where a key is in both."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def provenance(state: Column, updated_at: Column, legacy_at: Column) -> Column:
    """struct(state, updated_at, evidence): known and partial need a time; else an old scheduler's time makes it partial."""
    named = F.trim(F.coalesce(state, F.lit("")))
    at, old = F.try_to_timestamp(updated_at), F.try_to_timestamp(legacy_at)
    sure = named.isin("known", "partial") & at.isNotNull()
    return F.struct(
        F.when(sure, named).when(old.isNotNull(), "partial").otherwise("unknown").alias("state"),
        F.when(sure, at).otherwise(old).alias("updated_at"),
        F.when(~sure & old.isNotNull(), "scheduler_summary_unbound").alias("evidence"),
    )
