"""The event log as a stream: windowed history, and a state for each url.

Both run as Structured Streaming queries from a file source; ``availableNow`` drains
what is there and ends, so the same code serves a batch-like catch-up and a live log.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.operators.state import bucket_counts
from quillspark.sources.segments import shared_folder

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
# What the raw log's types are called in the crawl log.
KINDS = {"view": "fetch_success", "click": "cache_hit", "signup": "crawl_discovered", "purchase": "fetch_success", "error": "fetch_failure"}


def event_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """(event_id, event_at, canonical_url, event_type, status) from Parquet files."""
    reader = spark.readStream.schema(EVENTS)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    raw = reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in KINDS.items()))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("ok")
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("event_at"), F.col("user_id").alias("canonical_url"), kind.alias("event_type"), status.alias("status"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def windowed_history(events: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Tumbling windows of a stream; a window is final once the watermark passes it."""
    w = F.window("event_at", f"{seconds} seconds")
    return events.withWatermark("event_at", late).groupBy(w.alias("w")).agg(*bucket_counts()).select(F.col("w.start").alias("bucket"), "total", "success", "failed", "discovered", "fetched")


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what its source holds now; its rows as a table in the shared folder.

    With a ``folder`` of its own the stream goes on where its last run ended.  Every
    batch has a part of the table under its number, so a batch that is run again
    replaces what it wrote.
    """
    spark = stream.sparkSession
    base = folder or f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        part = "all" if mode == "complete" else f"batch-{number:09d}"
        batch.write.mode("overwrite").parquet(f"{base}/rows/{part}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{base}/rows/none")
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{base}/rows")


def history_of_files(spark: SparkSession, path: str, seconds: int = 60) -> DataFrame:
    rows = drained(windowed_history(event_stream(spark, path), seconds), "complete")
    return rows.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


_STATE = "retry_count int, last_status string, next_due double"
_OUT = "canonical_url bigint, last_status string, retry_count int, next_due_at timestamp"


def url_state_machine(events: DataFrame, most_days: int = 30, default_days: int = 7) -> DataFrame:
    """Each url's state after every batch: pending, success or failed, with retries and due time.

    A failure doubles the wait, in hours, up to ``most_days``; a success resets it; a due
    time that passes makes the url pending.  Events of a batch are taken in order, each
    id once, so a repeated delivery within it changes nothing.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        retries, status, due = state.get if state.exists else (0, "pending", 0.0)
        if state.hasTimedOut:
            status = "pending"
        else:
            rows = pd.concat(list(batches)).drop_duplicates("event_id").sort_values(["event_at", "event_id"])
            for at, kind, how in zip(rows["event_at"], rows["event_type"], rows["status"]):
                now = at.timestamp()
                if how == "failed":
                    retries, status = retries + 1, "failed"
                    due = now + 3600 * min(2.0 ** (min(retries, 40) - 1), most_days * 24.0)
                elif kind in ("fetch_success", "cache_hit"):
                    retries, status, due = 0, "success", now + 86400 * default_days
        state.update((retries, status, due))
        if status != "pending" and due * 1000 > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(int(due * 1000))
        yield pd.DataFrame({"canonical_url": [key[0]], "last_status": [status], "retry_count": [retries], "next_due_at": [pd.Timestamp(round(due * 1e6), unit="us")]})

    return events.withWatermark("event_at", "1 hour").groupBy("canonical_url").applyInPandasWithState(advance, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


def url_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("canonical_url").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failures"), F.max("event_at").alias("last_event"))


def url_states_of_files(spark: SparkSession, path: str) -> DataFrame:
    rows = drained(url_counters(event_stream(spark, path)), "complete")
    return rows.withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))
